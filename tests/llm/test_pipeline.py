"""The pipeline's stages on a few rows: each decision takes effect."""

import corpus_pipeline
from seqspark.llm import secret_scan


def test_stages(spark, tmp_path):
    body = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    passage = " ".join(f"bench{i}" for i in range(20))
    rows = [(i, body(i)) for i in range(40)]
    rows += [(100, body(1)), (101, f"{passage} tail"), (102, body(102) + ' token = "abcdef0123456789abcdef0123456789"'), (103, None), (104, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "benchmark", "secrets", "packing"]
    kept = []
    for n, f in corpus_pipeline.STAGES:
        out = f(spark, out, d)
        out.write.parquet(f"{d}/{n}")
        out = spark.read.parquet(f"{d}/{n}")
        if n != "packing":
            assert out.columns == docs.columns
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
    everyone = {i for i, _ in rows}
    assert kept[0] == everyone and kept[1] == everyone - {100, 104} and kept[2] == kept[1] - {101} and kept[3] == kept[2] == kept[4]
    secret = spark.read.parquet(f"{d}/secrets")
    assert secret_scan.scan(secret).where("size(spans) > 0").count() == 0
    assert secret.where("doc_id = 102").first().n_chars == len(secret.where("doc_id = 102").first().text)
    assert secret.where("doc_id = 1").first().text == body(1)
    assert spark.read.parquet(f"{d}/packing").where("length > 2048").count() == 0
