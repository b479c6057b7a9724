"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into ``SEGMENTS`` segments. Two fingerprints at ``DISTANCE`` or fewer differing bits agree up to
``DISTANCE // SEGMENTS`` bits (one bit) in some segment, so each fingerprint is listed in one table a segment under its segment
value, and looks up the Hamming ball of radius one around its own values there. Of a pair that differs in one bit of the segment, only the
one with the 0 bit flips it, and of an equal pair the smaller one asks, so a table match is met once; a match is verified on the complete distance.

Equal fingerprints are one node from the start: copies never become pairs. Groups of near copies, whose fingerprints crowd into
the same table entries, are drawn together first: each fingerprint is linked to its next few neighbours in the order of every
table entry, and the components of these links are found. The full look-up then asks only for links between different such
components, so it returns few rows from a dense group, yet no component is missed. Where an entry is crowded, most of its fingerprints
are of one component by then: these look only at the entry's others, so a crowd isn't compared with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.operators.cluster import components

from .common import discard, sized, spare, table, written

SHINGLE_WORDS, SEED, DISTANCE, SEGMENTS = 4, 42, 4, 3
#: Neighbours in the order of a table entry that are compared first.
NEAR = 3
#: Fingerprints in a table entry from which its largest component is set apart.
CROWD = 200


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of A-Z lower-cased UTF-8 text over shingles of ``words`` words between ASCII white space; 0 without words."""
    w = text.lower().split()  # of bytes: only A-Z change, only ASCII white space parts words
    if not w:
        return 0
    joined, ends = b" ".join(w), np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    k = min(words, len(w))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(w) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, fp)`` for every row; a null text has no words. ``key`` digests id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py().encode()) if t.is_valid else 0 for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["id", "key", "fp"])

    src = docs.select(F.col(id_col).alias("id"), _key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, key string, fp long")


def _key(id_col: str, text_col: str) -> Column:
    return F.md5(F.encode(F.concat_ws("\u0000", F.coalesce(F.col(id_col).cast("string"), F.lit("\u0001")), F.coalesce(F.col(text_col), F.lit("\u0001"))), "utf-8"))


def _bounds(segments: int) -> list[tuple[int, int]]:
    at = [64 * i // segments for i in range(segments + 1)]
    return list(zip(at, at[1:]))


def _mask(lo: int, hi: int) -> int:
    m = ((1 << (hi - lo)) - 1) << lo
    return m - (1 << 64) if m >> 63 else m


def _value(fp: Column, lo: int, hi: int) -> Column:
    return F.shiftrightunsigned(fp.bitwiseAND(F.lit(_mask(lo, hi)).cast("long")), lo)


def tables(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """``(seg, val, ...)``: each row of ``fps`` once a segment."""
    rows = F.array(*[F.struct(F.lit(s).alias("seg"), _value(F.col("fp"), lo, hi).alias("val")) for s, (lo, hi) in enumerate(_bounds(segments))])
    return fps.select("*", F.explode(rows).alias("e")).select("*", "e.seg", "e.val").drop("e")


def balls(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """``(seg, val, same, ...)``: the look-ups of radius one; ``same`` marks a fingerprint's own value."""
    own = [F.struct(F.lit(s).alias("seg"), _value(F.col("fp"), lo, hi).alias("val"), F.lit(True).alias("same")) for s, (lo, hi) in enumerate(_bounds(segments))]
    flip = [
        F.when(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long")) == 0, F.struct(F.lit(s).alias("seg"), (_value(F.col("fp"), lo, hi) + F.lit(1 << (b - lo)).cast("long")).alias("val"), F.lit(False).alias("same")))
        for s, (lo, hi) in enumerate(_bounds(segments))
        for b in range(lo, hi)
    ]
    return fps.select("*", F.explode(F.array_compact(F.array(*own, *flip))).alias("e")).select("*", "e.seg", "e.val", "e.same").drop("e")


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def crowds(fps: DataFrame, segments: int = SEGMENTS, least: int = CROWD) -> DataFrame:
    """``(seg, val, most)``: the component with most fingerprints in each table entry of more than ``least``."""
    each = tables(fps, segments).groupBy("seg", "val", "comp").agg(F.count("*").alias("n"))
    return each.groupBy("seg", "val").agg(F.sum("n").alias("all"), F.max_by("comp", F.struct("n", "comp")).alias("most")).where(F.col("all") > least).select("seg", "val", "most")


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """``(a, b)``: pairs of ``fps`` (columns ``fp``, ``comp``) at ``distance`` or fewer bits whose ``comp`` differ, each at one table at most.

    The fingerprints of a crowded entry are cut in two: those of its largest component (``other`` false) and the others. A look-up from that component needs only the others.
    """
    if distance // segments > 1:
        raise ValueError("balls of radius one need distance < 2 * segments")
    crowd = sized(written(crowds(fps, segments), "op9-crowds"), "merge")
    lone = F.coalesce(F.col("comp") != F.col("most"), F.lit(False))
    have = tables(fps, segments).join(crowd, ["seg", "val"], "left").select(F.col("fp").alias("b"), F.col("comp").alias("cb"), "seg", "val", lone.alias("other"))
    no, yes = F.lit(False), F.lit(True)
    sides = F.when(F.col("most").isNull(), F.array(no)).when(lone, F.array(no, yes)).otherwise(F.array(yes))
    ask = balls(fps, segments).join(crowd, ["seg", "val"], "left").select(F.col("fp").alias("a"), F.col("comp").alias("ca"), "seg", "val", "same", F.explode(sides).alias("other"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    cond = (ask["seg"] == have["seg"]) & (ask["val"] == have["val"]) & (ask["other"] == have["other"]) & (F.col("ca") != F.col("cb")) & (_apart(F.col("a"), F.col("b")) <= distance) & (~F.col("same") | (F.col("a") < F.col("b")))
    seg = ask["seg"]
    for s, (lo, hi) in enumerate(_bounds(segments)[:-1]):
        cond &= (seg <= s) | (F.bit_count(x.bitwiseAND(F.lit(_mask(lo, hi)).cast("long"))) > 1)
    return ask.join(have.hint("merge"), cond).select("a", "b")


def neighbour_links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, near: int = NEAR) -> DataFrame:
    """``(a, b)``: links between a fingerprint and its next ``near`` ones in the order of each table entry: no pairs, a constant number of looks a row.

    Entries are dealt by ranges of (entry, fingerprint), so a crowded one is cut; a link across a cut is left to :func:`links`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)
        for batch in batches:
            x = np.concatenate((held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)))
            out = []
            for k in range(1, near + 1):
                a, b = x[:-k], x[k:]
                fresh = np.arange(k, len(x)) >= len(held)
                ok = fresh & (a[:, 0] == b[:, 0]) & (a[:, 1] == b[:, 1]) & (np.bitwise_count((a[:, 2] ^ b[:, 2]).view(np.uint64)) <= distance)
                out.append(np.stack((a[ok, 2], b[ok, 2]), axis=1))
            got, held = np.concatenate(out), x[-near:]
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tables(fps, segments).select("seg", "val", "fp").repartitionByRange(parts, "seg", "val", "fp").sortWithinPartitions("seg", "val", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _joined(fps: DataFrame, comps: DataFrame) -> DataFrame:
    """``fps`` with ``comp`` moved to that of ``comps`` where it has the node."""
    c = comps.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return fps.join(c.hint("merge"), "comp", "left").select("fp", F.coalesce("to", "comp").alias("comp"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, distance: int, segments: int) -> DataFrame:
    """``(id, key, fp, component_id)`` for every row of ``docs``."""
    rows = written(fingerprints(docs, id_col, text_col), "op9-fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "op9-classes")
    nodes = classes.select("fp", F.col("fp").alias("comp"))
    near = written(_joined(nodes, components(neighbour_links(classes.select("fp"), distance, segments))), "op9-near")
    far = links(near, distance, segments)
    moved = far.join(near.select(F.col("fp").alias("a"), F.col("comp").alias("ca")).hint("merge"), "a").join(near.select(F.col("fp").alias("b"), F.col("comp").alias("cb")).hint("merge"), "b")
    last = written(_joined(near, components(moved.select(F.col("ca").alias("a"), F.col("cb").alias("b")))), "op9-last")
    # written apart, so that neither join needs a component's fingerprints in one task
    least = written(last.join(classes.hint("merge"), "fp").groupBy("comp").agg(F.min("least").alias("component_id")), "op9-names")
    known = written(last.join(sized(least, "merge"), "comp").select("fp", "comp", "component_id"), "op9-components")
    discard(near, last, least, classes)
    return rows.join(known.hint("merge"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """``(id_col, fp, component_id)`` for every row of ``docs``: the smallest id reachable over links of ``distance`` or fewer bits.

    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows give repeated rows. Null ids never
    name a component unless it has no other. Other columns are ignored. An empty table gives an empty result.
    """
    return _grouped(docs, id_col, text_col, distance, segments).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id, null ids last.

    Of several rows with that id one text stays, the same whenever the same rows are given; of exact repeats of that row one stays. Columns stay, whatever
    their names. Null, empty and blank texts are one group. An empty table gives an empty result.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("w")
    group = _grouped(docs, id_col, text_col, DISTANCE, SEGMENTS)
    best = written(group.groupBy("comp").agg(first).select("w.key"), "op9-kept")
    again = written(group.groupBy("key").count().where("count > 1").select("key"), "op9-repeats")
    once, more = best.join(again.hint("merge"), "key", "left_anti"), best.join(again.hint("merge"), "key", "left_semi")
    key = spare("doc_key", docs)
    keyed = docs.withColumn(key, _key(id_col, text_col))
    kept = keyed.join(once.select(F.col("key").alias(key)).hint("shuffle_hash"), key, "left_semi")
    repeated = keyed.join(sized(more.select(F.col("key").alias(key))), key, "left_semi").dropDuplicates([key])
    return kept.unionByName(repeated).select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
