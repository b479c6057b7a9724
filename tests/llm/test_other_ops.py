"""Operators 2, 4, 6 and 10 on small rows."""

import json
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from seqspark.llm import ann, common, pii, tool_calls, url_filter
from seqspark.operators import stages


def brute_url(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_url_rules(spark):
    rules = [*url_filter.RULES, ("example.org", "/", "block"), ("a.example.org", "/en/1/x", "allow"), ("org", "/es/es/es/es/es", "block"), ("com", "", "block"), ("xample.org", "/", "block"), ("é.net", "/ü", "block")]
    urls = [
        None, "", "no scheme", "http://", "http://Example.ORG/es/1?q#f", "https://www.example.org/en/12", "http://a.example.org/en/1/xy", "x://org", "x://org/", "http://b.org#/es/", "http://notexample.org/es/",
        "http://z.com", "http://z.com/fr/", "http://z.com/de/?a://b/c", "://com/de/é", "http://org/es/es/es/es/es/s", "http://k.é.net/üx", "http://é.net/u", "http://a..com/fr/", "http://example.org./es/", "http://q.net/fr/",
    ]
    df = spark.createDataFrame([(i if i else None, u, "x", "y") for i, u in enumerate(urls)] + [(5, urls[5], "x", "y")], "page_id long, url string, host string, verdict string")
    got = url_filter.judge_urls(df, spark.createDataFrame(rules, url_filter.RULES_SCHEMA), ranges=3).collect()
    want = [(i if i else None, *brute_url(u, rules)) for i, u in enumerate(urls)] + [(5, *brute_url(urls[5], rules))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    none = spark.createDataFrame([], url_filter.RULES_SCHEMA)
    assert {r.verdict for r in url_filter.judge_urls(df, none, default="block").collect()} == {"block"}
    assert url_filter.judge_urls(df.limit(0), none).count() == 0


def test_open_intervals(spark):
    """Nested prefixes cut into many ranges: every stack is the set of prefixes, whichever range a point is in."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("ab"), rng.integers(1, 8)))
    prefixes, points = sorted({word() for _ in range(60)}), sorted({word() + word() for _ in range(300)})
    iv = spark.createDataFrame([(x.encode(), x) for x in prefixes], "key binary, rule string")
    pt = spark.createDataFrame([(x.encode(), x) for x in points], "key binary, point string")
    want = {x: sorted(p for p in prefixes if x.startswith(p)) for x in points}
    for ranges in (1, 7, 40):
        got = {}
        for r in url_filter.open_intervals(pt, iv, True, ranges).collect():
            got.setdefault(r.point, []).append(r.rule)
        assert {x: sorted(v) for x, v in got.items()} == {x: v for x, v in want.items() if v}
        top = {r.point: r.rule for r in url_filter.open_intervals(pt, iv, False, ranges).collect()}
        assert top == {x: max(v, key=len) for x, v in want.items() if v}


def test_url_rules_at_random(spark):
    rng = np.random.default_rng(6)
    host = lambda: ".".join(rng.choice(["a", "b", "org"], rng.integers(1, 6)))
    path = lambda: "".join(rng.choice(["/", "x", "yy"], rng.integers(0, 6)))
    rules = [(host(), path(), str(rng.choice(["allow", "block"]))) for _ in range(80)]
    rules = list({(h, p): (h, p, max(v for a, b, v in rules if (a, b) == (h, p))) for h, p, _ in rules}.values())
    urls = [f"http://{host()}{path()}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = sorted(map(tuple, url_filter.judge_urls(df, spark.createDataFrame([*rules, (None, "/", "block"), ("org", None, "block")], url_filter.RULES_SCHEMA), ranges=5).collect()))
    assert got == [(i, *brute_url(u, rules)) for i, u in enumerate(urls)]


def brute_near(rows, k):
    ok = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in ok:
        if q % 5 == 0:
            out[q] = sorted(((-float(ok[q] @ v), i) for i, v in ok.items() if i != q))[:k]
    return out


def test_ann_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    vecs = centres[rng.integers(0, 12, 3000)] + 0.4 * rng.standard_normal((3000, 16))
    vecs[::7] *= 3
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    df = spark.createDataFrame([*rows, (None, [1.0] * 16), (9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0]), (9005, [None] * 16), (9006, [float("inf")] * 16)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("id") % 5 == 0, 10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute_near(rows, 10)
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    hits = np.mean([len({i for _, i in want[q]} & {i for i, _ in got[q].values()}) / 10 for q in want])
    assert hits >= 0.9
    for q in list(want)[:50]:
        for i, s in got[q].values():
            assert i != q and abs(s - float(vecs[q] @ vecs[i])) < 1e-9
        assert [s for _, s in (got[q][k] for k in range(1, 11))] == sorted((s for _, s in got[q].values()), reverse=True)


def test_ann_small_and_blocks(spark, monkeypatch):
    one = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(one, F.col("id") == 0, 20).collect()]
    assert sorted(got)[:2] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(one.limit(0), F.col("id") == 0).count() == 0
    monkeypatch.setattr(ann, "BLOCK", 8)  # one bucket in many parts
    same = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(100)], "vec_id long, embedding array<double>")
    top = {(r.query_id, r.vec_id) for r in ann.nearest(same, F.col("id") == 50, 20).collect()}
    assert top == {(50, i) for i in [x for x in range(100) if x % 3 == 2 and x != 50][:20]}


def exact_near(v, ids, queries, k):
    """All pairs, summed component by component; ties to the smaller id."""
    out = {}
    for q in queries:
        s = np.zeros(len(v))
        for j in range(v.shape[1]):
            s += v[ids.index(q), j] * v[:, j]
        best = {}
        for i, x in zip(ids, s.tolist()):
            if i != q:
                best[i] = max(best.get(i, x), x)
        out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def test_ann_ties_are_exact(spark, monkeypatch):
    """Half of the vectors are one vector of random doubles: its queries get the smallest ids, whichever parts they meet in."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((3000, 16))
    v[:1500] = v[0]
    order = rng.permutation(3000)
    v, one = v[order], set(np.flatnonzero(order < 1500).tolist())
    df = spark.createDataFrame([(i, x.tolist(), 1.0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, score double")
    for block in (ann.BLOCK, 4096):
        monkeypatch.setattr(ann, "BLOCK", block)
        got = {}
        for r in ann.nearest(df, F.col("id") % 20 == 0, 20).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        asked = [q for q in range(0, 3000, 20) if q in one]
        want = exact_near(v, list(range(3000)), asked, 20)
        assert len(got) == 150 and all([(i, s) for _, i, s in sorted(got[q])] == want[q] for q in asked)


def test_ann_repeated_ids(spark):
    """An id on a hundred vectors is one answer, and others aren't crowded out."""
    rng = np.random.default_rng(4)
    v = np.concatenate([np.ones((100, 4)) + 0.01 * rng.standard_normal((100, 4)), rng.standard_normal((60, 4))])
    ids = [7] * 100 + list(range(100, 160))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("id") == 100, 59).collect())
    assert [(i, s) for _, i, s in got] == exact_near(v, ids, [100], 59)[100]


CALLS = "conv long, id string, turn long, name string, arguments string, deps array<string>"


def test_tool_calls(spark):
    ok = '{"limit": 3.0, "query": "é"}'
    calls = [
        (1, "a", 1, "search", '{"query": "x", "limit": 3}', []), (1, "b", 3, "search", ok, ["a", "gone"]), (1, "c", 2, "search", '{"query": "x"}', ["b"]), (1, "d", 5, "nope", "{}", []), (1, "e", 6, "lookup", "not json", []),
        (1, "f", 7, "lookup", '{"query": "x", "lang": "xx"}', ["g"]), (1, "g", 8, "lookup", '{"query": "x"}', ["f"]), (1, "h", 9, "lookup", '{"query": "x"}', ["h"]), (1, "i", 10, "count", '{"query": "x", "exact": 1}', ["g"]),
        (2, "a", 1, "lookup", None, None), (None, "a", 1, "lookup", '{"query": "z", "lang": null}', []), (1, None, 4, "lookup", "{}", []), (1, "a", 9, "nope", "{}", []),
    ]
    results = [(1, "a", 4, "r1"), (1, "a", 2, "r0"), (1, "z", 3, "lost"), (1, "c", 3, None), (3, None, 1, "x")]
    out = tool_calls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv long, id string, turn long, content string"))
    got = {(r.conv, r.id): r for r in out.collect()}
    assert len(got) == out.count() == 12
    status = {k: r.status for k, r in got.items()}
    assert status == {
        ("1", "a"): "ok", ("1", "b"): "invalid", ("1", "c"): "invalid", ("1", "d"): "invalid", ("1", "e"): "invalid", ("1", "f"): "cycle", ("1", "g"): "cycle", ("1", "h"): "cycle", ("1", "i"): "cycle",
        ("2", "a"): "invalid", ("", "a"): "invalid", ("1", "z"): "orphan_result",
    }
    assert [got["1", x].level for x in "abcdfh"] == [0, 1, 2, 0, None, None]
    assert got["1", "a"].json == '{"arguments":{"limit":3,"query":"x"},"content":"r0","id":"a","name":"search","status":"ok"}'
    assert json.loads(got["1", "b"].json)["arguments"] == {"limit": 3, "query": "é"} and "é" in got["1", "b"].json
    empty = tool_calls.link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], "conv long, id string, turn long, content string"))
    assert empty.count() == 0


def brute_levels(edges):
    """Longest distance to a call that waits for none; None in or behind a cycle."""
    deps = {}
    for i, d in edges:
        deps.setdefault(i, set()).add(d)
    level = {d: 0 for _, d in edges if d not in deps}
    while True:
        ready = {i: 1 + max(level[d] for d in ds) for i, ds in deps.items() if i not in level and all(d in level for d in ds)}
        if not ready:
            return {i: level.get(i) for i in deps}
        level |= ready


def test_levels(spark):
    """Random graphs with cycles, and a chain of a hundred calls with side branches."""
    rng = np.random.default_rng(7)
    for n, m in ((12, 14), (30, 30), (40, 90)):
        edges = {(f"c{a}", f"c{b}") for a, b in rng.integers(0, n, (m, 2)).tolist()}
        edges |= {(f"d{a}", f"d{b}") for a, b in rng.integers(0, n, (m, 2)).tolist() if a > b}
        got = tool_calls.levels(spark.createDataFrame([("x", a, b) for a, b in edges], "conv string, id string, dep string")).collect()
        assert {r.id: r.level for r in got} == brute_levels(edges) and len(got) == len({a for a, _ in edges})
    chain = {(f"c{i}", f"c{i - 1}") for i in range(1, 101)} | {("c60", "s5"), ("c90", "c10")} | {(f"s{i}", f"s{i - 1}") for i in range(1, 6)}
    got = tool_calls.levels(spark.createDataFrame([("x", a, b) for a, b in chain], "conv string, id string, dep string")).collect()
    assert {r.id: r.level for r in got} == brute_levels(chain)


def test_arguments_of_any_shape(spark):
    """Lone surrogates are escaped, deep nesting is invalid, and both are rows."""
    deep = "[" * 100_000 + "]" * 100_000
    nested = '{"query": ' + '{"a":' * 3000 + "1" + "}" * 3000 + "}"
    args = ['{"query": "\\ud800 x"}', '{"\\udfff": 1}', deep, nested, '{"query": 1e999}', "NaN", '{"query": "' + "y" * 300_000 + '"}', "7" * 5000]
    calls = spark.createDataFrame([("c", f"i{n}", n, "lookup", a, None) for n, a in enumerate(args)], CALLS.replace("conv long", "conv string"))
    out = {r.id: r for r in tool_calls.link_calls(calls, spark.createDataFrame([], "conv string, id string, turn long, content string")).collect()}
    assert len(out) == len(args) and [out[f"i{n}"].status for n in range(8)] == ["pending", "invalid", "invalid", "invalid", "invalid", "invalid", "pending", "invalid"]
    assert "\\ud800 x" in out["i0"].json and json.loads(out["i0"].json)["arguments"] == {"query": "\ud800 x"}
    assert out["i2"].problem == "arguments nest too deep" and json.loads(out["i2"].json)["arguments"] == deep


def test_turns_of_the_smallest_tables(spark):
    """The registered query against a plain reading of every conversation."""
    d = "/root/testdata/sf0.001"
    turns = [r.asDict() for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    calls, results = {}, {}
    for t in turns:
        if t["role"] == "assistant":
            calls.setdefault((t["conv_id"], t["turn"]), []).append(t)
        elif t["role"] == "user":
            results.setdefault((t["conv_id"], t["turn"] - 1), []).append(t)
    got = tool_calls.op4_tool_calls(spark, d).collect()
    linked = {(int(r.conv), r.call_turn): r for r in got if r.call_turn is not None and r.status not in ("duplicate", "no_id")}
    assert len(turns) == len(got) + sum(k in results for k in calls)
    assert linked.keys() == calls.keys()
    for k, r in linked.items():
        text = min(t["text"] or "" for t in calls[k])
        body, pick = json.loads(r.json), zlib.crc32(text.encode())
        assert body["arguments"]["query"] == text and body["id"] == f"call-{k[0]}-{k[1]}" and r.json == tool_calls.canonical(body)
        assert r["name"] == ["search", "lookup", "count"][pick % 3]
        wants = {"query": text, "lang": "en"} if pick % 3 == 1 else {"query": text, "limit": str(len(text)) if pick % 7 == 0 else len(text)}
        assert body["arguments"] == wants
        ok = pick % 3 == 1 or pick % 7
        assert r.status == ("ok" if k in results else "pending") if ok else r.status == "invalid"
        waits, n = k, 0
        while zlib.crc32(min(t["text"] or "" for t in calls[waits]).encode()) % 9 < 3 and (waits[0], waits[1] - 2) in calls:
            waits, n = (waits[0], waits[1] - 2), n + 1
        assert r.level == n and body["content"] == (min(t["text"] for t in results[k]) if k in results else None)


TURNS = "conv_id long, turn long, role string, text string"


def test_whole_turns_are_formatted(spark):
    texts = ['Über "alles" \\ zwei\nZeilen', "Привет мир", None, "plain words here", "a\tb\u0001 😀"]
    rows = [(1, 0, "system", "be ü")] + [(1, i + 1, "assistant", t) for i, t in enumerate(texts)] + [(1, 9, None, "who"), (2, 0, "system", None), (2, 1, "user", "hi")]
    got = tool_calls.format_turns(spark.createDataFrame(rows, TURNS)).collect()
    calls = {r.call_turn: json.loads(r.json) for r in got if r.call_turn is not None}
    assert [calls[i + 1]["arguments"]["query"] for i in range(len(texts))] == [t or "" for t in texts]
    said = sorted((r.conv, r.result_turn, r["name"], json.loads(r.json)["content"]) for r in got if r.status == "message" and r["name"])
    assert said == [("1", 0, "system", "be ü"), ("2", 0, "system", None)] and [json.loads(r.json)["content"] for r in got if r.status == "message" and not r["name"]] == ["who"]
    assert len(got) == len(rows) and [r.status for r in got if r.conv == "2" and r["name"] is None] == ["orphan_result"]


def test_no_call_is_lost(spark):
    calls = [(1, "a", 1, "lookup", '{"query": "x"}', []), (1, "a", 1, "lookup", '{"query": "x"}', []), (1, "a", 5, "nope", None, None), (1, "a", None, "lookup", '{"query": "n"}', []), (1, None, 4, "lookup", '{"query": "q"}', []), (1, None, 4, "lookup", '{"query": "q"}', [])]
    results = [(1, "a", 2, "r0"), (1, "a", 3, "r1"), (1, "a", 3, "r1"), (1, None, 7, "lost"), (None, None, None, None)]
    out = tool_calls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv long, id string, turn long, content string"), whole=True).collect()
    got = sorted((r.status, r.call_turn or 0, r.result_turn or 0) for r in out)
    assert len(out) == len(calls) + len(results) - 1  # one call and one result share a row
    assert [g for g in got if g[0] == "duplicate"] == [("duplicate", 0, 3), ("duplicate", 0, 3), ("duplicate", 1, 0), ("duplicate", 1, 0), ("duplicate", 5, 0)]
    assert [g for g in got if g[0] == "no_id"] == [("no_id", 0, 0), ("no_id", 0, 7), ("no_id", 4, 0), ("no_id", 4, 0)]
    turns = [(None, 1, "assistant", "one"), (None, 1, "assistant", "two"), (None, 1, "assistant", "two"), (5, None, "assistant", "x"), (5, None, "user", "y"), (None, 2, "user", "u"), (6, 1, "assistant", "z"), (6, 1, "assistant", "zz"), (6, 2, "user", "r")]
    got = tool_calls.format_turns(spark.createDataFrame(turns, TURNS)).collect()
    said = [t for r in got for t in ((json.loads(r.json)["arguments"] or {}).get("query"), json.loads(r.json)["content"]) if t]
    assert sorted(said) == sorted(t[3] for t in turns) and sum(r.status == "no_id" for r in got) == 6 and sum(r.status == "duplicate" for r in got) == 1


def test_null_and_empty_conversations_differ(spark):
    calls = spark.createDataFrame([("", "a", 1, "lookup", '{"query": "x"}', []), (None, "a", 2, "lookup", '{"query": "y"}', [])], CALLS.replace("conv long", "conv string"))
    out = tool_calls.link_calls(calls, spark.createDataFrame([(None, "a", 3, "r")], "conv string, id string, turn long, content string")).collect()
    assert sorted((r.conv, r.call_turn, r.status) for r in out) == [("", 1, "pending"), ("", 2, "ok")]


def test_pii(spark):
    texts = [
        None, "", "nothing here 1.2.3 and 12345", "mail bos.42@mail8.example.com or BOS.42@MAIL8.EXAMPLE.COM now", "call +1 (988) 555-2485, +1 988 555 2485.", "4539578763621486 4539-5787-6362-1486 and 1234567890123456",
        "at 42.144.35.254 and 42.144.35.253", "Mr Smith met Mrs. Jane Smith and Mr. Smith; Frau Müller", "Г-жа Анна Петрова и Г-н Петров", "+1 (269) 555-3296 4524132264652876", "é 😀 x@y.zz é",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")], "doc_id long, text string, entities string")
    out = pii.pseudonymise(df, "k1")
    got = {r.doc_id: (r.text, r.entities) for r in out.collect()}
    assert out.count() == len(texts) + 1 and set(out.columns) == {"doc_id", "text", "entities"}
    assert got[0] == (None, {}) and got[1] == ("", {}) and got[2] == (texts[2], {})
    a, b = re.findall(r"\S+@\S+", got[3][0])
    assert a.upper() == b and a != b and re.fullmatch(r"[a-z]{3}\.\d\d@d[0-9a-f]{8}\.example", a) and got[3][1] == {"email": 2}
    p, q = re.findall(r"\+1 [\d() -]*\d", got[4][0])
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q) != "19885552485" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", p)
    c1, c2, c3 = re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", got[5][0])
    luhn = lambda s: sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(s)) % 10
    assert c1 == c2.replace("-", "") != "4539578763621486" and c1[0] == "4" and luhn(c1) == 0 == luhn("4539578763621486") and c3[0] == "1" and c3 != c1
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", got[6][0])
    assert len(set(ips)) == 2 and not set(ips) & {"42.144.35.254", "42.144.35.253"} and all(0 < int(x) < 255 for i in ips for x in i.split("."))
    names = re.fullmatch(r"Mr (\w+) met Mrs\. (\w+) (\w+) and Mr\. (\w+); Frau (\w+)", got[7][0])
    assert names and names[1] == names[4] != "Smith" and names[2] in pii.GIVEN["latin", "f"] and names[5] in pii.FAMILY["latin", "f"]
    cyr = re.fullmatch(r"Г-жа (\w+) (\w+) и Г-н (\w+)", got[8][0])
    assert cyr and cyr[1] in pii.GIVEN["cyrillic", "f"] and cyr[3] in pii.FAMILY["cyrillic", "m"]
    assert got[9][1] == {"phone": 1, "card": 1} and re.fullmatch(r"é 😀 [a-z]@d[0-9a-f]{8}\.example é", got[10][0])
    assert {r.doc_id: r.text for r in pii.pseudonymise(df, "k1").collect()} == {k: v[0] for k, v in got.items()}
    assert pii.pseudonymise(df, "k2").where("doc_id = 6").first().text != got[6][0]
    assert pii.pseudonymise(df.limit(0), "k").count() == 0


def test_surrogates_are_distinct(spark):
    """More people than names of one part: clashes are settled in later rounds."""
    people = spark.createDataFrame([("person", f"m|Name{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijklmnopqrstuvwxyz'[i // 26]}") for i in range(120)] + [("person", "m|Abbott")], "kind string, ident string")
    got = pii.assign(people, "k").collect()
    assert len(got) == 121 == len({r.new for r in got}) and not {r.new for r in got} & {r.ident for r in got}


def test_surrogates_of_a_full_space(spark):
    """Every five-digit number with a leading 1 and every one-letter mailbox of a domain is a real entity: wider candidates serve them all."""
    rows = [("phone", f"{i:05d}") for i in range(10000, 20000)] + [("email", f"{c}@d.com") for c in "abcdefghijklmnopqrstuvwxyz"]
    got = pii.assign(spark.createDataFrame(rows, "kind string, ident string"), "k").collect()
    assert sorted((r.kind, r.ident) for r in got) == sorted(rows)
    assert len({(r.kind, r.new) for r in got}) == len(rows) and not {(r.kind, r.new) for r in got} & set(rows)
    assert all(re.fullmatch(r"1\d{4,9}|[a-z]+@d[0-9a-f]{8}\.example", r.new) for r in got)


def test_coreference(spark):
    """Against a plain reading of each text: one replacement an entity everywhere, none shared, a surname alone goes with the only full name that fits."""
    texts = [
        "Mr Smith met Mr. John Smith and Mrs Smith", "John Smith and Mary Smith saw Dr Smith, Mr Smith", "Dr Jones. Prof. Anna Jones", "Jürgen von Berg, Herr von Berg",
        "call +49 30 1234567, 0049 30 1234567 or +49 (0)30 1234567; +44 20 7946 0958", "+1 743 555 3824, 1-743-555-3824", "no card 1234567890123456 but 4539578763621486",
    ]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], "i int, text string, text_key string, found string, put string")
    out = pii.pseudonymise(df, "k").orderBy("i").collect()
    assert out[0].asDict().keys() == {*df.columns, "entities"} and {(r.text_key, r.found, r.put) for r in out} == {("a", "b", "c")}
    got = [r.text for r in out]
    a = re.fullmatch(r"Mr ([\w-]+) met Mr\. (\w+) ([\w-]+) and Mrs ([\w-]+)", got[0])
    assert a[1] == a[3] != a[4]
    b = re.fullmatch(r"(\w+) ([\w-]+) and (\w+) ([\w-]+) saw Dr ([\w-]+), Mr ([\w-]+)", got[1])
    assert (b[1], b[2]) == (a[2], a[3]) and b[6] == b[2] and b[5] not in (b[2], b[4])
    c = re.fullmatch(r"Dr ([\w-]+)\. Prof\. (\w+) ([\w-]+)", got[2])
    assert c[1] == c[3] and c[2] in pii.GIVEN["latin", "f"]
    d = re.fullmatch(r"(\w+) ([\w-]+), Herr ([\w-]+)", got[3])
    assert d[2] == d[3]
    p = re.findall(r"\+?\d[\d ()-]+\d", got[4])
    n = [re.sub(r"\D", "", x.replace("(0)", "")) for x in p]
    assert n[0] == n[1][2:] == n[2] and n[0][:2] == "49" and n[3][:2] == "44" and "(0)" in p[2] and p[1].startswith("00")
    q = re.findall(r"[+\d][\d -]+\d", got[5])
    assert len({re.sub(r"\D", "", x) for x in q}) == 1 and q[0].startswith("+1 ")
    assert "1234567890123456" in got[6] and "4539578763621486" not in got[6] and out[6].entities == {"card": 1}


def test_pii_by_shuffle(spark, monkeypatch):
    """A much copied text, with the replacements too large to broadcast: the same rows."""
    rows = [(i, "write to a.b@c.org or Mr Smith", "x") for i in range(400)] + [(i, f"mail u{i}@c.org", None) for i in range(400, 460)] + [(460, None, None), (461, "", None)]
    df = spark.createDataFrame(rows, "i int, text string, other string").repartition(4)
    plain = sorted((r.i, r.text or "", str(r.entities)) for r in pii.pseudonymise(df, "k").collect())
    monkeypatch.setattr(stages, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    assert sorted((r.i, r.text or "", str(r.entities)) for r in pii.pseudonymise(df, "k").collect()) == plain and len(plain) == 462


def test_pii_forms(spark):
    """Each form is one entity, replaced as a whole; what only looks like one stays."""
    forms = {
        "phone": ["+14155552671", "+442079460958", "+1 415 5552671", "+49 30 1234567", "+33 1 23 45 67 89", "(743) 555-3824", "743-555-3824", "743.555.3824", "743 555 3824", "1-743-555-3824", "+49 (0)30 1234567",
                  "(030) 1234567", "030/1234567", "020 7946 0958", "01 23 45 67 89", "0049 30 1234567", "0171-1234567", "01632 960123", "+1 (988) 555-2485"],
        "card": ["3782 822463 10005", "3782-822463-10005", "378282246310005", "4539 5787 6362 1486"],
        "person": ["Mr O'Brien", "Mr O’Brien", "Mrs McDonald", "Frau Mueller-X", "Dr Weber", "Prof. Dr. Anna Weber", "Frau Dr. Weber", "Mr. J. R. Smith", "Señor de la Cruz", "Herr von Berg", "Mme D'Angelo", "Mr John F. Kennedy", "Miss Anne-Marie Smith-Jones"],
    }
    rows = [(k, x) for k, xs in forms.items() for x in xs]
    got = pii.pseudonymise(spark.createDataFrame([(i, f"so {x}, then") for i, (_, x) in enumerate(rows)], "i long, text string"), "k").collect()
    assert len(got) == len(rows)
    for r in got:
        kind, x = rows[r.i]
        assert r.entities == {kind: 1}, (x, r)
        new = r.text.removeprefix("so ").removesuffix(", then")
        assert new != x and not set(re.findall(r"[\w'’-]{4,}", x)) - {"Prof", "Frau", "Herr", "Miss", "Señor", "0049"} & set(re.findall(r"[\w'’-]{4,}", new)), (x, new)
        if kind != "person":
            assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", x)
        elif not re.search(r" \S+ .*\b[A-Z]", x):
            assert re.fullmatch(r"(?:Mr|Mrs|Frau|Dr|Mme|Herr|Señor) (?:Dr\. )?[A-Z][a-z]+(?: [A-Z][a-z]+)?", new), (x, new)
    by = {rows[r.i][1]: r.text.split(" ", 2)[2] for r in got}
    assert by["Mr O'Brien"] == by["Mr O’Brien"]
    plain = ["2003-01-02", "01-02-2003 04", "01/02/2003", "12345 and 1.2.3", "pages (2003) 100-105", "Mr and Dr", "978-3-16-148410-0", "10 000 000", "12-345-67890", "0123456789"]
    assert sorted(((r.text, r.entities) for r in pii.pseudonymise(spark.createDataFrame([(x,) for x in plain], "text string"), "k").collect()), key=str) == sorted(((x, {}) for x in plain), key=str)
    after = spark.createDataFrame([("(743) 555-3824 12 and +1 415 555 2671 4539-5787-6362-1486, Mr Smith's",)], "text string")
    r = pii.pseudonymise(after, "k").first()
    assert r.entities == {"phone": 2, "card": 1, "person": 1} and " 12 and " in r.text and r.text.endswith("'s")
