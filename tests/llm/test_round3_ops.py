"""Exact dedup, filter audit and conversation repair against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from seqspark.llm import conversation_repair as C
from seqspark.llm import exact_dedup as X
from seqspark.llm.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


# exact dedup


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def dedup_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    return sorted((i, max((x for x in groups[lowered(t)] if x is not None), default=None), len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in rows)


def test_chunks_cover_the_text_and_depend_on_content_alone():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    parts = X.chunks(data)
    assert b"".join(parts) == data and max(map(len, parts)) <= X.MOST and min(map(len, parts[:-1])) >= X.LEAST
    moved = X.chunks(b"some other start of a text" * 40 + data)
    assert len(set(parts) & set(moved)) > len(parts) * 0.8  # a shared passage is shared chunks
    assert X.chunks(b"") == [] and X.chunks(b"a") == [b"a"] and b"".join(X.chunks(b"a" * 70_000)) == b"a" * 70_000


def test_marks_do_not_depend_on_slices(monkeypatch):
    data = random.Random(2).randbytes(50_000)
    want = list(X.marks(data))
    monkeypatch.setattr(X, "SLICE", 777)
    assert list(X.marks(data)) == want and want


@pytest.mark.parametrize("bits", [64, 5])
def test_exact_groups_by_hand(spark, bits):
    """Five bits an identifier: chunks collide, and the identifiers are lengthened until they don't."""
    rng = random.Random(3)
    long = ["".join(rng.choice("abc é\n") for _ in range(6000)) for _ in range(3)]
    texts = [None, "", "A", "a", "Ä", "ä", *long, long[0].upper().replace("É", "é"), long[0] + "x", long[1], *(f"text {i}" for i in range(12)), *(["copy"] * 30)]
    rows = list(enumerate(texts, 100)) + [(None, "only null id"), (None, "copy"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = X.exact_groups(df, bits=bits).collect()
    want = [(i, k, n, s) for i, k, n, s in dedup_by_hand([r for r in rows if r[0] is not None] + [])]
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    full = Counter(lowered(t) for _, t in rows)
    assert len(got) == len(rows)
    for i, k, _, s in want:
        r = by[i]
        assert (r.keep_id, r.text_sha256, r.kept) == (k, s, i == k) and r.group_size == full[lowered(dict(rows)[i])]
    alone = next(r for r in got if r.doc_id is None and r.group_size == 1)
    assert alone.keep_id is None and alone.kept


def test_exact_groups_repeats_clashes_and_empty(spark):
    rows = [(7, "same", 1), (7, "same", 2), (3, "SAME", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int").withColumnRenamed("kept", "Text_Key")
    got = X.exact_groups(df).collect()
    assert sum(r.kept for r in got) == 1 and {(r.keep_id, r.group_size) for r in got} == {(7, 3)}
    one = X.keep_one(df)
    assert one.columns == ["doc_id", "text", "Text_Key"] and [(r.doc_id, r.text) for r in one.collect()] == [(7, "same")]
    assert X.exact_groups(df.limit(0)).count() == 0 and X.keep_one(df.limit(0)).count() == 0


def test_recipes_restore_the_texts(spark):
    rng = random.Random(4)
    texts = ["", None, "Short", "".join(rng.choice("abcdef \n") for _ in range(30_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows, width = X.verified_recipes(df)
    back = {r.rid: r.text for r in X.restored(rows, X.chunk_store(df), width).collect()}
    assert {r.id: back[r.rid] for r in rows.collect()} == {i: lowered(t) for i, t in enumerate(texts)}


# conversation repair


def cheapest(rows):
    """All edits of (initial, must delete, open end) with up to three inserts between two rows."""
    best = None

    def go(i, state, cost, text, ins):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and state in (C.START, C.ASSISTANT) and (best is None or (cost, text) < best):
            best = (cost, text)
        ahead = C.ASSISTANT if state == C.USER else C.USER
        if ins < 3:
            go(i, ahead, cost + 2, text + "I", ins + 1)
        if i < len(rows):
            role, delete, open_end = rows[i]
            go(i + 1, state, cost + 3, text + "D", 0)
            if not delete:
                go(i + 1, ahead, cost + 2 + open_end, text + "R", 0)
                if role[:1] == ("a" if ahead == C.ASSISTANT else "u"):
                    go(i + 1, ahead, cost + open_end, text + "K", 0)
                if role[:1] == "s" and state == C.START:
                    go(i + 1, C.SYSTEM, cost + open_end, text + "K", 0)

    go(0, C.START, 0, "", 0)
    return best


def table_of_strings(rows):
    """The same by whole strings a state, for long conversations."""
    best = {C.START: (0, "")}

    def put(to, state, cost, text):
        to[state] = min(to.get(state, (10**9, "")), (cost, text))

    def inserted(best):
        out = dict(best)
        for s in (C.START, C.SYSTEM, C.ASSISTANT):
            if s in best:
                put(out, C.USER, best[s][0] + 2, best[s][1] + "I")
        if C.USER in out:
            put(out, C.ASSISTANT, out[C.USER][0] + 2, out[C.USER][1] + "I")
        return out

    for role, delete, open_end in rows:
        best, to = inserted(best), {}
        for s, (cost, text) in best.items():
            put(to, s, cost + 3, text + "D")
            if not delete:
                ahead = C.ASSISTANT if s == C.USER else C.USER
                put(to, ahead, cost + 2 + open_end, text + "R")
                if role[:1] == ("a" if ahead == C.ASSISTANT else "u"):
                    put(to, ahead, cost + open_end, text + "K")
                if role[:1] == "s" and s == C.START:
                    put(to, C.SYSTEM, cost + open_end, text + "K")
        best = to
    best = inserted(best)
    return min(best[s] for s in (C.START, C.ASSISTANT) if s in best)


def audited(rows):
    a = C.Audit()
    out = "".join(a.row(role, "text", delete, open_end) for role, delete, open_end in rows)
    cost, rest, _ = a.end()
    return cost, out + rest


@pytest.mark.parametrize("every", [1, 2, 64])
def test_audit_is_the_cheapest_and_least(monkeypatch, every):
    monkeypatch.setattr(C, "EVERY", every)
    rng = random.Random(every)
    for _ in range(600):
        rows = [(rng.choice("suaux"), rng.random() < 0.25, rng.random() < 0.3) for _ in range(rng.randint(0, 5))]
        assert audited(rows) == cheapest(rows)
    for roles in ("suauaua", "a", "s", "ua"):
        for _ in range(40):
            rows = [(rng.choice(roles), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 200))]
            assert audited(rows) == table_of_strings(rows)


def test_audit_with_colliding_hashes(monkeypatch):
    """A modulus of 7: most hashes agree, the verification decides."""
    monkeypatch.setattr(C, "PRIME", 7)
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice("aus"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 60))]
        assert audited(rows) == table_of_strings(rows)


def test_undecided_letters_take_few_nodes():
    a = C.Audit()
    for _ in range(C.EVERY * 300):  # two phases of the same cost all along
        a.row("assistant", "", False, False)
    assert max(b[1].depth for b in a.best if b) < 40


def repair_by_hand(turns):
    """Rows (conv, turn, role, text) of live turns, to the contract's columns."""
    out = {}
    blank = " \t\n\v\f\r"
    for conv in {t[0] for t in turns}:
        rows = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3]))
        count, seen, coded = Counter(), set(), []
        for _, _, role, text in rows:
            bare = text.rstrip(blank)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            coded.append((role, fault in ("blank", "duplicate"), not bare or bare[-1] not in ".!?"))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = table_of_strings(coded)
        state, said, i = C.START, [], 0
        for c in audit:
            role = "assistant" if state == C.USER else "user"
            text = ""
            if c != "I":
                old, text = rows[i][2:]
                i += 1
                if c == "D":
                    continue
                role = role if c == "R" else old
            state = {"s": C.SYSTEM, "u": C.USER, "a": C.ASSISTANT}[role[0]]
            said.append((role, text))
        n = [t[1] for t in rows if t[1] is not None]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out[conv] = (max(n) - min(n) + 1 - len(set(n)) if n else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha), said
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_of_odd_rows(spark):
    rng = random.Random(6)
    said = ["Yes.", "No", "", " \n", "Why?", None, "long " * 5000 + "end."]
    turns = [(rng.choice([1, 2, 3, None]), rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(said)) for _ in range(120)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, audit string")
    want = repair_by_hand([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in turns])
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in C.audits(df).collect()}
    assert got == {c: w for c, (w, _) in want.items()}
    said_by = defaultdict(list)
    for r in sorted(C.repaired(df).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.pos)):
        said_by[r.conv_id].append((r.role, r.text))
    assert said_by == {c: s for c, (_, s) in want.items() if s}
    assert C.audits(df.limit(0)).count() == 0 and C.repaired(df.limit(0)).count() == 0


@needs_data
def test_op13_by_hand(spark):
    turns, every = [], set()
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        every.add(r.conv_id)
        code = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text, role = " " if r.text is None else r.text, " " if r.role is None else r.role
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            turns += [(r.conv_id, r.turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    want = repair_by_hand(turns)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in QUERIES["op13_conversation_repair"](spark, DATA).collect()}
    assert got == {c: want[c][0] if c in want else nothing for c in every}


# filter audit


def audit_by_hand(rows, labels):
    """Rows (id, text, part), by every order of the filters one after the other."""
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    failed = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]]
        failed.append((part or "", {c for c, x in zip("ABCDE", f) if x}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in failed}:
        share = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in failed if f[0] == part]
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[1]]
                fails = sum(c in f[1] for f in failed if f[0] == part)
                left = [f for f in left if c not in f[1]]
                share[c] += len(gone)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(f[1] == {c} for f in failed if f[0] == part), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


AUDIT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited_rows(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in AUDIT) for r in df.collect()}


@pytest.mark.parametrize("batch_bytes", [1, None])
def test_filter_audit_by_hand(spark, tmp_path, batch_bytes):
    """A file a micro-batch, larger ids first: masks are retracted; and all files in one."""
    from seqspark.llm import filter_audit as A

    rng = random.Random(7)
    long = " ".join(f"word{i}" for i in range(250))
    texts = [None, "", long, long + " $", long.upper(), "a " * 300, "Short one", "x\vy z " * 120]
    rows = [(i, rng.choice(texts), rng.choice(["p", "q", None, ""])) for i in range(120)]
    rows += [(None, long, "p"), (None, None, "q"), (5, rows[5][1], "r"), rows[7], rows[7]]
    rng.shuffle(rows)
    rows.sort(key=lambda r: -(r[0] or 0))
    for k in range(4):
        spark.createDataFrame([(*r, "x") for r in rows[k::4]], "doc_id long, text string, source string, mask string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    labels = [(i, i % 2, i % 3) for i in range(100)] + [(0, 1, 1), (None, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    merged = defaultdict(lambda: [0, 0])
    for i, q, t in labels:
        merged[i] = [max(merged[i][0], int(q == 1)), max(merged[i][1], int(t == 1))]
    want = audit_by_hand(rows, [(i, q, t) for i, (q, t) in merged.items() if i is not None])
    assert audited_rows(A.filter_audit(spark, str(tmp_path / "docs"), known, batch_bytes=batch_bytes)) == want


def test_filter_audit_without_documents(spark, tmp_path):
    from seqspark.llm import filter_audit as A

    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "none"))
    assert A.filter_audit(spark, str(tmp_path / "none"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_retraction_of_a_smaller_id():
    import pandas as pd

    from seqspark.llm import filter_audit as A

    class State:
        value = None
        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def update(self, value):
            self.value = value

    state, total = State(), Counter()
    for i, part in ((5, "a"), (9, "b"), (2, "b"), (2, "c"), (1, "a")):
        total[part, 3] += 1  # counted at once
        for f in A.retracted((0,), iter([pd.DataFrame([("k", i, part, 3, 1)], columns=["key", "id", "part", "mask", "n"])]), state):
            for p, m, n in f.itertuples(index=False):
                total[p, m] += n
    late = 3 | A.REPEATED
    assert {k: n for k, n in total.items() if n} == {("a", 3): 1, ("a", late): 1, ("b", late): 2, ("c", late): 1}


@needs_data
@pytest.mark.parametrize("name", [n for n in ORACLES if n in ("op11_exact_dedup", "op12_filter_audit")])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    r = c.execute(ORACLES[name])
    columns = [x[0] for x in r.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(r.fetchall(), key=repr)


# surrogates and neighbours: what earlier rounds left


def test_pii_of_long_texts_and_bare_surnames(spark):
    """Repeats that would carry a recursive matcher beyond its stack, and surnames of people found in the text."""
    from seqspark.llm import pii

    n = 100_000
    texts = ["Mr " * n, "a@b" + ".c" * n, "Mr " + "Ab-" * n + "Ab", "Jean " + "von " * n, "x" * n + " 1" * n + "@"]
    texts += ["Mr. John Smith called. Smith left, Smithson's not", "Frau Anna von Trapp met Trapp and von Trapp", "Smith alone"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, Entities string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert len(got) == len(texts) and [got[i].entities for i in (1, 2, 5, 6, 7)] == [{"email": 1}, {"person": 1}, {"person": 1}, {"person": 1}, {}]
    assert got[3].text == texts[3] and got[7].text == texts[7]
    new = re.fullmatch(r"Mr\. \S+ (\S+) called\. (\S+) left, Smithson's not", got[5].text)
    assert new and new[1] == new[2] != "Smith"
    new = re.fullmatch(r"Frau \S+ (\S+) met (\S+) and von (\S+)", got[6].text)
    assert new and new[1] == new[2] == new[3] != "Trapp"


@needs_data
def test_ann_by_hashing_alone(spark):
    """The sample is a tenth of the vectors, so what queries find isn't what the sample knew; few queries fall short."""
    import numpy as np

    from pyspark.sql import functions as F
    from seqspark.llm import ann

    path = DATA.replace("0.001", "0.1")
    if not os.path.isdir(path):
        pytest.skip("no larger tables")
    df = spark.read.parquet(f"{path}/embeddings.parquet")
    report = {}
    got = defaultdict(set)
    for r in ann.nearest(df, F.col("id") % 20 == 0, report=report).collect():
        got[r.query_id].add(r.vec_id)
    rows = df.collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    met = []
    for q in ids[ids % 20 == 0]:
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        met.append(len(got[q] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(met) >= 0.95 and report["compared"] == 0 and report["widened"] <= 0.05 * report["asked"]
    print(report, np.mean(met))
