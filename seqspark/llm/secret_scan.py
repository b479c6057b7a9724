"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression. Its parse tree gives the alternatives of literal runs that a match must hold, and these give a Boolean trigram
query: an OR of alternatives, each the AND of all trigrams of its runs. The index lists for every
trigram of some query the documents that have it (postings). Postings of an alternative's trigrams are intersected; the
documents of any alternative are the rule's candidates, and only candidates are verified with the pattern. A rule without
mandatory trigrams (a run of hex digits) scans every document.

Postings are keyed by a 64-bit hash of id and text. Two documents that share a hash only add candidates, and these are
verified on their own text, so the result is exact. Texts are shuffled, once, to meet their candidate flags only if these are too many to broadcast.
"""

from __future__ import annotations

import re._constants as op
import re._parser as regex
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, sized, spare, table, written

#: Alternatives at most while a query is derived, and characters at most that a class may stand for; beyond, the place is left open.
MOST, CLASS = 256, 8
#: Runs of literals of an alternative; an open place parts two runs.
_EMPTY, _OPEN = ("",), ("", "")


def _joined(a: frozenset, b: frozenset) -> frozenset:
    """Every alternative of ``a`` followed by every one of ``b``; inner runs too short for a trigram are dropped."""
    out = frozenset((*x[:-1], x[-1] + y[0], *y[1:]) for x in a for y in b)
    out = frozenset((x[0], *[r for r in x[1:-1] if len(r) > 2], x[-1]) if len(x) > 1 else x for x in out)
    return out if len(out) <= MOST else frozenset((*x, "") for x in a)


def _members(items) -> set[str] | None:
    """The characters of a class, if they are few."""
    out: set[str] = set()
    for kind, v in items:
        if kind is op.LITERAL:
            out.add(chr(v))
        elif kind is op.RANGE and v[1] - v[0] < CLASS:
            out |= {chr(c) for c in range(v[0], v[1] + 1)}
        else:
            return None
    return out


def _both_cases(tree) -> bool:
    """Whether the pattern asks for a letter in either case anywhere."""
    for kind, v in tree:
        if kind is op.IN and (chars := _members(v)) and any(c.isascii() and c.isalpha() and c.swapcase() in chars for c in chars):
            return True
        if kind is op.SUBPATTERN and (v[1] & regex.SRE_FLAG_IGNORECASE or _both_cases(v[3])):
            return True
        if kind is op.BRANCH and any(map(_both_cases, v[1])):
            return True
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and _both_cases(v[2]):
            return True
    return False


def _runs(tree, fold: bool) -> frozenset:
    """The alternatives of runs that every match of a parse tree holds, in order. What isn't known to be there is left open, so the condition stays necessary."""
    out = frozenset([_EMPTY])
    low = lambda c: c.lower() if fold and c.isascii() else c
    for kind, v in tree:
        one = frozenset([_OPEN])
        if kind is op.LITERAL:
            one = frozenset([(low(chr(v)),)])
        elif kind is op.IN:
            chars = _members(v)
            if chars and len({low(c) for c in chars}) <= CLASS:
                one = frozenset((low(c),) for c in chars)
        elif kind is op.SUBPATTERN:
            one = _runs(v[3], fold)
        elif kind is op.BRANCH:
            one = frozenset().union(*(_runs(x, fold) for x in v[1]))
            one = one if len(one) <= MOST else frozenset([_OPEN])
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            one = frozenset([_EMPTY])  # of no width
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = v
            each, one = _runs(inner, fold), frozenset([_EMPTY])
            if (least, most) == (0, 1):
                one = one | each
            else:
                for _ in range(min(least, 3)):
                    one = _joined(one, each)
                if most != least or least > 3:
                    one = _joined(one, frozenset([_OPEN]))
        out = _joined(out, one)
    return out


@cache
def trigram_query(pattern: str) -> tuple[bool, list[list[str]]]:
    """``(fold, query)``: the OR of ANDs of trigrams that each match of a pattern holds, of the lower-cased (A-Z) text if ``fold``; empty if some alternative has no trigram."""
    tree = regex.parse(pattern)
    fold = bool(tree.state.flags & regex.SRE_FLAG_IGNORECASE) or _both_cases(tree)
    each = {frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)) for runs in _runs(tree, fold)}
    least = [x for x in each if not any(y < x for y in each)]  # A or (A and B) is A
    return fold, sorted(map(sorted, least)) if all(least) else []


@dataclass(frozen=True)
class Rule:
    """``pattern``: a regular expression that Java's and Python's syntax share and that never matches the empty text. A match counts if group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def fold(self) -> bool:
        return trigram_query(self.pattern)[0]

    def query(self) -> list[list[str]]:
        """The Boolean trigram query: OR of ANDs; empty if some alternative has no trigram."""
        return trigram_query(self.pattern)[1]


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    Rule("assign", rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    # a run of 24 or more is the whole run of hex digits, so shorter runs need not be found first
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Public formats of tokens and keys. Fixed values.
MORE = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{1,64}@"),
)
RULES = BASE + MORE


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))


def postings(docs: DataFrame, rules: tuple = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(fold, trigram, key)``: the inverted index, over the trigrams that some rule asks for."""
    asked = sorted({(r.fold, t) for r in rules for alt in r.query() for t in alt})
    text = F.coalesce(F.col(text_col), F.lit(""))
    folded = docs.select(_key(id_col, text_col).alias("key"), text.alias("t"), ascii_lower(text).alias("l"))
    has = [F.when((F.col("l") if fold else F.col("t")).contains(t), F.struct(F.lit(fold).alias("fold"), F.lit(t).alias("trigram"))) for fold, t in asked]
    listed = folded.select("key", F.explode(F.array_compact(F.array(*has))).alias("p"))
    return listed.select("p.fold", "p.trigram", "key")


def candidates(docs: DataFrame, rules: tuple = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, kinds)``: the rules of which a document has all trigrams of some alternative."""
    rows = [(r.kind, n, len(alt), r.fold, t) for r in rules for n, alt in enumerate(r.query()) for t in alt]
    query = docs.sparkSession.createDataFrame(rows, "kind string, alt int, size int, fold boolean, trigram string")
    met = postings(docs, rules, id_col, text_col).join(sized(query, "merge"), ["fold", "trigram"])
    both = met.distinct().groupBy("key", "kind", "alt", "size").agg(F.count("*").alias("n"))
    return both.where("n = size").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` uses it: inside a lambda function an expression is evaluated for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _running(xs: Column, combine, kind: str = "int", chunk: int = 512) -> Column:
    """The running sums, or maxima, of an array of numbers from 0: inside chunks, then over the chunks, so that no long array is copied for each element."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def add(a, x):
        now = combine(a["at"], x)
        return F.struct(now.alias("at"), F.array_append(a["out"], now).alias("out"))

    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / chunk), F.lit(0)).cast("int")), lambda i: F.slice(v, i * chunk + 1, F.lit(chunk)))
    inside = F.transform(_once(xs, chunks), lambda c: F.aggregate(c, zero, add)["out"])

    def moved(parts):
        before = F.aggregate(parts, zero, lambda a, c: F.struct(combine(a["at"], F.coalesce(F.get(c, F.size(c) - 1), F.lit(0))).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))["out"]
        return F.flatten(F.zip_with(parts, before, lambda c, b: F.transform(c, lambda x: combine(b, x))))

    return _once(inside, moved)


_SPANS = "array<struct<start:int,end:int,kind:string>>"


def rule_spans(text: Column, rule: Rule) -> Column:
    """``array<struct<start, end, kind>>`` of a rule's matches: leftmost, not overlapping, in code points, end exclusive.

    The pieces between matches and the matches themselves, added up in turn, give the offsets.
    """
    between = F.transform(F.split(text, rule.pattern, -1), lambda s: F.length(s))
    match = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda s: F.length(s))
    size = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda s: F.length(s)) if rule.group else match
    ends = _running(F.zip_with(F.slice(between, 1, F.size(match)), match, lambda g, m: g + m), lambda a, x: a + x)
    each = F.filter(F.arrays_zip(ends.alias("end"), match.alias("len"), size.alias("size")), lambda m: m["size"] >= rule.least)
    found = F.transform(each, lambda m: F.struct((m["end"] - m["len"]).alias("start"), m["end"].alias("end"), F.lit(rule.kind).alias("kind")))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame, rules: tuple = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row and column of ``docs`` with ``spans``: ``array<struct<start, end, kind>>`` by start, then in the order of ``rules``.

    Null and empty texts have no spans. Rows are kept as they are, repeated ones and null ids included. A column named ``spans``
    is replaced. An empty table gives an empty result. A text of any length is one row.
    """
    kept = [c for c in docs.columns if c != "spans"]
    key, kinds = spare("doc_key", docs), spare("kinds", docs)
    flags = written(candidates(docs, rules, id_col, text_col).select(F.col("key").alias(key), F.col("kinds").alias(kinds)), "op8-candidates")
    flagged = docs.select(*kept, _key(id_col, text_col).alias(key)).join(sized(flags), key, "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = {r.kind: n for n, r in enumerate(rules)}
    none = F.array().cast(_SPANS)
    found = [F.when(F.array_contains(kinds, r.kind), rule_spans(text, r)).otherwise(none) if r.query() else rule_spans(text, r) for r in rules]
    rank = F.create_map(*[x for k, n in order.items() for x in (F.lit(k), F.lit(n))])
    keyed = F.transform(F.concat(*found), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return flagged.select(*kept, ordered.alias("spans"))


def redact(docs: DataFrame, rules: tuple = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[redacted]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; overlapping spans count as one. Columns and rows stay, whatever their names; a null text stays null."""
    theirs = {c: spare("own_spans", docs) for c in docs.columns if c.lower() == "spans"}
    found = scan(docs.withColumnsRenamed(theirs), rules, id_col, text_col)
    cover = _running(F.transform("spans", lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    before = F.concat(F.array(F.lit(0)), F.slice(cover, 1, F.size("spans") - 1))  # how far the spans before reach
    text = F.col(text_col)
    piece = lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mark))).otherwise("")
    whole = F.concat(F.array_join(F.zip_with("spans", before, piece), ""), F.substring(text, F.array_max(F.transform("spans", lambda s: s["end"])) + 1, F.length(text)))
    out = found.withColumn(text_col, F.when(F.size("spans") > 0, whole).otherwise(text)).drop("spans")
    return out.withColumnsRenamed({new: c for c, new in theirs.items()}).select(*docs.columns)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = [r.kind for r in BASE]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform("spans", lambda s: s["kind"])
    count = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in base]
    first = F.filter("spans", lambda s: s["kind"].isin(*base))
    return out.select("doc_id", *count, F.sha2(F.encode(listed(first), "utf-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


#: Written out for DuckDB: kind, pattern, the group whose length counts, and its least length.
_SQL_RULES = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 1),
    ("gitlab", r"glpat-[A-Za-z0-9_-]{20,}", 0, 1),
    ("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("login", r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{1,64}@", 0, 1),
)


def _sql() -> str:
    cte = []
    for n, (kind, pat, group, least) in enumerate(_SQL_RULES):
        p = pat.replace("'", "''")
        lengths = lambda xs: f"unnest(list_transform({xs}, lambda x: length(x)))"
        cte.append(
            f"""s{n} AS (SELECT rid, {lengths(f"string_split_regex(t, '{p}')[1:len(regexp_extract_all(t, '{p}'))]")} AS g, {lengths(f"regexp_extract_all(t, '{p}')")} AS m,
    {lengths(f"regexp_extract_all(t, '{p}', {group})")} AS sz, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS k FROM d WHERE regexp_matches(t, '{p}')),
y{n} AS (SELECT rid, '{kind}' AS kind, {n} AS ord, CAST(e - m AS BIGINT) AS st, CAST(e AS BIGINT) AS en FROM (SELECT *, sum(g + m) OVER (PARTITION BY rid ORDER BY k) AS e FROM s{n}) WHERE sz >= {least})"""
        )
    union = " UNION ALL ".join(f"SELECT * FROM y{n}" for n in range(len(_SQL_RULES)))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{', '.join(cte)},
a AS ({union}),
j AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, ord) AS spans FROM a GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (rid)"""


SQL = _sql()
