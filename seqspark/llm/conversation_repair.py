"""Conversation structure repair: the cheapest edits that make a conversation alternate, by a persistent audit DP.

The rows of a conversation come in order. A state is what the repaired roles end with (nothing yet, system, user, assistant), and each state keeps its
cheapest edits so far as a node: its letters, its parent, its ancestors at distances 1, 2, 4, .. and a rolling hash of all letters up to it. So edits that begin alike
share their nodes. Of equally cheap edits the least string wins: the longest common prefix is searched over the ancestors by comparing hashes, and the
found prefix is verified, as nodes or, where they differ, letter by letter.

Two equally cheap edits of the same rows are never each other's prefix, as a further letter could only be an insert, which costs. So the least prefix stays least
whatever follows, and one node a state is enough. Letters that all states share are decided and leave; of what remains undecided, letters on
which no states part are packed into one node, so a row takes a few bytes and not nodes, however long the conversation is. States that another one beats whatever follows
are dropped. No text is held: each state carries the SHA-256 of its own repaired turns.

A conversation's rows pass through one task, as a sorted stream: a SHA-256 over its texts can't be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

BLANK, ENDS = " \t\n\v\f\r", ".!?"
REROLE, DELETE, INSERT, OPEN = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: Modulus and base of the rolling hash; rows after which decided letters are looked for; records a result batch.
PRIME, BASE, EVERY, BATCH = (1 << 61) - 1, 911_382_323, 64, 2000


def digest(text: str) -> int:
    h = 0
    for c in text:
        h = (h * BASE + ord(c)) % PRIME
    return h


class Node:
    """The last letters of a string of edits (one, or many on which no other string parts), ``own`` their hash; ``up[k]`` is the ancestor 2^k nodes before."""

    __slots__ = ("depth", "hash", "letters", "own", "up")

    def __init__(self, parent: Node | None, letters: str, own: int | None = None):
        self.letters = letters
        if parent is None:
            self.depth, self.hash, self.own, self.up = 0, 0, 0, []
            return
        self.own = digest(letters) if own is None else own
        self.depth, self.hash = parent.depth + 1, (parent.hash * pow(BASE, len(letters), PRIME) + self.own) % PRIME
        self.up, k, at = [parent], 0, parent
        while k < len(at.up):
            at = at.up[k]
            self.up.append(at)
            k += 1


def ancestor(node: Node, depth: int) -> Node:
    while node.depth > depth:
        node = node.up[(node.depth - depth).bit_length() - 1]
    return node


def same(a: Node, b: Node) -> bool:
    """Whether two nodes are known to end the same string: they share a node, and the same letters follow it."""
    while a is not b:
        if a.letters != b.letters or a.depth != b.depth:
            return False
        a, b = a.up[0], b.up[0]
    return True


def letters(node: Node) -> str:
    out = []
    while node.up:
        out.append(node.letters)
        node = node.up[0]
    return "".join(reversed(out))


def less(a: Node, b: Node) -> bool:
    """Whether the string of ``a`` is less than that of ``b``."""
    d = min(a.depth, b.depth)
    x, y = ancestor(a, d), ancestor(b, d)
    if x.hash == y.hash:
        return a.depth < b.depth if same(x, y) else letters(a) < letters(b)
    for k in reversed(range(len(x.up))):
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if same(x.up[0], y.up[0]) and x.letters[0] != y.letters[0]:
        return x.letters < y.letters
    return letters(a) < letters(b)  # hashes that collided


def packed(leaves: list[Node]) -> tuple[str, list[Node]]:
    """The letters that all ``leaves`` begin with, and the leaves anew, without these, letters on which no two of them part in few nodes.

    Of a run of such nodes each is over twice as long as the next, so a letter is packed again only some times.
    """
    parent, children = {}, {}
    for leaf in leaves:
        node = leaf
        while node.up and id(node) not in parent:
            parent[id(node)] = node
            children.setdefault(id(node.up[0]), []).append(node)
            node = node.up[0]
        root = node if not node.up else root
    ends, out, moved = {id(x) for x in leaves}, [], {}
    while id(root) not in ends and len(children[id(root)]) == 1:
        root = children[id(root)][0]
        out.append(root.letters)
    moved[id(root)] = Node(None, "")
    heads = [(root, c) for c in children.get(id(root), ())]
    while heads:
        top, node = heads.pop()
        run = [(node.letters, node.own)]
        while id(node) not in ends and len(children[id(node)]) == 1:
            node = children[id(node)][0]
            run.append((node.letters, node.own))
            while len(run) > 1 and len(run[-2][0]) <= 2 * len(run[-1][0]):
                (s, h), (t, g) = run[-2:]
                run[-2:] = [(s + t, (h * pow(BASE, len(t), PRIME) + g) % PRIME)]
        at = moved[id(top)]
        for text, own in run:
            at = Node(at, text, own)
        moved[id(node)] = at
        heads += [(node, c) for c in children.get(id(node), ())]
    return "".join(out), [moved[id(x)] for x in leaves]


class Audit:
    """The DP over the rows of one conversation. A state has its cost, its node, the hash of its repaired turns and whether it has any."""

    def __init__(self) -> None:
        self.best: list[tuple | None] = [(0, Node(None, ""), hashlib.sha256(), False), None, None, None]
        self.rows = 0

    @staticmethod
    def _add(to: list, state: int, cost: int, before: tuple, letter: str, turn: bytes | None) -> None:
        """``before`` with one more edit, if that is the best of ``to`` for the state; ``turn`` is what the edit leaves."""
        now = to[state]
        if now is None or cost <= now[0]:
            node = Node(before[1], letter)
            if now is None or cost < now[0] or less(node, now[1]):
                to[state] = (cost, node, before, turn)

    @staticmethod
    def _hashed(found: tuple) -> tuple:
        cost, node, (_, _, sha, any_), turn = found
        if turn is None:
            return cost, node, sha, any_
        sha = sha.copy()
        sha.update(b"\n" + turn if any_ else turn)
        return cost, node, sha, True

    def _insert(self) -> None:
        """Turns of empty text between two rows: a user's, then an assistant's; more never pay."""
        for state, froms, turn in ((USER, (START, SYSTEM, ASSISTANT), b"user:"), (ASSISTANT, (USER,), b"assistant:")):
            to = [None if b is None else (b[0], b[1], b, None) for b in self.best]
            for s in froms:
                if self.best[s]:
                    self._add(to, state, self.best[s][0] + INSERT, self.best[s], "I", turn)
            if to[state]:
                self.best[state] = self._hashed(to[state])

    def _prune(self) -> None:
        """An assistant's end allows what a system's does, and what nothing does but for a system row, which it may delete."""
        a = self.best[ASSISTANT]
        if a and self.best[SYSTEM] and self.best[SYSTEM][0] > a[0]:
            self.best[SYSTEM] = None
        if a and self.best[START] and self.best[START][0] > a[0] + DELETE:
            self.best[START] = None

    def row(self, role: str, text: str, delete: bool, open_end: bool) -> str:
        """Takes the next row; returns the letters decided by it."""
        self._insert()
        initial = role[:1]
        to: list[tuple | None] = [None] * 4
        said = text.encode("utf-8", "surrogatepass")
        kept = role.encode("utf-8", "surrogatepass") + b":" + said
        for state, b in enumerate(self.best):
            if b is None:
                continue
            cost = b[0]
            self._add(to, state, cost + DELETE, b, "D", None)
            if delete:
                continue
            ahead = ASSISTANT if state == USER else USER
            self._add(to, ahead, cost + REROLE + open_end, b, "R", (b"assistant:" if state == USER else b"user:") + said)
            if initial == ("a" if state == USER else "u"):
                self._add(to, ahead, cost + open_end, b, "K", kept)
            elif initial == "s" and state == START:
                self._add(to, SYSTEM, cost + open_end, b, "K", kept)
        self.best = [None if t is None else self._hashed(t) for t in to]
        self._prune()
        self.rows += 1
        if self.rows % EVERY:
            return ""
        live = [i for i, b in enumerate(self.best) if b]
        out, nodes = packed([self.best[i][1] for i in live])
        for i, node in zip(live, nodes):
            self.best[i] = (self.best[i][0], node, *self.best[i][2:])
        return out

    def end(self) -> tuple[int, str, str]:
        """The cost, the letters not yet returned, and the hash of the repaired turns."""
        self._insert()
        best = [b for b in (self.best[START], self.best[ASSISTANT]) if b]
        first = best[0]
        for b in best[1:]:
            if b[0] < first[0] or b[0] == first[0] and less(b[1], first[1]):
                first = b
        return first[0], letters(first[1]), first[2].hexdigest()


class Conversation:
    """One conversation's rows in order: counts of faults, and the audit; with ``keep`` also the repaired turns, as they are decided, for which undecided rows wait."""

    def __init__(self, conv, keep: bool):
        self.conv, self.keep = conv, keep
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.audit: list[str] = []
        self.dp, self.last = Audit(), None
        self.low = self.high = None
        self.distinct = 0
        self.state, self.made = START, 0
        self.waiting: list[tuple[str, str]] = []
        self.turns: list[tuple[int, str, str]] = []

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        bare = text.rstrip(BLANK)
        blank, open_end, initial = not bare, bare[-1:] not in ENDS, role[:1]
        if blank:
            self.counts["blank"] += 1
        elif again:
            self.counts["duplicate"] += 1
        elif open_end:
            self.counts["truncated"] += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = initial
        if self.keep:
            self.waiting.append((role, text))
        self._take(self.dp.row(role, text, blank or again, open_end))

    def _take(self, decided: str) -> None:
        if not decided:
            return
        self.audit.append(decided)
        if not self.keep:
            return
        used = 0
        for c in decided:
            role, text = "assistant" if self.state == USER else "user", ""
            if c != "I":
                old, text = self.waiting[used]
                used += 1
                if c == "D":
                    continue
                role = role if c == "R" else old
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            self.turns.append((self.made, role, text))
            self.made += 1
        del self.waiting[:used]

    def end(self) -> dict:
        cost, rest, sha = self.dp.end()
        self._take(rest)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"conv": self.conv, "gaps": gaps, **self.counts, "cost": cost, "audit": "".join(self.audit), "repaired_sha256": sha}


def _ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str, live: Column | None) -> DataFrame:
    """``(conv, turn, role, text, live, again)``: whole conversations a partition, in order; ``again`` marks a role and text seen earlier. One shuffle, two sorts."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), own(role).alias("role"), own(text).alias("text"), (F.lit(True) if live is None else live).alias("live"))
    x = x.repartition("conv")
    seen = F.row_number().over(Window.partitionBy("conv", "live", "role", "text").orderBy(F.asc_nulls_first("turn")))
    return x.withColumn("again", seen > 1).sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text", "again")


def _streamed(turns: DataFrame, keep_turns: bool, *columns) -> DataFrame:
    x = _ordered(turns, *columns)
    kind = x.schema["conv"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    fields = ["conv", "pos", "role", "text"] if keep_turns else ["conv", *counts, "audit", "repaired_sha256"]
    schema = f"conv {kind}, pos long, role string, text string" if keep_turns else f"conv {kind}, {', '.join(c + ' long' for c in counts)}, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        made, now, types = 0, None, None

        def close() -> None:
            if now is not None:
                row = now.end()
                take()
                if not keep_turns:
                    out.append(row)

        def take() -> None:
            out.extend({"conv": now.conv, "pos": p, "role": r, "text": t} for p, r, t in now.turns)
            now.turns.clear()

        def batch() -> pa.RecordBatch:
            rest = {"role": pa.string(), "text": pa.string(), "audit": pa.string(), "repaired_sha256": pa.string()}
            got = pa.RecordBatch.from_arrays([pa.array([r[f] for r in out], types if f == "conv" else rest.get(f, pa.int64())) for f in fields], fields)
            out.clear()
            return got

        for b in batches:
            types = b.schema.field("conv").type
            for conv, turn, role, text, live, again in zip(*[c.to_pylist() for c in b.columns]):
                if now is None or conv != now.conv:
                    close()
                    now, made = Conversation(conv, keep_turns), 0
                if live:
                    now.add(turn, role, text, again)
                made += 1
                if made % EVERY == 0:
                    take()
                if len(out) >= BATCH:
                    yield batch()
        close()
        if out:
            yield batch()

    return x.mapInArrow(run, schema)


def audits(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", live: Column | None = None) -> DataFrame:
    """One row a conversation: ``conv``, counts of its faults, the cost and the letters of its cheapest repair, and the SHA-256 of the repaired turns.

    Rows go by turn, nulls first; rows of one turn by role and text. A null role or text is one space. A null conversation is one of its own. Of repeated
    rows all but the first are duplicates. Empty texts are blank, texts of any length are looked at once. Where ``live`` is false a row names its conversation and is no part of it. Other
    columns are ignored. An empty table gives an empty result.
    """
    return _streamed(turns, False, conv, turn, role, text, live).withColumnRenamed("conv", conv)


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", live: Column | None = None) -> DataFrame:
    """``(conv, pos, role, text)``: the turns of every conversation after its cheapest repair, ``pos`` from 0; as :func:`audits`. Rows wait here until their edit is decided, mostly for some rows."""
    return _streamed(turns, True, conv, turn, role, text, live).withColumnRenamed("conv", conv)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with known damage, drawn by a checksum of ``conv_id:turn``, and ``live``: rows dropped (not live), emptied, without their end marks, repeated, or made a user's."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")), F.lit(20))
    x = turns.select("conv_id", "turn", own("role").alias("role"), own("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return x.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") != 0).alias("live"), times.alias("time")).drop("time")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits(damaged(table(spark, sf_dir, "conversations")), live=F.col("live"))
