"""Sequence packing: first-fit decreasing with a tournament tree, run in randomised groups of documents.

Documents become token ids in one pass, are cut into pieces of at most ``capacity`` ids, and each piece rides with its payload to
a group of its own choice by a hash. The number of groups grows with the bytes of the corpus, so a group stays near ``group_bytes`` of text
however many or long the documents are, and groups are packed independently of each other. Inside a group the pieces go, longest first,
to the first sequence with room, found by descending a tournament tree over the sequences' free room.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CAPACITY, END_ID = 2048, 1
#: Bytes of text a group; a token has one at least.
GROUP_BYTES = 4 << 20
#: Ids that a task gathers before it passes pieces on.
HELD = 4 << 20
#: Entries of a task's piece cache; it is emptied when full.
CACHE = 250_000
_AWKWARD = re.compile(r"\s\s|\A\s|\s\Z")


class _Pieces(dict):
    """A word to the ids of its text with the space before it (a line end is part of the word), as unsigned 32-bit bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        out = self[word] = array("I", self.encode(word if word[0] == "\n" else " " + word)).tobytes()
        return out


@lru_cache(maxsize=2)
def _whole(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _tokenizer(path: str, ranks_path: str | None):
    """``(whole text -> ids, piece -> ids)``. The rank file holds the same vocabulary; pieces go through it as it is faster on short texts, and the tokenizer is only loaded for a text that needs it."""
    whole = lambda text: _whole(path).encode(text, add_special_tokens=False).ids
    if not ranks_path:
        return whole, None
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return whole, tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def encode_text(text: str, whole, pieces: _Pieces | None) -> bytes:
    """The text's ids as little-endian unsigned 32-bit bytes.

    The tokenizer never joins across a space between two characters that aren't white space, so a text without two white spaces in
    a row, nor any at its ends, is encoded word by word (a line end also starts one), each distinct word once. Any other text, or one with a
    special token's string, is encoded as a whole.
    """
    if pieces is None or "<|" in text:
        return np.array(whole(text), "<u4").tobytes()
    if not text or _AWKWARD.search(text):
        return np.array(pieces.encode(text), "<u4").tobytes()
    if len(pieces) > CACHE:
        pieces.clear()
    first, *rest = text.replace("\n", " \n").split(" ")
    return array("I", pieces.encode(first)).tobytes() + b"".join(map(pieces.__getitem__, rest))


def token_pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """``(doc_id, start, length, ids, ids_crc32, doc_tokens, spread)``: every document's ids, ended by ``end_id``, cut into pieces of ``capacity`` and a rest.

    A null text is empty and so has only the end id. ``ids`` is null without ``keep_ids``; ``spread`` is a hash of the row's
    content and place and the piece's start that deals it to a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, short = _tokenizer(tokenizer_path, ranks_path)
        cache = _Pieces(short) if short else None
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "spread"]

        def batch(b, at, out):
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(out, types))], names)

        for n, b in enumerate(batches):
            out: list[list] = [[] for _ in types]
            at, held = [], 0
            for i, t in enumerate(b.column(1)):
                buf = encode_text(t.as_py() or "", whole, cache) + end
                tokens, key = len(buf) // 4, zlib.crc32(f"{task}:{n}:".encode() + buf)
                for s in range(0, tokens, capacity):
                    part = buf[4 * s : 4 * (s + capacity)]
                    at.append(i)
                    for col, v in zip(out, (s, len(part) // 4, np.frombuffer(part, "<u4") if keep_ids else None, zlib.crc32(part), tokens, zlib.crc32(s.to_bytes(8, "little"), key))):
                        col.append(v)
                held += tokens
                if held > HELD:
                    yield batch(b, at, out)
                    out, at, held = [[] for _ in types], [], 0
            yield batch(b, at, out)

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, spread long")


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """``(sequence, offset)`` of each length. Longest first, ties in the given order; each goes to the first sequence with room.

    The tournament tree holds each sequence's free room at its leaves and the larger of two children above them.
    """
    n = len(lengths)
    size = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * size)  # one sequence a piece is always enough
    seq, off = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, k = int(lengths[i]), 1
        while k < size:
            k *= 2
            if tree[k] < need:
                k += 1
        seq[i], off[i] = k - size, capacity - tree[k]
        tree[k] -= need
        while k > 1:
            k //= 2
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a >= b else b
    return seq, off


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY, seed: int = 0) -> DataFrame:
    """``pieces`` (with ``doc_id``, ``start``, ``length``, ``spread``) with ``sequence_id`` and ``offset``; the other columns ride along.

    A sequence belongs to one group; its id is the group's number times 2^32 plus its own. Pieces are never split here, and
    lengths from 1 to ``capacity`` are taken. An empty table gives an empty result.
    """
    kept = [c for c in pieces.columns if c not in ("spread", "sequence_id", "offset")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "spread"], kind="stable", ignore_index=True)
        seq, off = first_fit_decreasing(pdf["length"].to_numpy(np.int64), capacity)
        return pdf.assign(sequence_id=(int(pdf["grp"].iloc[0]) << 32) + seq, offset=off)[[*kept, "sequence_id", "offset"]]

    dealt = pieces.select(*kept, "spread", F.pmod(F.xxhash64("spread", F.lit(seed)), F.lit(groups)).alias("grp"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in kept) + ", sequence_id long, offset long"
    return dealt.groupBy("grp").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_bytes: int = GROUP_BYTES, keep_ids: bool = True) -> DataFrame:
    """Each piece of every document with the sequence and offset that it is packed at.

    Null and empty texts are one piece with the end id. Repeated rows and null ids are packed like others. Other columns are
    ignored, whatever their names. An empty table gives an empty result. The pieces of a very long text are packed in many groups.
    """
    size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 1)).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    return pack(token_pieces(docs, tokenizer_path, ranks_path, id_col, text_col, capacity, keep_ids=keep_ids), groups, capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
