"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

Method: corpus-level merge replay. The words of the corpus are counted once; an inverted index from
token pair to the positions where it stands applies every merge in rank order to all words of a
table at once, touching only the neighbours of a merged pair. Documents are then written in the ids
of their words. The table holds the most frequent words, at most ``TABLE_WORDS`` of at most
``TABLE_CHARS`` characters, and is broadcast; every other word is replayed, in the same way, with the
documents it occurs in, so no word is replayed twice in a task and no document is ever shuffled.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode white space, as a character class.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pattern's borders at white space only: no match of PATTERN crosses a border of this one.
_COARSE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Bound of the broadcast table: words, and characters of each.
TABLE_WORDS, TABLE_CHARS = 100_000, 32
#: Words replayed together.
REPLAY_WORDS = 200_000


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _tokens(path: str) -> list[bytes]:
    ranks = _ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


_FINE = regex.compile(PATTERN)


def coarse_words(text: str) -> list[str]:
    """The text cut at white space, each blank in front of a word kept with the word."""
    return _COARSE.findall(text)


def merge_replay(words: list[str], path: str) -> list[bytes]:
    """Ids of each coarse word as little-endian 32-bit integers, by one replay over all words.

    ``symbol`` is the concatenation of all words as byte ids, linked by ``after`` and ``before``.
    ``places`` is the inverted index from pair to positions; the heap yields pairs by rank.
    """
    ranks, tokens = _ranks(path), _tokens(path)
    single = [ranks[bytes([b])] for b in range(256)]
    symbol: list[int] = []
    after: list[int] = []
    before: list[int] = []
    heads: list[list[int]] = []
    done: dict[str, int] = {}
    for word in words:
        pieces = []
        for piece in _FINE.findall(word):
            at = done.get(piece)
            if at is None:
                at = done[piece] = len(symbol)
                ids = [single[b] for b in piece.encode("utf-8")]
                symbol += ids
                before += [-1, *range(at, at + len(ids) - 1)]
                after += [*range(at + 1, at + len(ids)), -1]
            pieces.append(at)
        heads.append(pieces)
    places: dict[tuple[int, int], list[int]] = {}
    rank_of: dict[tuple[int, int], int | None] = {}
    heap: list[tuple[int, tuple[int, int]]] = []

    def note(pair: tuple[int, int], at: int) -> None:
        if pair not in rank_of:
            rank_of[pair] = ranks.get(tokens[pair[0]] + tokens[pair[1]])
        rank = rank_of[pair]
        if rank is not None:
            if pair not in places:
                places[pair] = []
                heapq.heappush(heap, (rank, pair))
            places[pair].append(at)

    for at, nxt in enumerate(after):
        if nxt >= 0:
            note((symbol[at], symbol[nxt]), at)
    while heap:
        rank, pair = heapq.heappop(heap)
        for at in sorted(places.pop(pair)):
            nxt = after[at]
            if nxt < 0 or symbol[at] != pair[0] or symbol[nxt] != pair[1]:
                continue
            symbol[at], symbol[nxt] = rank, -1
            after[at] = far = after[nxt]
            if far >= 0:
                before[far] = at
                note((rank, symbol[far]), at)
            if before[at] >= 0:
                note((symbol[before[at]], rank), before[at])
    out = []
    for pieces in heads:
        ids = []
        for at in pieces:
            while at >= 0:
                ids.append(symbol[at])
                at = after[at]
        out.append(np.array(ids, "<i4").tobytes())
    return out


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, int] = {}

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    get = counts.get
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                for w in _COARSE.findall(text):
                    counts[w] = get(w, 0) + 1
        if len(counts) > REPLAY_WORDS:
            yield flush()
    if counts:
        yield flush()


def _replay_table(path: str):
    """One replay over all words of the table, whose size is bounded."""

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for batch in batches for w in batch.column("word").to_pylist()]
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(merge_replay(words, path), pa.binary())], names=["word", "ids"])

    return replay


def word_table(docs: DataFrame, text: str, path: str) -> DataFrame:
    """The words that are broadcast with their ids; their number and length are bounded whatever the corpus."""
    words = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_distinct_words, "word string, n bigint")
    counted = words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.length("word") <= TABLE_CHARS)
    frequent = counted.orderBy(F.desc("n"), "word").limit(TABLE_WORDS).select("word")
    return frequent.repartition(1).mapInArrow(_replay_table(path), "word string, ids binary")


def _encode_batches(shared, path: str, keep: list[str], lengths: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            cut = [_COARSE.findall(t) if t else () for t in batch.column("_text").to_pylist()]
            own: dict[str, bytes] = {w: b"" for words in cut for w in words if w not in table}
            if own:
                own = dict(zip(own, merge_replay(list(own), path), strict=True))
            get = {**own, **table}.__getitem__ if own and len(own) * 4 > len(table) else (lambda w: table.get(w) or own[w]) if own else table.__getitem__
            ids = [b"".join(map(get, words)) for words in cut]
            n = np.array([len(x) for x in ids], np.int64) // 4
            if lengths:
                out = pa.array(n, pa.int64())
            else:
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out], names=[*keep, "n_tokens" if lengths else "ids"])

    return encode


def encode_corpus(docs: DataFrame, *, keep: list[str], text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, lengths: bool = False) -> DataFrame:
    """The columns ``keep`` of each row with ``ids``, or with ``n_tokens`` where only lengths matter.

    No special tokens: their strings are ordinary text. An empty and a NULL text have no ids: an
    empty list, never NULL. Blank texts, odd characters and texts of any length are encoded whole;
    repeated rows give equal rows; an empty table gives no rows; other columns are ignored. A row's
    list is limited to 2**31 ids in one Arrow batch.
    """
    spark = docs.sparkSession
    path = os.path.join(tokenizers, vocabulary)
    rows = word_table(docs, text, path).toArrow()
    table = dict(zip(rows.column("word").to_pylist(), rows.column("ids").to_pylist(), strict=True))
    shared = spark.sparkContext.broadcast(table)
    src = docs.select(*keep, F.col(f"`{text}`").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in keep)
    return src.mapInArrow(_encode_batches(shared, path, keep, lengths), f"{kinds}, " + ("n_tokens bigint" if lengths else "ids array<int>"))
