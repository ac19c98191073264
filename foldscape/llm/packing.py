"""Operator 2: best-fit-decreasing packing of tokenised documents into sequences.

Best fit decreasing takes pieces from the longest to the shortest and puts each
into the open bin with the least room that still holds it. Lengths are whole
numbers up to the capacity, so pieces of one length are interchangeable, and bins
with the same room are too: the whole packing is decided by how many pieces have
each length. That histogram (capacity rows, however large the corpus) goes to the
driver; a segment tree over the remaining capacities finds the tightest open bins
in logarithmic time, a run of equal pieces at once. The plan that comes back maps
ranks within a length to places: its size is bounded by the capacity alone.

Ranks are counted where pieces are made: in each task by length, then summed over
the tasks. The pieces are written once, as numbers; texts are never shuffled.

Null and empty texts are the single end-of-document id. Every row with a doc_id
is packed, repeated rows too; rows without a doc_id are left out, and columns beside
doc_id and text are pruned. An empty table gives no rows. Ties between equal pieces go by scan order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldscape.llm.common import batch, chunks, flat, ragged, table, texts_of, written
from foldscape.llm.pretoken import Words, split

CAPACITY = 1024
END_ID = 2


@cache
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if visible, else from 256 on in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def tokenizer(path: str, end_id: int) -> tuple:
    """Words with the ids of the vocabulary file at `path`; the literal special tokens; the library's own tokenizer."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    special = [t["content"] for t in made["added_tokens"]]
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in w): i for w, i in made["model"]["vocab"].items() if w not in special}
    core = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [core.encode_ordinary(w) for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes

    return Words(encode, (end_id,)), [s.encode() for s in special], Tokenizer.from_file(path)


def token_ids(texts: pa.ChunkedArray, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts with end_id after each, and n + 1 offsets."""
    words, special, library = tokenizer(path, end_id)
    points, starts, counts = split(texts)
    at = words.look(points, starts)
    begin = np.insert(words.begin[at], counts[1:], 0)  # the reserved end id is the first held
    size = np.insert(words.size[at], counts[1:], 1)
    ids = words.ids[ragged(begin, size)]
    total = np.concatenate([[0], np.cumsum(size)])
    offsets = total[counts + np.arange(len(counts))]
    raw, ends = flat(texts)
    whole = raw.tobytes()
    if any(s in whole for s in special):  # the library takes these literals out of a text before it splits
        parts = []
        for i in range(len(counts) - 1):
            text = whole[ends[i] : ends[i + 1]]
            own = ids[offsets[i] : offsets[i + 1]]
            if any(s in text for s in special):
                own = np.array([*library.encode(text.decode(), add_special_tokens=False).ids, end_id], np.uint32)
            parts.append(own)
        ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return ids, offsets


def ranks_within(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many equal values came before each; `seen` has the counts so far and is brought up to date."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    head = np.ones(len(order), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(head)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    out += seen[values]
    seen += np.bincount(values, minlength=len(seen))
    return out


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("part_rank", pa.int64())]
)
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, part_rank long"


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for t in chunks(batches):
            ids, offsets = token_ids(t["text"], path, end_id)
            n = np.diff(offsets)
            k = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
            stop = n[doc] - (k[doc] - 1 - piece) * capacity
            start = np.where(piece == 0, 0, stop - capacity)
            length = stop - start
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            a = offsets[:-1][doc] + start
            crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(a.tolist(), (a + length).tolist(), strict=True)]
            yield batch(_PIECES, t["doc_id"].to_numpy()[doc], piece, start, length, crc, np.full(len(doc), part), ranks_within(length, seen))

    return run


class Rooms:
    """Open bins by remaining room, with a segment tree over the rooms."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)  # how many groups of bins are below each node
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            self.groups[room].append((first, bins))
            self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += by
            at //= 2

    def take(self, least: int) -> tuple[int, int, int] | None:
        """Room, first bin and number of bins of a tightest group with room for `least`."""
        at = least + self.leaves
        while not self.tree[at]:
            while at & 1:  # a right child: its subtree is behind us
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._count(room, -1)
        return (room, *self.groups[room].pop())


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, offset, count): `count` pieces from a rank on go to as many bins from a bin on."""
    rooms, rows, bins = Rooms(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            found = rooms.take(length)
            room, first, n = found or (capacity, bins, -(-left // (capacity // length)))
            if found is None:
                bins += n
            each = room // length
            full = min(n, left // each)
            for size, deep in ((full, each), (1, left - full * each if full < n and left - full * each < each else 0)):
                if size and deep:
                    rows += [(length, rank + i * size, first, capacity - room + i * length, size) for i in range(deep)]
                    rooms.add(room - deep * length, first, size)
                    rank, left, first, n = rank + deep * size, left - deep * size, first + size, n - size
            rooms.add(room, first, n)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


_PLACED = pa.schema([*list(_PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PLACED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _place(runs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = 1 << 44
        keys = runs[:, 0] * wide + runs[:, 1]
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            yield batch(_PLACED, *(b[c] for c in _PLACED.names[:5]), runs[at, 2] + rank - runs[at, 1], runs[at, 3])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece of every row of `docs`: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(texts_of(docs).mapInArrow(_pieces(tokenizer_path, capacity, end_id), _PIECES_DDL))
    counted = pieces.groupBy("part", "length").agg((F.max("part_rank") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("part_rank"))
    return ranked.mapInArrow(_place(plan(totals, capacity)), _PLACED_DDL)


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
