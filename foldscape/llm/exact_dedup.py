"""Operator 9: exact dedup by deterministic block naming.

A text is cut into blocks of a fixed size. Distinct blocks are sorted, and a
block's integer name is its place in that order; then adjacent names of a text
are paired, distinct pairs are sorted and named in the same way, and so on until
each text has one name. Two texts of one naming have the same name only if they
are equal byte for byte: names come from comparisons, never from a hash.

On a cluster the naming runs twice. Each chunk of a scan names its own texts and
keeps one representative of each class, so a text that a third of all rows share
arrives once a chunk. Representatives are dealt out by a digest, which brings
equal texts together, and are named again there, a bounded run of digests at a
time. Members find their class through their representative, whose members are
at most one chunk's rows: no task gets a whole group. A digest of more than HOT
representatives is named in two steps: they are dealt out to as many tasks as the
square root of their number, each of which keeps one representative of a class
for all of its own, and only those meet. A text of ten million chunks is named
three thousand at a time.

Null and empty texts are one class (the empty text). Rows that repeat both id
and text are members like any others; both are kept if their id is the
smallest. Rows without a doc_id are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldscape.llm.common import batch, chunks, flat, table, texts_of, written

BLOCK = 128
#: Text bytes that are named at once; a digest's rows stay together.
RUN_BYTES = 16 << 20
#: Representatives of a digest that one task names; hot digests up to which they are broadcast (16 bytes each).
HOT, BROADCAST_DIGESTS = 64, 1_000_000
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
_TO_SPACE = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def normalised(text: bytes) -> bytes:
    """Each run of [\\x20\\x09-\\x0D] as one space."""
    text = text.translate(_TO_SPACE)
    return _SPACES.sub(b" ", text) if b"  " in text else text


def names(texts: list[bytes], block: int = BLOCK) -> np.ndarray:
    """An integer for each text; equal integers if and only if the texts are equal."""
    if not texts:
        return np.zeros(0, np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-lengths // block))
    starts = np.cumsum(counts) - counts
    room = bytearray(int(counts.sum()) * block)
    for t, at in zip(texts, (starts * block).tolist(), strict=True):
        room[at : at + len(t)] = t
    # zeros fill the last block; the length, named at the end, tells a filled block from a real one
    _, name = np.unique(np.frombuffer(room, f"S{block}"), return_inverse=True)
    name = name.astype(np.int64)
    while counts.max() > 1:
        halves = (counts + 1) // 2
        text = np.repeat(np.arange(len(texts)), halves)
        place = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves)
        left = np.repeat(starts, halves) + 2 * place
        paired = 2 * place + 1 < counts[text]
        right = np.where(paired, name[np.minimum(left + 1, len(name) - 1)] + 1, 0)
        _, name = np.unique(name[left] * (len(name) + 2) + right, return_inverse=True)
        name = name.astype(np.int64)
        counts, starts = halves, np.cumsum(halves) - halves
    _, name = np.unique(name * (int(lengths.max()) + 1) + lengths, return_inverse=True)
    return name.astype(np.int64)


_LOCAL = pa.schema(
    [("doc_id", pa.int64()), ("rep_id", pa.int64()), ("sha", pa.string()), ("part", pa.int64()), ("copies", pa.int64()), ("text", pa.binary())]
)
_LOCAL_DDL = "doc_id long, rep_id long, sha string, part long, copies long, text binary"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes within a chunk. The representative (smallest id, first row) carries the text and the count."""
    for t in chunks(batches, 8 << 20):
        ids = t["doc_id"].to_numpy()
        raw, ends = flat(t["text"])
        whole = raw.tobytes()
        texts = [normalised(whole[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        name = names(texts)
        order = np.lexsort((ids, name))
        head = np.ones(len(order), bool)
        head[1:] = name[order][1:] != name[order][:-1]
        rep = np.empty(len(order), np.int64)
        rep[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        size = np.bincount(rep, minlength=len(order))
        is_rep = rep == np.arange(len(order))
        sha = {int(i): hashlib.sha256(texts[i]).digest() for i in np.flatnonzero(is_rep)}
        yield batch(
            _LOCAL, ids, ids[rep], [sha[i].hex() for i in rep.tolist()],
            [int.from_bytes(sha[i][:8], "little", signed=True) for i in rep.tolist()],
            pa.array(size, pa.int64(), mask=~is_rep),
            [x if r else None for x, r in zip(texts, is_rep.tolist(), strict=True)],
        )


_GLOBAL = pa.schema([("rep_id", pa.int64()), ("part", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_GLOBAL_DDL = "rep_id long, part long, keep_id long, group_size long"
#: head: the representative that stands for this one; copies and text where it is that one itself.
_HEADS = pa.schema([("rep_id", pa.int64()), ("part", pa.int64()), ("head", pa.int64()), ("copies", pa.int64()), ("text", pa.binary())])
_HEADS_DDL = "rep_id long, part long, head long, copies long, text binary"


def _grouped(held: list[pa.Table]) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Representatives, the class of each, a row for each id and class, and of each class the smallest id and all copies."""
    t = pa.concat_tables(held)
    rep = t["rep_id"].to_numpy()
    name = names(t["text"].to_pylist())
    n = int(name.max()) + 1 if len(name) else 0
    keep = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(keep, name, rep)
    size = np.zeros(n, np.int64)
    np.add.at(size, name, t["copies"].to_numpy())
    _, once = np.unique(np.stack([rep, name], 1), axis=0, return_index=True)
    return t, name, once, keep, size


def _classes(held: list[pa.Table]) -> pa.RecordBatch:
    t, name, once, keep, size = _grouped(held)
    return batch(_GLOBAL, t["rep_id"].to_numpy()[once], t["part"].to_numpy()[once], keep[name[once]], size[name[once]])


def _heads(held: list[pa.Table]) -> pa.RecordBatch:
    t, name, once, keep, size = _grouped(held)
    rep, part = t["rep_id"].to_numpy()[once], t["part"].to_numpy()[once]
    head = keep[name[once]]
    own = head == rep
    texts = t["text"].take(pa.array(once)).to_pylist()
    return batch(_HEADS, rep, part, head, pa.array(size[name[once]], pa.int64(), mask=~own), [x if o else None for x, o in zip(texts, own.tolist(), strict=True)])


def _runs(of):
    """Rows come sorted by `key`; a run of keys is named at once, and never cut within a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            if size >= RUN_BYTES:
                same = int(np.searchsorted(t["key"].to_numpy(), held[-1]["key"][-1].as_py(), side="right"))
                if same < t.num_rows:
                    yield of([*held, t.slice(0, same)])
                    held, size, t = [], 0, t.slice(same)
            held.append(t)
            size += t.nbytes
        if held:
            yield of(held)

    return run


def _named(reps: DataFrame, key: Column, of, ddl: str) -> DataFrame:
    """Representatives (rep_id, part, copies, text) named in runs of a key that equal texts share."""
    return reps.select(key.alias("key"), "rep_id", "part", "copies", "text").repartition("key").sortWithinPartitions("key").mapInArrow(_runs(of), ddl)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`."""
    local = written(texts_of(docs).mapInArrow(_local, _LOCAL_DDL))
    reps = local.where("copies is not null").select("rep_id", "part", "copies", "text")
    hot = written(reps.groupBy("part").agg(F.ceil(F.sqrt(F.count("*"))).cast("int").alias("tasks")).where(F.col("tasks") ** 2 > HOT))
    n = hot.count()
    if n:
        some = F.broadcast(hot) if n <= BROADCAST_DIGESTS else hot
        salted = F.xxhash64("part", F.pmod(F.xxhash64("rep_id"), F.col("tasks")))
        first = written(_named(reps.join(some, "part"), salted, _heads, _HEADS_DDL))
        left = reps.join(some, "part", "left_anti").unionByName(first.where("text is not null").select("rep_id", "part", "copies", "text"))
        classes = written(_named(left, F.col("part"), _classes, _GLOBAL_DDL))
        led = first.where("rep_id <> head").select("rep_id", "part", "head")
        followers = led.join(classes.withColumnRenamed("rep_id", "head"), ["head", "part"]).select("rep_id", "part", "keep_id", "group_size")
        classes = classes.unionByName(followers)
    else:
        classes = _named(reps, F.col("part"), _classes, _GLOBAL_DDL)
    return local.select("doc_id", "rep_id", "part", "sha").join(classes, ["rep_id", "part"]).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose text no smaller doc_id has, with all their columns; rows without a doc_id go."""
    stays = exact_dedup(docs).where("kept").select("doc_id").distinct()
    return docs.join(stays.hint("shuffle_hash"), "doc_id", "left_semi")


def op9_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""
