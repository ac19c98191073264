"""Operator 3: reversible line dedup by sharded cuckoo filters over exact reference-count tables.

A line's key is the line stripped of blanks at both ends and with A-Z in lower
case; keys of MIN_CHARS code points or more are indexed by a 128-bit digest. The
index has two tables in the shared folder, in versions:

- postings: one row a document and distinct key. They are what makes deletions
  exact, and what verdicts are joined back through.
- shards: keys are dealt out by digest. A shard holds a cuckoo filter and the
  exact table (key, documents that hold it, largest such id). Arrivals ask the
  filter first: most lines of a corpus are new, and those are appended without a
  look at the table; the others are looked up, which settles false positives.
  Deleting a document lowers its keys' counts; a key without documents leaves
  the table, and its fingerprint the filter. Shards split as postings grow.

Documents come in arrivals, one after another, each against the index of those
before. An arrival is summed by key in each task before it is dealt out, so a line
that a third of all documents hold arrives at its shard once a task. The verdicts
are joined to postings by key, an inner equi-join whose hot partitions Spark
splits, and only ids and digests take part; texts move once, to meet their verdicts.

A key in MIN_DOCS documents or more loses all its lines but those of the largest
doc_id that holds it. Null and empty texts are one empty line, and a text whose
lines all go is empty. A row is a document: rows that repeat a doc_id count as so
many, none of them is dropped where that id is the largest, and delete() takes back
all of them. Rows without a doc_id are left out, and columns beside doc_id and text
are pruned. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldscape.llm.common import LOWER, batch, chunks, flat, mixed, rewritten, table, texts_of, written

MIN_CHARS = 20
MIN_DOCS = 3
#: Postings a shard is planned for; the number of shards grows with the input.
SHARD_POSTINGS = 250_000
LEAST_SHARDS = 256
#: The query deals its table into so many arrivals, then takes back one document in WITHDRAWN, by a hash of the id, and inserts it again.
ARRIVALS, WITHDRAWN = 3, 64
#: Keys of deleted documents up to which they are broadcast (16 bytes each).
BROADCAST_KEYS = 1_000_000
#: Distinct keys that a task sums up before it passes them on.
COMBINED_KEYS = 1_000_000
_BLANKS = b"\x20\t\n\x0b\x0c\r"
_LOWER = LOWER.tobytes()


def keys_of(lowered: bytes, min_chars: int) -> list[bytes | None]:
    """The digest of each line's key; None for keys that are too short. `lowered`: a text with A-Z lowered."""
    out: list[bytes | None] = []
    for line in lowered.split(b"\n"):
        key = line.strip(_BLANKS)
        long_enough = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


class CuckooFilter:
    """Sixteen-bit fingerprints, four to a bucket, each in one of two buckets that know each other."""

    SLOTS, KICKS = 4, 256

    def __init__(self, expected: int, table: np.ndarray | None = None):
        buckets = 1 << max(4, int(expected * 1.6 / self.SLOTS).bit_length())
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each hash."""
        h = mixed(h)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, one, self.other(one, mark)

    def other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(h)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def insert(self, h: np.ndarray) -> bool:
        """False if some found no place: the table behind the filter then fills a larger one."""
        mark, one, two = self.places(h)
        for turn in range(2):
            if not len(mark):
                return True
            bucket = two if turn else one
            order = np.argsort(bucket, kind="stable")
            ordered = bucket[order]
            head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            nth = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
            empty = self.table[ordered] == 0
            fits = nth < empty.sum(axis=1)
            # the nth arrival of a bucket takes its nth empty slot
            slot = np.argmax(empty & (np.cumsum(empty, axis=1) == nth[:, None] + 1), axis=1)
            self.table[ordered[fits], slot[fits]] = mark[order[fits]]
            rest = order[~fits]
            mark, one, two = mark[rest], one[rest], two[rest]
        for m, b in zip(mark.tolist(), one.tolist(), strict=True):
            for kick in range(self.KICKS):
                row = self.table[b]
                gap = np.flatnonzero(row == 0)
                if len(gap):
                    row[gap[0]] = m
                    break
                at = kick % self.SLOTS
                m, row[at] = int(row[at]), m
                b = int(self.other(np.array([b]), np.array([m], np.uint16))[0])
            else:
                return False
        return True

    def delete(self, h: np.ndarray) -> None:
        """One fingerprint less for each hash, all of which were inserted."""
        mark, one, two = self.places(h)
        for m, a, b in zip(mark.tolist(), one.tolist(), two.tolist(), strict=True):
            for bucket in (a, b):
                hit = np.flatnonzero(self.table[bucket] == m)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break


def _hash(keys: np.ndarray) -> np.ndarray:
    return np.frombuffer(keys.astype("S16").tobytes(), np.uint64)[::2]


class Shard:
    """A cuckoo filter and the exact table behind it, sorted by key."""

    def __init__(self, state: dict | None = None):
        self.keys = np.frombuffer(state["keys"], "S16") if state else np.zeros(0, "S16")
        self.refs = np.frombuffer(state["refs"], np.int64).copy() if state else np.zeros(0, np.int64)
        self.last = np.frombuffer(state["last"], np.int64).copy() if state else np.zeros(0, np.int64)
        self.filter = CuckooFilter(0, np.frombuffer(state["filter"], np.uint16).reshape(-1, 4).copy() if state else None)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is or would be in the table, and whether it is there."""
        at = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        hit[inside] = self.keys[at[inside]] == keys[inside]
        return at, hit

    def insert(self, keys: np.ndarray, refs: np.ndarray, last: np.ndarray) -> None:
        """Keys may repeat: an arrival is what one task found."""
        keys, code = np.unique(keys, return_inverse=True)
        n, top = np.zeros(len(keys), np.int64), np.full(len(keys), np.iinfo(np.int64).min)
        np.add.at(n, code, refs)
        np.maximum.at(top, code, last)
        maybe = np.flatnonzero(self.filter.holds(_hash(keys)))
        at, hit = self.find(keys[maybe])
        seen, at = maybe[hit], at[hit]
        self.refs[at] += n[seen]
        self.last[at] = np.maximum(self.last[at], top[seen])
        fresh = np.ones(len(keys), bool)
        fresh[seen] = False
        into = np.searchsorted(self.keys, keys[fresh])
        self.keys, self.refs, self.last = (np.insert(a, into, b[fresh]) for a, b in ((self.keys, keys), (self.refs, n), (self.last, top)))
        full = len(self.keys) > 0.9 * self.filter.table.size or not self.filter.insert(_hash(keys[fresh]))
        room = len(self.keys)
        while full:
            room *= 2
            self.filter = CuckooFilter(room)
            full = not self.filter.insert(_hash(self.keys))

    def delete(self, keys: np.ndarray, refs: np.ndarray, last: np.ndarray) -> None:
        """`last` holds, for each distinct key, the largest id that is left."""
        at, hit = self.find(keys)
        self.refs[at[hit]] -= refs[hit]
        self.last[at[hit]] = last[hit]
        gone = self.refs <= 0
        self.filter.delete(_hash(self.keys[gone]))
        self.keys, self.refs, self.last = self.keys[~gone], self.refs[~gone], self.last[~gone]

    def state(self, shard: int) -> pa.Table:
        row = {"shard": shard, "filter": self.filter.table.tobytes(), "keys": self.keys.astype("S16").tobytes(), "refs": self.refs.tobytes(), "last": self.last.tobytes()}
        return pa.Table.from_pylist([row], _STATE)


_STATE = pa.schema([("shard", pa.int32()), ("filter", pa.binary()), ("keys", pa.binary()), ("refs", pa.binary()), ("last", pa.binary())])
_STATE_DDL = "shard int, filter binary, keys binary, refs binary, last binary"
_ARRIVAL_DDL = "shard int, key binary, refs long, last long"


def _postings(min_chars: int):
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            raw, ends = flat(t["text"])
            whole = raw.tobytes().translate(_LOWER)
            keys: list[bytes] = []
            counts = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = {k for k in keys_of(whole[a:b], min_chars) if k is not None}
                keys += sorted(own)
                counts.append(len(own))
            yield batch(schema, keys, np.repeat(t["doc_id"].to_numpy(), counts))

    return run


def _key_array(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Sixteen-byte digests as an array; a digest's trailing zeros are padding either way."""
    raw, _ = flat(column)
    return np.frombuffer(raw.tobytes(), "S16")


def _combined(shards: int):
    schema = pa.schema([("shard", pa.int32()), ("key", pa.binary()), ("refs", pa.int64()), ("last", pa.int64())])

    def out(keys: list[np.ndarray], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        unique, code = np.unique(np.concatenate(keys), return_inverse=True)
        refs = np.bincount(code, minlength=len(unique))
        last = np.full(len(unique), np.iinfo(np.int64).min)
        np.maximum.at(last, code, np.concatenate(ids))
        shard = _shard_of(unique, shards)
        raw = pa.py_buffer(unique.tobytes())
        fixed = pa.Array.from_buffers(pa.binary(16), len(unique), [None, raw])
        yield from pa.Table.from_batches([batch(schema, shard, fixed, refs, last)]).to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, n = [], [], 0
        for b in batches:
            keys.append(_key_array(b["key"]))
            ids.append(b["doc_id"].to_numpy())
            n += b.num_rows
            if n >= COMBINED_KEYS:
                yield from out(keys, ids)
                keys, ids, n = [], [], 0
        if n:
            yield from out(keys, ids)

    return run


def _merged(key, arrivals: pa.Table, had: list[dict]) -> pa.Table:
    own = Shard(had[0] if had else None)
    if arrivals.num_rows:
        own.insert(_key_array(arrivals["key"]), arrivals["refs"].to_numpy(), arrivals["last"].to_numpy())
    return own.state(key[0].as_py())


def _first(key, arrivals):
    return _merged(key, arrivals, [])


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """A shard's keys stay together, or split by the factor, when the number of shards is multiplied."""
    return (mixed(_hash(keys) ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(shards)).astype(np.int32)


def _split(shards: int):
    """Each shard's table and filter as those of the shards that it becomes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                old = Shard(row)
                to = _shard_of(old.keys, shards)
                for shard in np.unique(to).tolist():
                    own, new = to == shard, Shard()
                    new.insert(old.keys[own], old.refs[own], old.last[own])
                    yield from new.state(shard).to_batches()

    return run


def _inserted(key, arrivals, states):
    return _merged(key, arrivals, states.to_pylist())


def _deleted(key, gone, states):
    own = Shard(next(iter(states.to_pylist()), None))
    if gone.num_rows:
        own.delete(_key_array(gone["key"]), gone["refs"].to_numpy(), gone["last"].to_numpy())
    return own.state(key[0].as_py())


class LineIndex:
    """Lines of the documents inserted so far and not deleted since."""

    def __init__(self, min_chars: int = MIN_CHARS):
        self.min_chars = min_chars
        self.postings: DataFrame | None = None
        self.shards: DataFrame | None = None
        self.n_shards = 0
        self.held = 0

    def insert(self, docs: DataFrame, arrivals: int = 1) -> LineIndex:
        """`docs` as from texts_of, in so many arrivals of one scan, dealt out by a hash of the id."""
        arrival = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)).cast("int").alias("arrival")
        new = written(docs.mapInArrow(_postings(self.min_chars), "key binary, doc_id long").select("*", arrival), "arrival")
        sizes = {r["arrival"]: r["n"] for r in new.groupBy("arrival").agg(F.count("*").alias("n")).collect()}
        for i in range(arrivals):
            self._arrive(new.where(F.col("arrival") == i).drop("arrival"), sizes.get(i, 0))
        new = new.drop("arrival")
        self.postings = new if self.postings is None else self.postings.unionByName(new)
        return self

    def _arrive(self, new: DataFrame, size: int) -> None:
        self.held += size
        if self.shards is None:
            self.n_shards = max(LEAST_SHARDS, size // SHARD_POSTINGS)
        elif self.held > 2 * self.n_shards * SHARD_POSTINGS:
            self.n_shards *= -(-self.held // (self.n_shards * SHARD_POSTINGS))
            self.shards = rewritten(self.shards.mapInArrow(_split(self.n_shards), _STATE_DDL), self.shards)
        arrived = new.mapInArrow(_combined(self.n_shards), _ARRIVAL_DDL).groupBy("shard")
        if self.shards is None:
            self.shards = written(arrived.applyInArrow(_first, _STATE_DDL))
        else:
            self.shards = rewritten(arrived.cogroup(self.shards.groupBy("shard")).applyInArrow(_inserted, _STATE_DDL), self.shards)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Take back documents: `ids` has their doc_id."""
        ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        gone = written(self.postings.join(ids, "doc_id", "left_semi").groupBy("key").agg(F.count("*").alias("refs")))
        left = written(self.postings.join(ids, "doc_id", "left_anti"))
        # either way a key that many documents hold is dealt out once a task: its largest id there
        touched = left.join(F.broadcast(gone.select("key")), "key", "left_semi") if gone.count() <= BROADCAST_KEYS else left
        still = touched.groupBy("key").agg(F.max("doc_id").alias("last"))
        lost = gone.join(still, "key", "left").select("key", "refs", F.coalesce("last", F.lit(-(1 << 63)).cast("long")).alias("last"))
        n = self.n_shards

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_shard_of(_key_array(b["key"]), n)), b["key"], b["refs"], b["last"]], ["shard", "key", "refs", "last"])

        by_shard = lost.mapInArrow(dealt, _ARRIVAL_DDL).groupBy("shard")
        self.shards = rewritten(by_shard.cogroup(self.shards.groupBy("shard")).applyInArrow(_deleted, _STATE_DDL), self.shards)
        self.postings = left
        return self

    def repeated(self, min_docs: int) -> DataFrame:
        """key and last of each key in min_docs documents or more, from the exact tables."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    own = Shard(row)
                    hit = own.refs >= min_docs
                    yield pa.RecordBatch.from_arrays([pa.array([k.ljust(16, b"\0") for k in own.keys[hit].tolist()], pa.binary()), pa.array(own.last[hit])], ["key", "last"])

        return self.shards.mapInArrow(run, "key binary, last long")

    def resolve(self, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
        """doc_id, n_lines, n_dropped and kept (text) of every row of `docs`, which was inserted before."""
        lost = self.postings.join(self.repeated(min_docs), "key").where("doc_id <> last")
        verdicts = lost.groupBy("doc_id").agg(F.array_join(F.collect_list(F.hex("key")), "").alias("lost"))
        return docs.join(verdicts.hint("shuffle_hash"), "doc_id", "left").mapInArrow(_resolved(self.min_chars), _RESOLVED_DDL)


_RESOLVED = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.binary())])
_RESOLVED_DDL = "doc_id long, n_lines long, n_dropped long, kept binary"


def _resolved(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            raw, ends = flat(t["text"])
            whole = raw.tobytes()
            n_lines, n_dropped, kept = [], [], []
            for a, b, lost in zip(ends[:-1].tolist(), ends[1:].tolist(), t["lost"].to_pylist(), strict=True):
                text = whole[a:b]
                n_lines.append(text.count(b"\n") + 1)
                if lost:
                    digests = bytes.fromhex(lost)
                    gone = {digests[i : i + 16] for i in range(0, len(digests), 16)}
                    lines = text.split(b"\n")
                    stay = [x for x, k in zip(lines, keys_of(text.translate(_LOWER), min_chars), strict=True) if k not in gone]
                    n_dropped.append(len(lines) - len(stay))
                    text = b"\n".join(stay)
                else:
                    n_dropped.append(0)
                kept.append(text)
            yield batch(_RESOLVED, t["doc_id"].combine_chunks(), n_lines, n_dropped, kept)

    return run


def op3_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, in arrivals; some are taken back and inserted again, which leaves every count as it was."""
    docs = texts_of(table(spark, sf_dir, "documents"))
    index = LineIndex().insert(docs, ARRIVALS)
    again = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(WITHDRAWN)) == 0)
    index.delete(again.select("doc_id")).insert(again)
    return index.resolve(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS MATERIALIZED (
  SELECT r, doc_id, i, line, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS key
  FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM numbered)
),
held AS (SELECT key, count(DISTINCT r) AS n, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key),
judged AS (
  SELECT l.*, h.key IS NOT NULL AS gone FROM lines l LEFT JOIN held h ON h.key = l.key AND h.n >= 3 AND l.doc_id <> h.last
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
