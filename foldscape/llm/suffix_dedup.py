"""Operator 10: removal of repeated passages by a logarithmic family of suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts earlier, in a
document of smaller id or further left in the same one. What has to be found is
which windows of LENGTH bytes occurred before.

Windows meet where they share text. Each window is named after the GRAM-byte
string of least hash within it, its anchor, which any other window of the same
bytes has at the same place. Neighbouring windows of one anchor form a segment,
so a document has a segment for every 30 bytes or so, and equal windows are
always in segments of one anchor. Anchors are dealt out to shards, and a shard
keeps the suffixes that it gets in a family of levels: a new batch, in document
order, is sorted into an array of suffixes; the array is merge-scanned against
each level for long matches; what is new becomes a level, and levels of like size
are merged into one of twice the size.

The family works twice, the second time on very little:

1. On sampled suffixes: one for each segment, by a 120-bit fingerprint of all its
   bytes. A segment that occurred before is a match from end to end. An anchor that
   one segment alone has ends here, as almost all do.
2. On the text of the segments whose anchor has others that differ, which is at
   the edges of what is repeated: all their windows are suffixes, bounded at LENGTH
   bytes, in arrays sorted and compared byte by byte.

Chunks post equal segments once, so a passage that a third of all documents share
arrives at its shard once a chunk; copies found within a chunk go to their own
documents. Segments of an anchor with more than HOT variants are dealt out window
by window, by content. Texts move to meet their verdicts by doc_id alone.

Null and empty texts lose nothing, nor do texts shorter than LENGTH. Matches are
judged on the input, never cross documents, and overlaps count. Rows that repeat
both id and text are the same place: neither is earlier, and both get the same
row. Different texts of one doc_id are different documents, in the order of a hash.
Rows without a doc_id are left out. An empty table gives no rows. cut_repeats()
keeps further columns, whatever their names; the others prune them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldscape.llm.common import BYTE_CODE, batch, chunks, flat, free_name, mixed, ragged, table, texts_of, undotted, written

LENGTH = 100
GRAM = 32
GRAMS = LENGTH - GRAM + 1
#: Input bytes that a shard is planned for; the number of shards grows with the input.
SHARD_BYTES = 4 << 20
LEAST_SHARDS = 512
#: Suffixes in a batch of the family, and starting positions worked on at once.
BATCH, BLOCK = 1 << 12, 1 << 20
#: Variants of an anchor beyond which its windows are dealt out one by one.
HOT = 4096
_POSITION = np.uint64((1 << 24) - 1)


def gram_hash(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling."""
    h, base, size = BYTE_CODE[raw], 0x9E3779B97F4A7C15, 1
    while size < GRAM:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base % (1 << 64), 2 * size
    return mixed(h)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` values from each position on."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[: -(width - size)], values[width - size :]) if size < width else values


def segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, start in it, number of windows, anchor and fingerprint of each segment, in order."""
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(raw) - LENGTH + 1), BLOCK):
        part = raw[at : at + BLOCK + LENGTH - 1]
        grams = gram_hash(part)
        place = np.arange(len(grams), dtype=np.uint64)
        anchor = (least((grams & ~_POSITION) | place, GRAMS) & _POSITION).astype(np.int64)
        start = np.arange(len(anchor)) + at
        text = np.searchsorted(offsets, start, side="right") - 1
        inside = start + LENGTH <= offsets[text + 1]
        anchor, start, text = anchor[inside], start[inside], text[inside]
        if not len(start):
            continue
        head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)))
        windows = np.diff(np.append(head, len(start)))
        first = start[head] - at
        last = first + windows - 1
        mark = windows.astype(np.uint64)
        for g in (first, first + 32, first + 64, first + 68, last + 32, last + 64, last + 68):  # these grams cover every byte
            mark = mixed(mark * np.uint64(0xD1342543DE82EF95) + grams[g])
        found.append((text[head], start[head] - offsets[text[head]], windows, grams[anchor[head]], mark))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Levels:
    """Sorted arrays of distinct suffixes, each level at least twice the size of the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, batch_of: np.ndarray) -> np.ndarray:
        """Which suffixes of the batch, in order, occurred before: in a level, or further up in the batch."""
        order = np.argsort(batch_of, kind="stable")
        array = batch_of[order]
        head = np.append(True, array[1:] != array[:-1]) if len(array) else np.zeros(0, bool)
        before = np.ones(len(array), bool)
        before[order[head]] = False
        fresh, places = array[head], order[head]
        for level in self.levels:  # a merge-scan: both sides are sorted
            at = np.minimum(np.searchsorted(level, fresh), len(level) - 1)
            hit = level[at] == fresh
            before[places[hit]] = True
            fresh, places = fresh[~hit], places[~hit]
        if len(fresh):
            self.levels.append(fresh)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self.levels[-2:] = [np.sort(np.concatenate(self.levels[-2:]), kind="stable")]
        return before


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


_DEALT = pa.schema([("key", pa.int32()), ("data", pa.binary())])
_DEALT_DDL = "key int, data binary"
_POSTED = np.dtype([("doc", "<i8"), ("start", "<u4"), ("windows", "u1"), ("anchor", "<u8"), ("mark", "<u8")])
#: windows + ASKED: the segment's text is asked for; + SPREAD: window by window.
_VERDICT = np.dtype([("doc", "<i8"), ("start", "<u4"), ("windows", "<u2")])
ASKED, SPREAD = 256, 512


def dealt(keys: np.ndarray, rows: np.ndarray) -> list[tuple[int, bytes]]:
    """Rows of each key, as bytes."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    stop = np.append(head[1:], len(keys))
    return [(int(keys[a]), rows[a:b].tobytes()) for a, b in zip(head.tolist(), stop.tolist()[: len(head)], strict=True)]


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return batch(_DEALT, [k for k, _ in rows], [d for _, d in rows])


def _verdicts(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), _VERDICT)
    out["doc"], out["start"], out["windows"] = doc, start, windows
    return out


def _posted(shards: int):
    """Segments to their anchor's shard; those that repeat within the chunk, to their document's bucket beyond the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            text, start, windows, anchor, mark = segments(*flat(t["text"]))
            ids = t["doc_id"].to_numpy()
            rows = np.empty(len(text), _POSTED)
            rows["doc"], rows["start"], rows["windows"], rows["anchor"], rows["mark"] = ids[text], start, windows, anchor, mark
            order = np.lexsort((start, ids[text], mark, anchor))
            rows = rows[order]
            same = (rows["anchor"][1:] == rows["anchor"][:-1]) & (rows["mark"][1:] == rows["mark"][:-1])
            again = np.append(False, same) if len(rows) else np.zeros(0, bool)
            # a repeated row of the same place isn't later than itself
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(rows)))) if len(rows) else np.zeros(0, np.int64)
            itself = (rows["doc"] == rows["doc"][head]) & (rows["start"] == rows["start"][head])
            late = rows[again & ~itself]
            rows = rows[~again]
            out = dealt((rows["anchor"] % np.uint64(shards)).astype(np.int64), rows)
            out += dealt(shards + bucket_of(late["doc"], shards), _verdicts(late["doc"], late["start"], late["windows"]))
            if out:
                yield _batch(out)

    return run


def _sampled(shards: int):
    """The first family: which posted segments occurred before, and which are to be looked at by their text."""

    def run(key, rows):
        own, data = key[0].as_py(), b"".join(rows["data"].to_pylist())
        if own >= shards:
            return pa.Table.from_batches([_batch([(own - shards, data)])])
        posted = np.frombuffer(data, _POSTED)
        posted = posted[np.lexsort((posted["mark"], posted["start"], posted["doc"]))]
        posted = posted[np.append(True, posted[1:] != posted[:-1])]  # rows that repeat id and text
        _, code, count = np.unique(posted["anchor"], return_inverse=True, return_counts=True)
        posted = posted[count[code] > 1]
        suffix = np.empty((len(posted), 2), ">u8")
        suffix[:, 0], suffix[:, 1] = posted["anchor"], posted["mark"]
        suffix = suffix.reshape(-1).view("S16") if len(posted) else np.zeros(0, "S16")
        levels, before = Levels(), np.zeros(len(posted), bool)
        for a in range(0, len(posted), BATCH):
            before[a : a + BATCH] = levels.add(suffix[a : a + BATCH])
        first = posted[~before]
        _, code, variants = np.unique(first["anchor"], return_inverse=True, return_counts=True)
        several = variants[code] > 1 if len(first) else np.zeros(0, bool)
        flag = np.where(variants[code[several]] > HOT, ASKED + SPREAD, ASKED) if several.any() else 0
        asked = first[several]
        late = posted[before]
        out = np.concatenate([_verdicts(late["doc"], late["start"], late["windows"]), _verdicts(asked["doc"], asked["start"], asked["windows"] + flag)])
        return pa.Table.from_batches([_batch(dealt(bucket_of(out["doc"], shards), out))])

    return run


_BY_DOC = pa.schema([("doc_id", pa.int64()), ("late", pa.binary()), ("asked", pa.binary())])
_BY_DOC_DDL = "doc_id long, late binary, asked binary"
_SPAN = np.dtype([("start", "<u4"), ("windows", "<u2")])


def _by_doc(key, rows):
    """Verdicts of a bucket as one row a document: repeated windows, and segments that are asked for."""
    all_of = np.frombuffer(b"".join(rows["data"].to_pylist()), _VERDICT)
    all_of = all_of[np.lexsort((all_of["start"], all_of["doc"]))]
    head = np.flatnonzero(np.append(True, all_of["doc"][1:] != all_of["doc"][:-1])) if len(all_of) else []
    out = []
    for a, b in zip(head, [*head[1:], len(all_of)], strict=False):
        own = np.empty(int(b - a), _SPAN)
        own["start"], own["windows"] = all_of["start"][a:b], all_of["windows"][a:b]
        asked = own["windows"] >= ASKED
        out.append((int(all_of["doc"][a]), own[~asked].tobytes(), own[asked].tobytes() if asked.any() else None))
    return pa.Table.from_batches([batch(_BY_DOC, *([list(c) for c in zip(*out, strict=True)] or [[]] * 3))])


_TEXTS = pa.schema([("shard", pa.int32()), ("places", pa.binary()), ("data", pa.binary())])
_TEXTS_DDL = "shard int, places binary, data binary"


def _asked(shards: int):
    """The text of the segments that are asked for, to the shard of their anchor (or, spread, of each window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            raw, offsets = flat(t["text"])
            ids = t["doc_id"].to_numpy()
            spans = [np.frombuffer(x, _SPAN) for x in t["asked"].to_pylist()]
            text = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
            every = np.concatenate(spans) if spans else np.zeros(0, _SPAN)
            windows, spread = every["windows"] % ASKED, every["windows"] >= ASKED + SPREAD
            at = offsets[text] + every["start"]
            # spread segments become one segment a window
            size = np.where(spread, windows, 1).astype(np.int64)
            part = np.repeat(np.arange(len(at)), size)
            at = ragged(at, size)
            windows = np.where(spread[part], 1, windows[part]).astype(np.int64)
            if not len(at):
                continue
            length = windows + LENGTH - 1
            data = raw[ragged(at, length)]
            begin = np.cumsum(length) - length
            # any hash that equal windows share will do: the anchor's, or the window's own
            key = np.empty(len(at), np.uint64)
            for a in range(0, len(at), 1 << 12):
                key[a : a + (1 << 12)] = _anchor_of(data, begin[a : a + (1 << 12)])
            own = spread[part]
            if own.any():
                key[own] = _window_of(data, begin[own])
            shard = (key % np.uint64(shards)).astype(np.int64)
            place = _verdicts(ids[text[part]], at - offsets[text[part]], windows)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            out = []
            for s in np.flatnonzero(np.diff(cut)).tolist():
                o = order[cut[s] : cut[s + 1]]
                out.append((s, place[o].tobytes(), data[ragged(begin[o], length[o])].tobytes()))
            yield batch(_TEXTS, *([list(c) for c in zip(*out, strict=True)]))

    return run


def _anchor_of(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The least gram hash in the window at each place: equal for all windows of a segment, by how segments are cut."""
    grams = gram_hash(data[ragged(begin, np.full(len(begin), LENGTH))])
    every = ragged(np.arange(len(begin)) * LENGTH, np.full(len(begin), GRAMS)).reshape(-1, GRAMS)
    own = grams[every]
    return own[np.arange(len(own)), (own & ~_POSITION).argmin(axis=1)]


def _window_of(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    window = data[ragged(begin, np.full(len(begin), LENGTH))].reshape(-1, LENGTH)
    h = np.zeros(len(begin), np.uint64)
    for i in range(LENGTH):
        h = mixed(h * np.uint64(0xD1342543DE82EF95) + BYTE_CODE[window[:, i]])
    return h


def _bounded(buckets: int):
    """The second family: suffixes bounded at LENGTH bytes, of every window of the texts asked for."""

    def run(key, rows):
        place = np.frombuffer(b"".join(rows["places"].to_pylist()), _VERDICT)
        data = np.frombuffer(b"".join(rows["data"].to_pylist()), np.uint8)
        length = place["windows"].astype(np.int64) + LENGTH - 1
        begin = np.cumsum(length) - length
        order = np.lexsort((place["start"], place["doc"]))
        order = order[np.append(True, place[order][1:] != place[order][:-1])]  # rows that repeat id and text
        place, begin = place[order], begin[order]
        windows = place["windows"].astype(np.int64)
        at = ragged(begin, windows)
        doc, start = np.repeat(place["doc"], windows), ragged(place["start"].astype(np.int64), windows)
        sliding = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
        levels, before = Levels(), np.zeros(len(at), bool)
        a = 0
        while a < len(at):
            suffix = np.ascontiguousarray(sliding[at[a : a + BATCH]]).view(f"S{LENGTH}").reshape(-1)
            before[a : a + BATCH] = levels.add(suffix)
            a += BATCH
        doc, start = doc[before], start[before]
        head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))) if len(doc) else np.zeros(0, np.int64)
        runs = np.diff(np.append(head, len(doc)))
        out = []
        while len(head):  # runs as verdicts of fewer than ASKED windows each
            some = np.minimum(runs, ASKED - 1)
            out.append(_verdicts(doc[head], start[head], some))
            more = runs > some
            head, runs = head[more] + some[more], runs[more] - some[more]
        found = np.concatenate(out) if out else np.zeros(0, _VERDICT)
        return pa.Table.from_batches([_batch(dealt(bucket_of(found["doc"], buckets), found))])

    return run


_CLEANED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
_CLEANED_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in chunks(batches):
        raw, offsets = flat(t["text"])
        edge = np.zeros(len(raw) + 1, np.int64)
        for a, late in zip(offsets.tolist(), t["late"].to_pylist(), strict=False):
            if late:
                own = np.frombuffer(late, _SPAN)
                np.add.at(edge, a + own["start"].astype(np.int64), 1)
                np.add.at(edge, a + own["start"].astype(np.int64) + own["windows"] + (LENGTH - 1), -1)
        gone = np.cumsum(edge)[:-1] > 0
        n_gone = np.concatenate([[0], np.cumsum(gone)])[offsets]
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(raw)]
        opens[firsts] = gone[firsts]
        n_open = np.concatenate([[0], np.cumsum(opens)])[offsets]
        left = raw[~gone].tobytes()
        ends = (offsets - n_gone).tolist()
        yield batch(_CLEANED, t["doc_id"].combine_chunks(), np.diff(offsets), np.diff(n_gone), np.diff(n_open), [left[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])


def _numbers(texts: DataFrame) -> DataFrame | None:
    """If a doc_id has several texts: place (a running number), doc_id and h of each text, in order of id and hash."""
    h = F.xxhash64("text")
    if texts.groupBy("doc_id").agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low <> high").isEmpty():
        return None
    each = texts.select("doc_id", h.alias("h")).distinct().repartitionByRange("doc_id", "h").withColumn("part", F.spark_partition_id())
    each = written(each.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "h"))))
    sizes = {r["part"]: r["n"] for r in each.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    before = [(p, sum(n for q, n in sizes.items() if q < p)) for p in sizes]
    starts = texts.sparkSession.createDataFrame(before, "part int, before long")
    return each.join(F.broadcast(starts), "part").select((F.col("before") + F.col("nth")).alias("place"), "doc_id", "h")


def repeats(texts: DataFrame) -> DataFrame:
    """place, h and late: the windows of each document that occurred before, as packed spans. `texts` as from texts_of.

    place is the doc_id; h is the hash of the text that is meant, and null if the id has no other.
    """
    numbers = _numbers(texts)
    if numbers is not None:
        texts = texts.withColumn("h", F.xxhash64("text")).join(numbers, ["doc_id", "h"]).select(F.col("place").alias("doc_id"), "text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(LEAST_SHARDS, size // SHARD_BYTES)
    posted = texts.mapInArrow(_posted(shards), _DEALT_DDL)
    sampled = posted.groupBy("key").applyInArrow(_sampled(shards), _DEALT_DDL)
    verdicts = written(sampled.groupBy("key").applyInArrow(_by_doc, _BY_DOC_DDL))
    asked = texts.join(verdicts.where("asked is not null").select("doc_id", "asked").hint("shuffle_hash"), "doc_id")
    found = (
        asked.mapInArrow(_asked(shards), _TEXTS_DDL).groupBy("shard").applyInArrow(_bounded(shards), _DEALT_DDL)
        .groupBy("key").applyInArrow(_by_doc, _BY_DOC_DDL)
    )
    late = (
        verdicts.select("doc_id", "late").unionByName(found.select("doc_id", "late"))
        .groupBy("doc_id").agg(F.array_join(F.transform(F.collect_list("late"), F.hex), "").alias("late"))
        .select(F.col("doc_id").alias("place"), F.unhex("late").alias("late"))
    )
    if numbers is None:
        return late.select("place", F.lit(None).cast("long").alias("h"), "late")
    return late.join(numbers, "place").select(F.col("doc_id").alias("place"), "h", "late")


def _with_late(docs: DataFrame, late: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with what is late of their texts, in a column whose name they don't have."""
    tag = free_name(docs.columns, "foldscape_")
    late = late.select(*[F.col(c).alias(tag + c) for c in late.columns]).hint("shuffle_hash")
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(late, (F.col("doc_id") == F.col(f"{tag}place")) & (F.col(f"{tag}h").isNull() | (F.col(f"{tag}h") == own)), "left").drop(f"{tag}place", f"{tag}h"), f"{tag}late"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of every row of `docs` that has a doc_id."""
    texts = texts_of(docs)
    joined, name = _with_late(texts, repeats(texts))
    return joined.withColumnRenamed(name, "late").mapInArrow(_cleaned, _CLEANED_DDL)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """`docs`, all columns, with what is left of each text and its n_chars.

    A cut may fall inside a character; the bytes that are left of it go too. Texts
    that lose nothing, nulls among them, and rows without a doc_id stay as they are.
    """
    plain = undotted(docs)
    names = plain.columns
    joined, late = _with_late(plain, repeats(texts_of(docs)).where("length(late) > 0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            texts, ids = pc.fill_null(t["text"], ""), pc.fill_null(t["doc_id"], 0).cast(pa.int64())
            once = pa.table({"doc_id": ids, "text": texts, "late": t[late]})
            kept = next(_cleaned(iter(once.combine_chunks().to_batches())))["kept"].to_pylist()
            lost = pc.is_valid(t[late]).to_pylist()
            left = [k.decode("utf-8", "ignore") if x else o for k, x, o in zip(kept, lost, t["text"].to_pylist(), strict=True)]
            out = t.select(names).set_column(names.index("text"), "text", pa.array(left, pa.string()))
            if "n_chars" in names:
                at = names.index("n_chars")
                n = [len(a) if x else o for a, x, o in zip(left, lost, t["n_chars"].to_pylist(), strict=True)]
                out = out.set_column(at, "n_chars", pa.array(n, t.schema.field("n_chars").type))
            yield from out.to_batches()

    return joined.select(*names, late).mapInArrow(run, plain.schema).toDF(*docs.columns)


def op10_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hexadecimal digits; a window is 2 * 100 of them.
SQL = r"""
WITH bytes AS (SELECT DISTINCT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (  -- of 500 windows each: substr() walks a string from its beginning
  SELECT doc_id, 500 * p AS base, least(500, length(h) // 2 - 99 - 500 * p) AS n, substr(h, 1000 * p + 1, 1198) AS h
  FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 + 400, 0) // 500)) AS p FROM bytes)
),
windows AS (
  SELECT doc_id, base + s AS s, md5(substr(h, 2 * s + 1, 200)) AS w FROM (SELECT doc_id, base, h, unnest(range(0, n)) AS s FROM pieces)
),
firsts AS (SELECT w, min((doc_id::HUGEINT << 40) + s) AS f FROM windows GROUP BY w),
late AS (SELECT doc_id, s FROM windows JOIN firsts USING (w) WHERE (doc_id::HUGEINT << 40) + s > f),
marked AS (SELECT doc_id, s, s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) + 100 AS opens FROM late),
grouped AS (SELECT doc_id, s, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM marked),
spans AS (SELECT doc_id, g, min(s) AS a, max(s) + 100 AS b FROM grouped GROUP BY doc_id, g),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id
),
kept AS (
  SELECT doc_id, string_agg(CASE WHEN g.b IS NULL THEN substr(h, 2 * g.a + 1) ELSE substr(h, 2 * g.a + 1, 2 * (g.b - g.a)) END, '' ORDER BY g.a) AS k
  FROM gaps g JOIN bytes USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM documents d JOIN bytes USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
