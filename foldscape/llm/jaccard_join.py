"""Operator 5: exact Jaccard join of word shingles in a metric space.

Jaccard distance is a metric: if two documents are within r of each other, their
distances to any third one, a pivot, differ by r at most. But almost all
documents of a corpus share nothing, and lie at distance 1 from every pivot, so
regions of pivots chosen at random would hold everything. Regions are therefore
opened only where distances below 1 can be:

1. Documents with the same set of shingles are one class, and its smallest id
   stands for it.
2. Shingle frequencies are counted exactly, over all classes, in shards of the
   shingle hash. A document that has a partner within r shares with it one of its
   n - ceil((1 - r) n) + 1 rarest shingles, in an order that is the same for all;
   the documents with such a shingle in common form a region, and the smallest is
   its pivot. Shingles of one document need no region, and never leave their shard.
3. Distances to the pivots are measured; documents within r of one are linked
   to it, and components of these links contracted. In a group of near copies
   that settles all but the boundary.
4. Regions that still hold several components are joined recursively. A region of
   REGION_DOCS documents or fewer is a task. A larger one is cut: pivots, a few for
   as many documents, create Voronoi regions; slices of its documents meet all of
   its pivots, are linked to those within r, and are replicated to each region whose
   pivot is not further than their own by more than 2r, which by the triangle
   inequality is wherever a partner can be. Those regions are joined in the same
   way, at the next level, by a shuffle; ones with a single component end.
5. Where pivots tell nothing apart (all distances alike, so that windows hold
   nearly everything), or few documents lie outside the largest component, a region
   is compared in blocks: only blocks of which one lies outside the largest
   component, and whose distances to a pivot and sizes allow a link.

In a task, documents are compared pivot by pivot, within windows of the distances
known so far, only across components, and only if the shingles that each of the
two has in common with any other document are enough. No task holds more than two
blocks, or a slice and the pivots.

Shingles are compared by 54 bits of a hash. Two different shingles of a pair
would have to agree in all of them to change its result.

Only links between different texts that connect something new need to be found
for the components; no pair of copies is expanded. Null, empty and blank texts
have no shingles and are linked with nothing, not even each other. Rows that
repeat a doc_id each get a row. Rows without a doc_id are left out. An empty
table gives no rows.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldscape.llm.common import LOWER, batch, chunks, flat, gram_hashes, mixed, span_hashes, table, texts_of, words_of, written
from foldscape.llm.graph import components

log = logging.getLogger("foldscape")

WORDS = 5
#: Similar if NUMERATOR * union <= DENOMINATOR * intersection.
NUMERATOR, DENOMINATOR = 3, 4
#: Shingles that one shard of the counting is planned for; the number of shards grows with the input.
SHARD_SHINGLES = 2_000_000
LEAST_SHARDS = 512
#: Documents of a region that is joined in one task; in a slice that meets a region's pivots; in a block.
REGION_DOCS, SLICE_DOCS, BLOCK_DOCS = 256, 512, 256
#: Pivots of a region at most (in the mean), levels of regions, and copies of a document beyond which cutting is of no use.
PIVOTS, LEVELS, COPIES = 64, 4, 2
#: Regions of so many documents are no longer cut within a task.
SMALL = 48
#: The largest distance of a link; the last digits of distances are rounded.
RADIUS = 1 - NUMERATOR / DENOMINATOR + 1e-9


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their text, sorted by both. `raw` with A-Z lowered."""
    starts, lengths, ends = words_of(raw, offsets)
    words = span_hashes(raw, starts, lengths)
    n = np.diff(ends)
    text = np.repeat(np.arange(len(n)), n)
    grams = gram_hashes(words, k)
    inside = text[k - 1 :] == text[: len(grams)] if len(grams) else np.zeros(0, bool)
    hashes, owner = [grams[inside]], [text[: len(grams)][inside]]
    for m in range(1, k):  # texts of fewer words: all of them as one
        short = np.flatnonzero(n == m)
        if len(short):
            h = np.full(len(short), m, np.uint64)
            for i in range(m):
                h = mixed(h * np.uint64(0x9FB21C651E98DF25) + words[ends[:-1][short] + i])
            hashes.append(h)
            owner.append(short)
    h, t = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], t[new]


def _sets(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and their texts, and of each text the number and a 128-bit digest (two columns) of its set."""
    raw, offsets = flat(t["text"])
    h, text = shingles(LOWER[raw], offsets)
    n = np.bincount(text, minlength=t.num_rows)
    sums = np.zeros((t.num_rows, 2), np.uint64)
    begin = np.concatenate([[0], np.cumsum(n)])[:-1]
    full = n > 0
    for i, salt in enumerate((0x2545F4914F6CDD1D, 0x6C62272E07BB0142)):
        sums[full, i] = np.add.reduceat(mixed(h ^ np.uint64(salt)), begin[full]) if full.any() else 0
    return h, text, n, sums


_SIZES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64())])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in chunks(batches):
        _, _, n, sums = _sets(t)
        yield batch(_SIZES, t["doc_id"].combine_chunks(), n, sums[:, 0].copy().view(np.int64), sums[:, 1].copy().view(np.int64))


_POSTINGS = pa.schema([("shard", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())])
_REPLIES = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("tokens", pa.binary()), ("dfs", pa.binary())])


def _cut(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each key from 0 to n begins in the sorted `keys`."""
    return np.searchsorted(keys, np.arange(n + 1))


def _postings(shards: int):
    """The shingles of each chunk by shard: ids of the documents there, how many each has, and 48 bits of each.

    Of texts with the same set, the chunk posts that of the smallest id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            h, text, n, sums = _sets(t)
            ids = t["doc_id"].to_numpy()
            order = np.lexsort((ids, sums[:, 1], sums[:, 0], n))
            posts = np.ones(len(ids), bool)
            same = (n[order][1:] == n[order][:-1]) & (sums[order][1:] == sums[order][:-1]).all(axis=1)
            posts[order[1:][same]] = False
            h, text = h[posts[text]], text[posts[text]]
            shard = (h % np.uint64(shards)).astype(np.int32)
            order = np.lexsort((text, shard))
            shard, text = shard[order], text[order]
            low = (h[order] // np.uint64(shards)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            cut = _cut(shard, shards)
            rows = []
            for s in np.flatnonzero(np.diff(cut)).tolist():
                a, b = int(cut[s]), int(cut[s + 1])
                head = np.flatnonzero(np.append(True, text[a + 1 : b] != text[a : b - 1]))
                counts = np.diff(np.append(head, b - a))
                rows.append((s, ids[text[a:b][head]].tobytes(), counts.astype("<u4").tobytes(), low[a:b].tobytes()))
            if rows:
                yield batch(_POSTINGS, *(list(c) for c in zip(*rows, strict=True)))

    return run


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _replies(buckets: int):
    """The shingles of a shard that two posted texts or more have, with their frequency, to their documents' buckets."""

    def run(key, rows):
        shard = key[0].as_py()
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in rows["ids"].to_pylist()])
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in rows["counts"].to_pylist()])
        low = np.frombuffer(b"".join(rows["tokens"].to_pylist()), np.uint8).reshape(-1, 6)
        token = np.zeros((len(low), 8), np.uint8)
        token[:, :6] = low
        token = token.view("<u8").reshape(-1)
        doc = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(token)
        token = token[order]
        head = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        df = np.repeat(np.diff(np.append(head, len(token))), np.diff(np.append(head, len(token))))
        shared = df > 1
        token = (token[shared] << np.uint64(14)) + np.uint64(shard % (1 << 14)) if len(token) else token
        df, owner = df[shared], ids[doc[order[shared]]]
        bucket = bucket_of(owner, buckets)
        order = np.argsort(bucket, kind="stable")
        cut = _cut(bucket[order], buckets)
        found = []
        for s in np.flatnonzero(np.diff(cut)).tolist():
            o = order[cut[s] : cut[s + 1]]
            found.append((s, owner[o].tobytes(), token[o].tobytes(), df[o].astype("<u4").tobytes()))
        columns = [list(c) for c in zip(*found, strict=True)] if found else [[]] * 4
        return pa.Table.from_batches([batch(_REPLIES, *columns)])

    return run


_CANDIDATES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("shared", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])
_CANDIDATES_DDL = "doc_id long, n long, shared array<long>, prefix array<long>"


def _candidates(key, replies, sizes):
    """Documents with a shared shingle among their rarest ones: all their shared shingles, and those of the prefix."""
    size_ids, size_n = sizes["doc_id"].to_numpy(), sizes["n"].to_numpy()
    order = np.argsort(size_ids)
    size_ids, size_n = size_ids[order], size_n[order]
    empty = pa.Table.from_batches([batch(_CANDIDATES, [], [], [], [])])
    if not replies.num_rows or not len(size_ids):
        return empty
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in replies["ids"].to_pylist()])
    tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in replies["tokens"].to_pylist()])
    dfs = np.concatenate([np.frombuffer(x, "<u4") for x in replies["dfs"].to_pylist()])
    at = np.minimum(np.searchsorted(size_ids, ids), len(size_ids) - 1)
    own = size_ids[at] == ids  # others have a copy with a smaller id
    ids, tokens, dfs, n = ids[own], tokens[own], dfs[own], size_n[at[own]]
    order = np.lexsort((tokens, dfs, ids))
    ids, tokens, n = ids[order], tokens[order], n[order]
    if not len(ids):
        return empty
    once = np.append(True, (ids[1:] != ids[:-1]) | (tokens[1:] != tokens[:-1]))  # rows that repeat an id post twice
    ids, tokens, n = ids[once], tokens[once], n[once]
    head = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    count = np.diff(np.append(head, len(ids)))
    n = n[head]
    prefix = n - -(-n * NUMERATOR // DENOMINATOR) + 1
    rare = prefix - (n - count)  # shared shingles in the prefix
    rows = []
    tokens = tokens.view(np.int64)
    for i in np.flatnonzero(rare > 0).tolist():
        a, b = int(head[i]), int(head[i] + count[i])
        rows.append((int(ids[a]), int(n[i]), tokens[a:b], tokens[a : a + int(rare[i])]))
    return pa.Table.from_batches([batch(_CANDIDATES, *(list(c) for c in zip(*rows, strict=True)))]) if rows else empty


class Region:
    """Documents of a region with their shared shingles; links() finds what connects their components."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, comps: np.ndarray, sets: list[np.ndarray]):
        self.ids, self.n = ids, n.astype(np.int64)
        self.count = np.array([len(s) for s in sets], np.int64)
        self.begin = np.cumsum(self.count) - self.count
        _, self.tokens = np.unique(np.concatenate(sets), return_inverse=True)
        self.vocabulary = int(self.tokens.max()) + 1 if len(self.tokens) else 0
        self.parent = np.unique(comps, return_inverse=True)[1]
        self.found: list[tuple[int, int]] = []

    def common(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Shared shingles of the pivot and each other."""
        mark = np.zeros(self.vocabulary + 1, np.int64)
        mark[self.tokens[self.begin[pivot] : self.begin[pivot] + self.count[pivot]]] = 1
        lengths = self.count[others]
        at = np.arange(int(lengths.sum())) + np.repeat(self.begin[others] - (np.cumsum(lengths) - lengths), lengths)
        return np.bincount(np.repeat(np.arange(len(others)), lengths), weights=mark[self.tokens[at]], minlength=len(others)).astype(np.int64)

    def measure(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Distances to the pivot; documents within r are linked to it if that connects something."""
        both = self.common(pivot, others)
        union = self.n[others] + self.n[pivot] - both
        for x in others[DENOMINATOR * both >= NUMERATOR * union].tolist():
            if self.parent[x] != self.parent[pivot]:
                self.found.append((pivot, x))
                self.parent[self.parent == self.parent[x]] = self.parent[pivot]
        return 1 - both / union

    def links(self) -> list[tuple[int, int]]:
        self.join(np.arange(len(self.ids)), RADIUS)
        return [(int(self.ids[a]), int(self.ids[b])) for a, b in self.found]

    def join(self, docs: np.ndarray, r: float) -> None:
        if len(np.unique(self.parent[docs])) < 2:
            return
        if len(docs) <= SMALL:
            return self.scan(docs, r)
        pivots = docs[np.linspace(0, len(docs) - 1, max(2, int(len(docs) ** 0.5) // 2)).astype(np.int64)]
        distance = np.stack([self.measure(int(p), docs) for p in pivots])
        nearest = distance.min(axis=0)
        regions = [docs[row <= nearest + 2 * r] for row in distance]
        if sum(map(len, regions)) > 2 * len(docs):  # the windows hold nearly everything: cutting would only repeat work
            return self.scan(docs, r)
        for own in regions:
            self.join(own, r)
        return None

    def scan(self, docs: np.ndarray, r: float) -> None:
        """Each document in turn as the pivot of those behind it, within a window of distances to the first one."""
        far = self.measure(int(docs[0]), docs)
        for i in range(1, len(docs) - 1):
            p, rest = int(docs[i]), docs[i + 1 :]
            most = np.minimum(self.count[rest], self.count[p])  # shingles that the two can have in common
            enough = DENOMINATOR * most >= NUMERATOR * (self.n[rest] + self.n[p] - most)
            near = (np.abs(far[i + 1 :] - far[i]) <= r) & (self.parent[rest] != self.parent[p]) & enough
            if near.any():
                self.measure(p, rest[near])


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _region(rows: pa.Table) -> Region:
    return Region(rows["doc_id"].to_numpy(), rows["n"].to_numpy(), rows["component"].to_numpy(), [np.asarray(x, np.int64) for x in rows["shared"].to_pylist()])


def _region_links(rows):
    found = _region(rows).links()
    return pa.Table.from_batches([batch(_LINKS, [a for a, _ in found], [b for _, b in found])])


#: sub: a region below this one that the document is in; null for a link (doc_id to other).
_CUT = pa.schema([("a", pa.int64()), ("sub", pa.int64()), ("doc_id", pa.int64()), ("component", pa.int64()), ("other", pa.int64()), ("bin", pa.int32()), ("own", pa.bool_())])
_CUT_DDL = "a long, sub long, doc_id long, component long, other long, bin int, own boolean"


def _cut_region(rows):
    """Documents of a slice against all pivots of their region: links, and the Voronoi regions that they are in."""
    region, a = _region(rows), rows["a"][0].as_py()
    pivot = rows["pivot"].to_numpy(zero_copy_only=False)
    pivots, docs = np.flatnonzero(pivot), np.flatnonzero(~pivot)
    pivots = pivots[np.argsort(region.ids[pivots])]
    distance = np.stack([region.measure(int(p), docs) for p in pivots])
    inside = distance <= distance.min(axis=0) + 2 * RADIUS
    at, to = np.nonzero(inside)
    sub = mixed((np.uint64(a % (1 << 64)) * np.uint64(0x9E3779B97F4A7C15)) ^ region.ids[pivots].view(np.uint64)).view(np.int64)
    bins = (distance[0] / RADIUS).astype(np.int32)  # partners are in neighbouring bins
    comps = rows["component"].to_numpy()
    links = region.found
    n, k = len(at), len(links)
    return pa.Table.from_batches([batch(
        _CUT, np.full(n + k, a), pa.array([*sub[at].tolist(), *[None] * k], pa.int64()),
        np.concatenate([region.ids[docs[to]], [region.ids[x] for x, _ in links]]).astype(np.int64),
        pa.array([*comps[docs[to]].tolist(), *[None] * k], pa.int64()), pa.array([*[None] * n, *[int(region.ids[y]) for _, y in links]], pa.int64()),
        np.concatenate([bins[to], np.zeros(k, np.int32)]), np.concatenate([at == distance.argmin(axis=0)[to], np.zeros(k, bool)]),
    )])


def _several(members: DataFrame) -> DataFrame:
    """Members (a, doc_id, component) of regions with several components; the largest is the region's home."""
    each = members.groupBy("a", "component").agg(F.count("*").alias("m"))
    home = each.groupBy("a").agg(F.max(F.struct("m", "component")).alias("home"), F.sum("m").alias("docs"), F.count("*").alias("comps")).where("comps > 1")
    facts = home.select("a", F.col("home.component").alias("home"), "docs", (F.col("docs") - F.col("home.m")).alias("outs"))
    return members.join(facts, "a").select("a", "doc_id", "component", "docs", "outs", (F.col("component") != F.col("home")).alias("out"))


def _cut_regions(wide: DataFrame, found: DataFrame, level: int) -> DataFrame:
    """Rows of _CUT for regions (as from _several), by slices."""
    draw = F.xxhash64("doc_id", "a", F.lit(level))
    least = wide.groupBy("a").agg(F.min_by("doc_id", draw).alias("first"))
    k = F.least(F.lit(PIVOTS), F.ceil(2 * F.col("docs") / REGION_DOCS))
    drawn = wide.join(least, "a").withColumn("pivot", (F.col("doc_id") == F.col("first")) | (F.pmod(draw, F.ceil(F.col("docs") / k)) == 0))
    slices = F.ceil(F.col("docs") / SLICE_DOCS).cast("int")
    docs = drawn.select("a", F.pmod(F.xxhash64("doc_id"), slices).cast("int").alias("slice"), F.lit(False).alias("pivot"), "doc_id", "component")
    pivots = drawn.where("pivot").select("a", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(True).alias("pivot"), "doc_id", "component")
    return docs.unionByName(pivots).join(found, "doc_id").groupBy("a", "slice").applyInArrow(_cut_region, _CUT_DDL)


def _by_blocks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Links of regions (a, doc_id, component, out, bin), a pair of blocks a task."""
    own = docs.join(found.select("doc_id", "n"), "doc_id").withColumn("kind", F.floor(F.log(1.34, "n")).cast("int"))  # partners are in neighbouring kinds
    cells = own.groupBy("a", "out", "bin", "kind").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("blocks"))
    own = own.join(cells, ["a", "out", "bin", "kind"]).withColumn("block", F.pmod(F.xxhash64("doc_id", "a"), F.col("blocks")).cast("int"))
    one, two = (cells.select("a", *[F.col(c).alias(f"{c}{i}") for c in ("out", "bin", "kind", "blocks")]) for i in (1, 2))
    near = one.where("out1").join(two, "a").where("abs(bin1 - bin2) <= 1 and abs(kind1 - kind2) <= 1 and (not out2 or struct(bin1, kind1) <= struct(bin2, kind2))")
    same = F.expr("out2 and bin1 = bin2 and kind1 = kind2")
    each = near.withColumn("same", same).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks1") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
    tasks = each.where("not same or i <= j").withColumn("task", F.xxhash64("out2", "bin1", "kind1", "i", "bin2", "kind2", "j"))
    left = tasks.select("a", "task", F.lit(True).alias("out"), F.col("bin1").alias("bin"), F.col("kind1").alias("kind"), F.col("i").alias("block"))
    right = tasks.where("not same or i < j").select("a", "task", F.col("out2").alias("out"), F.col("bin2").alias("bin"), F.col("kind2").alias("kind"), F.col("j").alias("block"))
    dealt = own.join(left.unionByName(right), ["a", "out", "bin", "kind", "block"]).select("a", "task", "doc_id", "component")
    return dealt.join(found, "doc_id").groupBy("a", "task").applyInArrow(_region_links, "a long, b long")


def region_links(members: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) that connect the components of each region; members (a, doc_id, component), found (doc_id, n, shared)."""
    links = []
    for level in range(LEVELS + 1):
        live = written(_several(members))
        if live.isEmpty():
            break
        small, large = live.where(F.col("docs") <= REGION_DOCS), live.where(F.col("docs") > REGION_DOCS)
        links.append(written(small.join(found, "doc_id").select("a", "doc_id", "n", "component", "shared").groupBy("a").applyInArrow(_region_links, "a long, b long")))
        if large.isEmpty():
            break
        uncut = (F.col("outs") <= REGION_DOCS) | F.lit(level == LEVELS)
        links.append(written(_by_blocks(large.where(uncut).withColumn("bin", F.lit(0)), found)))
        wide = large.where(~uncut)
        cut = written(_cut_regions(wide, found, level))
        links.append(cut.where("sub is null").select(F.col("doc_id").alias("a"), F.col("other").alias("b")))
        subs = cut.where("sub is not null")
        sums = subs.groupBy("a").agg(F.count("*").alias("copies"), F.count_if("own").alias("docs"))
        stuck = sums.where(F.col("copies") > COPIES * F.col("docs")).select("a")
        same = subs.where("own").join(stuck, "a").select("a", "doc_id", "bin")
        links.append(written(_by_blocks(wide.join(same, ["a", "doc_id"]), found)))
        members = subs.join(stuck, "a", "left_anti").select(F.col("sub").alias("a"), "doc_id", "component")
        log.info("level %d: %d regions cut, %d of them compared in blocks, %d links", level, sums.count(), stuck.count(), sum(x.count() for x in links[-3:]))
    out = links[0] if links else members.select("a", F.col("doc_id").alias("b")).limit(0)
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (n, f1, f2, doc_id: its smallest), and links (a, b) between such ids that connect all components.

    `docs` as from texts_of. Also returned first: sizes, one row (doc_id, n, f1, f2) a document.
    """
    sizes = written(docs.mapInArrow(_sizes, "doc_id long, n long, f1 long, f2 long"))
    classes = written(sizes.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("doc_id")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(LEAST_SHARDS, total // SHARD_SHINGLES)
    replies = (
        docs.mapInArrow(_postings(shards), "shard int, ids binary, counts binary, tokens binary")
        .groupBy("shard").applyInArrow(_replies(shards), "bucket int, ids binary, tokens binary, dfs binary")
    )

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(b["doc_id"].to_numpy(), shards)), b["doc_id"], b["n"]], ["bucket", "doc_id", "n"])

    own = classes.select("doc_id", "n").mapInArrow(bucketed, "bucket int, doc_id long, n long")
    found = written(replies.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(_candidates, _CANDIDATES_DDL))
    members = found.select("doc_id", "n", F.explode("prefix").alias("token"))
    pivots = (
        members.groupBy("token").agg(F.min(F.struct("doc_id", "n")).alias("pivot"), F.max("doc_id").alias("last"))
        .where("pivot.doc_id < last").select("token", F.col("pivot.doc_id").alias("a"), F.col("pivot.n").alias("na"))
    )
    # regions of the same pivot are one: whoever shares a rare shingle with it that nobody smaller has
    regions = written(members.join(pivots, "token").select("a", "na", "doc_id", "n").distinct())
    pairs = regions.where(f"doc_id <> a and {DENOMINATOR} * least(n, na) >= {NUMERATOR} * greatest(n, na)").select("a", F.col("doc_id").alias("b"))
    left = found.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = found.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("both"))
    stars = written(both.where(f"{DENOMINATOR} * both >= {NUMERATOR} * (na + nb - both)").select("a", "b"))
    settled = components(stars)
    rest = written(regions.join(settled.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("a", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    return sizes, classes, stars.unionByName(region_links(rest, found.select("doc_id", "n", "shared")).distinct())


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`."""
    sizes, classes, links = jaccard_links(texts_of(docs))
    named = classes.join(components(links).withColumnRenamed("node", "doc_id"), "doc_id", "left").select("n", "f1", "f2", F.coalesce("component", "doc_id").alias("component"))
    return sizes.join(named, ["n", "f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The smallest doc_id of each component, with all columns of `docs`; rows without a doc_id go."""
    stays = jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stays.hint("shuffle_hash"), "doc_id", "left_semi")


def op5_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
),
sets AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
