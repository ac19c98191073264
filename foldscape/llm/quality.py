"""Operator 4: quality rules by the log-likelihood ratio of hashed n-grams.

Words and pairs of neighbouring words are hashed into buckets. One multinomial
is counted over a trusted target (every labelled row of quality 1), the other
over every document of the raw corpus. A document's score is the mean, over its
n-grams, of log p(target) - log p(raw): length-normalised.

The score counts a document in the models that judge it, so it favours labelled
rows over equally clean ones without a label. The verdict is made on held_score:
there equal texts count once in both models, and a text's own n-grams are taken
out of both before it is scored. A document is kept if it passes the base rules
and its held_score is at least THRESHOLD, a fixed number: the same document gets
the same verdict in every run over the same corpus.

Three scans: the first counts equal texts by a 64-bit hash, the second sends the
buckets of each task to the sum, SPAN of them in a compressed row, the third only scores. What the driver
holds are the models. The number of buckets grows with the corpus, to a bound that
keeps the models small enough to send. Texts that the target holds or that occur
more than once meet the second scan as a broadcast of their hashes, up to
BROADCAST_GROUPS; beyond, as a join that shuffles texts. The third scores a text
both as one that the target holds and as one that it doesn't; which of them counts
is joined to its row afterwards, the same way.

Null and empty texts have no words: counts of 0, score 0.0, and they fail the
base rules. Repeated rows each get a row. Rows without a doc_id are left out of
the result and the counts. Without any target row no ratio can be formed: all
scores are 0.0 and only the base rules decide. Labels with nulls count as unlabelled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from foldscape.llm.common import batch, chunks, flat, free_name, gram_hashes, ragged, span_hashes, table, texts_of, undotted, words_of, written

#: Buckets are a power of two, near BUCKETS times the root of the corpus's bytes (as the number of distinct n-grams grows,
#: by Heaps' law), within these bounds: up to three arrays of 2**22 numbers (100 MB) that a worker holds. In proportion to
#: the corpus they would make the rows that all tasks together send to the sum grow with its square.
BUCKETS, LEAST_BITS, MOST_BITS = 8, 16, 22
#: Verdict on the mean held-out log ratio, in nats.
THRESHOLD = -0.15
#: Pseudo-counts that the raw distribution adds to the target's.
PRIOR = 1.0
#: Pseudo-counts on both sides of a bucket's held-out ratio: target rows held out of the given tables all stay above THRESHOLD.
HELD_PRIOR = 2.5
#: A text counts as so many parts, shared by its copies: integers add up alike in any order.
PARTS = 1 << 28
#: The most texts, of those with copies or in the target, whose hashes are broadcast.
BROADCAST_GROUPS = 1_000_000
#: Neighbouring buckets whose sums travel in one row.
SPAN = 1 << 12
_HASH = "_text_hash"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def bits_for(size: int) -> int:
    """Binary digits of a bucket's number for so many bytes of text."""
    return min(MOST_BITS, max(LEAST_BITS, (BUCKETS * math.isqrt(size)).bit_length() - 1))


def buckets(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and every word pair, and the text that each is in."""
    starts, lengths, ends = words_of(raw, offsets)
    words = span_hashes(raw, starts, lengths)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(ends))
    shift = np.uint64(64 - bits)
    inside = text[1:] == text[:-1]
    pairs = gram_hashes(words, 2)[inside] if len(words) > 1 else words[:0]
    pair_text = text[1:][inside] if len(words) > 1 else text[:0]
    return np.concatenate([words >> shift, pairs >> shift]).astype(np.int64), np.concatenate([text, pair_text])


@dataclass(frozen=True)
class Model:
    """What scoring needs of the corpus."""

    #: log p(target) - log p(raw) of each bucket, over all rows
    ratio: np.ndarray
    #: n-grams of each bucket in the corpus and in the target, equal texts once
    raw: np.ndarray
    target: np.ndarray


def hashed(docs: DataFrame, name: str = _HASH) -> DataFrame:
    """`docs` with a hash of their texts."""
    return docs.withColumn(name, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def flagged(df: DataFrame, name: str, flags: DataFrame) -> DataFrame:
    """`df` with the columns of `flags`, which has a row a hash at most, by the column `name` of both; nulls where it has none."""
    few = flags.count() <= BROADCAST_GROUPS
    return df.join(F.broadcast(flags) if few else flags.hint("shuffle_hash"), name, "left")


_COUNTED = ["raw", "target", "raw_parts", "target_parts"]


def _counts(bits: int):
    n = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(_COUNTED), n), np.int64)
        for t in chunks(batches):
            b, text = buckets(*flat(t["text"]), bits)
            copies, good = t["copies"].to_numpy(), t["good"].to_numpy()
            parts = np.rint(PARTS / copies)
            sums[0] += np.bincount(b, minlength=n)
            sums[1] += np.bincount(b, weights=np.rint(PARTS * good / copies)[text], minlength=n).astype(np.int64)
            sums[2] += np.bincount(b, weights=parts[text], minlength=n).astype(np.int64)
            sums[3] += np.bincount(b, weights=(parts * (good > 0))[text], minlength=n).astype(np.int64)
        spans = sums.reshape(len(_COUNTED), -1, SPAN).swapaxes(0, 1)
        hit = np.flatnonzero(spans[:, 0].any(axis=1))
        yield batch(_SPANS, hit, [_pack(spans[i]) for i in hit])

    return run


_SPANS = pa.schema([("span", pa.int32()), ("sums", pa.binary())])


def _pack(sums: np.ndarray) -> bytes:
    """The sums of a span, compressed: parts less those of rows without copies, which leaves few numbers but 0; bytes of one place together."""
    rows, target, parts, target_parts = sums
    left = np.stack([rows, target, rows * PARTS - parts, target - target_parts])
    return pa.compress(np.ascontiguousarray(left.reshape(-1).view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    raw = pa.decompress(data, len(_COUNTED) * SPAN * 8, codec="zstd", asbytes=True)
    rows, target, copied, target_copied = np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.int64).reshape(len(_COUNTED), SPAN)
    return np.stack([rows, target, rows * PARTS - copied, target - target_copied])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for t in batches:
        for span, data in zip(t["span"].to_pylist(), t["sums"].to_pylist(), strict=True):
            sums = _unpack(data)
            held[span] = held[span] + sums if span in held else sums
    yield batch(_SPANS, list(held), [_pack(x) for x in held.values()])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The models of a corpus, and the hashes of the target's texts with the number of their labelled rows (`good`). `docs` as from texts_of."""
    chosen = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    bits = bits_for(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    n = 1 << bits
    docs = hashed(docs)
    seen = written(
        docs.select("doc_id", _HASH).join(chosen.withColumn("named", F.lit(1)), "doc_id", "left")
        .groupBy(_HASH).agg(F.count(F.lit(1)).alias("copies"), F.count("named").alias("good")).where("copies > 1 or good > 0")
    )
    shared = flagged(docs.select("text", _HASH), _HASH, seen).select("text", *[F.coalesce(c, F.lit(x)).alias(c) for c, x in (("copies", 1), ("good", 0))])
    ddl = "span int, sums binary"
    counted = np.zeros((len(_COUNTED), n), np.int64)
    for span, sums in shared.mapInArrow(_counts(bits), ddl).repartition("span").mapInArrow(_summed, ddl).collect():
        counted[:, span * SPAN : (span + 1) * SPAN] = _unpack(sums)
    raw, target, raw_once, target_once = counted / np.array([[1], [PARTS], [PARTS], [PARTS]])
    trusted = seen.where("good > 0").select(_HASH, "good")
    if not target.sum():
        return Model(np.zeros(n), raw_once, target_once), trusted
    p = (raw + 1) / (raw.sum() + n)
    q = (target + PRIOR * p * n) / (target.sum() + PRIOR * n)
    return Model(np.round(np.log(q / p), 9), raw_once, target_once), trusted


def held_scores(b: np.ndarray, text: np.ndarray, n: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Mean log ratio of each of n texts under models without it: if the target doesn't hold it, and if it does."""
    size = len(model.raw)
    each, count = np.unique(text * size + b, return_counts=True)
    text, b = each // size, each % size
    own = np.bincount(text, weights=count, minlength=n)
    # copies' parts are rounded, and rows without an id aren't in the models: never below 0
    rest = lambda of, less: np.maximum(of - less, 0)
    p = (rest(model.raw[b], count) + 1) / (rest(model.raw.sum(), own)[text] + size)

    def mean(target: np.ndarray, target_all: np.ndarray) -> np.ndarray:
        logs = np.log((target + HELD_PRIOR) / (p * target_all + HELD_PRIOR))
        return np.round(np.bincount(text, weights=count * logs, minlength=n) / np.maximum(own, 1), 9)

    target, target_all = model.target[b], model.target.sum()
    return mean(target, target_all), mean(rest(target, count), rest(target_all, own)[text])


def equal_windows(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which pairs of WINDOW-word windows (by their first words) are equal, by comparison of their words' bytes."""
    out = np.ones(len(one), bool)
    for a in range(0, len(one), 1 << 16):
        x, y = one[a : a + (1 << 16)], two[a : a + (1 << 16)]
        same = np.ones(len(x), bool)
        for k in range(WINDOW):
            same &= lengths[x + k] == lengths[y + k]
            at = np.flatnonzero(same)
            size = lengths[x[at] + k]
            differ = raw[ragged(starts[x[at] + k], size)] != raw[ragged(starts[y[at] + k], size)]
            same[at[np.repeat(np.arange(len(at)), size)[differ]]] = False
        out[a : a + (1 << 16)] = same
    return out


def repeat_words(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, grams: np.ndarray) -> int:
    """Words of a text in WINDOW-word windows that are in it twice or more; `grams`: a hash of each window.

    Windows of one hash are compared with the first of them; only where that shows a
    collision are they told apart one by one. Memory is a few numbers a word.
    """
    order = np.argsort(grams, kind="stable")
    head = np.flatnonzero(np.append(True, grams[order][1:] != grams[order][:-1]))
    size = np.diff(np.append(head, len(order)))
    several = np.repeat(size > 1, size)
    group = np.repeat(np.arange(len(head)), size)[several]
    member, first = order[several], np.repeat(order[head], size)[several]
    same = equal_windows(raw, starts, lengths, member, first)
    twice = np.zeros(len(grams), bool)
    odd = np.unique(group[~same])
    twice[member[~np.isin(group, odd)]] = True
    for g in odd.tolist():
        some = member[group == g].tolist()
        texts = [tuple(raw[starts[i + k] : starts[i + k] + lengths[i + k]].tobytes() for k in range(WINDOW)) for i in some]
        often = Counter(texts)
        twice[[i for i, x in zip(some, texts, strict=True) if often[x] > 1]] = True
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which items have another one of the same owner and hash; a superset by hash collisions."""
    order = np.lexsort((hashes, owner))
    same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def base(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    n = len(offsets) - 1
    starts, lengths, ends = words_of(raw, offsets)
    n_words = np.diff(ends)
    text = np.repeat(np.arange(n), n_words)

    def per_text(hit: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    blanks = (raw == 32) | ((raw >= 9) & (raw <= 13))
    out = {"n_words": n_words, "word_chars": per_text(((raw & 0xC0) != 0x80) & ~blanks), "n_symbols": per_text(_SYMBOL[raw])}
    # windows of words; texts with a hash seen twice are counted by comparison
    words = span_hashes(raw, starts, lengths)
    grams = gram_hashes(words, WINDOW)
    inside = text[WINDOW - 1 :] == text[: len(text) - WINDOW + 1] if len(grams) else np.zeros(0, bool)
    owner = text[: len(grams)][inside]
    again = np.unique(owner[_repeated(grams[inside], owner)])
    out["n_repeat_words"] = np.zeros(n, np.int64)
    for i in again.tolist():
        a, b = int(ends[i]), int(ends[i + 1])
        out["n_repeat_words"][i] = repeat_words(raw, starts[a:b], lengths[a:b], grams[a : b - WINDOW + 1])
    # lines: whole lines, with their blanks
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    cut[np.flatnonzero(raw == 10) + 1] = True
    begin = np.flatnonzero(cut[:-1]) if len(raw) else np.zeros(0, np.int64)
    stop = np.append(begin[1:], len(raw))[: len(begin)]
    stop = stop - (raw[np.maximum(stop - 1, 0)] == 10) if len(begin) else stop
    inked = np.concatenate([[0], np.cumsum(~blanks)])
    full = inked[stop] > inked[begin]
    begin, stop = begin[full], stop[full]
    line_text = np.searchsorted(offsets, begin, side="right") - 1
    lines = span_hashes(raw, begin, stop - begin)
    out["n_dup_lines"] = np.zeros(n, np.int64)
    for i in np.unique(line_text[_repeated(lines, line_text)]).tolist():
        some = [x for x in raw[offsets[i] : offsets[i + 1]].tobytes().split(b"\n") if x.strip(b"\x20\t\n\x0b\x0c\r")]
        out["n_dup_lines"][i] = len(some) - len(set(some))
    return out


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCORED = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", _HASH, *_BASE)]
    + [("base_failed", pa.bool_()), ("score", pa.float64()), ("held_out", pa.float64()), ("held_in", pa.float64())]
)
_SCORED_DDL = f"doc_id long, {_HASH} long, {', '.join(f'{c} long' for c in _BASE)}, base_failed boolean, score double, held_out double, held_in double"


def judged(raw: np.ndarray, offsets: np.ndarray, model: Model) -> dict[str, np.ndarray]:
    """Base counts and scores of each text; held_out is its held_score if the target doesn't hold it, held_in if it does."""
    out = base(raw, offsets)
    b, text = buckets(raw, offsets, (len(model.raw) - 1).bit_length())
    n = len(offsets) - 1
    grams = np.bincount(text, minlength=n)
    out["score"] = np.round(np.bincount(text, weights=model.ratio[b], minlength=n) / np.maximum(grams, 1), 9)
    out["held_out"], out["held_in"] = held_scores(b, text, n, model)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    return out


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of counts, scores and verdict for every row of `docs` that has a doc_id."""
    texts = texts_of(docs)
    model, trusted = fit(texts, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            found = judged(*flat(t["text"]), model)
            yield batch(_SCORED, t["doc_id"].combine_chunks(), t[_HASH].combine_chunks(), *(found[c] for c in _SCORED.names[2:]))

    scored = flagged(hashed(texts).mapInArrow(score, _SCORED_DDL), _HASH, trusted)
    scored = scored.withColumn("held_score", F.when(F.col("good").isNotNull(), F.col("held_in")).otherwise(F.col("held_out")))
    kept = ~F.col("base_failed") & (F.col("held_score") >= threshold)
    return scored.select("doc_id", *_BASE, "base_failed", kept.alias("kept"), "score", "held_score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns; null texts fail. Up to BROADCAST_GROUPS texts in the target, no row is shuffled."""
    model, trusted = fit(texts_of(docs), labels)
    plain = undotted(docs)
    name = free_name(plain.columns, _HASH)
    outside, inside, good = (f"{name}_{x}" for x in ("out", "in", "good"))
    schema = StructType([*plain.schema.fields, *(StructField(c, t) for c, t in ((name, LongType()), (outside, BooleanType()), (inside, BooleanType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            found = judged(*flat(pc.fill_null(t["text"], "")), model)
            kept = [~found["base_failed"] & (found[c] >= threshold) for c in ("held_out", "held_in")]
            t = t.append_column(outside, pa.array(kept[0])).append_column(inside, pa.array(kept[1]))
            yield from t.filter(pa.array(kept[0] | kept[1])).to_batches()

    found = flagged(hashed(plain, name).mapInArrow(run, schema), name, trusted.toDF(name, good))
    kept = found.where(F.when(F.col(good).isNotNull(), F.col(inside)).otherwise(F.col(outside)))
    return kept.drop(name, outside, inside, good).toDF(*docs.columns)


def op4_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
