"""Operator 7: toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding makes lower case of everything, Latin letters of their Greek and Cyrillic
doubles and of the digits and signs that stand in for letters, and a single space
of all other signs. The lexicon holds beginnings of words, found by an automaton
in one pass over the text. A hit counts with its term's weight, unless an
exception phrase begins at the same word. A document's score is a logistic
function of the weighted hits, as a sum and for each word: normalised by length.

Everything is learned from labelled rows that aren't held out (crc32 of the id,
modulo 3, is not 1), at most TRAIN_ROWS of them, taken by a hash of the id. Equal
texts among them count once, with the label of their smallest id, so that a term in
many copies of one document doesn't look strong. Terms are rated by the
log-likelihood ratio between toxic and other documents that have them, or have them
twice, whichever tells more; weights are log odds; exceptions are the two words from
a hit on that LEAST_EXCUSED clean documents have and no toxic one; the logistic
function is fitted by Newton's method to hits that exceptions have been taken from.
All of it is sums over the sample, so that the model is the same however rows are
dealt out. Its size is bounded by TERMS and EXCEPTIONS; scoring is one scan, without
a shuffle.

Null and empty texts have no hits: the score is the model's for none. Rows that
repeat each get a row; rows without a doc_id are left out, and columns beside doc_id
and text are pruned. With no usable label, or with one class alone, every score is
0.0. Labels with nulls count as none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldscape.llm.common import batch, chunks, table, texts_of, written

#: The most labelled rows that a model is fitted on.
TRAIN_ROWS = 20_000
TERMS, EXCEPTIONS = 64, 200
#: Characters of a word's beginning that may be a term; shorter words are terms whole.
SHORTEST, LONGEST = 3, 8
#: Toxic documents that a term needs, and its least log-likelihood ratio.
LEAST_DOCS, LEAST_RATIO = 5, 30.0
#: Clean documents that an exception phrase needs.
LEAST_EXCUSED = 3
TOXIC_FROM = 0.7
#: Look-alikes of Latin letters, and digits and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "ο": "o", "о": "o", "р": "p", "ѕ": "s",
    "υ": "u", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t",
    "χ": "x", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "ı": "i", "ɡ": "g", "ԁ": "d", "ԛ": "q",
    "ԝ": "w",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Zero-width characters and soft hyphens, which hide inside words.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_TRAILING = "!$@"


def _fold_table() -> dict[int, str]:
    table_ = {i: " " for i in range(128) if not chr(i).isalnum() and chr(i) not in "$@!'"}
    table_ |= {ord(a): b for a, b in (HOMOGLYPHS | SUBSTITUTES).items()}
    table_ |= {0xFF01 + i: SUBSTITUTES.get(chr(0x21 + i), chr(0x21 + i).lower()) for i in range(94) if chr(0x21 + i).isalnum()}
    return table_ | {ord(c): None for c in INVISIBLE} | {ord("'"): None}


_FOLD = _fold_table()


def folded(text: str) -> str:
    """Words of `text`, folded, with a space before each."""
    words = (w.rstrip(_TRAILING) if w[-1] in _TRAILING else w for w in text.lower().replace("!!", " ").split())
    return " " + " ".join(" ".join(words).translate(_FOLD).split())


def automaton(weights: dict[str, float], exceptions: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term, w in weights.items():
        out.add_word(term, (len(term), w))
    for phrase in exceptions:
        out.add_word(phrase, (len(phrase), None))
    if len(out):
        out.make_automaton()
    return out


def spans(found, text: str) -> list[tuple[int, float]]:
    """Where hits begin (at the space before their word) and their weights, without those that an exception begins at."""
    if not len(found):
        return []
    every = [(end + 1 - size, w) for end, (size, w) in found.iter(text + " ")]
    excused = {at for at, w in every if w is None}
    return [(at, w) for at, w in every if w is not None and at not in excused]


def hits(found, text: str) -> tuple[float, int, int]:
    """Summed weights, number of hits and words of a folded text."""
    n = text.count(" ") if len(text) > 1 else 0
    counted = [w for _, w in spans(found, text)]
    return math.fsum(counted), len(counted), n


def features(total: float, n: int) -> list[float]:
    return [1.0, math.log1p(total), 100.0 * total / (n + 20), math.log(n + 1.0)]


def _train_labels(labels: DataFrame) -> dict[int, int]:
    rows = (
        labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    )
    return {r["doc_id"]: r["toxic"] for r in rows.collect()}


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label and text of the rows to learn from: equal texts once, TRAIN_ROWS at most."""
    known = _train_labels(labels)
    named = docs.sparkSession.createDataFrame(sorted(known.items()), "doc_id long, label int")
    digest = F.sha2(F.col("text"), 256)
    rows = docs.join(F.broadcast(named), "doc_id").groupBy(digest.alias("digest")).agg(F.min(F.struct("doc_id", "label", "text")).alias("r"))
    return written(rows.select("r.*"))


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beginnings of words, and how many clean and toxic texts have them, and have them twice."""
    counts: dict[str, list[int]] = {}
    for t in chunks(batches):
        for label, text in zip(t["label"].to_pylist(), t["text"].to_pylist(), strict=True):
            own = Counter(w[:k] for w in folded(text).split() for k in range(min(len(w), SHORTEST), min(len(w), LONGEST) + 1))
            for stem, n in own.items():
                at = counts.setdefault(stem, [0, 0, 0, 0])
                at[label] += 1
                at[2 + label] += n > 1
    every = sorted(counts)
    for a in range(0, len(every), 50_000):
        some = every[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array([counts[s][i] for s in some], pa.int64()) for i in range(4))], _STEM_COUNTS)


_STEM_COUNTS = ["stem", "clean", "toxic", "clean_twice", "toxic_twice"]


def _contexts(weights: dict[str, float]):
    """Of each text its label, its words, and the weight of its hits by the two words that they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(weights, [])
        schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("n", pa.int64()), ("phrases", pa.list_(pa.string())), ("totals", pa.list_(pa.float64()))])
        for t in chunks(batches):
            rows = []
            for doc, label, text in zip(t["doc_id"].to_pylist(), t["label"].to_pylist(), t["text"].to_pylist(), strict=True):
                text = folded(text)
                by: dict[str, list[float]] = {}
                for at, w in spans(found, text):
                    one = (text + " ").find(" ", at + 1)
                    two = (text + " ").find(" ", one + 1)
                    by.setdefault((text + " ")[at : (one if two < 0 else two) + 1], []).append(w)
                rows.append((doc, label, hits(found, text)[2], sorted(by), [math.fsum(by[p]) for p in sorted(by)]))
            if rows:
                yield batch(schema, *(list(c) for c in zip(*rows, strict=True)))

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


class Model:
    """Terms with weights, exception phrases, and the logistic function's coefficients."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], coefficients: list[float] | None):
        self.weights, self.exceptions, self.coefficients = weights, exceptions, coefficients

    def score(self, total: float, n: int) -> float:
        if self.coefficients is None:
            return 0.0
        z = math.fsum(a * b for a, b in zip(self.coefficients, features(total, n), strict=True))
        return round(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))), 9)


def _rated(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Log-likelihood ratio of a among n1 against b among n0; 0 where a isn't three times as frequent."""
    p = (a + b) / (n1 + n0)
    pairs = ((a, n1 * p), (n1 - a, n1 * (1 - p)), (b, n0 * p), (n0 - b, n0 * (1 - p)))
    total = sum((F.when((k > 0) & (e > 0), k * F.log(k / e)).otherwise(0.0) for k, e in pairs), F.lit(0.0))
    return F.when(a / n1 > 3 * b / n0, 2 * total).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """`docs` as from texts_of; `labels` with doc_id and toxic."""
    rows = sample(docs, labels)
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model({}, [], None)
    c = {x: F.col(x) for x in _STEM_COUNTS}
    counted = (
        rows.mapInArrow(_stems, ", ".join(["stem string", *[f"{x} long" for x in _STEM_COUNTS[1:]]])).groupBy("stem").agg(*[F.sum(x).alias(x) for x in _STEM_COUNTS[1:]])
        .where((c["toxic"] >= LEAST_DOCS) & (c["toxic"] / n1 > 3 * c["clean"] / n0))
        .withColumn("rating", F.greatest(_rated(c["toxic"], c["clean"], n1, n0), _rated(c["toxic_twice"], c["clean_twice"], n1, n0)))
        .where(F.col("rating") >= LEAST_RATIO).collect()
    )
    weights: dict[str, float] = {}
    for r in sorted(counted, key=lambda r: (-round(r["rating"], 6), -len(r["stem"]), r["stem"])):
        stem = f" {r['stem']}"
        if len(weights) < TERMS and not any(stem.startswith(t) or t.startswith(stem) for t in weights):
            weights[stem] = round(math.log((r["toxic"] + 0.5) / (n1 + 1)) - math.log((r["clean"] + 0.5) / (n0 + 1)), 6)
    seen = sorted(rows.mapInArrow(_contexts(weights), "doc_id long, label int, n long, phrases array<string>, totals array<double>").collect(), key=lambda r: (r["doc_id"], r["label"], r["n"], r["phrases"]))
    clean, toxic = Counter(), Counter()
    for r in seen:
        (toxic if r["label"] else clean).update(r["phrases"])
    excused = sorted((p for p, k in clean.items() if k >= LEAST_EXCUSED and not toxic[p]), key=lambda p: (-clean[p], p))[:EXCEPTIONS]
    gone = set(excused)
    x = [features(math.fsum(w for p, w in zip(r["phrases"], r["totals"], strict=True) if p not in gone), r["n"]) for r in seen]
    coefficients = logistic(np.array(x), np.array([r["label"] for r in seen], float))
    return Model(weights, excused, [round(float(k), 9) for k in coefficients])


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("hits", pa.int64())])


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and hits of every row of `docs` that has a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(model.weights, model.exceptions)
        for t in chunks(batches):
            seen = [hits(found, folded(x)) for x in t["text"].to_pylist()]
            yield batch(_SCORED, t["doc_id"].combine_chunks(), [model.score(a, n) for a, _, n in seen], [h for _, h, _ in seen])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double, hits long")


def op7_folded_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, fit(texts_of(docs), table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "hits"
    )
