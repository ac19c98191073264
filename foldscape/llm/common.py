"""What the training-data operators share: whole-table reads, bounded Arrow chunks, written tables."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds at once; longer single texts form a chunk of their own.
CHUNK_BYTES = 4 << 20
#: Rows that the JVM puts into one Arrow batch; with texts of tens of KB this stays at tens of MB.
BATCH_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table `name` below `sf_dir`, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (null: empty) of `docs`.

    Rows without a doc_id can't be named in a result and are left out; columns
    beside these two are pruned, whatever their names.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).where(F.col("doc_id").isNotNull())


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir or the context's; where both are unset, below a temporary one, but only in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = own.get() if own.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="foldscape-")
        spark.conf.set("spark.checkpoint.dir", f"file://{base}")
        base = f"file://{base}"
    path = f"{base.rstrip('/')}/foldscape-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder made by shared_dir, by the file system that it is in."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).delete(jvm.org.apache.hadoop.fs.Path(path), True)
    except Exception:  # noqa: BLE001  the session may have ended before its temporary tables
        return


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder, a folder for each value of `by`: cuts lineage, and survives lost executors."""
    path = shared_dir(df.sparkSession)
    to = df.write.option("compression", "zstd")
    (to.partitionBy(by) if by else to).parquet(path)
    # shuffle files of steps before this one go when the driver's JVM collects what stands for them
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rewritten(df: DataFrame, old: DataFrame | None) -> DataFrame:
    """`df` written, and then the table `old` from written(), which nothing needs any more, deleted."""
    new = written(df)
    if old is not None:
        for folder in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
            forget(df.sparkSession, folder)
    return new


def free_name(columns: list[str], base: str) -> str:
    """`base`, or with a number, such that no column's name begins with it; case doesn't count."""
    held = [c.lower() for c in columns]
    return next(t for t in (base + str(i or "") for i in range(len(held) + 1)) if not any(c.startswith(t.lower()) for c in held))


def undotted(df: DataFrame) -> DataFrame:
    """`df` with other names for columns that Spark's Arrow functions can't refer to: those with dots or backticks."""
    tag = free_name(df.columns, "column_")
    return df.toDF(*[f"{tag}{i}" if "." in c or "`" in c else c for i, c in enumerate(df.columns)])


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Batches cut and joined to tables whose `text` has about `limit` bytes."""
    held, size = [], 0
    for batch in batches:
        at = batch.schema.get_field_index("text")
        ends = text_offsets(batch.column(at))
        start = 0
        while start < batch.num_rows:
            room = max(0, limit - size)
            stop = int(np.searchsorted(ends, ends[start] + room, side="right")) - 1
            if stop <= start:
                if held:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                    continue
                stop = start + 1
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop] - ends[start])
            start = stop
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def text_offsets(texts: pa.Array) -> np.ndarray:
    """Where each text starts in the bytes of `texts`, and the end."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    raw = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def flat(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and n + 1 offsets from 0. Texts aren't null."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = text_offsets(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, … of every run, one run after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - firsts, lengths)


def blank(raw: np.ndarray) -> np.ndarray:
    """Where bytes are one of [\\x20\\x09-\\x0D]."""
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


#: Bytes A-Z as a-z, others as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word `[^\\x20\\x09-\\x0D]+` that doesn't cross texts, and n + 1 counts from 0."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~blank(raw)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a text's first byte; n itself is beyond all words
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:n]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:n]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops - starts, np.searchsorted(starts, offsets)


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of a fixed odd number modulo 2**64, n at least."""
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, 0x9E3779B97F4A7C15, np.uint64)]))
    return _POWERS


#: A random-looking odd number for each byte.
BYTE_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def span_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; spans are sorted, not empty and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    every = ragged(starts, lengths)
    place = every - np.repeat(starts, lengths)
    terms = BYTE_CODE[raw[every]] * powers(int(lengths.max()))[place]
    sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
    return mixed(sums + lengths.astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes, across texts too; len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : i + n]
    return mixed(out)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of `schema` from arrays or lists."""
    return pa.RecordBatch.from_arrays(
        [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)],
        schema=schema,
    )
