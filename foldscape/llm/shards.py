"""Operator 8: sharding by size-tiered compaction with a versioned manifest.

A store is a folder of immutable Parquet shards and a folder of manifests.
Arrivals are appended as they come, one small shard for each task that has rows.
Compaction looks at sizes alone: shards fall into tiers by powers of FANOUT; a
tier with FANOUT shards or more is merged, in path order, into shards of up to the
target size, and that is repeated until no tier is full. A merge reads its shards
in one task and writes one, so nothing is shuffled, and a row is rewritten at most
once a tier. Shards of half the target or more are left alone. A wave of merges
has a few for each core of the cluster, in jobs of JOB_MERGES that run side by side.

Each change commits the next manifest, a file that is created only if it doesn't
exist (which HDFS and object stores with conditional writes promise): of two
writers one gets the version, and the other goes on from there. A merge commits on
top of whatever was appended meanwhile, as long as the shards that it read are
still named; otherwise its files are deleted again. Attempts are bounded, with
growing pauses. A manifest that its writer left unfinished is not read; writers
stop at it until repair() closes it. Small manifests list all shards, large ones
what changed, with a full list every SNAPSHOT_EVERY versions. The driver holds
names and sizes of shards, never rows.

Nothing that a reader or a writer may still need is deleted by compaction: every
version stays readable until expire() drops it, and vacuum() removes shards that
no version on disk names and that are older than VACUUM_MINUTES, so that those of
an arrival that is written but not yet committed stay. A run that fails, or an
executor that is lost, leaves only such files.

Rows are kept as they are: nulls, empty and very long texts, repeated rows and
columns beside those of `documents`, whatever their names. Arrivals may differ in
their columns: the store has those of all of them, and rows of an arrival without
one have null there. A column that comes with another type is refused (ValueError)
before it is committed. An empty arrival adds a version without rows. Reading an
empty store gives no rows and no columns.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from foldscape.llm.common import shared_dir, table

TARGET_BYTES = 64 << 20
FANOUT = 4
SMALLEST = 1 << 20
#: Merges in one job, each a task; jobs side by side at most; merges of a wave for each core.
JOB_MERGES, JOBS, WAVE_PER_CORE = 64, 32, 4
ATTEMPTS = 20
#: Shards up to which every manifest has the full list, and versions from one full list to the next beyond.
FULL_LIST, SNAPSHOT_EVERY = 1_000, 32
#: Age from which files that no version names may go, and from which an unfinished manifest is its writer's last.
VACUUM_MINUTES, REPAIR_MINUTES = 24 * 60, 30
#: Arrivals that the query deals its table into.
ARRIVALS = 8


class Conflict(RuntimeError):
    """Another writer's change stands in the way of this one."""


def nullable(kind: DataType) -> DataType:
    """A type as Parquet gives it back: everything in it may be null."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, nullable(f.dataType), True) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, MapType):
        return MapType(nullable(kind.keyType), nullable(kind.valueType), True)
    return kind


def united(had: str | None, new: StructType) -> str:
    """The columns of a store with those of an arrival; names are compared as Spark does, without case."""
    fields = {f.name.lower(): f for f in StructType.fromJson(json.loads(had))} if had else {}
    for f in nullable(new):
        known = fields.setdefault(f.name.lower(), f)
        if known.dataType != f.dataType:
            raise ValueError(f"column {f.name} is {f.dataType.simpleString()} here and {known.dataType.simpleString()} in the store")
    return StructType(list(fields.values())).json()


class Store:
    """Shards and manifests below `root`, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.root}/manifest"))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, folder: str) -> list[tuple[str, int]]:
        if not self.fs.exists(self._path(folder)):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self._path(folder)))

    def _age(self, path: str) -> float:
        return time.time() / 60 - self.fs.getFileStatus(self._path(path)).getModificationTime() / 60_000

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:010d}.json"

    def _load(self, version: int) -> dict | None:
        """What a manifest file says; None if it is unfinished."""
        stream = self.fs.open(self._path(self._manifest_path(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """Versions with a manifest file, the last of which may be unfinished."""
        return [int(n[1:-5]) for n, _ in self._files(f"{self.root}/manifest") if n.startswith("v") and n.endswith(".json")]

    def version(self) -> int:
        found = self.versions()
        return 0 if not found else found[-1] if self._load(found[-1]) is not None else found[-1] - 1

    def manifest(self, version: int | None = None) -> dict:
        """Schema and shards (path, bytes, tier) of a version; of the last one by default."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        own = self._load(version)
        shards, changes, at = own.get("shards"), [own], version
        while shards is None:
            at -= 1
            changes.append(self._load(at))
            shards = changes[-1].get("shards")
        if len(changes) > 1:
            by_path = {s["path"]: s for s in changes.pop()["shards"]}
            for change in reversed(changes):
                for path in change["removed"]:
                    del by_path[path]
                by_path.update((s["path"], s) for s in change["added"])
            shards = sorted(by_path.values(), key=lambda s: s["path"])
        return {"version": version, "schema": own["schema"], "shards": shards}

    def commit(self, added: list[dict], removed: list[str] = (), schema: StructType | None = None, attempts: int = ATTEMPTS) -> dict:
        """Make the last version with shards added and removed the next one."""
        for attempt in range(attempts):
            base = self.manifest()
            gone, here = set(removed), {s["path"] for s in base["shards"]}
            if not gone <= here:
                raise Conflict("another writer merged the same shards")
            after = {"version": base["version"] + 1, "schema": united(base["schema"], schema) if schema is not None else base["schema"]}
            shards = sorted([s for s in base["shards"] if s["path"] not in gone] + added, key=lambda s: s["path"])
            full = len(shards) <= FULL_LIST or after["version"] % SNAPSHOT_EVERY == 1
            content = {**after, "shards": shards} if full else {**after, "added": added, "removed": sorted(gone)}
            try:
                out = self.fs.create(self._path(self._manifest_path(after["version"])), False)
            except Exception as e:  # noqa: BLE001  Py4J wraps the file system's own error
                if not self.fs.exists(self._path(self._manifest_path(after["version"]))):
                    raise
                if attempt + 1 == attempts:
                    raise Conflict(f"version {after['version']} was not free in {attempts} attempts; if its writer is gone, repair() closes it") from e
                time.sleep(min(5.0, 0.1 * 2**attempt))
                continue
            out.write(bytearray(json.dumps(content).encode()))
            out.close()
            return {**after, "shards": shards}
        raise Conflict("no attempt was allowed")

    def repair(self, minutes: float = REPAIR_MINUTES) -> bool:
        """Close a manifest that its writer left unfinished so long ago: as a version that changes nothing."""
        found = self.versions()
        if not found or self._load(found[-1]) is not None or self._age(self._manifest_path(found[-1])) < minutes:
            return False
        out = self.fs.create(self._path(self._manifest_path(found[-1])), True)
        out.write(bytearray(json.dumps({**self.manifest(found[-1] - 1), "version": found[-1]}).encode()))
        out.close()
        return True

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / SMALLEST, self.fanout)))

    def _written(self, df: DataFrame) -> list[dict]:
        folder = f"run-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        return [{"path": f"{folder}/{n}", "bytes": size, "tier": self.tier(size)} for n, size in self._files(f"{self.root}/data/{folder}") if n.startswith("part-")]

    def _discard(self, shards: list[dict]) -> None:
        """Delete shards of this writer that were never committed."""
        for s in shards:
            self.fs.delete(self._path(f"{self.root}/data/{s['path']}"), False)

    def append(self, rows: DataFrame, arrivals: int = 1, settle=None) -> dict:
        """New shards from `rows`, on top of whatever was committed meanwhile.

        With several arrivals the shards of one scan are committed in as many
        versions, and `settle`, if given, is called after each.
        """
        united(self.manifest()["schema"], rows.schema)  # before anything is written
        new = self._written(rows)
        groups = [new[len(new) * i // arrivals : len(new) * (i + 1) // arrivals] for i in range(arrivals)]
        last = self.manifest()
        for i, group in enumerate(groups):
            if not group and (i or new):
                continue
            try:
                last = self.commit(group, schema=rows.schema)
            except (Conflict, ValueError):
                self._discard([s for g in groups[i:] for s in g])
                raise
            if settle is not None:
                settle()
        return last

    def _merges(self, shards: list[dict]) -> list[list[dict]]:
        """Groups of like-sized shards, each of the target size at most."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if 2 * s["bytes"] < self.target:
                tiers.setdefault(s["tier"], []).append(s)
        groups = []
        for _, some in sorted(tiers.items()):
            if len(some) < self.fanout:
                continue
            group, size = [], 0
            for s in some:
                if group and size + s["bytes"] > self.target:
                    groups.append(group)
                    group, size = [], 0
                group.append(s)
                size += s["bytes"]
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def _merged(self, base: dict, groups: list[list[dict]]) -> list[dict]:
        """One new shard for each group, in one job."""
        out = None
        for g in groups:
            one = self._read(base, g).coalesce(1)
            out = one if out is None else out.union(one)
        return self._written(out)

    def compact(self) -> dict:
        """Merge until no tier is full; every wave of merges is a version."""
        lost = 0
        wave = max(JOB_MERGES, WAVE_PER_CORE * self.spark.sparkContext.defaultParallelism)
        while True:
            base = self.manifest()
            groups = self._merges(base["shards"])[:wave]
            if not groups:
                return base
            jobs = [groups[a : a + JOB_MERGES] for a in range(0, len(groups), JOB_MERGES)]
            with ThreadPoolExecutor(min(JOBS, len(jobs))) as pool:
                new = [s for found in pool.map(lambda g: self._merged(base, g), jobs) for s in found]
            try:
                self.commit(new, [s["path"] for g in groups for s in g])
            except Conflict:
                self._discard(new)
                lost += 1
                if lost == ATTEMPTS:
                    raise
                time.sleep(min(60.0, 0.5 * 2**lost))

    def expire(self, keep: int) -> None:
        """Drop all versions but the last `keep`, and those that their manifests build on."""
        oldest = max(1, self.version() - keep + 1)
        while oldest > 1 and self._load(oldest).get("shards") is None:
            oldest -= 1
        for v in self.versions():
            if v < oldest:
                self.fs.delete(self._path(self._manifest_path(v)), False)

    def vacuum(self, minutes: float = VACUUM_MINUTES) -> None:
        """Delete shards that no version on disk names and that are older than `minutes`."""
        old = [(run, n) for run, _ in self._files(f"{self.root}/data") for n, _ in self._files(f"{self.root}/data/{run}") if n.startswith("part-") and self._age(f"{self.root}/data/{run}/{n}") >= minutes]
        named: set[str] = set()  # looked up after the files: what is committed in between is named
        for v in self.versions():
            own = self._load(v)
            named |= {s["path"] for s in (own.get("shards") or own.get("added") or [])} if own else set()
        for run, n in old:
            if f"{run}/{n}" not in named:
                self.fs.delete(self._path(f"{self.root}/data/{run}/{n}"), False)

    def _read(self, manifest: dict, shards: list[dict]) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else StructType([])
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{s['path']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        manifest = self.manifest(version)
        return self._read(manifest, manifest["shards"])


def placed(store: Store) -> DataFrame:
    """doc_id, n_bytes, shard, shard_bytes and tier of every row of the last version."""
    rows = store.read()
    if not store.manifest()["shards"]:
        return rows.sparkSession.createDataFrame([], "doc_id long, n_bytes long, shard string, shard_bytes long, tier int")
    file = rows.metadataColumn("_metadata")  # the reader's own, whatever columns the rows have
    size = file["file_size"]
    tier = F.greatest(F.lit(0), F.floor(F.log(float(store.fanout), size / SMALLEST))).cast("int")
    shard = F.regexp_extract(file["file_path"], r"/(run-[^/]+/part-\d+)", 1)
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), shard.alias("shard"), size.alias("shard_bytes"), tier.alias("tier"))


def op8_size_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the shard that it is in after compaction, and the bytes and tier of that shard.

    The table arrives in ARRIVALS parts, and the store is compacted after each.
    Nobody else reads this store, so versions go as soon as there is a next one.
    """
    store = Store(spark, shared_dir(spark))

    def settle() -> None:
        store.compact()
        store.expire(1)

    store.append(table(spark, sf_dir, "documents"), ARRIVALS, settle)
    store.vacuum(0)
    return placed(store)
