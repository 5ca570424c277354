"""Tables that streams write batch by batch and that merge as they grow.

A table is a list of runs, each a folder of Parquet files that never changes. A manifest names the runs
and the last batch they hold. A batch writes its run first and then a new manifest, in one rename, so
after a crash in between nobody reads what the batch left, and the batch runs again. A batch that the manifest
already holds changes nothing. ``fanout`` runs of a level merge into one of the next: there are
at most ``fanout`` runs a level and as many levels as the logarithm of the batches, and a row is
rewritten once a level.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FANOUT = 4
#: Manifests that stay beside the newest, for readers that opened them.
KEPT_MANIFESTS = 4


class LeveledTable:
    """Runs and manifests under a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.folder}/{name}".rstrip("/"))

    def _manifests(self) -> list[str]:
        place = self._path("manifests")
        if not self.files.exists(place):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.files.listStatus(place)) if n.endswith(".json"))

    def manifest(self) -> dict:
        """The newest manifest: version, last batch, runs, and folders that the next merge may delete."""
        names = self._manifests()
        if not names:
            return {"version": 0, "batch": -1, "runs": [], "left": []}
        stream = self.files.open(self._path(f"manifests/{names[-1]}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, old: dict, **changes) -> dict:
        new = old | changes | {"version": old["version"] + 1}
        draft, place = self._path(f"manifests/.draft-{uuid.uuid4().hex}"), self._path(f"manifests/{new['version']:012d}.json")
        stream = self.files.create(draft, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        if not self.files.rename(draft, place):
            raise RuntimeError(f"another writer made manifest {new['version']} of {self.folder}")
        for name in self._manifests()[:-KEPT_MANIFESTS - 1]:
            self.files.delete(self._path(f"manifests/{name}"), False)
        return new

    def paths(self, runs: list[dict] | None = None, part: str = "rows") -> list[str]:
        return [f"{self.folder}/{r['name']}/{part}" for r in (self.manifest()["runs"] if runs is None else runs)]

    def add(self, batch: int, write: Callable[[str], dict | None]) -> bool:
        """Let ``write`` fill a new run and enter it as the run of ``batch``. False if the batch is in already."""
        old = self.manifest()
        if batch <= old["batch"]:
            return False
        name = f"runs/{batch:012d}-{uuid.uuid4().hex}"
        facts = write(f"{self.folder}/{name}") or {}
        self._commit(old, batch=batch, runs=[*old["runs"], {"name": name, "level": 0, "first": batch, "last": batch} | facts])
        return True

    def merge(self, write: Callable[[list[dict], str], dict | None]) -> None:
        """Merge full levels, the lowest first. Folders that a merge replaced go at the next merge."""
        while True:
            old = self.manifest()
            levels: dict[int, list[dict]] = {}
            for run in old["runs"]:
                levels.setdefault(run["level"], []).append(run)
            full = next((k for k in sorted(levels) if len(levels[k]) >= self.fanout), None)
            if full is None:
                return
            merged = levels[full]
            name = f"runs/{merged[-1]['last']:012d}-{uuid.uuid4().hex}"
            facts = write(merged, f"{self.folder}/{name}") or {}
            run = {"name": name, "level": full + 1, "first": merged[0]["first"], "last": merged[-1]["last"]} | facts
            names = {r["name"] for r in merged}
            self._commit(old, runs=[run, *[r for r in old["runs"] if r["name"] not in names]], left=sorted(names))
            for gone in old["left"]:
                self.files.delete(self._path(gone), True)


# --- newest version of every key ------------------------------------------------

def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of every key the row of the last batch that changed it, with that batch."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def upsert(table: LeveledTable, changed: DataFrame, batch: int, keys: list[str]) -> None:
    """Enter the changed rows of a batch and merge what is full."""
    def first(path: str) -> None:
        changed.withColumn("batch", F.lit(batch).cast("long")).write.parquet(f"{path}/rows")

    def merged(runs: list[dict], path: str) -> None:
        paths = table.paths(runs)
        rows = changed.sparkSession.read.schema(changed.withColumn("batch", F.lit(0).cast("long")).schema).parquet(*paths)
        newest(rows, keys).select(rows.columns).write.parquet(f"{path}/rows")

    table.add(batch, first)
    table.merge(merged)


def current_rows(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Current rows of an upserted table. What is read follows the live keys, not the batches there ever were."""
    paths = LeveledTable(spark, folder).paths()
    if not paths:
        raise ValueError(f"no batch has been written to {folder}")
    return newest(spark.read.parquet(*paths), keys).drop("batch")


# --- keys seen once ---------------------------------------------------------------

#: Bits of a filter chunk, as the bitmap functions have them, and keys for each chunk: 16 bits a key.
CHUNK_BITS, CHUNK_KEYS = 32768, 2048
BUCKETS = 64


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _bucket(key: Column) -> Column:
    return F.pmod(F.shiftright(_hash(key), 48), F.lit(BUCKETS)).cast("int")


def _slot(key: Column, chunks: Column) -> Column:
    """Bit of a key in a filter of so many chunks."""
    return F.pmod(_hash(key), chunks.cast("long") * CHUNK_BITS)


def write_keys(keys: DataFrame, key: str, path: str) -> dict:
    """Distinct keys by bucket, and their filter: one bitmap for each chunk of its bits."""
    keys.withColumn("bucket", _bucket(F.col(key))).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    spark = keys.sparkSession
    rows = spark.read.schema(f"{key} string, bucket int").parquet(f"{path}/rows")
    n = rows.count()
    chunks = max(1, -(-n // CHUNK_KEYS))
    slots = rows.select(_slot(F.col(key), F.lit(chunks)).alias("slot"))
    (slots.groupBy(F.floor(F.col("slot") / CHUNK_BITS).alias("chunk"))
     .agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(CHUNK_BITS))).alias("bits")).write.parquet(f"{path}/filter"))
    return {"keys": n, "chunks": chunks}


def stored_keys(spark: SparkSession, table: LeveledTable, runs: list[dict], key: str) -> DataFrame:
    """(key, bucket) of the runs. Buckets are folders, so a filter on them leaves the others unread."""
    rows = None
    for path in table.paths(runs):                       # a run has its own partition folders
        one = spark.read.schema(f"{key} string, bucket int").parquet(path)
        rows = one if rows is None else rows.unionByName(one)
    return rows


def seen_before(table: LeveledTable, keys: DataFrame, key: str) -> DataFrame | None:
    """Those of ``keys`` that a run holds; nothing at all if there is no run.

    Each key looks up one bit per run; only keys with a hit are compared with stored keys, and only the buckets
    those fall into are read.
    """
    spark = keys.sparkSession
    runs = [r for r in table.manifest()["runs"] if r["keys"]]
    if not runs:
        return None
    filters = None
    for number, run in enumerate(runs):
        one = spark.read.schema("chunk long, bits binary").parquet(f"{table.folder}/{run['name']}/filter").withColumn("run", F.lit(number))
        filters = one if filters is None else filters.unionByName(one)
    asked = keys.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("run"), F.lit(r["chunks"]).cast("long").alias("chunks"))
                                                 for i, r in enumerate(runs)])).alias("r")).select(key, "r.*")
    asked = asked.withColumn("slot", _slot(F.col(key), F.col("chunks"))).withColumn("chunk", F.floor(F.col("slot") / CHUNK_BITS))
    bit = F.pmod("slot", F.lit(CHUNK_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hits = (asked.join(filters, ["run", "chunk"]).filter(F.getbit(byte, bit % 8) == 1)
            .select(key).distinct().withColumn("bucket", _bucket(F.col(key))))
    stored = stored_keys(spark, table, runs, key)
    touched = [r.bucket for r in hits.select("bucket").distinct().collect()]          # BUCKETS at most
    return hits.join(stored.filter(F.col("bucket").isin(touched)), [key, "bucket"], "left_semi").select(key)


def admit(table: LeveledTable, arrived: DataFrame, batch: int, key: str) -> None:
    """Enter the keys of a batch that no run holds. NULL is no key."""
    def first(path: str) -> dict:
        keys = arrived.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct().persist()
        try:
            old = seen_before(table, keys, key)
            return write_keys(keys if old is None else keys.join(old, key, "left_anti"), key, path)
        finally:
            keys.unpersist()

    def merged(runs: list[dict], path: str) -> dict:
        return write_keys(stored_keys(arrived.sparkSession, table, runs, key).select(key), key, path)

    table.add(batch, first)
    table.merge(merged)


def admitted(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """All keys that came in, once each."""
    table = LeveledTable(spark, folder)
    runs = table.manifest()["runs"]
    if not runs:
        raise ValueError(f"no batch has been written to {folder}")
    return stored_keys(spark, table, runs, key).select(key)
