"""A keyed table that takes batches without being copied: deltas by key bucket, and a manifest of what is current.

Rows lie in ``buckets`` buckets by the hash of their key. A batch writes its own rows, as a delta of each bucket that it
touches. A bucket whose deltas hold more rows than ``COMPACT`` times its base is rewritten; so what is written follows the
batches, and not the table. ``manifests/<epoch>.json`` names, for each bucket, the epochs that hold its rows. It is
put in place by a rename, after all its files: a batch counts wholly or not at all.

A replayed batch that is committed changes nothing; one that was cut off starts again from the manifest before it. Files
that neither the present manifest nor the one before it names are deleted, so a reader of the last version can finish.

Defined results: of a key's rows in a batch the one with the greatest sequence stands, and it replaces whatever the table
has; NULL equals NULL in keys; an empty batch commits an empty delta; batches must come in the order of their epochs.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relops import last_wins

#: A bucket is rewritten when its deltas hold more than this share of the rows of its base.
COMPACT = 0.5
_BUCKET, _EPOCH = "__bucket", "__epoch"


class Folder:
    """The few file operations that a manifest needs, on whatever file system Spark reads the path with."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path.rstrip("/"), spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(one.getPath().getName() for one in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file under another name and rename it, so that it is there as a whole or not at all."""
        stream = self.fs.create(self._path(f"{name}.part"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.rename(self._path(f"{name}.part"), self._path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def size(self, name: str = "") -> int:
        path = self._path(name)
        return self.fs.getContentSummary(path).getLength() if self.fs.exists(path) else 0


def _manifests(folder: Folder) -> list[int]:
    return [int(name[:-5]) for name in folder.names("manifests") if name.endswith(".json")]


def _manifest(folder: Folder, epoch: int) -> dict:
    return json.loads(folder.read(f"manifests/{epoch:020d}.json"))


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    newest = Window.partitionBy(_BUCKET, *keys).orderBy(F.col(_EPOCH).desc())
    return rows.withColumn("__k", F.row_number().over(newest)).where("__k = 1").drop("__k")


def _paths(folder: Folder, manifest: dict, some: list[str] | None = None) -> list[str]:
    return [f"{folder.path}/{part['at']}/{_BUCKET}={b}" for b, parts in manifest["buckets"].items() if some is None or b in some for part in parts]


def _load(spark: SparkSession, folder: Folder, manifest: dict, some: list[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(manifest["schema"])
    stored = T.StructType([*schema.fields, T.StructField(_EPOCH, T.LongType())])
    paths = _paths(folder, manifest, some)
    rows = spark.read.schema(stored).parquet(*paths) if paths else spark.createDataFrame([], stored)
    return rows.withColumn(_BUCKET, _bucket(manifest["keys"], manifest["n_buckets"]))


def _write(rows: DataFrame, folder: Folder, at: str) -> dict[str, int]:
    """Store rows by bucket; how many each bucket got."""
    rows.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{folder.path}/{at}")
    if not any(name.startswith(f"{_BUCKET}=") for name in folder.names(at)):
        return {}
    counted = rows.sparkSession.read.parquet(f"{folder.path}/{at}").groupBy(_BUCKET).agg(F.count("*").alias("n"))
    return {str(b): n for b, n in counted.collect()}  # a row for each bucket


def merge_batch(batch: DataFrame, epoch: int, path: str, keys: list[str], sequence: str, buckets: int = 64) -> None:
    """Upsert a batch by key. The number of buckets is fixed by the first batch."""
    spark = batch.sparkSession
    folder = Folder(spark, path)
    known = _manifests(folder)
    if epoch in known:
        return
    before = [e for e in known if e < epoch]
    incoming = last_wins(batch, keys, sequence)
    old = _manifest(folder, max(before)) if before else {"buckets": {}, "keys": keys, "n_buckets": buckets, "schema": incoming.schema.jsonValue()}
    if old["keys"] != keys:
        raise ValueError(f"the table has the keys {old['keys']}")
    stored = T.StructType.fromJson(old["schema"])
    incoming = incoming.select(*stored.fieldNames(), F.lit(epoch).cast("long").alias(_EPOCH), _bucket(keys, old["n_buckets"]).alias(_BUCKET))
    delta = f"data/{epoch:020d}-delta"
    now = {b: list(parts) for b, parts in old["buckets"].items()}
    for b, n in _write(incoming, folder, delta).items():
        now.setdefault(b, []).append({"at": delta, "rows": n})
    heavy = [b for b, parts in now.items() if len(parts) > 1 and sum(p["rows"] for p in parts[1:]) > COMPACT * parts[0]["rows"]]
    if heavy:
        base = f"data/{epoch:020d}-base"
        rows = _latest(_load(spark, folder, old | {"buckets": now}, heavy), keys)
        for b, n in _write(rows, folder, base).items():
            now[b] = [{"at": base, "rows": n}]
    folder.put(f"manifests/{epoch:020d}.json", json.dumps(old | {"buckets": now}))
    _sweep(folder, epoch, max(before, default=None))


def _sweep(folder: Folder, epoch: int, before: int | None) -> None:
    """Delete the files and manifests that neither of the last two versions names."""
    kept = [epoch] if before is None else [before, epoch]
    named = {(part["at"], b) for e in kept for b, parts in _manifest(folder, e)["buckets"].items() for part in parts}
    for at in folder.names("data"):
        live = {b for a, b in named if a == f"data/{at}"}
        if not live:
            folder.delete(f"data/{at}")
            continue
        for name in folder.names(f"data/{at}"):
            if name.startswith(f"{_BUCKET}=") and name.partition("=")[2] not in live:
                folder.delete(f"data/{at}/{name}")
    for e in _manifests(folder):
        if e not in kept:
            folder.delete(f"manifests/{e:020d}.json")


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last committed batch."""
    folder = Folder(spark, path)
    known = _manifests(folder)
    if not known:
        raise FileNotFoundError(f"no batch is committed in {path}")
    manifest = _manifest(folder, max(known))
    return _latest(_load(spark, folder, manifest), manifest["keys"]).drop(_BUCKET, _EPOCH)


def merge_sink(path: str, keys: list[str], sequence: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A sink for ``drain`` that upserts each batch."""
    return lambda batch, epoch: merge_batch(batch, epoch, path, keys, sequence, buckets)
