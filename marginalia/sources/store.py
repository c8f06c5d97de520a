"""Stored tables: the vector index (keyed merge by buckets) and the reference store (one partition a source)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.ids import point_id
from marginalia.operators.bibliography import from_json_maps, latest, stem, to_json_maps
from marginalia.session import staged

POINT = "point_id string, vector array<float>, content string, source string, page_number int, chunk_index int"
METRICS = ("cosine",)


class VectorStore:
    """A table of points: point_id, vector, content, source, page_number, chunk_index, in buckets by point id.

    A write makes new files for the buckets it touches, and then a new manifest (which bucket is where) by one
    rename, so readers never see half a table, a lost job leaves the old version, and untouched buckets
    aren't written again. Of two writers on one version the second fails, and may repeat its merge.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int, metric: str = "cosine", buckets: int = 64) -> None:
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
        self.spark, self.path, self.dimension, self.metric, self.buckets = spark, path, dimension, metric, buckets
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _version(self) -> int:
        """The latest manifest's number, -1 without any."""
        found = self._fs.globStatus(self._Path(f"{self.path}/manifest-*.json"))
        return max((int(f.getPath().getName()[9:-5]) for f in found or []), default=-1)

    def _manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{version:012d}.json", wholetext=True).first()[0])

    def _commit(self, version: int, manifest: dict) -> None:
        target = self._Path(f"{self.path}/manifest-{version:012d}.json")
        # Whoever makes the lock owns this version.
        try:
            self._fs.create(self._Path(f"{self.path}/lock-{version:012d}"), False).close()
        except Exception as e:
            raise RuntimeError(f"another writer made version {version}: merge again") from e
        temporary = self._Path(f"{self.path}/new-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(temporary, target):
            raise RuntimeError(f"version {version} couldn't be published")

    def ensure(self) -> None:
        """Makes the table if it isn't there; raises if it is one of other vectors or another metric."""
        v = self._version()
        if v < 0:
            self._commit(0, {"dimension": self.dimension, "metric": self.metric, "buckets": self.buckets, "at": {}})
            return
        m = self._manifest(v)
        if (m["dimension"], m["metric"]) != (self.dimension, self.metric):
            raise ValueError(f"the table holds vectors of size {m['dimension']} compared by {m['metric']}")
        self.buckets = m["buckets"]

    def scan(self, vectors: bool = False) -> DataFrame | None:
        """All points; without ``vectors`` the vector column isn't read. None before the first write."""
        v = self._version()
        at = self._manifest(v)["at"] if v >= 0 else {}
        if not at:
            return None
        t = self._read(list(at.values()))
        return t if vectors else t.drop("vector")

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(POINT).parquet(*[f"{self.path}/{p}" for p in sorted(parts)])

    def count(self) -> int:
        t = self.scan()
        return 0 if t is None else t.count()

    def upsert(self, points: DataFrame, replace_source: bool = False) -> int:
        """Merge by point id and return the number of new points: they win over stored ones, and of several with
        one id the one with the greatest content counts. ``replace_source`` also drops the stored points
        of the sources in ``points``, which a plain re-ingest leaves behind."""
        self.ensure()
        new = points.select(point_id(F.col("source"), F.col("page_number"), F.col("chunk_index")).alias("point_id"), F.col("vector").cast("array<float>").alias("vector"), "content", "source", "page_number", "chunk_index")
        checked = F.when(F.size("vector") == self.dimension, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector's size isn't {self.dimension}")))
        rest = ["vector", "content", "source", "page_number", "chunk_index"]
        new = new.withColumn("vector", checked).groupBy("point_id").agg(F.max_by(F.struct(*rest), F.struct("content", F.xxhash64("vector"))).alias("p")).select("point_id", *[f"p.{c}" for c in rest])
        bucket = F.pmod(F.xxhash64("point_id"), F.lit(self.buckets)).cast("int")
        new = staged(new.withColumn("bucket", bucket))
        sizes = {r.bucket: r["count"] for r in new.groupBy("bucket").count().collect()}
        version = self._version()
        manifest = self._manifest(version)
        at: dict[str, str] = manifest["at"]
        touched = {str(b) for b in sizes}
        gone = new.select("source").distinct()
        if replace_source and at:
            stale = self._read(list(at.values())).select("source", bucket.alias("bucket")).join(gone, "source", "left_semi")
            touched |= {str(r.bucket) for r in stale.select("bucket").distinct().collect()}
        before = [at[b] for b in touched if b in at]
        if before:
            old = self._read(before).withColumn("bucket", bucket)
            old = old.join(gone, "source", "left_anti") if replace_source else old.join(new.select("point_id"), "point_id", "left_anti")
            merged = old.unionByName(new)
        else:
            merged = new
        folder = f"data-{uuid.uuid4().hex}"
        if touched:
            merged.repartition(max(1, min(len(touched), self.buckets)), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            there = {f.getPath().getName()[7:] for f in self._fs.globStatus(self._Path(f"{self.path}/{folder}/bucket=*")) or []}
            manifest["at"] = {b: p for b, p in at.items() if b not in touched} | {b: f"{folder}/bucket={b}" for b in there}
            self._commit(version + 1, manifest)
        return sum(sizes.values())

    def vacuum(self) -> int:
        """Removes what the latest manifest doesn't name; readers of older versions must be done. Returns the number
        of folders removed."""
        v = self._version()
        if v < 0:
            return 0
        used, n = set(self._manifest(v)["at"].values()), 0
        for f in self._fs.globStatus(self._Path(f"{self.path}/data-*/bucket=*")) or []:
            p = f.getPath()
            if f"{p.getParent().getName()}/{p.getName()}" not in used:
                n += bool(self._fs.delete(p, True))
        for f in self._fs.globStatus(self._Path(f"{self.path}/manifest-*.json")) or []:
            if int(f.getPath().getName()[9:-5]) < v:
                self._fs.delete(f.getPath(), False)
        return n


class ReferenceStore:
    """References by source: one JSON object a source, in partitions by the source's stem."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._there = lambda: p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def save(self, refs: DataFrame, order: str | None = None) -> None:
        """refs: source, number, content. A source's partition is replaced whole; of repeated numbers the last in
        ``order`` counts, or without one the greatest content."""
        maps = to_json_maps(latest(refs, F.col(order) if order else F.col("content")))
        maps.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stem").text(self.path)

    def all(self) -> DataFrame:
        """stem, number, content of the whole store, empty where nothing was saved; filters on the stem prune partitions."""
        if not self._there():
            return self.spark.createDataFrame([], "stem string, number int, content string")
        return from_json_maps(self.spark.read.option("basePath", self.path).schema("value string, stem string").text(self.path).withColumnRenamed("value", "json"))

    def load(self, source: str) -> dict[int, str]:
        """The references of one source; none for an unknown one."""
        key = stem(F.lit(source))
        return {r.number: r.content for r in self.all().where(F.col("stem") == key).collect()}

    def get(self, source: str, number: int) -> str | None:
        """One reference; null for an unknown source or number."""
        got = self.all().where((F.col("stem") == stem(F.lit(source))) & (F.col("number") == number)).first()
        return got.content if got else None

    def lookup(self, asked: DataFrame) -> DataFrame:
        """``asked`` (source, number, ...) with ``content``; null where the store has none. One join for all."""
        r = self.all().select(F.col("stem").alias("_stem"), F.col("number").alias("_number"), F.col("content").alias("reference"))
        return asked.join(r, (stem(F.col("source")) == F.col("_stem")) & (F.col("number") == F.col("_number")), "left").drop("_stem", "_number")
