"""Current tables as versions of buckets.

Plain Parquet has no MERGE.  A table is kept in a fixed number of buckets by a hash of its key, and a
run writes only the buckets it touches, into a folder of its own.  A version is a small table that
names, for every bucket, the folder that holds it; it is written last, as one file, and the newest
version is the current one.  So readers see a run whole or not at all, a run that died leaves nothing
to be read, untouched buckets keep their files, and a run that is already committed is known.  One run
commits at a time; a second one that started from the same version fails when it commits.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

VERSION = "run_id string, name string, bucket int, folder string"
#: In place of a bucket: rows that are only ever added.
ADDED = -1


@dataclass(frozen=True)
class Version:
    """``folders`` holds (table, bucket) -> folder, at most one entry a bucket."""

    seq: int = 0
    folders: Mapping[tuple[str, int], str] = field(default_factory=dict)


@dataclass(frozen=True)
class Store:
    """Tables below ``root``, a folder that all executors share.

    ``buckets`` is fixed for the life of the store: choose it so that a bucket of the full table is
    a few files' worth.
    """

    spark: SparkSession
    root: str
    buckets: int = 64

    def bucket(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{VERSION}, seq long").parquet(f"{self.root}/versions")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def committed(self, run_id: str) -> bool:
        versions = self._versions()
        return versions is not None and not versions.filter(F.col("run_id") == run_id).isEmpty()

    def head(self) -> Version:
        """The current version; one without tables before the first run."""
        versions = self._versions()
        newest = versions and versions.agg(F.max("seq")).first()[0]
        if not newest:
            return Version()
        rows = versions.filter((F.col("seq") == newest) & (F.col("bucket") != ADDED)).collect()
        return Version(newest, {(r["name"], r["bucket"]): r["folder"] for r in rows})

    def read(
        self, name: str, schema: str, version: Version | None = None, buckets: Iterable[int] | None = None
    ) -> DataFrame:
        """The rows of a table in a version (the current one, if not given), or of some of its buckets."""
        version = version or self.head()
        wanted = range(self.buckets) if buckets is None else buckets
        paths = [
            f"{version.folders[name, b]}/bucket={b}" for b in sorted(wanted) if (name, b) in version.folders
        ]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read_added(self, name: str, schema: str) -> DataFrame:
        """The rows that committed runs have added to a table."""
        versions = self._versions()
        rows = [] if versions is None else versions.filter(
            (F.col("name") == name) & (F.col("bucket") == ADDED)
        ).collect()
        paths = [r["folder"] for r in rows]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def folder(self, name: str, run_id: str) -> str:
        return f"{self.root}/{name}/run={run_id}"

    def commit(
        self, base: Version, run_id: str, changed: Mapping[str, tuple[DataFrame, list[str]]],
        added: Mapping[str, DataFrame], touched: Iterable[int],
    ) -> Version:
        """Write ``changed`` (table -> all rows of the touched buckets, and their key) and ``added``, then the version."""
        touched, folders = list(touched), dict(base.folders)
        for name, (rows, key) in changed.items():
            path = self.folder(name, run_id)
            placed = rows.withColumn("bucket", self.bucket(*key))
            # One task a bucket would make a hot bucket one file; Spark splits large ones, and joins small ones.
            placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            written = {r["bucket"] for r in self.spark.read.parquet(path).select("bucket").distinct().collect()} if touched else set()
            for b in touched:
                folders.pop((name, b), None)
            folders |= {(name, b): path for b in written}
        entries = [(run_id, name, b, path) for (name, b), path in folders.items()]
        for name, rows in added.items():
            rows.write.mode("overwrite").parquet(self.folder(name, run_id))
            entries.append((run_id, name, ADDED, self.folder(name, run_id)))
        seq = base.seq + 1
        entries = entries or [(run_id, None, None, None)]
        self.spark.createDataFrame(entries, VERSION).coalesce(1).write.mode("error").parquet(f"{self.root}/versions/seq={seq}")
        return Version(seq, folders)
