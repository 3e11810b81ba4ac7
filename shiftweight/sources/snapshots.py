"""Tables and small documents that are replaced as a whole, in a folder that driver and executors share.

A new version is written beside the old one and becomes visible by one rename of a small file. Readers keep the version
they began with; a job that fails before the rename leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.runs import bare_key, upsert_rows


class VersionExists(Exception):
    """Somebody else published this version first."""


class Folder:
    """Small text files of a folder, read and written by the driver through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """Sorted names of the files, without those that are still being written."""
        if not self._fs.exists(self._at("")):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if n[0] not in "._")

    def put(self, name: str, text: str) -> None:
        """Write a new file at once; one of that name is an error."""
        waiting = f"_{uuid.uuid4().hex}"
        out = self._fs.create(self._at(waiting), False)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(self._hadoop, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(self._at("").toUri(), self._conf).rename(self._at(waiting), self._at(name), none)
        except Exception as e:
            self._fs.delete(self._at(waiting), False)
            if "FileAlreadyExists" in str(e) or self._fs.exists(self._at(name)):
                raise VersionExists(f"{self.path}/{name}") from e
            raise

    def get(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class SnapshotTable:
    """A table of at most one row per key, in buckets of the key's hash; an upsert writes only buckets that it touches.

    Versions are numbered; a version lists for each bucket the folder that holds its rows. Two writers of one version: the
    second gets ``VersionExists`` and can try again. The driver holds lists of ``buckets`` entries.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "run_id", buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.versions = Folder(spark, f"{self.path}/versions")
        known = self._manifest(self.version())
        self.buckets = known["buckets"] if known else buckets

    def version(self) -> int:
        """The latest version; 0 before the first upsert."""
        names = self.versions.names()
        return int(names[-1].split(".")[0]) if names else 0

    def _manifest(self, version: int) -> dict | None:
        return json.loads(self.versions.get(f"{version:012d}.json")) if version else None

    def _folders(self, known: dict, buckets: list[int] | None = None) -> list[str]:
        return [f"{self.path}/data/{folder}/bucket_={b}" for b, folder in known["folders"].items() if buckets is None or int(b) in buckets]

    def read(self, version: int | None = None) -> DataFrame | None:
        """Rows of a version (default: the latest one); None before the first. Columns that old rows lack are null."""
        return self._rows(self._manifest(self.version() if version is None else version))

    def _rows(self, known: dict | None, buckets: list[int] | None = None) -> DataFrame | None:
        if known is None:
            return None
        schema = T.StructType.fromJson(known["schema"])
        folders = self._folders(known, buckets)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, new: DataFrame, order: str = "row_no") -> int:
        """Put rows in by ``runs.upsert_rows`` and return the version that holds them.

        Rows of untouched buckets are neither read nor written. ``new`` without rows gives the version as it is.
        """
        at = self.version()
        known = self._manifest(at)
        bucket = F.pmod(F.xxhash64(bare_key(F.col(self.key))), F.lit(self.buckets)).cast("int")
        touched = sorted(r.b for r in new.select(bucket.alias("b")).distinct().collect())  # ``buckets`` values at most
        if not touched:
            return at
        old = self._rows(known, touched)
        kept = upsert_rows(new.limit(0) if old is None else old, new, self.key, order)
        folder = uuid.uuid4().hex
        kept.withColumn("bucket_", bucket).repartition(len(touched), "bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/data/{folder}")
        before = T.StructType.fromJson(known["schema"]).fields if known else []
        names = {f.name for f in kept.schema}
        schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in kept.schema], *[f for f in before if f.name not in names]])
        folders = (known["folders"] if known else {}) | {str(b): folder for b in touched}
        self._publish(at + 1, {"buckets": self.buckets, "key": self.key, "schema": json.loads(schema.json()), "folders": folders})
        return at + 1

    def _publish(self, version: int, known: dict) -> None:
        self.versions.put(f"{version:012d}.json", json.dumps(known))

    def expire(self, keep: int = 2) -> list[int]:
        """Forget all but the latest versions and delete the folders that none of these names; readers of old versions must be done."""
        names = self.versions.names()
        old, stays = names[:-keep], names[-keep:]
        used = {folder for n in stays for folder in json.loads(self.versions.get(n))["folders"].values()}
        data = Folder(self.spark, f"{self.path}/data")
        for n in old:
            gone = set(json.loads(self.versions.get(n))["folders"].values()) - used
            self.versions.drop(n)
            for folder in gone:
                data.drop(folder)
        return [int(n.split(".")[0]) for n in old]
