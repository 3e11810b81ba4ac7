"""Run files read once: a stored table of what was seen of a folder, so that only new and changed files are opened."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import SnapshotTable


class RunFiles:
    """Rows of all files of one name below a runs folder, kept in ``store`` and brought up to date by ``refresh``.

    ``read(paths)`` turns files into rows with a column ``file`` (such as ``read_metrics_csv``); rows of files that gave none before
    are looked for again only when the file changes. Files are the same if path, time of change and length are.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, store: str, read: Callable[[list[str]], DataFrame], buckets: int = 64):
        self.spark, self.pattern, self.read = spark, f"{root.rstrip('/')}/*/*/*/*/{name}", read
        self.files, self.rows = SnapshotTable(spark, f"{store}/files", "file", buckets), SnapshotTable(spark, f"{store}/rows", "file", buckets)

    def listed(self) -> DataFrame:
        """(file, path, changed, length) of the files as they are now; contents are not read."""
        found = self.spark.read.format("binaryFile").load(self.pattern)
        return found.select(F.col("_metadata.file_path").alias("file"), "path", F.unix_micros("modificationTime").alias("changed"), "length")

    def changed(self) -> DataFrame:
        """The listed files that are new or not as they were seen."""
        now, seen = self.listed(), self.files.read()
        return now if seen is None else now.join(seen.select("file", "changed", "length"), ["file", "changed", "length"], "left_anti")

    def refresh(self) -> int:
        """Read new and changed files and store their rows; the number of files opened.

        The rows are stored before the list of files: a refresh that is broken off reads these files again. The driver holds the paths of changed
        files, as it does when it lists them.
        """
        changed = self.changed().select("file", "path", "changed", "length", F.col("changed").alias("row_no")).collect()
        if not changed:
            return 0
        files = self.spark.createDataFrame(changed, "file string, path string, changed bigint, length bigint, row_no bigint")
        # A changed file may have no row any more; what it gave before must not stay. "found" says whether it has one.
        rows = files.select("file", "row_no").join(self.read([r.path for r in changed]).withColumn("found", F.lit(True)), "file", "left")
        self.rows.upsert(rows)
        self.files.upsert(files)
        return len(changed)

    def table(self) -> DataFrame | None:
        """Stored rows of the files that still exist; None before the first refresh."""
        rows = self.rows.read()
        return None if rows is None else rows.filter("found").drop("found", "row_no").join(self.listed().select("file"), "file", "left_semi")
