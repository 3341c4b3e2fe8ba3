"""Which folders of a stream count: versions of one row, each a file of its own.

A version names the live folders and the last batch that compaction has taken in. Its file appears by a single
rename when the job that writes it commits, so a reader sees a version whole or not at all: the state before a batch
or compaction, or the one after. Folders of earlier versions stay, for readers that have begun; like all written
tables they are left to the folder's expiry rule. A stream is the only writer of its manifest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version bigint, through bigint, names array<string>"


def batch_name(batch_id: int) -> str:
    return f"batch_id={batch_id}"


def compacted_name(batch_id: int) -> str:
    return f"through_id={batch_id}"


def _place(folder: str) -> str:
    # Spark leaves out names that begin with an underscore when it reads the folder itself.
    return f"{folder.rstrip('/')}/_manifest"


def versions(spark: SparkSession, folder: str) -> DataFrame | None:
    """All versions of a folder's manifest; None where the folder has none."""
    try:
        return spark.read.schema(VERSION).parquet(_place(folder))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def live_folders(spark: SparkSession, folders: Sequence[str], version: int | None = None) -> list[str]:
    """The folders that count, by the newest version or by an earlier one; a folder without manifest counts whole."""
    live = []
    for folder in folders:
        known = versions(spark, folder)
        if known is None:
            live.append(folder)
            continue
        wanted = known if version is None else known.filter(F.col("version") <= version)
        (names,) = wanted.agg(F.max_by("names", "version")).first()
        live += [f"{folder.rstrip('/')}/{name}" for name in names or []]
    return live


class Manifest:
    """The manifest as its writer sees it: read once, then kept in step with what it commits."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.version, self.through, self.names = 0, -1, []
        known = versions(spark, folder)
        newest = known.orderBy(F.desc("version")).first() if known is not None else None
        if newest is not None:
            self.version, self.through, self.names = newest.version, newest.through, list(newest.names)

    @property
    def loose(self) -> list[int]:
        """Live batches that compaction has not taken in."""
        return [int(name.removeprefix("batch_id=")) for name in self.names if name.startswith("batch_id=")]

    def has(self, batch_id: int) -> bool:
        return batch_id <= self.through or batch_name(batch_id) in self.names

    def folders(self) -> list[str]:
        return [f"{self.folder}/{name}" for name in self.names]

    def add(self, batch_id: int) -> None:
        self._commit(self.through, [*self.names, batch_name(batch_id)])

    def compacted(self, through: int) -> None:
        """All that is live now lies in one folder, which takes in the batches up to ``through``."""
        self._commit(through, [compacted_name(through)])

    def _commit(self, through: int, names: list[str]) -> None:
        version = self.version + 1
        row = self.spark.range(1).select(
            F.lit(version).cast("bigint").alias("version"),
            F.lit(through).cast("bigint").alias("through"),
            F.array(*map(F.lit, names)).alias("names"),
        )
        row.coalesce(1).write.mode("append").parquet(_place(self.folder))
        self.version, self.through, self.names = version, through, names
