"""Written intermediate tables.

Jobs that need a value fixed once (row positions, the state of an iteration) write it
to the shared folder the cluster names in ``spark.checkpoint.dir`` and read it back.
The files survive lost executors and cut the lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from coursemill.session import apply_settings

PRESSED = {"spark.sql.parquet.compression.codec": "zstd", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for written tables: the cluster's checkpoint folder, else (local runs only) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/coursemill/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="coursemill-")
    return _local_roots[app]


class Store:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or shared_root(spark)).rstrip("/")

    def fresh_path(self, label: str) -> str:
        return f"{self.root}/{label}-{uuid.uuid4().hex}"

    def keep_pressed(self, df: DataFrame, label: str) -> DataFrame:
        """As ``keep``, for large tables: as zstd, and the shuffle files that ``df`` took are removed once it is written.

        Else those files stay until the driver happens to collect its garbage.
        """
        before = {k: self.spark.conf.get(k, None) for k in PRESSED}
        try:
            apply_settings(self.spark, PRESSED)
            return self.keep(df, label)
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads the written files."""
        path = self.fresh_path(label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_bucketed(self, df: DataFrame, label: str, column: str) -> DataFrame:
        """As ``keep``, in buckets of ``column``: what is read back is grouped by it without a shuffle."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = self.fresh_path(label)
        name = "".join(c if c.isalnum() else "_" for c in path.rsplit("/", 1)[-1])
        df.write.bucketBy(buckets, column).option("path", path).format("parquet").saveAsTable(name)
        return self.spark.table(name)
