"""Shared-folder storage for intermediate tables.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``, which driver and
executors share.  Only when that setting is absent and the master is a single local
JVM (tests, notebooks) is a temporary folder created instead.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROWS_A_FILE, ROWS_A_BUCKET = 500_000, 100_000
PACKAGE_PARENT = str(Path(__file__).resolve().parent.parent)


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if PACKAGE_PARENT not in known.split(":"):
        env["PYTHONPATH"] = f"{PACKAGE_PARENT}:{known}" if known else PACKAGE_PARENT
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that all processes of this application can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='provloom-')}")
    return sc.getCheckpointDir().rstrip("/")


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows at most, in no more partitions than these rows are worth."""
    return df.coalesce(1 + rows // ROWS_A_FILE)


def buckets_for(rows: int) -> int:
    """Buckets for tables of ``rows`` rows that are joined again and again."""
    return 1 + rows // ROWS_A_BUCKET


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, as it does once their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables written by one operator call; ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = attach(spark)
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, codec: str | None = None, rows: int | None = None) -> DataFrame:
        """Write ``df`` once and return it as a table read back from storage.

        ``rows`` bounds its rows where the caller knows them: a small table then comes in
        few files instead of one a shuffle partition.
        """
        if rows is not None:
            df = few(df, rows)
        writer = df.write.mode("overwrite")
        if codec:
            writer = writer.option("compression", codec)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep_bucketed(self, df: DataFrame, name: str, buckets: int, *columns: str, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Write ``df`` as a table of buckets by ``columns``, which joins on them do not shuffle again.

        ``each`` is applied to the rows once they lie in their buckets.
        """
        spread = df.repartition(buckets, *columns)
        return self.append_bucketed(each(spread) if each else spread, name, buckets, *columns)

    def append_bucketed(self, df: DataFrame, name: str, buckets: int, *columns: str) -> DataFrame:
        """Add ``df``, which lies in these buckets already, to the table; it is returned with all rows that it has."""
        table = self.tables.setdefault(name, f"{name.replace('-', '_')}_{uuid.uuid4().hex}")
        df.write.mode("append").bucketBy(buckets, *columns).option("path", self.path(name)).format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            target = jvm.org.apache.hadoop.fs.Path(self.path(name))
            target.getFileSystem(conf).delete(target, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{table}.parquet")
