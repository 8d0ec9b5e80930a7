"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many bytes may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Bytes of files whose rows one task of a shuffle gets.
PART_BYTES = 2 << 20


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.master(f"local[{cores}]")
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; only a local session may choose its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "atomloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own within the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_at_end(spark: SparkSession, folder: str) -> None:
    """Delete a folder, which must be there, when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def cut(df: DataFrame) -> DataFrame:
    """Compute now, into Parquet files of the shared folder, and read them again: the lineage ends there."""
    spark = df.sparkSession
    folder = fresh_dir(spark, "cut")
    df.write.parquet(folder)
    remove_at_end(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that a table is read from, as far as Spark knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def spread(df: DataFrame, key: str, size: int, part_bytes: int | None = None) -> DataFrame:
    """Rows by their key in as many tasks as ``size`` bytes of files need, so that a task's memory doesn't grow with the input; few bytes are left to Spark."""
    n = -(-size // (part_bytes or PART_BYTES))
    return df if n < 8 else df.repartition(min(n, 20_000), key)


def driver_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of the driver's rows, broadcast if they fit BROADCAST_BYTES and joined by Spark's own choice beyond it."""
    size = sum(_size(x) for row in rows for x in row)
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _size(x) -> int:
    if isinstance(x, (list, tuple)):
        return 16 + sum(map(_size, x))
    return 16 + len(x) if isinstance(x, str) else 8
