"""What the operators of this subpackage share: materialising, sized joins, row keys."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many bytes may be broadcast; a larger one is shuffled.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, which the cluster names in spark.checkpoint.dir.

    Only where the setting is absent (tests, a local session) one is chosen.
    """
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
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _filesystem(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared folder now."""
    system, path = _filesystem(spark, folder)
    system.delete(path, True)


def remove_at_end(spark: SparkSession, folder: str) -> None:
    """Delete a folder, which must be there, when the driver ends."""
    system, path = _filesystem(spark, folder)
    system.deleteOnExit(path)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Compute now, into Parquet files of the shared folder, and read them again.

    The lineage ends there, so a lost executor costs nothing that was computed
    before; Spark knows the table's size; and the files go with the driver, or
    with ``discard``.
    """
    spark = df.sparkSession
    folder = fresh_dir(spark, name)
    df.write.parquet(folder)
    remove_at_end(spark, folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out.__dict__["_cut_folder"] = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` wrote and that nothing reads any more."""
    for t in tables:
        folder = t.__dict__.pop("_cut_folder", None)
        if folder:
            remove(t.sparkSession, folder)


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit BROADCAST_BYTES, else as it is (Spark shuffles it)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def shielded(df: DataFrame, *names: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``df`` with its columns renamed so that none can clash, copies of the named ones in front, and the way back."""
    back = [(f"_c{i}", c) for i, c in enumerate(df.columns)]
    plain = df.toDF(*[a for a, _ in back])
    at = {c: a for a, c in back}
    return plain.select(*[F.col(at[n]).alias(n) for n in names], *[a for a, _ in back]), back


def unshielded(df: DataFrame, back: list[tuple[str, str]]) -> DataFrame:
    return df.select(*[F.col(a).alias(c) for a, c in back])
