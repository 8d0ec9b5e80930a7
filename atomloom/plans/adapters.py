"""Ordinary tables as structures and atoms, so that every operator can be checked against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atomloom.operators.structures import ATOM_SCHEMA
from atomloom.plans.session import PART_BYTES, file_bytes, spread

CELL = (60.0, 12.0, 12.0)
#: Users have many events, so that their pairs are many more.
EVENT_PART_BYTES = PART_BYTES // 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_items(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    """Line items by their order: all that is done by structure_id later on needs no other shuffle."""
    rows = table(spark, sf_dir, "lineitem")
    return spread(rows.select(F.col("l_orderkey").alias("structure_id"), *columns), "structure_id", file_bytes(rows))


def order_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as atoms of their order: quantity, discount and tax are the position."""
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    null = F.lit(None).cast("double")
    rows = _line_items(
        spark,
        sf_dir,
        *order,
        F.col("l_returnflag").alias("species"),
        F.col("l_quantity").alias("x"),
        F.round(F.col("l_discount") * 100).alias("y"),
        F.round(F.col("l_tax") * 100).alias("z"),
        (F.col("l_extendedprice") / 1e4).alias("fx"),
        F.col("l_discount").alias("fy"),
        F.col("l_tax").alias("fz"),
    )
    number = F.row_number().over(Window.partitionBy("structure_id").orderBy(*order))
    rows = rows.withColumns({"atom_id": (number - 1).cast("bigint")} | {c: null for c in ("sx", "sy", "sz")})
    return rows.select(*[c.split()[0] for c in ATOM_SCHEMA.split(", ")])


def order_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as structures; an order without a head has no energy and no kind."""
    n = _line_items(spark, sf_dir).groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_atoms"))
    head = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("structure_id"), F.lower("o_orderpriority").alias("config_type"), (F.col("o_totalprice") / 1e5).alias("energy"))
    zero = F.lit(0.0)
    lattice = F.array(*[F.array(*[F.lit(CELL[k]) if a == k else zero for a in range(3)]) for k in range(3)])
    null_tensor = F.lit(None).cast("array<array<double>>")
    return n.join(head, "structure_id", "left").select(
        "structure_id",
        "config_type",
        "n_atoms",
        lattice.alias("lattice"),
        "energy",
        null_tensor.alias("virials"),
        F.lit(None).cast("double").alias("energy_sigma_inv"),
        null_tensor.alias("virial_sigmas_inv"),
    )


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as atoms on a line: the user is the structure, the value the position."""
    events, zero = table(spark, sf_dir, "events"), F.lit(0.0)
    rows = events.select(F.col("user_id").alias("structure_id"), "ts", "event_id", F.col("event_type").alias("species"), F.col("value").alias("x"))
    number = F.row_number().over(Window.partitionBy("structure_id").orderBy("ts", "event_id"))
    rows = spread(rows, "structure_id", file_bytes(events), EVENT_PART_BYTES).withColumn("atom_id", (number - 1).cast("bigint"))
    return rows.select("structure_id", "atom_id", "species", "x", zero.alias("y"), zero.alias("z"))
