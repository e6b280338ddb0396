"""Skew-safe row numbering within groups.

``row_number() over (partition by g order by o)`` sends every row of a group to one
task; a group holding a third of the data would sit in one task. Here the rows
are range-partitioned on (g, o) instead — Spark samples the key distribution, so
a hot group is split over many tasks — and each row's number is its position
inside its task plus the row count of the same group in earlier tasks. Those
counts form a small (group, task) table: at most #groups + #tasks rows because
each task holds one contiguous key range.

The order key must be total (end it with a unique column) so the numbering is
deterministic. The sorted rows are checkpointed to the shared checkpoint folder:
both uses of them then read the same partitioning, also after an executor loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.session import ensure_checkpoint_dir


def row_number_within(df: DataFrame, group_cols: list[str], order_cols: list[Column], name: str = "rn", num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [F.col(g) for g in group_cols] + list(order_cols)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    tagged = ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_mid")).checkpoint(eager=True)
    stats = tagged.groupBy(*group_cols, "_part").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols).orderBy("_part") if group_cols else Window.orderBy("_part")
    stats = stats.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_cols)],
        F.col("_part").alias("_spart"),
        "_first",
        (F.sum("_n").over(w) - F.col("_n")).alias("_offset"),
    )
    cond = tagged["_part"] == stats["_spart"]
    for i, g in enumerate(group_cols):
        cond = cond & tagged[g].eqNullSafe(stats[f"_g{i}"])
    joined = tagged.join(stats, cond, "inner")
    out = joined.withColumn(name, F.col("_mid") - F.col("_first") + F.col("_offset") + 1)
    return out.drop("_part", "_mid", "_first", "_offset", "_spart", *[f"_g{i}" for i in range(len(group_cols))])
