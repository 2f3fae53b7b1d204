"""Ordered running sums per key that do not put a key in one task.

``running_sum`` is a prefix sum over ``order`` within ``keys``. The rows are
range-partitioned by (keys, order), so a key holding a large share of all
rows spreads over several contiguous blocks; sums are computed per
(key, block) and only keys that straddle a block border (at most
``2 * blocks`` of them, a bound independent of the data) get an offset from
the blocks before them, through a broadcast table of at most that size. Null
keys are keys like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packtables.operators.joins import null_safe_join
from packtables.session import cut_lineage


def running_sum(df: DataFrame, keys: list[str], order: list[Column | str], value: Column | str, out: str,
                num_blocks: int | None = None) -> DataFrame:
    """Adds ``out`` = sum of ``value`` over the key's rows up to and including this one."""
    n = num_blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(value) if isinstance(value, str) else value
    ordered = [F.col(k).asc() for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    r = cut_lineage(cut_lineage(df.withColumn("_v", v)).repartitionByRange(n, *ordered)
                    .withColumn("_blk", F.spark_partition_id()))
    wl = Window.partitionBy(*keys, "_blk").orderBy(*order)
    r = r.withColumn("_lp", F.sum("_v").over(wl.rowsBetween(Window.unboundedPreceding, 0)))
    kstruct = F.struct(*[F.col(k) for k in keys])
    ends = r.groupBy("_blk").agg(F.min(kstruct).alias("lo"), F.max(kstruct).alias("hi"))
    border = (ends.select(F.col("lo").alias("_k")).union(ends.select(F.col("hi").alias("_k"))).distinct()
              .select(*[F.col(f"_k.{k}").alias(k) for k in keys]))
    totals = (null_safe_join(r, border, keys, "left_semi", broadcast=True)
              .groupBy(*keys, "_blk").agg(F.sum("_v").alias("_t")))
    wk = Window.partitionBy(*keys).orderBy("_blk")
    offsets = totals.select(*keys, "_blk", F.sum("_t").over(wk.rowsBetween(Window.unboundedPreceding, -1))
                            .alias("_off"))
    res = null_safe_join(r, offsets, keys + ["_blk"], "left", broadcast=True)
    return res.withColumn(out, F.col("_lp") + F.coalesce(F.col("_off"), F.lit(0))).drop("_v", "_blk", "_lp", "_off")
