"""Equi-joins that treat null keys as equal; sides that are sent to the other one by their counted size."""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL = 32 * 2 ** 20            # bytes of keys up to which they are sent to the other side of a join


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """``left.join(right, keys, how)`` for inner, left, left_semi and left_anti joins, with null equal to null."""
    from pyspark.sql import functions as F

    renamed = right.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    if broadcast:
        renamed = F.broadcast(renamed)
    on = None
    for i, k in enumerate(keys):
        c = left[k].eqNullSafe(renamed[f"_key_{i}"])
        on = c if on is None else on & c
    return left.join(renamed, on, how).drop(*[f"_key_{i}" for i in range(len(keys))])


def sent(keys: DataFrame) -> DataFrame:
    """``keys`` (numbers and short texts), written once, and to be broadcast if they are at most ``SMALL`` by count."""
    from pyspark.sql import functions as F

    from packtables.session import cut_lineage

    keys = cut_lineage(keys)
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in keys.dtypes if kind == "string"]
    size = keys.select(F.sum(sum(texts, F.lit(32 + 8 * len(keys.columns)))).alias("n")).first().n
    return F.broadcast(keys) if (size or 0) <= SMALL else keys
