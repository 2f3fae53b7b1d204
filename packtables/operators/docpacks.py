"""Budgeting a table of documents as file packs (B1, B2 file rule, W4, W5, P16).

Every ``group_col`` value is one pack; its documents are ``<file>`` entries.
Files are dropped longest first (ties: lower id first, the stable order of
the reference), until the pack fits the budget. A null group is a pack too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packtables.functions.text import cdata, xml_escape
from packtables.functions.tokens import count_tokens
from packtables.operators.budget import apply_budget
from packtables.operators.joins import null_safe_join
from packtables.plans.xml import ROOT_CLOSE, literal_tokens, root_open, section_tokens


def budget_documents(docs: DataFrame, max_tokens: int = 6000, group_col: str = "source",
                     id_col: str = "doc_id", text_col: str = "text", method: str = "scan") -> DataFrame:
    path = F.concat(F.col(group_col), F.lit("/doc_"), F.col(id_col).cast("string"))
    line = F.concat(F.lit('    <file path="'), xml_escape(path), F.lit('">'), cdata(F.col(text_col)), F.lit("</file>"))
    pack_id = F.substring(F.md5(F.col(group_col).cast("string")), 1, 8)
    entries = docs.select(
        F.col(group_col), F.col(id_col), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"),
        count_tokens(line).alias("tokens"),
        (count_tokens(root_open(pack_id)) + F.lit(literal_tokens(ROOT_CLOSE))).alias("base"))
    # The section wrapper goes with the file that is dropped last (the shortest,
    # ties: highest id); an aggregate finds it without ordering the whole pack.
    order = [F.col("chars").desc(), F.col(id_col).asc()]
    last = (entries.groupBy(group_col).agg(F.min(F.struct("chars", (-F.col(id_col)).alias("nid"))).alias("m"))
            .select(group_col, F.col("m.chars").alias("chars"), (-F.col("m.nid")).alias(id_col),
                    F.lit(True).alias("_last")))
    steps = (null_safe_join(entries, last, [group_col, "chars", id_col], "left")
             .withColumn("delta", F.col("tokens") + F.when(F.col("_last"), F.lit(section_tokens("files")))
                         .otherwise(F.lit(0))).drop("_last"))
    return apply_budget(steps, [group_col], order, budget=max_tokens, method=method)

