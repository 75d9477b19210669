"""Tier files: all items of a tier in the order of their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks(items: DataFrame, tier: int, tag: str = "context") -> DataFrame:
    """(part, path, block): the opening line, a block for each item, the closing line; in order.

    A tier may be large, so its text stays distributed; a sort by part and path puts it in order.
    """
    head = items.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("path"), F.lit(f'<{tag} tier="{tier}">\n\n').alias("block"))
    tail = head.select(F.lit(2).alias("part"), "path", F.lit(f"</{tag}>\n").alias("block"))
    text = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n<!-- source: "), F.col("path"), F.lit(" -->\n\n"), F.col("body"), F.lit("\n\n"))
    own = items.filter(F.col("tier") == tier).select(F.lit(1).alias("part"), "path", text.alias("block"))
    return head.unionByName(own).unionByName(tail).orderBy("part", "path")
