"""Connected components of a graph given by its links, as joins and minima.

Large-star and small-star rounds (Kiveris et al., 2014) alternate until no link changes: every node
points its larger neighbours, then its smaller ones, to the smallest it knows. Each round is a table in
the shared folder, so a lost executor never reaches back beyond one round. The number of rounds grows
with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptscore.llm.words import split_join, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.where(F.col("v") > F.col("u"))
    return split_join(larger, least, ["u"]).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = split_join(links, least, ["hi"]).where(F.col("lo") > F.col("m"))
    return (
        moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .unionAll(least.select("hi", F.col("m").alias("lo")))
        .distinct()
    )


def _state(links: DataFrame) -> tuple:
    return tuple(
        links.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi", F.lit(1)))
        ).first()
    )


def components(spark: SparkSession, links: DataFrame, root: str) -> DataFrame:
    """(node, root) for every linked node but the roots; ``links`` has two columns of one ordered type.

    A link of a node with itself and repeated links change nothing; no links give no rows.
    """
    a, b = links.columns
    ordered = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    stars = written(spark, ordered, f"{root}/round-0")
    before, number = _state(stars), 0
    while before[0]:
        number += 1
        stars = written(spark, _small_star(_large_star(stars)), f"{root}/round-{number}")
        now = _state(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
