"""Connected components of a graph given as a table of links, by rounds of joins.

Each round hangs every node on the smallest node it can see (alternating the larger and
the smaller neighbours), so long chains fold up in a logarithmic number of rounds. Links
never leave the cluster: only one checksum per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm.shared import drop_stage, write_stage


def _larger_to_smallest(links: DataFrame) -> DataFrame:
    """For each node, its larger neighbours linked to the smallest of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("__m")).select("a", F.least("a", "__m").alias("__m"))
    return (
        both.where(F.col("b") > F.col("a"))
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("__m").alias("b"))
        .distinct()
    )


def _smaller_to_smallest(links: DataFrame) -> DataFrame:
    """For each node, itself and its smaller neighbours linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("__m"))
    hung = links.join(least, "a").where(F.col("b") != F.col("__m"))
    return least.select("a", F.col("__m").alias("b")).unionByName(
        hung.select(F.col("b").alias("a"), F.col("__m").alias("b"))
    ).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node of its component, for each node of some link.

    ``links`` has two columns of one orderable type; nulls and self-links are ignored,
    repeated links do no harm, and no link gives no row. Ends when a round changes nothing.
    """
    spark = links.sparkSession
    first, second = links.columns[:2]
    a, b = F.col(f"`{first}`"), F.col(f"`{second}`")
    turned = links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    current, path = write_stage(turned, "links")
    before = None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(mark) == before or not mark[0]:
            break
        before = tuple(mark)
        folded, new_path = write_stage(_smaller_to_smallest(_larger_to_smallest(current)), "links")
        drop_stage(spark, path)
        current, path = folded, new_path
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
