"""Connected components of a link table, by stars that grow and shrink in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwise.llm.common import checkpointed

#: Parts that the neighbours of one node are dealt to. Few, because a side that Spark finds small enough
#: to broadcast is repeated so many times first.
SALTS = 4


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """links(u, v) with the m of their u; a node of very many neighbours is met in parts."""
    dealt = links.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    each = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(each, ["u", "part"])


def _large_star(links: DataFrame) -> DataFrame:
    """Neighbours above a node are tied to the smallest node around it."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = _with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(u, v) but the smallest ones of components.

    Each round is two joins on a node's smallest neighbour, which is aggregated before the shuffle;
    rounds grow with the logarithm of the longest chain. Lineage is cut by reliable checkpoints.
    """
    links = checkpointed(links.where("u <> v").distinct())
    mark = None
    while True:
        links = checkpointed(_small_star(_large_star(links)).distinct())
        # The sums tell whether anything changed; they are one row however many links there are.
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")),
                        F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if now == mark:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
