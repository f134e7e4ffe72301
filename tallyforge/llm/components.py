"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins over the links; stars need O(log^2 n) rounds at
most. The minima combine on the map side, and a centre that holds more than its share of the links
meets them by broadcast, so no task gets a whole star. Rounds are written to the shared folder, so
lineage stays short and a lost executor costs a re-read. Nothing but the number of changed links
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import lookup, shuffle_partitions, written

#: Links of one node that a plain join may send to a task, at least.
STAR = 100_000


def components(links: DataFrame, a: str = "a", b: str = "b", star: int = STAR) -> DataFrame:
    """``node, root`` for each node that has a link: ``root`` is the smallest node reachable.

    Links may repeat, run either way, or join a node to itself. No links: no rows. Null ends are
    dropped. Nodes with more than ``star`` links, and more than a quarter of a partition's share of
    all, are joined by broadcast.
    """
    parts = shuffle_partitions(links.sparkSession)
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    total = links.count()

    def met(rows: DataFrame, low: DataFrame) -> DataFrame:
        limit = max(star, 2 * total / (4 * parts))
        return rows.join(low.drop("n"), "u") if 2 * total <= limit else lookup(rows, low, "u", limit)

    while True:
        both = links.select("u", "v").union(links.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # large star: larger neighbours of u go to u's minimum
        large = met(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours go to u's minimum
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = met(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(small, "links")
        # settled when every node has one link and no root has a smaller neighbour
        total, nodes = after.agg(F.count("*"), F.count_distinct("u")).first()
        chained = after.select("v").distinct().join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count() if total == nodes else 1
        links = after
        if total == nodes and not chained:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v"), F.col("v")).distinct())
