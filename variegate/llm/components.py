"""Connected components of links, as rounds of joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variegate.llm.common import written


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``: the smallest node it is linked with.

    Each round takes the least root among a node and its neighbours and then that root's own
    root, so long chains shorten as if by halving. Roots only fall, and the rounds end when none
    does. Links may be repeated; nodes without a link do not appear. Only the number of changes
    reaches the driver.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = written(both.groupBy(F.col("a").alias("node"))
                    .agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        heard = both.join(roots.select(F.col("node").alias("b"), "root"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        least = roots.join(heard, "node") \
            .select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        # the neighbour's root may hang below another one by now; so may one's own old root
        hung = least.where(F.col("root") < F.col("old")).groupBy(F.col("old").alias("__of")) \
            .agg(F.min("root").alias("__hook"))
        hooked = least.join(hung, F.col("root") == F.col("__of"), "left") \
            .select("node", "old", F.least("root", F.coalesce("__hook", "root")).alias("root"))
        up = roots.select(F.col("node").alias("__of"), F.col("root").alias("__up"))
        new = written(hooked.join(up, F.col("root") == F.col("__of"), "left")
                      .select("node", "old", F.least("root", F.coalesce("__up", "root"))
                              .alias("root")))
        roots = new.select("node", "root")
        if new.where(F.col("root") < F.col("old")).limit(1).count() == 0:
            return roots
