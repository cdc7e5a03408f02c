"""Connected components of a link table, by label passing with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, renamed, staged


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component): ``component`` is the smallest node reachable.

    ``links`` has columns a, b of any one orderable type; each is taken both
    ways; self links and nulls are ignored.  Every round, each node takes the
    smallest label among its neighbours and itself and then its label's label,
    so that long chains halve.  Rounds go through tables in the shared folder;
    the driver sees one count a round.
    """
    links = links.select("a", "b").where("a <> b")
    both = staged(links.union(links.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        fresh = staged(stepped.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        discard(labels)
        labels = fresh
        if not fresh.where("label <> old").limit(1).count():
            discard(both)
            return renamed(labels, labels.select("node", F.col("label").alias("component")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
