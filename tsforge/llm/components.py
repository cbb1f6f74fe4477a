"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import materialize


def components(links: DataFrame, *, rounds: int = 200) -> DataFrame:
    """``links`` (a, b long) to (id, root): the smallest id that each id reaches.

    Each round hangs the parents of a node's neighbours below the smallest of them and then
    halves the paths, so that rounds grow with the logarithm of the longest path. The table is
    settled once no link joins two roots: a root is never above its id, so it is then the smallest
    one. A hub's rows are summed where they are read (min needs no more than one row for each key
    and task). ``links`` is read once a round, so it should be a stored table; links may repeat.
    Ids without a link don't appear; an empty table gives an empty one. A graph that ``rounds``
    rounds don't settle raises an error.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    parent = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    for _ in range(rounds):
        around = edges.join(parent.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id"))
        seen = around.agg(F.min("root").alias("near"), F.max("root").alias("far"))
        apart = (F.col("near") != F.col("root")) | (F.col("far") != F.col("root"))
        hooked = materialize(parent.join(seen, "id").select("id", "root", F.least("root", "near").alias("low"), apart.alias("apart")), "hooked")
        if hooked.where("apart").isEmpty():
            return hooked.select("id", "root")
        # The root's own link moves as well: a tree hangs below the smallest root beside it.
        offers = hooked.select(F.col("root").alias("id"), "low").union(hooked.select("id", "low"))
        lower = offers.groupBy("id").agg(F.min("low").alias("low"))
        jumped = (
            lower.join(lower.select(F.col("id").alias("low"), F.col("low").alias("far")), "low", "left")
            .select("id", F.least("low", F.coalesce("far", "low")).alias("root"))
        )
        parent = materialize(jumped, "roots")
    raise RuntimeError(f"components don't settle within {rounds} rounds")
