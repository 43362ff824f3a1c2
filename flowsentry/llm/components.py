"""Connected components of a link table by repeated contraction.

In each round every node takes the smallest id among itself and its neighbours, jumps once more along that choice, and
links are rewritten between the chosen nodes; links inside one chosen node go. Ids are hashes, so long chains shrink by
a constant factor a round. The choices of all rounds, applied in order, give each node's root. Rounds are written to
the shared folder, so neither lineage nor recovery grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import discard, durable


def contract(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(choices (node, root), links left (a, b)) of one round."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    chosen = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    jump = chosen.select(F.col("node").alias("root"), F.col("root").alias("next"))
    choices = durable(chosen.join(jump, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
    of = lambda name: choices.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    left = links.join(of("a"), "a").join(of("b"), "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).filter("a <> b").distinct()
    left = durable(left)
    discard(chosen)
    return choices, left


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the same for all nodes of a component."""
    rounds = []
    left = durable(links.select("a", "b").filter("a <> b").distinct())
    while not left.isEmpty():
        before = left
        choices, left = contract(before)
        discard(before)
        rounds.append(choices)
    discard(left)
    if not rounds:
        return durable(links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0))
    labels = rounds[0]
    for choices in rounds[1:]:
        labels = labels.join(choices.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    labels = durable(labels)
    discard(*rounds)
    return labels
