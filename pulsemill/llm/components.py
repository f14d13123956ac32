"""Connected components of links between 64-bit nodes."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsemill.session import cut_lineage


def forest(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Links (a, b) from every node of a component to its smallest one, for links given as arrays."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        fresh = label.copy()
        for side in (x, y):
            np.minimum.at(fresh, side, low)
            np.minimum.at(fresh, label[side], low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return pd.DataFrame({"a": nodes[far].view(np.int64), "b": nodes[label[far]].view(np.int64)})


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b) but the roots; root is the smallest node reachable.

    Alternates two rewritings of the links, each of which keeps the components: every greater neighbour is tied
    to the smallest neighbour, then every smaller one, until all links point to roots. Each round is written
    to the shared folder.
    """
    links = cut_lineage(_apart(links), "links")
    before = None
    while True:
        links = cut_lineage(_small_star(_large_star(links)), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _apart(links: DataFrame) -> DataFrame:
    """Each link once, from the greater to the smaller node."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return _apart(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    tied = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _apart(tied.union(least.select("a", F.col("m").alias("b"))))
