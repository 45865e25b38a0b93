"""Connected components of a distributed link table, and tables written in the shared folder."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advislake.sources.scratch import fresh_path, shuffle_given_back


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; later steps start from its files."""
    path = fresh_path(df.sparkSession, label)
    with shuffle_given_back(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forest(nodes: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Smallest node that each place reaches by the links (p, q) between places."""
    label = nodes.copy()
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        if (new == label).all():
            return label
        label = new


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every upper end has one lower end and no lower end is an upper one."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    sums = ends.groupBy("n").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("all"))
    return sums.where("up > 1 or (up = 1 and all > 1)").isEmpty()


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every linked node; root is the smallest node of its component.

    Large-star and small-star steps in turn: each node's larger neighbours move to the smallest node it
    knows, then its smaller ones do, until every component is a star around its root. Links never grow in
    number, and rounds grow with the logarithm of the longest chain. Each round is written, so a lost
    executor costs one round at most. Null ends are ignored.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where("u <> v").distinct(), "links")
    while not _is_star_forest(edges):
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(down.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
