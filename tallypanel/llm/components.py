"""Connected components of a graph given by edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypanel.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``v, root`` for every end of an edge ``a, b``; the root is the smallest vertex.

    Each round a vertex takes the smallest root among its neighbours' and then the root of
    that root, so long paths shrink fast. Rounds are fixed in shared scratch and end when
    nothing changes; only the count of changes comes to the driver.
    """
    ends = edges.where(F.col("a") != F.col("b"))
    both = ends.select("a", "b").unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "edges")
    nearest = both.groupBy("a").agg(F.min("b").alias("b"))
    roots = materialize(nearest.select(F.col("a").alias("v"), F.least("a", "b").alias("root")), "roots")
    while True:
        seen = both.join(roots.select(F.col("v").alias("b"), "root"), "b")
        best = seen.groupBy("a").agg(F.min("root").alias("best"))
        near = roots.join(best.withColumnRenamed("a", "v"), "v").select(
            "v", "root", F.least("root", "best").alias("next")
        )
        above = roots.select(F.col("v").alias("next"), F.col("root").alias("jump"))
        found = near.join(above, "next", "left").select(
            "v", F.coalesce("jump", "next").alias("root"), (F.coalesce("jump", "next") != F.col("root")).alias("changed")
        )
        found = materialize(found, "roots")
        roots = found.select("v", "root")
        if not found.where("changed").limit(1).count():
            return roots


def forest(linked: np.ndarray) -> np.ndarray:
    """Smallest member reachable from each, of a symmetric matrix of links."""
    n = len(linked)
    root = np.arange(n)
    while True:
        near = np.where(linked, root[None], n).min(1, initial=n)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new
