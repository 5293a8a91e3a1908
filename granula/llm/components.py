"""Connected components of an undirected link table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.base import stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the least node reachable.

    Each round takes the least label among a node's neighbours and then the label of that
    label (pointer jumping), so long chains need logarithmically many rounds. A round is
    written to the shared folder before the next. Null ends are ignored. Hubs are safe: the
    minimum is combined before the shuffle and the joins can be split.
    """
    kept = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    edges = stored(kept.union(kept.select("b", "a")).distinct(), f"{name}-edges")
    start = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = stored(start.select("node", F.least("node", "m").alias("root")), f"{name}-labels")
    while True:
        heard = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("m"))
        near = labels.join(heard, F.col("node") == F.col("n")).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        far = labels.select(F.col("node").alias("n"), F.col("root").alias("m"))
        after = stored(near.join(far, F.col("root") == F.col("n")).select("node", "was", F.least("root", "m").alias("root")), f"{name}-labels")
        if after.where(F.col("was") != F.col("root")).isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")
