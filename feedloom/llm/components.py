"""Connected components of a table of links, by alternating large and small stars.

A round rewrites the links so that every node points at ever smaller nodes of its component, until all
nodes point at the smallest. Minima are merged ahead of the shuffle and joined back, so the links of one
node are never gathered; a counted small table of them is broadcast. Each round is written to the shared scratch folder and
drops its shuffles; nothing is collected but whether every node points at a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom import runtime
from feedloom.llm.common import landed


def _toward(links: DataFrame, smaller_only: bool, small: bool) -> DataFrame:
    """(u, v, m): every link of u, with the smallest of u and its (smaller) neighbours."""
    kept = links.where("v < u") if smaller_only else links
    least = kept.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return kept.join(F.broadcast(least) if small else least, "u")


def _settled(pairs: DataFrame) -> bool:
    """True if every node of the links (u, v), v < u, either points at one other or is pointed at."""
    ends = F.array(*[F.struct(F.col(c).alias("node"), F.lit(c == "u").cast("int").alias("points")) for c in ("u", "v")])
    nodes = pairs.select(F.inline(ends)).groupBy("node").agg(F.sum("points").alias("points"), F.min("points").alias("least"))
    return nodes.where("points > 1 OR points > 0 AND least = 0").isEmpty()


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) of every node that has a link to another; root is its component's smallest node.

    ``links`` has two long columns (a, b), in any order and with repeats. Rows with a null and links of a
    node to itself are ignored. An empty table gives an empty table.
    """
    pairs = links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    pairs = pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = landed(pairs.distinct(), "links")
    # A round makes no more links than it is given, and a link has two ends.
    fits = runtime.fits_broadcast(pairs, runtime.BROADCAST_ROWS // 2)
    for _ in range(max_rounds):
        if _settled(pairs):
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward(both, False, fits).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        toward = _toward(large if fits else large.distinct(), True, fits)
        small = (
            toward.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(toward.select("u", F.col("m").alias("v")))
            .distinct()
        )
        pairs = landed(small, "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
