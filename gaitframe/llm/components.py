"""Connected components of a link table, in Spark joins only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitframe.session import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every linked node; the component is its smallest node.

    Alternates the large star (neighbours above a node are tied to the smallest one around it) and the
    small star (the same below) until nothing changes, a logarithmic number of rounds in practice. A round
    is a combined minimum and a join that Spark may split by skew (the minima are written first, as a join that
    shares a stage with a grouping can't be split), so a hub with any number of links is never one group; every
    round is a written table, so a lost executor repeats one round at most.
    Nulls and self links are ignored; an empty table gives an empty one. Runs jobs.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = (links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
             .filter(x.isNotNull() & y.isNotNull() & (x != y)).distinct())
    edges, before = materialize(edges, "links"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select("v", "v").distinct())
        before = tuple(now)
        both = edges.union(edges.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").filter("u != v").distinct(), "links")
