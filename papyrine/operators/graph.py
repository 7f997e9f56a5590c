"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.plans.layout import cut, drop

#: Rounds before the loop gives up; star contraction needs about log2 of the longest path.
ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node links its larger (or smaller-or-equal) neighbours to its least neighbour."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if not large:
        both = both.where("src > dst")
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    joined = both.join(least, "src")
    if large:
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        out = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(least.select("src", F.col("m").alias("dst")))
    return out.where("src != dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (src, dst); the component is its least node.

    Null ends and loops are ignored apart from naming their node. Each round is written
    to the shared folder, so plans stay short; no link list is ever collected.
    """
    ends = edges.select("src", "dst").where("src is not null and dst is not null")
    nodes = ends.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    now = cut(ends.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before = None
    for _ in range(ROUNDS):
        last, now = now, cut(_star(_star(now, True), False))
        drop(last)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("src").alias("node"), F.col("dst").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


#: Members of a bucket that are paired in one group; larger buckets are cut into blocks of this size.
BLOCK = 256


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """(a, b), a < b, each once: every two ids that share a bucket, of written rows (bucket, id).

    Every two blocks of a bucket meet, so no group holds more than about two of them.
    """
    large = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    spot = rows.join(large, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spot = spot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spot = spot.groupBy("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct("block", "id")).alias("m"))
    one, two = F.filter("m", lambda x: x["block"] == F.col("i")), F.filter("m", lambda x: x["block"] == F.col("j"))
    crossed = spot.select(F.explode(one).alias("x"), two.alias("ys")).select("x", F.explode("ys").alias("y")).where("x.id != y.id")
    return crossed.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
