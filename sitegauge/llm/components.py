"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import counted_small
from sitegauge.session import let_go, materialize

#: Neighbours from which a node is a hub, whose links are kept from meeting in one task.
HUB_LINKS = 256
#: Parts that the links of hubs are cut into where the hubs are too many to be broadcast.
SALTS = 64


def _with_least(links: DataFrame) -> DataFrame:
    """Every (u, v) beside the least of u and its neighbours.

    The least comes to a hub's links by broadcast if the counted hubs allow it, else by salted
    keys; other links join it by their node.
    """
    sizes = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = materialize(sizes.select("u", F.least("u", "m").alias("m"), "n"))
    hubs = least.where(F.col("n") >= HUB_LINKS).select("u", F.col("m").alias("hub_m"))
    if hubs.isEmpty():
        return links.join(least.drop("n"), "u")
    if counted_small(hubs):
        marked = links.join(F.broadcast(hubs), "u", "left")
    else:
        salted = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
        marked = links.withColumn("salt", salt).join(salted, ["u", "salt"], "left").drop("salt")
    far = marked.where("hub_m is not null").select("u", F.col("hub_m").alias("m"), "v")
    near = marked.where("hub_m is null").select("u", "v").join(least.where(F.col("n") < HUB_LINKS).drop("n"), "u")
    return far.unionByName(near)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return _with_least(links).select(ends.alias("end")).select("end.u", "end.v").where(F.col("u") != F.col("v")).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: what the rounds end in. One small job, where another round takes about ten."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"))))
    roles = links.select(ends.alias("end")).groupBy("end.node").agg(F.sum("end.up").alias("ups"), F.min("end.up").alias("least"))
    return roles.where((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("least") == 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root): each linked node with the least node it reaches, roots included.

    ``links`` has columns u and v of one orderable type; direction, loops and repeats do not
    matter; rows with a null are ignored. No links give an empty table. Every round is a
    reliable checkpoint, so a lost executor costs a read and not the history.
    """
    ends = links.where("u is not null and v is not null and u != v")
    now = materialize(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(now):
        now = materialize(_small_star(_large_star(now)))
        let_go(links.sparkSession)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
