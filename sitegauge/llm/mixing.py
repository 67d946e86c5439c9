"""Mixing sources to target weights by Poisson replication, with Spark functions only.

Each source gets a mean repetition rate: its target share of the mixture over its share of the rows.
A row's number of copies is a Poisson value of that mean, made by inverting the distribution at a
number in [0, 1) that is hashed from the seed and the doc_id. Rows are copied that often, and the
copies are dealt out and sorted by another hash: a global shuffle that a rerun repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import counted_small

SEED = "mix-1"
#: A higher rate is the sum of several Poisson values of rates up to this.
RATE_STEP = 16.0
#: Sources up to which their rates are broadcast; beyond, rows join them by salted source.
BROADCAST_SOURCES = 100_000
SALTS = 64
#: Copies that one row is unfolded into at a time.
UNFOLD = 1024


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) hashed from the parts' text, 52 bits of it."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def inverse_poisson(rate: Column, u: Column) -> Column:
    """How many values of the distribution function with this mean (up to RATE_STEP) are at most u."""
    terms = F.ceil(rate + 12 * F.sqrt(rate) + 12).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.when(first <= u, 1).otherwise(0).alias("k"))

    def step(at: Column, k: Column) -> Column:
        p = at["p"] * rate / k
        total = at["c"] + p
        return F.struct(p.alias("p"), total.alias("c"), (at["k"] + F.when(total <= u, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda at: at["k"])


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(_source, _rate): a source's mean number of copies of each row.

    ``weights`` are target shares by source, scaled to sum to 1; None means equal shares. A source
    without a weight gets rate 0. ``epochs`` is the size of the mixture in rows over that of the input.
    """
    sizes = docs.groupBy(F.col("source").cast("string").alias("_source")).agg(F.count("*").alias("_rows"))
    if weights is None:
        sizes = sizes.withColumn("_weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "_named string, _weight double")
        sizes = sizes.join(given, F.col("_source").eqNullSafe(F.col("_named")), "left").drop("_named").fillna(0.0, ["_weight"])
    whole = sizes.agg(F.sum("_rows").alias("_all"), F.sum("_weight").alias("_weights")).first()
    if not whole["_all"]:
        return sizes.select("_source", F.lit(0.0).alias("_rate"))
    if not whole["_weights"]:
        raise ValueError("no source of the input has a weight")
    scale = epochs * whole["_all"] / whole["_weights"]
    return sizes.select("_source", (F.lit(scale) * F.col("_weight") / F.col("_rows")).alias("_rate"))


def _with_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    source = docs["source"].cast("string")
    if counted_small(rates, BROADCAST_SOURCES):
        return docs.join(F.broadcast(rates), source.eqNullSafe(rates["_source"])).drop("_source")
    salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(docs["doc_id"]), F.lit(SALTS)).cast("int")
    return docs.join(salted, source.eqNullSafe(salted["_source"]) & (salt == salted["_salt"])).drop("_source", "_salt")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """Copies of the rows of ``docs`` in mixed order: its columns, replica (from 1) and order_key.

    A null source is a source of its own; a null doc_id hashes as empty text; texts are not looked at.
    Repeated rows have the same number of copies each. If ``docs`` has a column called replica
    or order_key, the added one gets an underscore in front, again until it is free. An empty
    table gives an empty result. Rows of a partition are in the order of order_key.
    """
    replica, order = (_free(docs, name) for name in ("replica", "order_key"))
    rated = _with_rates(docs, source_rates(docs, weights, epochs))
    parts = F.ceil(F.col("_rate") / RATE_STEP).cast("int")
    drawn = F.aggregate(
        F.when(parts > 0, F.sequence(F.lit(1), parts)).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda total, part: total + inverse_poisson(F.col("_rate") / F.greatest(parts, F.lit(1)), unit_hash(seed, part, docs["doc_id"])),
    )
    counted = rated.withColumn("_copies", drawn).where("_copies > 0")
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0), ((F.col("_copies") - 1) / UNFOLD).cast("int"))))
    last = F.least(F.col("_copies"), (F.col("_block") + 1) * UNFOLD)
    copies = blocks.withColumn(replica, F.explode(F.sequence(F.col("_block") * UNFOLD + 1, last)))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.col(replica)))
    keyed = copies.withColumn(order, key).drop("_rate", "_copies", "_block")
    return keyed.repartition(order).sortWithinPartitions(order)


def _free(docs: DataFrame, name: str) -> str:
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return name


#: The mixture of equal shares, in DuckDB's SQL.
ORACLE = f"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, CAST((SELECT sum(n) FROM sizes) AS DOUBLE) / (SELECT count(*) FROM sizes) * 1.0 / n AS rate FROM sizes),
parts AS (SELECT *, CAST(ceil(rate / {RATE_STEP}) AS INTEGER) AS m FROM rates),
terms AS (
  SELECT source, m, k, exp(sum(CASE WHEN k = 0 THEN -rate / m ELSE ln(rate / m / k) END) OVER (PARTITION BY source ORDER BY k)) AS p
  FROM parts, range(0, 91) AS t(k) WHERE k <= ceil(rate / m + 12 * sqrt(rate / m) + 12)),
steps AS (SELECT source, m, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
draws AS (
  SELECT d.doc_id, d.source, part,
    CAST(CAST('0x' || substr(md5('{SEED}:' || part || ':' || d.doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, range(1, 100) AS t(part) WHERE part <= p.m),
copies AS (
  SELECT w.doc_id, count(*) AS n FROM draws w JOIN steps s ON w.source IS NOT DISTINCT FROM s.source AND s.c <= w.u
  GROUP BY w.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(r AS INTEGER) AS replica,
  md5('{SEED}:order:' || d.doc_id || ':' || r) AS order_key
FROM documents d JOIN copies c USING (doc_id), range(1, 10000) AS t(r) WHERE r <= c.n
"""
