"""Mixing sources to target weights by Poisson replication.

Source s should make up the share w_s of the mixture, so each of its n_s documents
is wanted total * w_s / n_s times on average. Each document's count is drawn from
the Poisson distribution with that mean by inverting it at a uniform number hashed
from a seed, the document's id and its text: the same input gives the same mixture on any
cluster, documents are judged on their own, and different texts without an id, or with the same one, are drawn apart. Documents are then exploded by
their counts and put in a global random order, again by hash.

Sizes are counted per source before anything is shuffled. The cumulative distributions,
a table with one row per source, are running sums over a window per source, of as many
terms as lie within twelve standard deviations of the rate; they are written once and joined back
(see ``left_join_small``; broadcast only if both rows and bytes are few). So the documents are
read twice: to count, and to draw. MD5 is uniform, so the global order is cut into
even ranges of its leading digits, without a sample of the rows to be sorted, and no source is hot.

Defined results: null sources are a source of their own; rows with equal id and text are
drawn alike; a null id or text is hashed as the empty string; a source with target 0 goes;
targets of sources that aren't there are ignored and the others rescaled; an empty
table gives an empty result; all columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantide.llm.common import BROADCAST_ROWS, fresh, left_join_small, stored, table

#: target shares follow size ** TEMPERATURE where none are given: 1 keeps the sizes, 0 makes sources equal
TEMPERATURE = 0.5
SEED = 17
#: bytes of distributions that are broadcast
BROADCAST_BYTES = 32 << 20


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, targets: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, size: float = 1.0, source: str = "source") -> DataFrame:
    """source, n and rate (the mean count of its documents); the mixture has ``size`` times the documents."""
    n = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        n = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        if not targets or any(not (v >= 0 and math.isfinite(v)) for v in targets.values()):
            raise ValueError("targets must be finite and not negative")
        named = [F.lit(x) for k, v in targets.items() if k is not None for x in (k, float(v))]
        found = F.try_element_at(F.create_map(*named), F.col("source")) if named else F.lit(None)
        n = n.withColumn("weight", F.coalesce(F.when(F.col("source").isNull(), F.lit(float(targets.get(None, 0.0)))).otherwise(found), F.lit(0.0)))
    totals = n.agg(F.sum("n").alias("total"), F.sum("weight").alias("weights"))
    share = F.try_divide(F.col("weight"), F.col("weights"))
    # the totals are a single row
    return n.join(F.broadcast(totals)).select("source", "n", F.coalesce(F.round(size * F.col("total") * share / F.col("n"), 9), F.lit(0.0)).alias("rate"))


def _log_factorial(k: Column) -> Column:
    """ln k!, by Stirling's series where k! is no 64-bit number; its relative error is that of doubles."""
    x = F.greatest(k, F.lit(1)).cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(k <= 20, F.ln(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def with_distribution(sources: DataFrame) -> DataFrame:
    """source, rate, first and cdf: P(count <= k) for k = first, first + 1, ... within twelve standard deviations of the rate.

    What lies outside has a probability below about 1e-20.
    """
    reach = F.ceil(12 * F.sqrt("rate")) + 24
    terms = sources.select("source", "rate", F.explode(F.sequence(F.greatest(F.floor("rate") - reach, F.lit(0)), F.when(F.col("rate") > 0, F.ceil("rate") + reach).otherwise(F.lit(0)))).alias("k"))
    p = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.ln("rate") - F.col("rate") - _log_factorial(F.col("k")))).otherwise(F.lit(1.0))
    upto = terms.withColumn("p", F.sum(p).over(Window.partitionBy("source").orderBy("k")))
    rows = upto.groupBy("source", "rate").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("rows"))
    return rows.select("source", "rate", F.col("rows")[0]["k"].cast("int").alias("first"), F.col("rows.p").alias("cdf"))


def replicate(docs: DataFrame, key: str = "doc_id", source: str = "source", targets: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, size: float = 1.0, seed: int = SEED, copy: str | None = "copy", text: str = "text") -> DataFrame:
    """The mixture, shuffled: all columns of the documents, and the copy's number from 0 if a name is given for it.

    A table without the column ``text`` is drawn by its key alone. Partitions are in order and sorted; there are as many as ``spark.sql.shuffle.partitions``.
    """
    spark = docs.sparkSession
    first, cdf, n, number, order, part, own, u = (fresh(f"_mix_{x}", docs.columns) for x in ("first", "cdf", "n", "copy", "order", "part", "own", "u"))
    dist = stored(with_distribution(rates(docs, targets, temperature, size, source)), "mixture")
    terms = dist.agg(F.sum(F.size("cdf"))).first()[0] or 0
    small = dist.select(F.col("source").alias(source), F.col("first").alias(first), F.col("cdf").alias(cdf))
    # made before the join, so that nothing of it is moved past it
    empty = F.lit("")
    one = [F.coalesce(F.col(f"`{key}`").cast("string"), empty), *([F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), empty))] if text in docs.columns else [])]
    drawn = docs.withColumn(own, F.concat_ws("|", *one))
    drawn = drawn.withColumn(u, uniform(F.lit(f"count{seed}"), F.col(own)))
    j = left_join_small(drawn, small, [source], BROADCAST_ROWS if 8 * terms <= BROADCAST_BYTES else 0)
    count = F.col(first) + F.size(F.filter(cdf, lambda p: p <= F.col(u)))
    out = j.withColumn(n, count).where(F.col(n) > 0).withColumn(number, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    out = out.withColumn(order, F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.col(own), F.col(number))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leading = F.conv(F.substring(order, 1, 8), 16, 10).cast("long")
    out = out.withColumn(part, F.shiftright(leading * parts, 32).cast("int")).repartitionById(parts, part).sortWithinPartitions(order)
    return out.select(*docs.columns, *([F.col(number).alias(copy)] if copy else []))


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH n AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS weight FROM documents GROUP BY source),
r AS (SELECT source, round(sum(n) OVER () * (weight / sum(weight) OVER ()) / n, 9) AS rate FROM n),
k AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 24)::BIGINT)) AS k FROM r),
f AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM k),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM f),
u AS (SELECT *, ('0x' || substr(md5('count{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
d AS (SELECT doc_id, text, lang, u.source, n_chars, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u) AS copies FROM u)
SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(0, copies - 1))::INT AS copy FROM d WHERE copies > 0
"""
