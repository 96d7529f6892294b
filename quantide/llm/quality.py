"""Quality rules with thresholds that adapt to each language and source.

Each document gets counts (words, symbols, repeated lines, repeated word
triples). From the counts come four rates in thousandths, and for every language
and source a quantile sketch per rate: a histogram whose bins keep the seven
leading binary digits of the rate. Bins of different parts simply add up, so
sketches merge in any order to the same result, and a source's sketch is a few
hundred rows however many documents it has. Limits are set from the sketches'
quantiles, then joined back to filter; no rate has a fixed cutoff or least spread
beyond one bin.

A limit lies ``reach`` spreads beyond the median. The spread is the smaller of the two
half-spreads, so junk on one side doesn't widen it. Where the lower one is nothing,
as with traits that most documents lack, it is the distance from the median to
an upper quantile, the higher the more often good documents show the trait (see
``RATES``). A source's limit is at most twice as far from its language's median as the
language's own, so junk of a dirty source sets no limit. A document goes where its
count exceeds what the limit allows by more than ``sigmas`` standard deviations of
a Poisson count (one event at least): so a short text isn't judged by one line.
Junk that passes a rate's quantile in a whole language, or a source's junk within
that bound, isn't told from the rest.

Everything is DataFrame expressions; no Python runs on the executors.

Defined results: a null text counts as empty (no words, base_failed); null
languages and sources form groups of their own; repeated rows and repeated ids
are judged one by one; groups with fewer than ``min_docs`` documents use the
sketch of their language, or of all documents if that is small too; an empty
table gives an empty result; extra columns of the input are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantide.llm.common import fresh, left_join_small, stored, table, text_or_empty

SPACE = " \t\n\u000b\f\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: rate -> (count, what it is a rate of, its upper quantile as a fraction, whether a low rate is suspect too)
RATES = {"symbol_rate": ("n_symbols", "n_words", (3, 4), False), "dup_line_rate": ("n_dup_lines", "n_lines", (7, 8), False), "repeat_rate": ("n_repeat_words", "n_words", (15, 16), False), "word_length": ("word_chars", "n_words", (3, 4), True)}


@dataclass(frozen=True)
class QualityRules:
    """Limits are median + ``reach`` * spread, at most the language's median + 2 * ``reach`` * its spread; for word length mirrored below as well."""

    reach: int = 5
    sigmas: int = 3
    min_docs: int = 30
    min_words: int = 50
    max_repeat_percent: int = 50


def _word_list(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(SPACE)), WORD_GAP)


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words to each row; columns of the same names are replaced."""
    t, w, lines, hashes, wins, again = (fresh(f"_q_{x}", docs.columns) for x in ("text", "words", "lines", "hashes", "wins", "again"))
    out = docs.withColumn(t, text_or_empty(text))
    out = out.withColumn(w, _word_list(F.col(t)))
    out = out.withColumn(w, F.when(F.btrim(F.col(t), F.lit(SPACE)) == "", F.array().cast("array<string>")).otherwise(F.col(w)))
    out = out.withColumn(lines, F.filter(F.split(F.col(t), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    three = lambda i: [F.get(F.col(w), i + k) for k in range(3)]
    out = out.withColumn(hashes, F.when(F.size(w) > 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(*three(i)))))
    # only where hashes repeat: hashes with their places, sorted, so that equal windows become neighbours; neighbours' words are compared
    placed = F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn(wins, F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(placed)))
    at = lambda k: F.get(F.col(wins), k)
    words = lambda k: F.array(*three(at(k)["i"]))
    same = lambda a, b: (at(a)["h"] == at(b)["h"]) & (words(a) == words(b))
    twice = F.filter(F.col(wins), lambda x, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    out = out.withColumn(again, F.transform(twice, lambda x: x["i"]))
    covered = F.array_distinct(F.flatten(F.array(F.col(again), F.transform(again, lambda i: i + 1), F.transform(again, lambda i: i + 2))))
    counts = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.concat_ws("", F.col(w))).cast("long"),
        "n_symbols": F.regexp_count(F.col(t), F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long"),
        "n_repeat_words": F.coalesce(F.size(covered), F.lit(0)).cast("long"),
    }
    kept = [c for c in docs.columns if c.lower() not in {(prefix + k).lower() for k in counts}]
    return out.select(*kept, *[c.alias(prefix + k) for k, c in counts.items()])


def _rates(prefix: str = "") -> dict[str, Column]:
    return {k: F.expr(f"(1000 * `{prefix}{c}`) div greatest(`{prefix}{n}`, 1L)") for k, (c, n, *_) in RATES.items()}


def _bin(rate: Column) -> Column:
    """The rate with all but its seven leading binary digits cleared."""
    shift = F.greatest(F.length(F.bin(rate)) - 7, F.lit(0))
    power = F.pow(F.lit(2.0), shift).cast("long")
    return rate - F.pmod(rate, power)


def base_failed(rules: QualityRules, prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < rules.min_words) | (100 * r > rules.max_repeat_percent * n)


def sketches(counted: DataFrame, rules: QualityRules, prefix: str = "") -> DataFrame:
    """(lang, source, rate, bin, n): the histogram of each rate over the documents that pass the base rules."""
    rates = _rates(prefix)
    pairs = F.array(*[F.struct(F.lit(k).alias("rate"), _bin(v).alias("bin")) for k, v in rates.items()])
    rows = counted.where(~base_failed(rules, prefix)).select("lang", "source", F.explode(pairs).alias("p"))
    return rows.select("lang", "source", "p.rate", "p.bin").groupBy("lang", "source", "rate", "bin").agg(F.count(F.lit(1)).alias("n"))


def merged_limits(sketch: DataFrame, rules: QualityRules) -> DataFrame:
    """(lang, source, <rate>_low, <rate>_high) from the sketch of each source, its language or all, whichever has enough documents."""
    from pyspark.sql import Window

    def quantiles(by: list[str]) -> DataFrame:
        s = sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*by, "rate")
        s = s.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bin")))
        at = lambda p, q: F.min(F.when(F.col("upto") * q >= F.col("total") * p, F.col("bin")))
        middle, lower = at(1, 2), at(1, 2) - at(1, 4)
        spread = F.when(lower > 0, F.least(at(3, 4) - middle, lower))
        for rate, (_, _, upper, _) in RATES.items():
            spread = spread.when(F.col("rate") == rate, at(*upper) - middle)
        return s.groupBy(*by, "rate").agg(F.max("total").alias("total"), middle.alias("mid"), F.greatest(F.lit(1), spread).alias("spread"))

    own, lang, whole = quantiles(["lang", "source"]), quantiles(["lang"]), quantiles([])
    tagged = lambda df, tag: df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns])
    g, a = tagged(lang, "g"), tagged(whole, "a")
    j = own.join(g, own["lang"].eqNullSafe(g["g_lang"]) & (own["rate"] == g["g_rate"]), "left").join(a, own["rate"] == a["a_rate"], "left")
    wide = lambda c: F.when(F.col("g_total") >= rules.min_docs, F.col(f"g_{c}")).otherwise(F.col(f"a_{c}"))
    pick = lambda c: F.when(F.col("total") >= rules.min_docs, F.col(c)).otherwise(wide(c))
    reach, most = rules.reach * pick("spread"), 2 * rules.reach * wide("spread")
    j = j.withColumn("high", F.least(pick("mid") + reach, wide("mid") + most)).withColumn("low", F.greatest(pick("mid") - reach, wide("mid") - most, F.lit(0)))
    only = lambda c, k: F.max(F.when(F.col("rate") == k, F.col(c)))
    aggs = [only("high", k).alias(f"{k}_high") for k in RATES] + [only("low", k).alias(f"{k}_low") for k, (*_, both) in RATES.items() if both]
    return j.groupBy("lang", "source").agg(*aggs)


def verdicts(counted: DataFrame, limits: DataFrame, rules: QualityRules, prefix: str = "") -> DataFrame:
    """Join the limits and add base_failed and kept. ``counted`` must hold lang and source."""
    names = {c: fresh(f"_lim_{c}", counted.columns) for c in limits.columns if c not in ("lang", "source")}
    j = left_join_small(counted, limits.withColumnsRenamed(names), ["lang", "source"])
    good = F.lit(True)

    def within(excess: Column, allowed: Column) -> Column:
        """Whether a count is beyond what is allowed (both in thousandths) by no more than noise."""
        noise = F.lit(1000.0 * rules.sigmas**2) * F.greatest(allowed, F.lit(1000))
        return F.coalesce((excess <= 0) | (excess.cast("double") * excess.cast("double") <= noise), F.lit(True))

    for k, (c, n, _, both) in RATES.items():
        seen, of = F.lit(1000) * F.col(prefix + c), F.col(prefix + n)
        high = F.col(names[f"{k}_high"]) * of
        good = good & within(seen - high, high)
        if both:
            low = F.col(names[f"{k}_low"]) * of
            good = good & within(low - seen, low)
    failed = base_failed(rules, prefix)
    return j.withColumn(prefix + "base_failed", failed).withColumn(prefix + "kept", ~failed & good).drop(*names.values())


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Counts and verdict per document: doc_id, lang, source, the counts, base_failed, kept.

    The counts are taken once and written without the text; sketches and verdicts read that small table.
    """
    counted = stored(with_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality")
    return verdicts(counted, merged_limits(sketches(counted, rules), rules), rules)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with all of their columns as they were.

    The documents are written once with their counts, so that texts are neither shuffled nor counted twice.
    """
    prefix = fresh("_quality_", [c[:9] for c in docs.columns])
    counted = stored(with_counts(docs, prefix=prefix), "quality")
    judged = verdicts(counted, merged_limits(sketches(counted, rules, prefix), rules), rules, prefix)
    return judged.where(f"`{prefix}kept`").select(*docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base
), wins AS (
  SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words)
), reps AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM wins) WHERE k > 1
  ) GROUP BY rid
), counted AS (
  SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN reps USING (rid)
), judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counted
), rates AS (
  SELECT rid, lang, source, r.rate, r.c, r.n, (1000 * r.c) // greatest(r.n, 1) AS v FROM (
    SELECT rid, lang, source, unnest([
      {'rate': 'symbol_rate', 'c': n_symbols, 'n': n_words}, {'rate': 'dup_line_rate', 'c': n_dup_lines, 'n': n_lines},
      {'rate': 'repeat_rate', 'c': n_repeat_words, 'n': n_words}, {'rate': 'word_length', 'c': word_chars, 'n': n_words}]) AS r
    FROM judged WHERE NOT base_failed)
), bins AS (
  SELECT lang, source, rate, v - v % (2 ** greatest(length(bin(v)) - 7, 0))::BIGINT AS bin FROM rates
), q AS (
  SELECT lang, source, rate, grouping(lang, source, rate) AS g, count(*) AS total, quantile_disc(bin, 0.5) AS mid,
         greatest(1, CASE WHEN quantile_disc(bin, 0.5) > quantile_disc(bin, 0.25) THEN least(quantile_disc(bin, 0.75) - quantile_disc(bin, 0.5), quantile_disc(bin, 0.5) - quantile_disc(bin, 0.25))
                          WHEN rate = 'dup_line_rate' THEN quantile_disc(bin, 0.875) - quantile_disc(bin, 0.5)
                          WHEN rate = 'repeat_rate' THEN quantile_disc(bin, 0.9375) - quantile_disc(bin, 0.5)
                          ELSE quantile_disc(bin, 0.75) - quantile_disc(bin, 0.5) END) AS spread
  FROM bins GROUP BY GROUPING SETS ((lang, source, rate), (lang, rate), (rate))
), wide AS (
  SELECT o.lang, o.source, o.rate, o.total, o.mid, o.spread,
         CASE WHEN l.total >= 30 THEN l.mid ELSE a.mid END AS wide_mid, CASE WHEN l.total >= 30 THEN l.spread ELSE a.spread END AS wide_spread
  FROM q o JOIN q l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rate = l.rate AND o.g = 0 AND l.g = 2 JOIN q a ON o.rate = a.rate AND a.g = 6
), own AS (
  SELECT lang, source, rate, wide_mid, wide_spread, CASE WHEN total >= 30 THEN mid ELSE wide_mid END AS mid, CASE WHEN total >= 30 THEN spread ELSE wide_spread END AS spread FROM wide
), limits AS (
  SELECT lang, source, rate, least(mid + 5 * spread, wide_mid + 10 * wide_spread) AS high,
         CASE WHEN rate = 'word_length' THEN greatest(mid - 5 * spread, wide_mid - 10 * wide_spread, 0) ELSE 0 END AS low
  FROM own
), bad AS (
  SELECT DISTINCT rid FROM (SELECT rid, (1000 * c - high * n)::DOUBLE AS over, (low * n - 1000 * c)::DOUBLE AS under, 9000.0::DOUBLE * greatest(high * n, 1000) AS high_noise, 9000.0::DOUBLE * greatest(low * n, 1000) AS low_noise
    FROM rates r JOIN limits m ON r.lang IS NOT DISTINCT FROM m.lang AND r.source IS NOT DISTINCT FROM m.source AND r.rate = m.rate)
  WHERE over > 0 AND over * over > high_noise OR under > 0 AND under * under > low_noise
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND bad.rid IS NULL) AS kept
FROM judged LEFT JOIN bad USING (rid)
"""
