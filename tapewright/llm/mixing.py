"""Operator 4, mixing sources to target weights by Poisson replication. DataFrame functions only.

A source with share w of the target and m of the N rows is repeated at the mean rate w * target_rows / m. Each
document's count is the inverse of the Poisson distribution function at a uniform number hashed from the seed and its
id, or for rates over ``MOST_RATE`` the sum of such draws of equal smaller rates, so it does not depend on partitions or
retries; the document is exploded by its count, and all copies are shuffled by a hash of seed, id and copy number, which
also orders them inside their partitions.

Null sources form a source of their own; sources without a target weight keep their share of the rows; rows that repeat
an id are replicated alike, each of them; a row without an id is hashed by its text instead; null and empty texts are
replicated like any other; an empty table gives an empty one. The SQL sums the distribution function from logarithms of
the probabilities, not by the recurrence used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import materialize

SEED = 17
#: Target weights of the production query: the hot source is held to a tenth, two sources are raised, others keep their share.
WEIGHTS = {"src0": 0.10, "src1": 0.10, "src2": 0.05}
#: Sources that ``weights`` may name, and rows of the table of rates up to which it is sent to every task (a kilobyte
#: each). Beyond it documents meet their rate by source and salt, so that a hot source spreads over ``SALTS`` tasks.
MOST_WEIGHTS = 10_000
SALTS = 64
TAIL = 12
#: Largest rate of one draw: exp(-rate) becomes 0 at about 745.
MOST_RATE = 700


def uniform(*parts) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5, the same in every engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """ARRAY<DOUBLE>: the distribution function at 0, 1, ... until the rest is below any hashed uniform number.

    Terms are summed from exp(-rate) on, which bounds ``rate`` by MOST_RATE.
    """
    last = F.ceil(rate + TAIL * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, k):
        term = acc["term"] * rate / k
        return F.struct(term.alias("term"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + term)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, weights: dict[str, float], target_rows: float | None = None) -> DataFrame:
    """source_key, rate, draws and cdf (of a draw) of every source; one partially aggregated count of all rows."""
    if len(weights) > MOST_WEIGHTS or sum(weights.values()) > 1 + 1e-9 or min(weights.values(), default=0) < 0:
        raise ValueError("weights must be at most 10,000 shares with a sum of at most 1")
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(f"s:{s}", float(w)) for s, w in weights.items()] or [], "source_key string, wanted double")
    counted = docs.groupBy(key(F.col("source")).alias("source_key")).agg(F.count("*").alias("n"))
    both = counted.join(F.broadcast(wanted), "source_key", "left")
    total = both.agg(F.sum("n").alias("all_rows"), F.sum(F.when(F.col("wanted").isNull(), F.col("n"))).alias("free_rows"), F.sum("wanted").alias("used"))
    left = F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(F.col("used"), F.lit(0.0)))
    share = F.coalesce("wanted", left * F.col("n") / F.col("free_rows"))
    rows = F.lit(float(target_rows)) if target_rows else F.col("all_rows").cast("double")
    return both.crossJoin(F.broadcast(total)).select("source_key", (share * rows / F.col("n")).alias("rate")).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE).cast("int"))).withColumn("cdf", poisson_cdf(F.col("rate") / F.col("draws")))


def key(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.when(source.isNull(), "n:").otherwise(F.concat(F.lit("s:"), source.cast("string")))


def mix_rows(docs: DataFrame, weights: dict[str, float], target_rows: float | None = None, seed: int = SEED) -> DataFrame:
    """_doc (the row of ``docs``, whatever its columns are called), copy (from 1) and mix_key, in a global random order."""
    table = materialize(rates(docs.select("source"), weights, target_rows).select("source_key", "draws", "cdf"), "rates")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"))
    doc = F.coalesce(F.col("_doc.doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col("_doc.text"), F.lit("")))))
    keyed = rows.withColumn("source_key", key(F.col("_doc.source")))
    if table.count() <= MOST_WEIGHTS:
        counted = keyed.join(F.broadcast(table), "source_key")
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        counted = keyed.withColumn("_salt", F.pmod(F.xxhash64(doc), F.lit(SALTS)).cast("int")).join(salted, ["source_key", "_salt"])
    below = lambda u: F.size(F.filter("cdf", lambda c: c < u))
    more = F.transform(F.sequence(F.lit(2), F.col("draws")), lambda k: uniform(F.lit(f"count:{seed}:draw"), k, doc))
    rest = F.when(F.col("draws") > 1, F.aggregate(more, F.lit(0), lambda n, u: n + below(u))).otherwise(0)
    times = below(uniform(F.lit(f"count:{seed}"), doc)) + rest
    copies = counted.select("_doc", times.alias("_times")).where("_times > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("copy"))
    mixed = copies.withColumn("mix_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"order:{seed}"), doc, F.col("copy"))), 1, 13), 16, 10).cast("long"))
    return mixed.repartition("mix_key").sortWithinPartitions("mix_key")


def mix(docs: DataFrame, weights: dict[str, float], target_rows: float | None = None, seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` with copy and mix_key, which replace columns of these names."""
    mixed = mix_rows(docs, weights, target_rows, seed)
    return mixed.select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in ("copy", "mix_key")), "copy", "mix_key")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the whole mixed corpus, every copy of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs, WEIGHTS).select("doc_id", "copy", "source", "lang", "text", "mix_key")


def _values() -> str:
    return ", ".join(f"('s:{s}', {w!r}::DOUBLE)" for s, w in WEIGHTS.items())


ORACLE = f"""
WITH wanted(source_key, wanted) AS (VALUES {_values()}),
keyed AS (SELECT doc_id, text, lang, source, CASE WHEN source IS NULL THEN 'n:' ELSE 's:' || source END AS source_key FROM documents),
counted AS (SELECT source_key, count(*) AS n FROM keyed GROUP BY source_key),
tied AS (SELECT c.source_key, c.n, w.wanted FROM counted c LEFT JOIN wanted w USING (source_key)),
total AS (SELECT sum(n)::DOUBLE AS all_rows, sum(CASE WHEN wanted IS NULL THEN n END)::DOUBLE AS free_rows, coalesce(sum(wanted), 0) AS used FROM tied),
rates AS (SELECT source_key, coalesce(wanted, greatest(0.0::DOUBLE, 1.0::DOUBLE - used) * n / free_rows) * all_rows / n AS rate FROM tied, total),
drawn AS (SELECT source_key, rate, greatest(1, ceil(rate / {MOST_RATE})::INTEGER) AS draws FROM rates),
steps AS (SELECT source_key, draws, rate / draws AS lam, unnest(range(0, (ceil(rate / draws + {TAIL} * sqrt(rate / draws) + 40) + 1)::BIGINT)) AS k FROM drawn),
masses AS (SELECT source_key, draws, k, CASE WHEN lam = 0 THEN (k = 0)::INTEGER::DOUBLE ELSE exp(k * ln(lam) - lam - lgamma(k + 1)) END AS mass FROM steps),
sums AS (SELECT source_key, draws, k, sum(mass) OVER (PARTITION BY source_key ORDER BY k) AS cdf FROM masses),
cdfs AS (SELECT source_key, draws, list(cdf ORDER BY k) AS cdf FROM sums GROUP BY source_key, draws),
named AS (SELECT *, coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) AS doc FROM keyed),
numbers AS (SELECT n.*, cdf, list_transform(range(1, draws + 1), lambda i: (('0x' || substr(md5(CASE WHEN i = 1 THEN 'count:{SEED}:' || doc ELSE 'count:{SEED}:draw:' || i || ':' || doc END), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS us FROM named n JOIN cdfs USING (source_key)),
times AS (SELECT *, list_sum(list_transform(us, lambda u: len(list_filter(cdf, lambda c: c < u)))) AS n FROM numbers),
copies AS (SELECT doc_id, doc, text, lang, source, unnest(range(1, n::BIGINT + 1))::INTEGER AS copy FROM times)
SELECT doc_id, copy, source, lang, text, ('0x' || substr(md5('order:{SEED}:' || doc || ':' || copy), 1, 13))::BIGINT AS mix_key FROM copies
"""
