"""Operator 5, quality classifier by importance resampling.

Two generative models of hashed byte n-grams (2 to 4 bytes, ``BUCKETS`` buckets) are counted: one over all documents, one
over labelled good ones. A document's log importance weight is the mean log ratio of its n-grams, times ``SCALE`` n-grams, so that
long documents don't weigh more than short ones. Gumbel noise hashed from the seed and the id is added, and the k
largest sums are the sample. k is the number of documents whose noisy weight reaches a cut that is set on held-out
labelled documents; any other k can be given.

Fitted on at most ``LABELLED`` labelled rows, those of the smallest hashes; half of them count, half set the cut. The
corpus model, the weights and the selection cover all rows. Null text is empty and has weight 0, as have texts of one
byte; null ids share the noise of an empty id; rows with equal ids share their noise; labels of absent documents are
ignored; without labels of both kinds the cut keeps everything. Ties at the k-th place are all kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.common import arrow_rows, materialize, trimmed

BUCKETS = 1 << 16
LABELLED = 20_000
SCALE = 200
SEED = 23
#: Held-out good documents that the cut may lose.
LOSS = 0.002
BINS = 1024


def grams(data: bytes) -> np.ndarray:
    """Hash buckets of all n-grams of 2, 3 and 4 bytes."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    out, code = [], x
    for n in (2, 3, 4):
        code = (code[: max(0, len(x) - n + 1)] << np.uint32(8)) | x[n - 1 :]
        h = (code + np.uint32(n)) * np.uint32(0x9E3779B1)
        out.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(16))
    return np.concatenate(out)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def sample_labels(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id, good (quality and not toxic; a null toxic counts as no), held: at most ``most`` labelled rows."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    first = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)
    return first.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), (F.col("quality") == 1).alias("fine"), (F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(2)) == 1).alias("held"))


def count_models(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over all documents and over the labelled good ones that are not held out.

    Every task sums what it reads; the sums are added by bucket, and two numbers a bucket reach the driver.
    """
    read = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id", "left").select("text", F.expr("coalesce(good AND NOT held, false)").alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for text, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = np.bincount(grams(encoded(text)), minlength=BUCKETS)
                counts[0] += n
                if target:
                    counts[1] += n
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "raw", "target"])

    summed = read.mapInArrow(trimmed(run), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in summed.collect():  # at most BUCKETS rows
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw by bucket; the target is smoothed towards the corpus, so that unseen buckets stay finite."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    p = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    q = (target + 20.0 * p * len(raw) / 100) / (target.sum() + 20.0 * len(raw) / 100)
    return np.log(q) - np.log(p)


def noise(doc_id, seed: int = SEED) -> float:
    """Standard Gumbel noise, a function of seed and id."""
    u = (xxhash.xxh3_64_intdigest(f"{seed}:{'' if doc_id is None else doc_id}") + 0.5) / 2.0**64
    return -math.log(-math.log(u)) if 0 < u < 1 else 0.0


def weight(text: str | None, ratio: np.ndarray) -> tuple[int, float]:
    """N-grams of a text, and its log importance weight."""
    g = grams(encoded(text))
    return len(g), float(ratio[g].mean() * SCALE) if len(g) else 0.0


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_grams, log_weight, noisy of every row."""

    def make(rows):
        for doc_id, text in rows:
            n, w = weight(text, ratio)
            yield doc_id, n, w, w + noise(doc_id)

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType()), T.StructField("noisy", T.DoubleType())])
    return arrow_rows(docs, ["doc_id", "text"], make, schema)


def cut_of(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut set on held-out weights: between the kinds where they part, else where ``LOSS`` of the good are lost."""
    if not len(good) or not len(bad):
        return -math.inf
    low = float(np.quantile(good, LOSS))
    under = bad[bad < low]
    return (low + float(np.quantile(under, 0.98))) / 2 if len(under) > 0.9 * len(bad) else low


def kth_largest(scored: DataFrame, k: int, col: str = "noisy") -> float:
    """The k-th largest value: counts of at most ``BINS`` bins at a time narrow it down exactly."""
    if k <= 0:
        return math.inf
    low, high, n = scored.agg(F.min(col), F.max(col), F.count(col)).first()
    if k >= n:
        return -math.inf
    need = k
    while low < high:
        width = (high - low) / BINS
        inside = scored.where(F.col(col).between(low, high))
        if width <= 0 or low + width <= low:  # neighbouring doubles
            return high if inside.where(F.col(col) >= high).count() >= need else low
        bins = inside.groupBy(F.least(F.floor((F.col(col) - low) / width), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("low"), F.max(col).alias("high"))
        for r in sorted(bins.collect(), key=lambda r: -r.bin):
            if r.n >= need:
                low, high = r.low, r.high
                break
            need -= r.n
    return low


class Selection:
    """What has been fitted: the ratio of the models and the least noisy weight of the sample."""

    def __init__(self, docs: DataFrame, labels: DataFrame, k: int | None = None):
        labels = materialize(sample_labels(labels), "labels")  # at most LABELLED rows
        self.ratio = log_ratio(*count_models(docs, labels))
        self.scored = materialize(weigh(docs, self.ratio), "weights")
        if k is None:
            held = self.scored.join(F.broadcast(labels.where("held")), "doc_id").select("noisy", "fine").collect()
            self.cut = cut_of(np.array([r.noisy for r in held if r.fine]), np.array([r.noisy for r in held if not r.fine]))
            k = self.scored.where(F.col("noisy") >= self.cut).count() if self.cut > -math.inf else self.scored.count()
        self.k = k
        self.least = kth_largest(self.scored, k)


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, noisy, selected of every row."""
    chosen = Selection(docs, labels, k)
    return chosen.scored.withColumn("selected", F.col("noisy") >= F.lit(chosen.least))


def keep_selected(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The selected rows of ``docs``, all columns. Weights are computed again beside the rows, which are not shuffled."""
    chosen = Selection(docs, labels, k)
    ratio, least, names = chosen.ratio, chosen.least, docs.columns
    at, key = names.index("text"), names.index("doc_id")

    def make(rows):
        for row in rows:
            if weight(row[at], ratio)[1] + noise(row[key]) >= least:
                yield row

    return arrow_rows(docs, names, make, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document's weight and whether it is in the sample."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
