"""Operator 9, approximate nearest neighbours by learned partitions.

On a bounded sample (``PER_PARTITION`` rows a partition, by hash order; a partition for each ``ROWS`` rows of the table, up to
``PARTITIONS``) the neighbour graph is cut into balanced partitions by recursive
bisection: a spectral order split at its median, then swaps that lower the cut. A small network with one hidden layer
learns the share of each partition among a vector's neighbours. Every row of the table is indexed under its most
probable partition; a query goes to its several most probable ones, as many as reach ``COVERAGE`` of the true
neighbours of sample rows that the network was not trained on. Candidates of the probed partitions are reranked by the
exact cosine in double precision. Partitions are split into blocks of at most about ``BLOCK`` rows, and queries into
blocks too, so a partition that holds a third of all rows does not meet in one task.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than
most sample rows have. Null ids take no part. Rows with equal ids are candidates of their own, but one query, that of the
smallest vector; a query skips all rows with its own id. Ties go to the smaller id. With fewer candidates than ``k`` all
are returned. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows of the table for each partition, sample rows for each, and partitions at least and at most (powers of two).
ROWS = 1_000
PER_PARTITION = 256
FEWEST, PARTITIONS = 16, 64
GRAPH_K = 10
HIDDEN = 96
COVERAGE = 0.97
BLOCK = 20_000
QUERY_BLOCK = 5_000


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """The rows that take part, as vec_id BIGINT and v ARRAY<DOUBLE>."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(finite & F.exists("v", lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def neighbour_lists(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of each row of unit vectors, in blocks."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(near: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A balanced cut of the graph among ``rows``: True for one half."""
    place = np.full(near.shape[0], -1)
    place[rows] = np.arange(len(rows))
    a = np.repeat(np.arange(len(rows)), near.shape[1])
    b = place[near[rows].reshape(-1)]
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    n, degree = len(rows), np.maximum(np.bincount(a, minlength=len(rows)), 1)
    total = lambda f: np.bincount(a, weights=f[b], minlength=n)
    root = np.sqrt(degree)
    f = rng.standard_normal(n)
    for _ in range(60):  # the second eigenvector of the normalised graph, by power steps
        f -= root * (root @ f) / (root @ root)
        f = 0.5 * f + 0.5 * total(f / root) / root
        f /= np.linalg.norm(f) or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(f / root, kind="stable")[n // 2 :]] = True
    for _ in range(20):  # swaps of the pairs that gain most
        gain = np.where(side, degree - 2 * total(side * 1.0), 2 * total(side * 1.0) - degree)
        up, down = np.flatnonzero(~side), np.flatnonzero(side)
        up, down = up[np.argsort(-gain[up], kind="stable")], down[np.argsort(-gain[down], kind="stable")]
        m = min(len(up), len(down), max(1, n // 40))
        better = gain[up[:m]] + gain[down[:m]] > 0
        if not better.any():
            break
        side[up[:m][better]], side[down[:m][better]] = True, False
    return side


def partition_graph(near: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """A partition number for each row, from halving ``parts`` (a power of two) times over."""
    rng, label = np.random.default_rng(seed), np.zeros(near.shape[0], np.int64)
    count = 1
    while count < parts:
        for p in range(count):
            rows = np.flatnonzero(label == p)
            if len(rows) > 1:
                label[rows[bisect(near, rows, rng)]] += count
        count *= 2
    return label


class Router:
    """A network with one hidden layer from a unit vector to the probability of each partition."""

    def __init__(self, x: np.ndarray, share: np.ndarray, steps: int = 400, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w1 = rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2)
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), rng.standard_normal((HIDDEN, share.shape[1])) * 0.1, np.zeros(share.shape[1])
        params = [self.w1, self.b1, self.w2, self.b2]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), 512)
            h = np.maximum(x[at] @ self.w1 + self.b1, 0)
            d = (self._softmax(h @ self.w2 + self.b2) - share[at]) / len(at)
            dh = (d @ self.w2.T) * (h > 0)
            for i, (p, g) in enumerate(zip(params, (x[at].T @ dh, dh.sum(0), h.T @ d, d.sum(0)))):  # Adam
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                p -= 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each unit vector, the most probable first."""
        return np.argsort(-(np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2), axis=1, kind="stable")


class Index:
    """What is fitted on the sample: the router, the number of partitions, and how many a query probes."""

    def __init__(self, sample: np.ndarray, k: int, parts: int = FEWEST, coverage: float = COVERAGE):
        self.dim = sample.shape[1]
        while parts > 1 and len(sample) < 64 * parts:
            parts //= 2
        self.parts, self.probes, self.router = parts, 1, None
        if parts == 1:
            return
        x = unit(sample)
        held = len(x) // 5
        near = neighbour_lists(x, GRAPH_K)
        label = partition_graph(near, parts)
        share = np.eye(parts)[label] * 0.5 + np.eye(parts)[label[near]].mean(1) * 0.5
        self.router = Router(x[held:], share[held:])
        order = self.router.order(x)
        home = order[:, 0]
        found = home[neighbour_lists(x, k)[:held]]
        rank = np.argsort(order[:held], axis=1)
        need = np.take_along_axis(rank, found, axis=1)
        covered = [(need < p).mean() for p in range(1, parts + 1)]
        self.probes = 1 + next(i for i, c in enumerate(covered) if c >= coverage or i == parts - 1)

    def route(self, v: np.ndarray) -> np.ndarray:
        return np.zeros((len(v), 1), np.int64) if self.router is None else self.router.order(unit(v))


def fit(vectors: DataFrame, k: int) -> Index:
    """Fit on at most ``PER_PARTITION * PARTITIONS`` rows, those of the smallest hashes. Rows of the sample's commonest length are taken."""
    wanted = max(1, vectors.count() // ROWS)
    parts = min(PARTITIONS, max(FEWEST, 1 << (wanted.bit_length() - 1)))
    rows = vectors.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(PER_PARTITION * parts).select("v").collect()
    lengths = [len(r.v) for r in rows]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    same = [r.v for r in rows if len(r.v) == dim]
    return Index(np.array(same, np.float64).reshape(len(same), dim), k, parts)


def routed(vectors: DataFrame, index: Index, probes: int) -> DataFrame:
    """vec_id, v, part: each row under its ``probes`` most probable partitions."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("part", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[len(v) == index.dim for v in pdf["v"]]]
            if len(pdf):
                order = index.route(np.stack(pdf["v"].to_numpy()))[:, :probes]
                at = np.repeat(np.arange(len(pdf)), order.shape[1])
                yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy()[at], "v": pdf["v"].to_numpy()[at], "part": order.reshape(-1).astype(np.int32)})

    return vectors.mapInPandas(run, schema)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``c`` with ``q`` in double precision; the same for a pair wherever it is computed."""
    q, c = q / np.abs(q).max(), c / np.abs(c).max(1, keepdims=True)
    return (c * q).sum(1) / np.sqrt((c * c).sum(1) * (q * q).sum())


def nearest(k: int):
    """Of one block of queries and one of candidates, each query's ``k`` nearest."""

    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(queries) or not len(rows):
            return none
        qid, cid = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
        q, c = np.stack(queries["v"].to_numpy()), np.stack(rows["v"].to_numpy())
        cu, out = unit(c), []
        for at in range(0, len(q), 64):
            near = unit(q[at : at + 64]) @ cu.T
            near[qid[at : at + 64, None] == cid[None, :]] = -np.inf
            for i, s in enumerate(near):
                m = min(k, len(s))
                least = np.partition(s, len(s) - m)[len(s) - m]
                pick = np.flatnonzero((s >= least - 1e-9) & np.isfinite(s))
                score = exact(q[at + i], c[pick])
                best = np.lexsort((cid[pick], -score))[:k]
                out.append((np.full(len(best), qid[at + i]), cid[pick][best], score[best]))
        if not out:
            return none
        return pd.DataFrame({n: np.concatenate(x) for n, x in zip(("query_id", "vec_id", "score"), zip(*out))})

    return run


def search(queries: DataFrame, rows: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, rank, vec_id, score. ``queries`` and ``rows``: vec_id and v of valid vectors."""
    spark = rows.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    homes = routed(rows, index, 1)
    asked = routed(queries, index, index.probes)
    sizes = {r.part: r.n for r in homes.groupBy("part").agg(F.count("*").alias("n")).collect()}
    wanted = {r.part: r.n for r in asked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = [(p, -(-n // BLOCK), -(-wanted.get(p, 1) // QUERY_BLOCK)) for p, n in sizes.items()]  # a row a partition
    table = F.broadcast(spark.createDataFrame(blocks, "part int, row_blocks int, query_blocks int"))
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(table, "part").withColumn("qb", spread("query_blocks", 1)).withColumn("rb", every("row_blocks")).select("part", "qb", "rb", "vec_id", "v")
    right = homes.join(table, "part").withColumn("rb", spread("row_blocks", 2)).withColumn("qb", every("query_blocks")).select("part", "qb", "rb", "vec_id", "v")
    found = left.groupBy("part", "qb", "rb").cogroup(right.groupBy("part", "qb", "rb")).applyInPandas(nearest(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str, k: int = 5, every: int = 50) -> DataFrame:
    """op9: the five nearest of every row whose vec_id is divisible by 50, against all rows."""
    vectors = valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(vectors.where(F.col("vec_id") % every == 0), vectors, fit(vectors, k), k)
