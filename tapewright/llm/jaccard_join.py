"""Operator 2, n-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles; two documents link when num/den of their union is shared. Every
shingle is hashed to one bit, and a document's sketch is the exclusive or of its shingles' bits, so the Hamming distance
of two sketches is at most the size of the sets' symmetric difference, which a link bounds by the two sizes.

Candidates. Sizes fall into bands such that a partner lies in the same or the next band. A band's largest possible
difference D cuts the sketch into m = D + 1 + slack blocks: by the pigeonhole at least 1 + slack blocks of a linked pair
are equal. Documents meet by the digests of their blocks. Empty blocks say little and would be shared by strangers, so
a document with at most ``slack`` empty blocks leaves them out (it still has an equal block with tokens with every
partner); the others also meet by their pairs of empty blocks, of which two such partners share one if that is all
that they share. Members of equal lists of documents are compared once.

Comparison. In each list, by blocks of at most 2 * ``BLOCK`` documents, Hamming distances rule out all pairs that cannot
link. Where few pairs are left, at most ``FEW`` a document, all are verified on the exact sets, and the list is done. In
the other, dense lists first only a spanning forest of them is verified; then, with the components that all this gives,
every remaining candidate pair between different components of a dense list. So no link between components is lost,
while links inside one need not be listed. Equal sets are merged before, by 128-bit digests.

Null, empty and white texts have size 0 and link with nothing. Rows with equal doc_id are one vertex; rows with a null
doc_id are returned with a null component. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tapewright.llm.common import arrow_rows, hash_shingles, materialize, maybe_broadcast, mix64, release, small_batches, trimmed
from tapewright.llm.graph import components

#: Documents of one list that are compared at once, at most twice as many.
BLOCK = 512
#: Pairs a document up to which a list's pairs are all verified at once; the others are dense and are compared twice.
FEW = 4
#: Texts that are hashed together.
TOGETHER = 64
#: Rows of keys sent to Spark at once.
SEND = 200_000
_SEED = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Rule:
    """Shingles of ``k`` words; a link shares num/den of the union."""

    k: int = 3
    num: int = 90
    den: int = 100

    def most_apart(self, total: int) -> int:
        """The largest symmetric difference of linked sets whose sizes sum to ``total``."""
        return total * (self.den - self.num) // (self.den + self.num)

    def links(self, shared: int, total: int) -> bool:
        return self.den * shared >= self.num * (total - shared)


@lru_cache(maxsize=8)
def bands(rule: Rule) -> list[int]:
    """Lower ends of the size bands: the partner of a size in one band is below the end of the next."""
    ends = [1, 2]
    while ends[-1] < 1 << 31:
        ends.append(max(ends[-1] + 1, (ends[-1] - 1) * rule.den // rule.num + 1))
    return ends


@lru_cache(maxsize=4096)
def plan(rule: Rule, band: int) -> tuple[int, int]:
    """Blocks and slack of a band; no blocks where linked sets must be equal."""
    ends = bands(rule)
    apart = rule.most_apart(2 * (ends[band + 1] - 1))
    if apart == 0:
        return 0, 0
    smallest, blocks, slack = max(1, ends[band] * rule.num // rule.den), apart + 1, 0
    for _ in range(2):
        empty = blocks * math.exp(-smallest / blocks)
        slack = min(math.ceil(empty + 3 * math.sqrt(empty)), apart + 1)
        blocks = apart + 1 + slack
    return blocks, slack


def block_keys(tokens: np.ndarray, rule: Rule) -> np.ndarray:
    """The keys under which a set (distinct shingle hashes) meets its possible partners."""
    size, ends, out = len(tokens), bands(rule), []
    band = int(np.searchsorted(ends, size, "right")) - 1
    spread = mix64(tokens ^ _SEED)
    for at in (band, band + 1):
        if at > band and size * rule.den // rule.num < ends[at]:
            break
        m, slack = plan(rule, at)
        if not m:
            continue
        block = ((spread >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(block, kind="stable")
        block = block[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        bits = mix64((spread[order] & np.uint64(0xFFFF)) + np.uint64(1))
        digest = np.bitwise_xor.reduceat(bits, first)
        tag = np.uint64((at * 0x9E3779B97F4A7C15) & (2**64 - 1))
        out.append(mix64(mix64(block[first] + tag) ^ digest))
        if m - len(first) > slack:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), block[first])
            if slack:
                i, j = np.triu_indices(len(empty), 1)
                empty = empty[i] * np.uint64(m) + empty[j]
            out.append(mix64(mix64(empty + tag) ^ _SEED))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The parity sketch as 64-bit words: a power of two of bits, four or more a token."""
    bits = 1 << max(8, math.ceil(math.log2(4 * max(1, len(tokens)))))
    at = (mix64(tokens) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, length: int) -> np.ndarray:
    """A sketch folded to ``length`` words, as if it had been made with so few bits."""
    while len(words) > length:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def token_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The distinct shingles of each text."""
    return [np.unique(h) for h in hash_shingles(texts, k)]


def documents_base(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits; null without words) and sketch of every row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.BinaryType())])

    def make(rows):
        while some := list(islice(rows, TOGETHER)):
            for (doc_id, _), s in zip(some, token_sets([text for _, text in some], rule.k)):
                yield (doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), sketch(s).tobytes()) if len(s) else (doc_id, 0, None, None)

    return arrow_rows(docs, ["doc_id", "text"], make, schema)


def keyed(docs: DataFrame, rule: Rule) -> DataFrame:
    """key, doc_id: every key of every document; of equal sets that one task sees, of the first only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, ids, held = set(), [], [], 0

        def send():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array([i for i, _ in ids], np.int64), [n for _, n in ids]))], names=["key", "doc_id"])

        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                for doc_id, s in zip(part.column(0).to_pylist(), token_sets(part.column(1).to_pylist(), rule.k)):
                    if doc_id is None or not len(s):
                        continue
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    if digest in seen:
                        continue
                    if len(seen) < 500_000:
                        seen.add(digest)
                    mine = block_keys(s, rule)
                    if len(mine):
                        keys.append(mine), ids.append((doc_id, len(mine)))
                        held += len(mine)
                    if held >= SEND:
                        yield send()
                        keys, ids, held = [], [], 0
        if keys:
            yield send()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "key long, doc_id long")


def lists(docs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """list, size, rep: the distinct lists of documents that meet under a key, by their representatives."""
    # ids all of whose rows are copies of another id's text need no keys of their own
    copies = materialize(nodes.where("rep is not null").groupBy("doc_id").agg(F.max(F.col("rep") == F.col("doc_id")).alias("own")).where("not own").select("doc_id"), "copies")
    key = keyed(docs.join(maybe_broadcast(copies), "doc_id", "left_anti"), rule).repartition("key")
    # equal lists have an equal exclusive or of their members' hashes; lists that share it by chance are compared together
    w = Window.partitionBy("key")
    met = key.select("doc_id", F.count("*").over(w).alias("n"), F.bit_xor(F.xxhash64("doc_id")).over(w).alias("mark")).where("n > 1")
    met = met.select(F.xxhash64("mark", "n").alias("list"), "doc_id").distinct()
    members = met.join(nodes.where("rep is not null").select("doc_id", "rep").distinct(), "doc_id").select("list", "rep").distinct()
    members = materialize(members, "members")
    sizes = members.groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    return members.join(sizes, "list")


def apart(s: np.ndarray) -> np.ndarray:
    """Hamming distances of all pairs of sketches (rows of 64-bit words)."""
    out = np.zeros((len(s), len(s)), np.int32)
    for i in range(len(s) - 1):
        out[i, i + 1 :] = np.bitwise_count(s[i + 1 :] ^ s[i]).sum(1, dtype=np.int32)
    return out + out.T


def forest(distance: np.ndarray, limit: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Pairs within their limits that join the components, near ones first."""
    comp, out = comp.copy(), []
    for share in (0.5, 0.85, 1.0):
        near = (distance <= share * limit) & (limit >= 0)
        for i in np.flatnonzero(near.any(1)):
            other = np.flatnonzero(near[i] & (comp != comp[i]))
            if len(other):
                labels, at = np.unique(comp[other], return_index=True)
                out += [(int(i), int(j)) for j in other[at]]
                comp[np.isin(comp, labels)] = comp[i]
    return out


def candidate_pairs(members: DataFrame, base: DataFrame, rule: Rule, every: bool) -> DataFrame:
    """a, b: pairs of different components that the sketches allow; ``every`` one, or in dense lists a spanning forest of them.

    ``dense`` names such a list in a row without a pair. ``members``: list, size, rep, comp. Lists over ``BLOCK`` are cut into blocks by hash and compared block by block.
    """
    nb = F.ceil(F.col("size") / BLOCK).cast("int")
    cut = members.withColumn("nb", nb).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(7)), "nb").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cut = cut.select("list", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "rep", "comp")
    sketches = base.where("digest is not null and doc_id is not null").select(F.col("doc_id").alias("rep"), "n_shingles", "sketch")
    rows = cut.join(sketches, "rep").repartition("list", "b1", "b2").sortWithinPartitions("list", "b1", "b2", "rep")

    def compare(name: int, group: list[tuple]) -> list[tuple[int | None, int | None, int | None]]:
        ids = np.array([g[0] for g in group])
        comp = np.array([g[1] for g in group])
        size = np.array([g[2] for g in group])
        words = [np.frombuffer(g[3], np.uint64) for g in group]
        shortest = min(map(len, words))
        distance = apart(np.stack([fold(w, shortest) for w in words]))
        total = size[:, None] + size[None, :]
        limit = np.where(np.minimum(size[:, None], size[None, :]) * rule.den >= np.maximum(size[:, None], size[None, :]) * rule.num, total * (rule.den - rule.num) // (rule.den + rule.num), -1)
        np.fill_diagonal(limit, -1)
        i, j = np.nonzero(np.triu((distance <= limit) & (comp[:, None] != comp[None, :]), 1))
        dense = not every and len(i) > FEW * len(ids)
        if dense:
            i, j = (np.array(x, np.int64) for x in zip(*forest(distance, limit, comp)))
        a, b = ids[i], ids[j]
        keep = a != b
        return [(x, y, None) for x, y in zip(np.minimum(a, b)[keep].tolist(), np.maximum(a, b)[keep].tolist())] + [(None, None, name)] * dense

    def make(stream):
        group, last = [], None
        for lst, b1, b2, *row in stream:
            if (lst, b1, b2) != last:
                if len(group) > 1:
                    yield from compare(last[0], group)
                group, last = [], (lst, b1, b2)
            group.append(tuple(row))
        if len(group) > 1:
            yield from compare(last[0], group)

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("dense", T.LongType())])
    return arrow_rows(rows, ["list", "b1", "b2", "rep", "comp", "n_shingles", "sketch"], make, schema, rows=50_000).distinct()


def verified(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """a, b, link: each pair's exact test. Only texts of documents in some pair are moved."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = docs.select("doc_id", "text").join(maybe_broadcast(ids), "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def make(rows):
        known = {}
        while some := list(islice(rows, TOGETHER)):
            texts = {t for row in some for t in row[2:]}
            known = {t: s for t, s in known.items() if t in texts}
            new = [t for t in texts if t not in known]
            known |= zip(new, token_sets(new, rule.k))
            for a, b, ta, tb in some:
                x, y = known[ta], known[tb]
                shared = len(x) + len(y) - len(np.union1d(x, y))
                yield a, b, bool(len(x) and rule.links(shared, len(x) + len(y)))

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("link", T.BooleanType())])
    return arrow_rows(both, ["a", "b", "ta", "tb"], make, schema).groupBy("a", "b").agg(F.max("link").alias("link"))


def join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id that links reach."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = materialize(documents_base(docs, rule), "sets")
    reps = base.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    nodes = materialize(base.join(reps, "digest", "left").select("doc_id", "n_shingles", "rep"), "nodes")
    met = materialize(lists(docs, nodes, rule), "lists")
    found = materialize(candidate_pairs(met.withColumn("comp", F.col("rep")), base, rule, every=False), "pairs")
    pairs = found.where("dense is null").select("a", "b")
    tested = materialize(verified(pairs, docs, rule), "tested")
    # equal ids of different rows tie their representatives together, so that a document is one vertex
    same = nodes.where("rep is not null and doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).join(nodes.where("doc_id = rep").select(F.col("doc_id").alias("a")).distinct(), "a", "left_semi")
    links = tested.where("link").select("a", "b").unionByName(same)
    label = materialize(components(links), "labels")
    dense = met.join(found.where("dense is not null").select(F.col("dense").alias("list")), "list", "left_semi")
    known = dense.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("list", "size", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = known.groupBy("list").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("list")
    rest = candidate_pairs(known.join(mixed, "list", "left_semi"), base, rule, every=True).select("a", "b").join(tested, ["a", "b"], "left_anti")
    rest = materialize(rest, "rest")
    more = materialize(verified(rest, docs, rule).where("link").select("a", "b"), "more")
    if more.limit(1).count():
        label = materialize(components(links.unionByName(more)), "labels")
    release(found, rest)
    return nodes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, rule: Rule) -> DataFrame:
    """``docs`` with one document of each component: all rows of its smallest doc_id. Rows with a null id stay."""
    classes = materialize(join(docs, rule), "classes")
    drop = materialize(classes.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    return docs.join(maybe_broadcast(drop), docs["doc_id"] == drop["doc_id"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: three-word shingles, nine tenths of the union shared, every document."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), Rule(3, 90, 100))
