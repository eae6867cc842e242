"""Operator 10, substring dedup by compact windows.

A document is its sequence of shingle hashes (five words). For each of ``HASHES`` hash functions, the Cartesian tree of
the hashed sequence gives for every position c the longest window [l, r] whose minimum stands at c; all windows of at
least ``WIDTH`` shingles are kept (about 2 n / WIDTH of them), and each stands for all passages around c inside it. Two
documents that share a passage of WIDTH shingles (``WORDS`` words) have, for every hash function, a window over it with
the same minimum; with passages of similarity J, for a share J of the functions. Of runs of WIDTH shingles that a document
repeats only the first are windowed; the others get what the first one gets.

Windows meet by function and minimum.

* Meetings of at most ``HOT`` windows: every pair of documents is compared. Aligned at their minima, two windows overlap in
  an interval; pairs with a long enough one are verified on the texts: exact runs are extended to their ends, and beside
  them the intervals are cut to all parts where the passages' shingle sets have a similarity of ``SIMILAR`` or more.
* Longer meetings, exact passages: one hash function is enough, as equal passages have equal minima. Each run of WIDTH
  shingles that its windows stand for is hashed; documents with an equal run form a class, and each gets the run as a
  passage. Work and rows are linear in the windows, however many documents share a passage.
* Longer meetings, near passages: a window with no such run around its minimum is compared with all windows of the meeting
  that have none either, and with the first document of each class, by two bytes a shingle. In each block of
  ``NEAR_BLOCK`` its ``PARTNERS`` best and so many others go on to verification on the texts that they share with it, within SIDE shingles of
  its minimum, whatever any partner shares. Where the texts do not bear that out, all others follow that share
  more than lies in passages found by then. Meetings of more than ``BIG`` windows are first divided by
  selected 10-shingle runs around the minimum, of which near passages share one; so what is compared pair by pair
  are windows that share more than a common line. A document with an exact passage in a long meeting is not compared
  further there, so near text that adjoins the passage is not added.

Keys that are frequent in a sample of documents are spread over ``SALTS`` tasks and go the long way; this changes only
where rows are handled, as the long way is open to all keys.

Documents with equal words are one document to all this; copies of at least ``WORDS`` words are whole-text passages of
each other. Null, empty and short texts have no passages. Rows with a null doc_id take no part. Rows that repeat a
doc_id count as one document. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tapewright.llm.common import arrow_rows, hash_shingles, hash_words, materialize, maybe_broadcast, mix64, powers, release, shingles, small_batches, trimmed

SHINGLE = 5
WORDS = 50
WIDTH = WORDS - SHINGLE + 1
HASHES = 4
SIMILAR = 0.8
#: Windows of a meeting that are compared pair by pair on the texts, and from which it is divided.
HOT, BIG = 4, 1024
NEAR_BLOCK = 2048
#: Shingles compared on each side of a minimum, up to SHIFT places apart; the share of two aligned passages of similarity
#: SIMILAR that agrees; how many agree at least; and partners of a window in a block that are verified whatever they share.
SIDE, SHIFT, SHARE = WIDTH - 1, 2, 2 * SIMILAR / (1 + SIMILAR)  # 8 of 9
AGREE, AROUND, PARTNERS = int(SHARE * WIDTH) - 1, 2 * SIDE + 1, 3
#: Runs that documents share, and exact passages, (three numbers each) that may be sent to every task; beyond it rows are
#: shuffled by run, and windows by document.
BROADCAST_SPANS = 500_000
#: Pairs that are compared at once.
PAIRS = 1 << 14
#: Runs by which large meetings are divided: of GRAM shingles, the smallest of any GRAMS neighbours.
GRAM, GRAMS = 10, 11
#: Documents sampled for frequent keys, windows of the sample that make a key frequent, and tasks that it is spread over.
SAMPLE, OFTEN, SALTS = 4096, 12, 64
#: Parts of an alignment that are tested with all shorter ones.
TESTS = 48
#: Shingles handled at once.
TOGETHER = 1 << 15
SEND = 100_000


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of ``w`` values along the last axis, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[..., : out.shape[-1] - step], out[..., step:])
        have += step
    return out


def compact_windows(x: np.ndarray, width: int = WIDTH, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, l, c, r of all nodes of the Cartesian trees of the rows of ``x`` (of equal values the leftmost is the
    minimum) that span at least ``width`` positions. ``longest``: a bound of all spans, if there is one.

    Such a node is the minimum of some ``width`` positions, so only those minima are looked at; their spans reach to the
    last value that is not larger on the left, and to the next smaller one on the right.
    """
    rows, n = x.shape
    if n < width:
        return (np.empty(0, np.int64),) * 4
    levels = [x]  # levels[k][:, i]: the minimum of 2**k values from i
    while 2 << (len(levels) - 1) <= min(n, longest or n):
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:, :-step], levels[-1][:, step:]))
    # the largest of the window minima over each position tells whether the position is one of them
    side = np.zeros((rows, width - 1), x.dtype)
    padded = np.concatenate([side, sliding_min(x, width), side], axis=1)
    row, found = np.nonzero(~sliding_min(~padded, width)[:, :n] == x)
    v, left, right = x[row, found], found.copy(), found + 1
    for k in range(len(levels) - 1, -1, -1):  # spans grow by halving steps, all candidates at once
        low, step = levels[k], 1 << k
        left -= np.where((left >= step) & (low[row, np.maximum(left - step, 0)] > v), step, 0)
        right += np.where((right + step <= n) & (low[row, np.minimum(right, low.shape[1] - 1)] >= v), step, 0)
    right -= 1
    wide = right - left + 1 >= width
    return row[wide], left[wide], found[wide], right[wide]


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` values: a polynomial in an odd number, as all its powers can be divided by."""
    n = len(h) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    up, down = powers(len(h))
    total = np.r_[np.uint64(0), np.cumsum(h * up, dtype=np.uint64)]
    return mix64((total[width:] - total[:n]) * down[:n])


def first_runs(h: np.ndarray) -> np.ndarray:
    """Whether the run of WIDTH shingles from each position has not stood before it in the document."""
    new = np.zeros(max(0, len(h) - WIDTH + 1), bool)
    new[np.unique(run_hashes(h, WIDTH), return_index=True)[1]] = True
    return new


SEEDS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def ordered(h: np.ndarray) -> np.ndarray:
    """The values of the hash functions (a row each), by which minima are found: 32 bits, none of them 0."""
    return np.maximum(((h[None, :] * SEEDS[:, None]) >> np.uint64(32)).astype(np.uint32), np.uint32(1))


def keys_of(h: np.ndarray, f: np.ndarray | int) -> np.ndarray:
    """The keys under which windows of function ``f`` with these minima meet."""
    return mix64(h ^ SEEDS[f])


def windows_of(texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Document (its place in the list), key, l, c, r of every compact window of some documents (sequences of word hashes).

    The documents stand behind one another; shingles that reach into the next are 0 and bound every window.
    """
    size = np.array([len(t) for t in texts])
    begin = np.r_[0, np.cumsum(size)]
    flat = np.concatenate(texts)
    h = np.zeros(len(flat), np.uint64)
    h[: len(flat) - SHINGLE + 1] = shingles(flat, SHINGLE)
    over = (begin[1:, None] - np.arange(1, SHINGLE)).reshape(-1)  # the places of shingles that reach into the next document
    x = ordered(h)
    x[:, over] = 0
    f, left, mid, right = compact_windows(x, WIDTH, int(size.max()))
    inside = x[f, mid] > 0
    f, left, mid, right = f[inside], left[inside], mid[inside], right[inside]
    key = keys_of(h[mid], f)
    doc = np.searchsorted(begin, mid, "right") - 1
    order = np.lexsort((key, doc))
    twice = doc[order][1:][(doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])]
    if len(twice):  # a minimum twice in a document: of equal runs only the first is taken
        keep = np.ones(len(doc), bool)
        for k in np.unique(twice):
            own = np.flatnonzero(doc == k)
            new = np.r_[0, np.cumsum(first_runs(h[begin[k] : begin[k + 1] - SHINGLE + 1]))]
            last, first = np.minimum(mid[own], right[own] - WIDTH + 1) - begin[k], np.maximum(left[own], mid[own] - WIDTH + 1) - begin[k]
            keep[own] = new[last + 1] > new[first]
        f, left, mid, right, doc, key = f[keep], left[keep], mid[keep], right[keep], doc[keep], key[keep]
    return doc, key.view(np.int64), *(y.astype(np.int32) for y in (left - begin[doc], mid - begin[doc], right - begin[doc]))


def windows(docs: DataFrame) -> DataFrame:
    """key, doc_id, l, c, r: every compact window of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(ids, texts):
            doc, *rest = windows_of(texts)
            return pa.RecordBatch.from_arrays([pa.array(rest[0]), pa.array(np.array(ids, np.int64)[doc]), *map(pa.array, rest[1:])], names=["key", "doc_id", "l", "c", "r"])

        ids, texts, size = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                for doc_id, words in zip(part.column(0).to_pylist(), hash_words(part.column(1).to_pylist())):
                    if doc_id is None or len(words) < WORDS:
                        continue
                    ids.append(doc_id), texts.append(words)
                    size += len(words)
                    if size >= TOGETHER:
                        yield send(ids, texts)
                        ids, texts, size = [], [], 0
        if ids:
            yield send(ids, texts)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "key long, doc_id long, l int, c int, r int")


def block_pairs(group: np.ndarray, doc: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """a, b, d, low, high of the pairs of rows of a group (equal neighbours in ``group``) that overlap in WIDTH shingles.
    Some pairs at a time."""
    if not len(group):
        return
    end = np.searchsorted(group, group, "right")
    i, k = np.arange(len(group)), 0
    while len(i := i[i + k + 1 < end[i]]):
        k += 1
        j = i + k
        near = np.minimum(r[i] - c[i], r[j] - c[j]) + np.minimum(c[i] - l[i], c[j] - l[j]) + 1 >= WIDTH
        near &= doc[i] != doc[j]
        p, q = i[near], j[near]
        p, q = np.where(doc[p] < doc[q], p, q), np.where(doc[p] < doc[q], q, p)
        d = c[q] - c[p]
        if len(p):
            yield doc[p], doc[q], d, np.maximum(l[p], l[q] - d), np.minimum(r[p], r[q] - d)


MET = "a long, b long, d int, low int, high int, key long, n int"


def met_batch(a, b, d, low, high, key, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64()), pa.array(d, pa.int32()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(key, pa.int64()) if key is not None else pa.nulls(len(a), pa.int64()), pa.array(n, pa.int32()) if n is not None else pa.nulls(len(a), pa.int32())], names=["a", "b", "d", "low", "high", "key", "n"])


def frequent(docs: DataFrame, rows: int) -> DataFrame:
    """key, about: those of OFTEN windows or more in a sample of about SAMPLE documents, chosen by hash of their ids, and how
    many windows they have about."""
    share = min(1 << 30, max(1, rows // SAMPLE))
    found = windows(docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(share)) == 0)).groupBy("key").agg(F.count("*").alias("n"))
    return found.where(F.col("n") >= OFTEN).select("key", F.least(F.col("n") * share, F.lit(1 << 30)).cast("int").alias("about"))


def meetings(docs: DataFrame, rows: int) -> DataFrame:
    """a, b, d, low, high of all pairs that meet in short meetings; where b is null, a window of a long one: document a, its
    minimum d, its ends low and high, with the key and about how many windows n the meeting has.

    A key's rows come sorted to one task, those of a frequent key to SALTS. A task holds no more than SEND rows at a time.
    """
    often = F.broadcast(materialize(frequent(docs, rows), "frequent"))  # at most the sample's windows / OFTEN
    own = windows(docs).join(often, "key", "left").withColumn("salt", F.when(F.col("about").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) + 1))
    dealt = own.repartition("key", "salt").sortWithinPartitions("key").select("key", "doc_id", "l", "c", "r", F.coalesce("about", F.lit(0)).alias("about"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_key = None  # of rows sent already

        def split(key, doc, l, c, r, about):
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            n = np.repeat(size, size)
            endless = (n >= SEND) | ((key == long_key) if long_key is not None else False)
            away = endless | (about > 0) | (n > HOT)
            if away.any():
                yield met_batch(doc[away], None, c[away], l[away], r[away], key[away], np.where(endless, 1 << 30, np.where(about > 0, about, n))[away])
            some = ~away & (n > 1)
            out, rows = [], 0
            for part in block_pairs(key[some], doc[some], l[some], c[some], r[some]):
                out.append(part)
                rows += len(part[0])
                if rows >= SEND:
                    yield met_batch(*(np.concatenate(x) for x in zip(*out)), None, None)
                    out, rows = [], 0
            if out:
                yield met_batch(*(np.concatenate(x) for x in zip(*out)), None, None)

        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append([x.to_numpy(zero_copy_only=False) for x in b.columns])
            size += b.num_rows
            if size < SEND:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            order = cols[0]
            whole = int(np.searchsorted(order, order[-1], "left"))  # the last group may go on in the next batch
            if whole == 0:  # one key alone: a long meeting
                yield from split(*cols)
                long_key, held, size = order[-1], [], 0
            else:
                yield from split(*(x[:whole] for x in cols))
                held, size = [[x[whole:] for x in cols]], len(order) - whole
        if held:
            yield from split(*(np.concatenate(x) for x in zip(*held)))

    return dealt.mapInArrow(trimmed(run), MET)


def selected_runs(h: np.ndarray, low: int, high: int) -> np.ndarray:
    """Hashes of the runs of GRAM shingles inside h[low..high] that are the smallest of some GRAMS neighbours."""
    x = run_hashes(h[low : high + 1], GRAM)
    return np.unique(sliding_min(x, GRAMS)) if len(x) >= GRAMS else np.unique(x)


LONG = "run boolean, gid long, doc_id long, c int, l int, r int, sig binary"


def long_rows(hot: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the windows of long meetings: run, gid, doc_id, c: a row for each run of WIDTH shingles at c, with its hash; and
    (not run) a row for each window under its key, or under key and selected run in large meetings, with SIDE shingles a side,
    a byte of each and then another of each."""
    listed = hot.groupBy(F.col("a").alias("doc_id")).agg(F.collect_set(F.struct("key", F.col("d").alias("c"), F.col("low").alias("l"), F.col("high").alias("r"), "n")).alias("ws"))
    both = docs.select("doc_id", "text").join(listed, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            run, gid, doc, c, l, r = (np.concatenate(x) for x in list(zip(*held))[:6])
            sig = np.concatenate([x[6] for x in held]).tobytes()
            ends = np.r_[0, np.cumsum(np.where(run, 0, 2 * AROUND))].astype(np.int32)
            sig = pa.Array.from_buffers(pa.binary(), len(run), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(sig)])
            return pa.RecordBatch.from_arrays([pa.array(run), pa.array(gid.view(np.int64)), *map(pa.array, (doc, c, l, r)), sig], names=["run", "gid", "doc_id", "c", "l", "r", "sig"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, texts, lists = batch.slice(at, 64).columns
                spread = np.r_[0, np.cumsum(pa.compute.list_value_length(lists).to_numpy())]
                flat = lists.flatten()
                keys, *places = (flat.field(k).to_numpy() for k in ("key", "c", "l", "r", "n"))
                for k, (doc_id, words) in enumerate(zip(ids.to_pylist(), hash_words(texts.to_pylist()))):
                    some = slice(spread[k], spread[k + 1])
                    h, key = shingles(words, SHINGLE), keys[some].view(np.uint64)
                    c, l, r, n = (x[some].astype(np.int64) for x in places)
                    if r.max() >= len(h):  # another text of the same id
                        continue
                    runs = run_hashes(h, WIDTH)
                    one = keys_of(h[c], 0) == key
                    step = np.zeros(len(runs) + 1, np.int64)
                    np.add.at(step, np.maximum(l, c - WIDTH + 1)[one], 1)
                    np.add.at(step, (np.minimum(c, r - WIDTH + 1) + 1)[one], -1)
                    stood = np.cumsum(step[:-1]) > 0
                    pos = np.flatnonzero(np.isin(runs, runs[stood]) if len(np.unique(runs)) < len(runs) else stood)
                    none = np.zeros(len(pos), np.int32)
                    held.append((np.ones(len(pos), bool), runs[pos], np.full(len(pos), doc_id, np.int64), pos.astype(np.int32), none, none, np.empty((0, 2 * AROUND), np.uint8)))
                    around = np.lib.stride_tricks.sliding_window_view(np.pad(h.astype(np.uint16).view(np.uint8).reshape(-1, 2), ((SIDE, SIDE), (0, 0))), AROUND, 0)
                    which, gid = np.flatnonzero(n <= BIG), [key[n <= BIG]]
                    which = [which]
                    for m in np.flatnonzero(n > BIG):
                        own = mix64(key[m] ^ selected_runs(h, max(l[m], c[m] - SIDE), min(r[m], c[m] + SIDE)))
                        gid.append(own), which.append(np.full(len(own), m))
                    which = np.concatenate(which)
                    held.append((np.zeros(len(which), bool), np.concatenate(gid), np.full(len(which), doc_id, np.int64), *(y[which].astype(np.int32) for y in (c, l, r)), around[c[which]].reshape(-1, 2 * AROUND)))
                    size += len(pos) + 4 * len(which)
                    if size >= SEND:
                        yield send()
                        held, size = [], 0
        if held:
            yield send()

    return both.select("doc_id", "text", "ws").mapInArrow(trimmed(run), LONG)


def islands(rows: DataFrame, by: list[str]) -> DataFrame:
    """Neighbouring ``c`` of each group as one row: ``by``, low, high, other (the smallest)."""
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy("c"))
    return rows.withColumn("part", F.col("c") - place).groupBy(*by, "part").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("other").alias("other")).drop("part")


def exact_classes(runs: DataFrame) -> DataFrame:
    """doc_id, rep, low, high, other: maximal neighbouring runs (by their starts) that other documents have too; rep: of which
    the document is the first that has them."""
    classes = materialize(runs.groupBy("gid").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"), "classes")
    if classes.count() <= BROADCAST_SPANS:
        classes = F.broadcast(classes)
    found = runs.join(classes, "gid").select("doc_id", "c", (F.col("doc_id") == F.col("first")).alias("rep"), F.when(F.col("doc_id") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("other"))
    return islands(found, ["doc_id", "rep"])


def near_partners(rows: DataFrame, exact: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b, d, low, high: partners in each block of every window of a long meeting without an exact run around its minimum,
    among windows without one and those of first documents of a class; so many that they share with it whatever any partner
    does. Where b is null, document a's window under ``gid`` with its minimum at d has other partners too, and what they
    share lies in low..high. And the windows compared."""
    spans = lambda rep: F.collect_list(F.when(rep, F.struct("low", "high")))
    holds = lambda name: F.coalesce(F.exists(name, lambda s: (s["low"] <= F.col("c")) & (F.col("c") < s["high"] + WIDTH)), F.lit(False))
    found = materialize(exact.groupBy("doc_id").agg(spans(F.lit(True)).alias("every"), spans(F.col("rep")).alias("firsts")), "exact-spans")
    if exact.count() <= BROADCAST_SPANS:
        found = F.broadcast(found)
    marked = rows.join(found, "doc_id", "left").select("gid", "doc_id", "c", "l", "r", "sig", (~holds("every")).cast("int").alias("open"), holds("firsts").alias("first")).where("open = 1 or first")
    marked = materialize(marked.drop("first"), "long-windows")
    sizes = marked.groupBy("gid").agg(F.count("*").alias("n"), F.sum("open").alias("u")).where("n > 1 and u > 0")
    return materialize(compared(marked.join(sizes, "gid")), "near"), marked


def rest_partners(marked: DataFrame, near: DataFrame, found: DataFrame) -> DataFrame | None:
    """a, b, d, low, high of the other partners of windows that share more with them than lies in passages ``found`` (merged),
    as not all that the partners in ``near`` share by bytes was verified. None, if there are no such windows."""
    held = found.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start_word").alias("s"), (F.col("end_word") - SHINGLE).alias("e"))).alias("held"))
    more = near.where("b is null").select("gid", F.col("a").alias("doc_id"), F.col("d").alias("c"), "low", "high").join(held, "doc_id", "left")
    inside = F.exists("held", lambda x: (x["s"] <= F.col("low")) & (F.col("high") <= x["e"]))
    more = materialize(more.where(~F.coalesce(inside, F.lit(False))).select("gid", "doc_id", "c").distinct(), "more")
    if not more.count():
        return None
    around = F.get(F.filter("held", lambda x: (x["s"] <= F.col("c")) & (F.col("c") <= x["e"])), F.lit(0))
    rows = marked.join(maybe_broadcast(materialize(more.select("gid").distinct(), "more-gids")), "gid").join(maybe_broadcast(more.withColumn("want", F.lit(1))), ["gid", "doc_id", "c"], "left").join(held, "doc_id", "left")
    rows = rows.withColumn("around", around).select("gid", "doc_id", "c", "l", "r", "open", F.coalesce("want", F.lit(0)).alias("want"), F.coalesce(F.col("c") - F.col("around.s"), F.lit(-1)).alias("kl"), F.coalesce(F.col("around.e") - F.col("c"), F.lit(-1)).alias("kr"), "sig")
    rows = materialize(rows, "rest-windows")
    sizes = rows.groupBy("gid").agg(F.count("*").alias("n"))
    return compared(rows.join(sizes, "gid")).drop("gid").join(near.where("b is not null").select("a", "b", "d"), ["a", "b", "d"], "left_anti")


def compared(rows: DataFrame) -> DataFrame:
    """a, b, d, low, high, gid: partners of the open rows among the ``n`` of their gid, by blocks. With columns want, kl and kr
    (how far around its minimum a window lies in passages found) all partners that may add to a row that wants them."""
    known = [x for x in ("want", "kl", "kr") if x in rows.columns]
    cut = rows.withColumn("nb", F.ceil(F.col("n") / NEAR_BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc_id", "c"), F.col("nb")).cast("int"))
    cut = cut.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("gid", F.least("own", "to").alias("b1"), F.greatest("own", "to").alias("b2"), "own", "doc_id", "c", "l", "r", "open", "sig", *known)
    dealt = cut.repartition("gid", "b1", "b2").sortWithinPartitions("gid", "b1", "b2", "doc_id", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], 1)
            if rows >= NEAR_BLOCK:  # compare whole blocks, and keep the last, which may go on
                new = np.flatnonzero((ids != np.concatenate([last, ids[:-1]])).any(1))
                if len(new):
                    yield from compare_blocks([*held, batch.slice(0, int(new[-1]))])
                    held, rows, batch = [], 0, batch.slice(int(new[-1]))
            held.append(batch)
            rows, last = rows + batch.num_rows, ids[-1:]
        if held:
            yield from compare_blocks(held)

    return dealt.mapInArrow(trimmed(run), "a long, b long, d int, low int, high int, gid long")


def compare_blocks(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partners of the rows of whole blocks (or pairs of blocks, across), and what rows share that have more."""
    table = pa.Table.from_batches(parts)
    gid, b1, b2, own, doc, c, l, r, free = (table.column(k).to_numpy() for k in ("gid", "b1", "b2", "own", "doc_id", "c", "l", "r", "open"))
    known = tuple(table.column(k).to_numpy() for k in ("want", "kl", "kr")) if "kl" in table.column_names else None
    if len(doc) < 2:
        return
    first = np.flatnonzero(np.r_[True, (gid[1:] != gid[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])])
    size = np.diff(np.r_[first, len(doc)])
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(doc), 2 * AROUND)
    names, out, rows = ["a", "b", "d", "low", "high", "gid"], [], 0

    def send():
        i, j, more, low, high = (np.concatenate(x) for x in zip(*out))
        p, q = np.where(doc[i] < doc[j], i, j), np.where(doc[i] < doc[j], j, i)
        d = c[q] - c[p]
        cols = (np.r_[doc[p], doc[more]], np.r_[doc[q], doc[more]], np.r_[d, c[more]], np.r_[np.maximum(l[p], l[q] - d), c[more] + low], np.r_[np.minimum(r[p], r[q] - d), c[more] + high], np.r_[gid[p], gid[more]])
        mask = np.r_[np.zeros(len(p), bool), np.ones(len(more), bool)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k in "d low high".split() else pa.int64(), mask=mask if k == "b" else None) for k, x in zip(names, cols)], names=names)

    for found in partners(np.repeat(first, size), np.repeat(size, size), sig, doc, c, l, r, free, np.where(b1 != b2, own, -1), known):
        out.append(found)
        rows += len(found[0]) + len(found[2])
        if rows >= SEND:
            yield send()
            out, rows = [], 0
    if rows:
        yield send()


def agreement(sig: np.ndarray, p: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether each shingle around rows ``p`` stands around row j, up to SHIFT places apart."""
    x, y = sig[p], sig[j]
    same = x == y
    for k in range(1, SHIFT + 1):
        same[:, k:] |= x[:, k:] == y[:, :-k]
        same[:, :-k] |= x[:, :-k] == y[:, k:]
    return same


def running(step: np.ufunc, x: np.ndarray) -> np.ndarray:
    """``step.accumulate`` along the first axis in place, a whole row at once."""
    for before, now in zip(x, x[1:]):
        step(before, now, out=now)
    return x


def in_parts(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By how much the best part of WIDTH shingles or more exceeds SHARE (times 9); and which agreeing shingles lie in such
    parts that reach SHARE, or in the best, positions first. All such parts hold the middle."""
    flat = np.ascontiguousarray(same.T)
    total = np.zeros((AROUND + 1, len(same)), np.int16)
    np.multiply(flat, 9, out=total[1:])
    total[1:] -= 8
    running(np.add, total)
    ends = total[WIDTH:] - running(np.minimum, total[:WIDTH].copy())  # of the best parts with each end
    starts = running(np.maximum, total[:SIDE:-1].copy())[::-1] - total[:WIDTH]
    best = ends.max(0)
    need = np.minimum(best, 0)
    flat[:SIDE] &= running(np.maximum, starts)[:SIDE] >= need
    flat[SIDE:] &= running(np.maximum, ends[::-1])[::-1] >= need
    return best, flat


def partners(first: np.ndarray, size: np.ndarray, sig: np.ndarray, doc: np.ndarray, c: np.ndarray, l: np.ndarray, r: np.ndarray, free: np.ndarray, own: np.ndarray, known: tuple[np.ndarray, ...] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of a row and one of its block (``size`` rows from ``first``), one of them open, that agree in a part of WIDTH
    shingles or more of which SHARE (less one) agree: for each row the PARTNERS that agree best, others until every shingle
    that some partner shares is shared by one of them, those that may reach farthest, and of partners that agree less by
    one those that share more; then the rows that have more partners, and the first and last shingle that they share, from
    the minimum. With ``known`` (which rows want partners, and how far around its minimum a row lies in passages found) all
    pairs that share a shingle beyond that, and no rows. Some pairs at a time."""
    left, right = np.minimum(c - l, SIDE), np.minimum(r - c, SIDE)
    place = np.arange(AROUND) - SIDE
    thin, wide = np.ascontiguousarray(sig[:, :AROUND]), sig[:, :AROUND] | sig[:, AROUND:].astype(np.uint16) << 8
    some = np.maximum.reduceat(free, np.unique(first))[np.cumsum(np.r_[False, first[1:] != first[:-1]])] if known is None else known[0]
    todo = np.flatnonzero((some > 0) & (size > 1))
    upto = np.cumsum(size[todo])
    while len(todo):
        step = max(1, int(np.searchsorted(upto, PAIRS, "right")))
        i, todo, upto = todo[:step], todo[step:], upto[step:] - upto[step - 1]
        p = np.repeat(np.arange(len(i)), size[i])
        j = np.arange(len(p)) + np.repeat(first[i] - np.r_[0, np.cumsum(size[i])[:-1]], size[i])
        x = i[p]
        may = ((free[x] | free[j]) > 0) & (doc[x] != doc[j]) & ((own[x] < 0) | (own[x] != own[j]))
        back, ahead = np.minimum(left[x], left[j]), np.minimum(right[x], right[j])
        may &= back + ahead + 1 >= WIDTH
        if known is not None:
            _, kl, kr = known
            may &= (back > kl[x]) | (ahead > kr[x])
        p, j = p[may], j[may]
        if not len(p):
            continue
        some = np.flatnonzero(agreement(thin, i[p], j).sum(1, dtype=np.uint8) >= AGREE)
        if not len(some):
            continue
        row, j = p[some], j[some]
        p = i[row]
        same = agreement(wide, p, j)
        same &= (place >= -np.minimum(left[p], left[j])[:, None]) & (place <= np.minimum(right[p], right[j])[:, None])
        best, shared = in_parts(same)
        good = best > (-18 if known is None else -9)
        if known is not None:
            good &= (shared & ((place[:, None] < -kl[p]) | (place[:, None] > kr[p]))).any(0)
            yield p[good], j[good], p[:0], p[:0], p[:0]
            continue
        order = np.lexsort((doc[j], -best, row))
        order = order[good[order]]
        row, p, j, shared = row[order], p[order], j[order], np.ascontiguousarray(shared[:, order].T)
        weak = best[order] <= -9
        covered, claimed = np.zeros((2, len(i), AROUND), bool)
        taken, left_of = [], np.arange(len(row))
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        pick = np.flatnonzero((rank == 0) | (rank < PARTNERS) & ~weak)
        while len(pick):
            taken.append(left_of[pick])
            np.logical_or.at(covered, row[taken[-1]], shared[taken[-1]])
            np.logical_or.at(claimed, row[taken[-1]], shared[taken[-1]] & ~weak[taken[-1]][:, None])
            gain = (shared[left_of] & ~covered[row[left_of]]).sum(1)
            left_of, gain = left_of[gain > 0], gain[gain > 0]
            most = np.lexsort((-gain, weak[left_of], row[left_of]))
            pick = most[np.r_[True, np.diff(row[left_of][most]) > 0][: len(most)]]
        if taken:
            taken = np.concatenate(taken)
            for ends, reach in ((slice(0, SHINGLE), c - l), (slice(-SHINGLE, None), r - c)):  # beyond the bytes
                far = np.where(shared[:, ends].any(1), np.minimum(reach[p], reach[j]), 0)
                have = np.full(len(i), SIDE)
                np.maximum.at(have, row[taken], far[taken])
                beyond = np.flatnonzero(far > have[row])
                most = beyond[np.lexsort((-far[beyond], row[beyond]))]
                taken = np.r_[taken, most[np.r_[True, np.diff(row[most]) > 0][: len(most)]]]
            many = np.bincount(row[~weak], minlength=len(i)) - np.bincount(row[taken][~weak[taken]], minlength=len(i))
            more = np.flatnonzero(many > 0)
            yield p[taken], j[taken], i[more], claimed[more].argmax(1) - SIDE, SIDE - claimed[more][:, ::-1].argmax(1)


def pair_anchors(pairs: DataFrame) -> DataFrame:
    """a, b, anchors: pairs of documents with the alignments and intervals in which their windows meet."""
    wide = pairs.groupBy("a", "b", "d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return wide.groupBy("a", "b").agg(F.collect_set(F.struct("d", "low", "high")).alias("anchors"))


def exact_runs(x: np.ndarray, y: np.ndarray, d: int, low: int, high: int) -> list[tuple[int, int]]:
    """Runs of at least WIDTH equal shingles, x[i] == y[i + d], that touch [low, high], extended to their ends."""
    first, last = max(0, -d), min(len(x), len(y) - d)
    same = np.r_[False, x[first:last] == y[first + d : last + d], False]
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(first + int(s), first + int(e)) for s, e in zip(edges[::2], edges[1::2]) if e - s >= WIDTH and first + s <= high and first + e > low]


def similar_runs(x: np.ndarray, y: np.ndarray, d: int, low: int, high: int, runs: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Parts of x[low..high] of which enough shingles stand in the aligned part of y, if both parts' sets are similar:
    their bounds and those of y's parts, ends exclusive.

    Longest parts come first; of one that fails, shorter ones are tried, less its first or last run of shared shingles. From
    the test TESTS on (documents of a few lines in changing order), one that fails is cut in two at its longest gap
    instead, and of others only what no part tried before has covered is tried. Parts whose shared shingles all lie in
    ``runs`` (exact ones) or in parts found before are left out.
    """
    low, high = max(0, low), min(len(x), high + 1)
    ylow, yhigh = max(0, low + d - WIDTH), min(len(y), high + d + WIDTH)
    if high - low < WIDTH or yhigh - ylow < WIDTH:
        return []
    new = np.ones(high - low, bool)
    for s, e in runs:
        new[max(0, s - low) : max(0, e - low)] = False
    if not new.any():
        return []
    hits = places(x[low:high], np.sort(y[ylow:yhigh]))[1]
    new &= hits
    if not new.any():
        return []
    total = np.r_[0.0, np.cumsum(hits - SHARE)]
    ends = np.searchsorted(-np.minimum.accumulate(total), -total, "left")  # the first start from which the part up to here reaches the share
    last = np.r_[ends[1:] > ends[:-1], True]  # no later end has a part from here
    todo = [(int(ends[e]) - e, int(ends[e]), int(e)) for e in np.flatnonzero(last & (np.arange(len(total)) - ends >= WIDTH))]  # by length, then start
    heapify(todo)
    out, tried, seen = [], set(), np.zeros(len(hits), bool)
    while todo:
        _, s, e = heappop(todo)
        if len(tried) >= TESTS and seen[s:e].any():
            edges = np.flatnonzero(np.diff(np.r_[False, ~seen[s:e], False].astype(np.int8)))
            for p, q in zip(edges[::2] + s, edges[1::2] + s):
                if q - p >= WIDTH:
                    heappush(todo, (int(p - q), int(p), int(q)))
            continue
        if (s, e) in tried or not new[s:e].any():
            continue
        tried.add((s, e))
        if total[e] - total[s] >= -1e-9 and (found := matched(x[low + s : low + e], y, max(ylow, low + s + d - WIDTH), min(yhigh, low + e + d + WIDTH), low + s + d, low + e + d)):
            out.append((low + s, low + e, *found))
            new[s:e], seen[s:e] = False, True
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, hits[s:e], False].astype(np.int8)))
        starts, stops = edges[::2] + s, edges[1::2] + s
        if not len(starts):
            continue
        if len(starts) == 1:  # all of it is shared: halves that overlap in WIDTH - 1
            cut = (e - s - WIDTH) // 2
            shorter = [(int(starts[0]), int(stops[0]))] if (s, e) != (starts[0], stops[0]) else [(s, e - cut - 1), (s + cut + 1, e)]
        elif len(tried) < TESTS:
            shorter = [(int(starts[0]), int(stops[-1])), (int(starts[1]), e), (s, int(stops[-2]))]
        else:
            k = int(np.argmax(starts[1:] - stops[:-1]))
            shorter = [(s, int(stops[k])), (int(starts[k + 1]), e)]
        if len(tried) >= TESTS:
            seen[s:e] = True
            shorter = [(p, q) for p, q in shorter if q - p >= WIDTH]
            for p, q in shorter:  # these alone may be tried inside
                seen[p:q] = False
        for p, q in shorter:
            if q - p >= WIDTH and (p, q) not in tried:
                heappush(todo, (p - q, p, q))
    return out


def places(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in ``among`` (sorted, not empty), and whether it does."""
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return at, among[at] == values


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def matched(part: np.ndarray, y: np.ndarray, ylow: int, yhigh: int, at: int, to: int) -> tuple[int, int] | None:
    """Bounds of the part of y[ylow:yhigh], or else of y[at:to], that holds the shared shingles, if its set is similar."""
    p = distinct(part)
    where, inside = places(y[ylow:yhigh], p)
    for low, high in dict.fromkeys([(ylow, yhigh), (max(ylow, at), min(yhigh, to))]):
        found = np.flatnonzero(inside[low - ylow : high - ylow])
        if len(found):
            t, u = low + int(found[0]), low + int(found[-1]) + 1
            if u - t >= WIDTH:
                some = inside[t - ylow : u - ylow]
                shared = np.count_nonzero(np.bincount(where[t - ylow : u - ylow][some], minlength=len(p)))
                if shared >= SIMILAR * (len(p) + len(distinct(y[t:u][~some]))):
                    return t, u
    return None


def repeats(h: np.ndarray, start: int, end: int, width: int) -> list[tuple[int, int]]:
    """All places in h with the runs of ``width`` shingles that stand in h[start:end]."""
    runs = run_hashes(h, width)
    at = np.flatnonzero(np.isin(runs, runs[start : end - width + 1]))
    cuts = np.flatnonzero(np.diff(at) > 1) + 1
    return [(int(p[0]), int(p[-1]) + width) for p in np.split(at, cuts)]


def pair_spans(a: int, b: int, x: np.ndarray, x_twice: bool, y: np.ndarray, y_twice: bool, anchors: list[tuple[int, int, int]]) -> set[tuple]:
    """doc_id, other, start, end, exact of the passages of two documents, from alignments (d, low, high), longest first.
    Alignments whose words on both sides lie in passages found before are left out; a passage that stands in its own
    document more than once is reported everywhere."""
    out, held = set(), (np.zeros(len(x), bool), np.zeros(len(y), bool))
    for d, low, high in sorted(anchors, key=lambda g: (g[1] - g[2], g)):
        if held[0][max(0, low) : high + 1].all() and held[1][max(0, low + d) : high + d + 1].all():
            continue
        runs = exact_runs(x, y, d, low, high)
        found = [(s, e, s + d, e + d, True) for s, e in runs] + [(*m, False) for m in similar_runs(x, y, d, low, high, runs)]
        for s, e, t, u, exact in found:
            for side, h, twice, own, other, p, q in ((0, x, x_twice, a, b, s, e), (1, y, y_twice, b, a, t, u)):
                if twice and held[side][p:q].all():
                    continue
                for p, q in repeats(h, p, q, WIDTH if exact else q - p) if twice else [(p, q)]:
                    out.add((own, other, p, q + SHINGLE - 1, exact))
                    held[side][p:q] = True
    return out


SPAN = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("other", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("exact", T.BooleanType())])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, other, start, end (words, end exclusive), exact: both sides of every verified passage."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = docs.select("doc_id", "text").join(maybe_broadcast(ids), "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")  # partners of one document come together

    def make(rows):
        known = {}  # shingles of a text, and whether one stands in it twice
        while some := list(islice(rows, 64)):
            texts = {(i, t) for a, b, _, ta, tb in some for i, t in ((a, ta), (b, tb))}
            known = {k: v for k, v in known.items() if k in texts}
            new = [k for k in texts if k not in known]
            for k, h in zip(new, hash_shingles([t for _, t in new], SHINGLE)):
                known[k] = h, len(np.unique(h)) < len(h)
            for a, b, anchors, ta, tb in some:
                yield from pair_spans(a, b, *known[a, ta], *known[b, tb], [(g["d"], g["low"], g["high"]) for g in anchors])

    return arrow_rows(both, ["a", "b", "anchors", "ta", "tb"], make, SPAN, rows=20_000)


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a document as one: doc_id, start_word, end_word, match_id (the smallest other document), exact (all of it)."""
    by_start = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = spans.groupBy("doc_id", "start", "end").agg(F.min("other").alias("other"), F.max("exact").alias("exact")).withColumn("part", group)
    return cut.groupBy("doc_id", "part").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other").alias("match_id"), F.min("exact").alias("exact")).drop("part")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, match_id, exact: every passage of at least WORDS words that another document has too."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.IntegerType()), T.StructField("digest", T.BinaryType())])

    def digests(rows):
        while some := list(islice(rows, 64)):
            for (doc_id, _), words in zip(some, hash_words([text for _, text in some])):
                yield doc_id, len(words), xxhash.xxh3_128_digest(words.tobytes()) if len(words) >= WORDS else None

    base = arrow_rows(docs, ["doc_id", "text"], digests, schema).groupBy("doc_id").agg(F.min_by("n_words", "digest").alias("n_words"), F.min("digest").alias("digest"))
    base = materialize(base, "texts")
    reps = base.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("doc_id").alias("last"))
    nodes = materialize(base.join(reps, "digest").select("doc_id", "n_words", "rep", "copies", "last"), "nodes")
    copies = materialize(nodes.where("rep <> doc_id").select("doc_id"), "copies")
    docs = docs.join(maybe_broadcast(copies), "doc_id", "left_anti")
    met = materialize(meetings(docs, base.count()), "meetings")
    long = materialize(long_rows(met.where("b is null"), docs), "long")
    exact = materialize(exact_classes(long.where("run").select("gid", "doc_id", "c")), "exact")
    near, marked = near_partners(long.where("not run").drop("run"), exact)
    pairs = materialize(pair_anchors(met.where("b is not null").select("a", "b", "d", "low", "high").unionByName(near.where("b is not null").drop("gid"))), "pairs")
    spans = verified(pairs, docs).unionByName(exact.select("doc_id", "other", F.col("low").alias("start"), (F.col("high") + WORDS).alias("end"), F.lit(True).alias("exact")))
    spans = materialize(spans, "spans")
    release(met, long)
    own = materialize(merged(spans), "merged")
    rest = rest_partners(marked, near, own)
    if rest is not None:
        rest = materialize(pair_anchors(rest), "rest-pairs")
        own = materialize(merged(spans.unionByName(verified(rest, docs))), "merged-rest")
    own = own.select(F.col("doc_id").alias("rep"), F.col("match_id").alias("other"), F.col("start_word").alias("start"), F.col("end_word").alias("end"), "exact")
    inherited = nodes.select("doc_id", "rep").join(own, "rep").select("doc_id", "other", "start", "end", "exact")
    copied = nodes.where("copies > 1").select("doc_id", F.when(F.col("doc_id") == F.col("rep"), F.col("last")).otherwise(F.col("rep")).alias("other"), F.lit(0).alias("start"), F.col("n_words").alias("end"), F.lit(True).alias("exact"))
    return merged(inherited.unionByName(copied))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the repeated passages of all documents."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
