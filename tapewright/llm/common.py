"""Helpers shared by the training-data operators: shared storage, Arrow row maps, hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIR: list[str] = []

#: Rows of an id table that may be broadcast (8 bytes each); beyond it joins shuffle.
BROADCAST_IDS = 1_000_000


#: Bytes of a Parquet row group that a writer holds before it goes to disk.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Where that is unset: one in the warehouse folder, or,
    if all runs on this machine, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not (spark.conf.get("spark.master", "") or "").split("[")[0] == "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tapewright"
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="tapewright-"))
    return _OWN_DIR[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    back = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
    back._tapewright_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_tapewright_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def maybe_broadcast(ids: DataFrame) -> DataFrame:
    """``ids`` (a materialised table of one or two longs a row), with a broadcast hint where its counted rows are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to 16 MB, so that long texts don't add up in a Python worker. The setting stays:
    plans read it when they run, which is after the operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def trim() -> None:
    """Give freed memory back to the system. Workers are kept for later tasks, beside those of other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with its memory given back at the end of every task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def arrow_rows(df: DataFrame, inputs: list[str], make: Callable[[Iterator[tuple]], Iterator[tuple]], schema: T.StructType, rows: int = 2000, nbytes: int = 32 << 20) -> DataFrame:
    """Map rows through ``make``, a generator over tuples of ``inputs``.

    Output is sent in batches of at most ``rows`` rows or about ``nbytes`` bytes of strings and binaries.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples():
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    part = b.slice(at, 500)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held: list[tuple] = []
        size = 0
        for row in make(tuples()):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
            if len(held) >= rows or size >= nbytes:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out, strict=True)], schema=out)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out, strict=True)], schema=out)

    return df.select(*inputs).mapInArrow(trimmed(run), schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Characters between words, and a random number for each byte.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
ODD = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once; one word or one text may be longer.
PIECE = 1 << 18
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ODD and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, odd in enumerate((ODD, pow(ODD, -1, 1 << 64))):
            _POWERS[k] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n + PIECE, odd, np.uint64)])
    return _POWERS[0][:n], _POWERS[1][:n]


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of ``data``, which begins and ends with a space: a polynomial of its bytes, divided by the
    power of its place."""
    b = np.frombuffer(data, np.uint8)
    up, down = powers(len(b))
    space = SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    total = np.cumsum(BYTES[b] * up, dtype=np.uint64)
    return start, mix64((total[end - 1] - total[start - 1]) * down[start])


def hash_words(texts: list[str | None]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text: what stands between ASCII white space, A-Z in lower case; other letters stay
    as they are. Texts are hashed together, long ones in pieces cut between words."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held, ids, size = [], [], 0

    def flush():
        start, h = _hash_piece(b"\n" + b"\n".join(held) + b"\n")
        at = np.searchsorted(start, np.cumsum([1] + [len(x) + 1 for x in held]))
        for k, i in enumerate(ids):
            out[i].append(h[at[k] : at[k + 1]])

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        while data:
            cut = len(data)
            if cut > PIECE:
                cut = next((k for k in range(PIECE, 0, -1) if SPACE[data[k - 1]]), None) or next((k for k in range(PIECE, len(data)) if SPACE[data[k]]), len(data))
            held.append(data[:cut]), ids.append(i)
            size += cut
            data = data[cut:]
            if size >= PIECE:
                flush()
                held, ids, size = [], [], 0
    if held:
        flush()
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.empty(0, np.uint64) for x in out]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the ``k``-word shingles of a sequence of word hashes, in order; with fewer words, of the whole
    sequence; none without words."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    acc = np.full(n, (k * 0x9E3779B97F4A7C15) & (2**64 - 1), np.uint64)
    for j in range(k):
        acc = mix64(acc + h[j : j + n])
    return acc


def hash_shingles(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The shingles of each text, hashed together."""
    words = hash_words(texts)
    if not words:
        return []
    every = shingles(np.concatenate(words), k)
    begin = np.cumsum([0] + [len(w) for w in words])
    return [every[at : at + len(w) - k + 1] if len(w) >= k else shingles(w, k) for at, w in zip(begin, words)]


def text_shingles(text: str | None, k: int) -> np.ndarray:
    return shingles(hash_words([text])[0], k)
