"""Operator 8, BPE encoding and decoding by speculation and verification.

A word's tokens are proposed by greedy longest match. A sequence is what the merges give exactly when every adjacent
pair of it is compatible, that is, when merging the two tokens' joined text gives these two tokens again. That test runs
for all pairs of all new words of a batch at once: along the right edge of the left token's merge tree and the left edge
of the right token's, it looks for a merge across the border that would have come before one that the tokens needed.
Only words with an incompatible pair are merged exactly, by a queue in O(n log n).

Vocabulary rules of the file that is read: lower case, NFC, words end in ``</w>``, merges in rank order; decoding joins
token strings with spaces, as the file declares no decoder. Null text is empty text and gives no tokens. Strings of the
special tokens in a text give those tokens.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tapewright.llm.common import arrow_rows

END = "</w>"
#: Blocks in which all Unicode versions of the last twenty years agree, as code point ranges.
COMMON = ((0, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3CE), (0x410, 0x44F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
UNCOMMON = re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in COMMON) + "]")


def _common_pattern() -> re.Pattern:
    """The split pattern for texts of COMMON letters only, by explicit classes (no contraction begins with a letter)."""

    def runs(kind: str) -> str:
        points = [c for a, b in COMMON for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == kind]
        cuts = [i for i in range(1, len(points)) if points[i] != points[i - 1] + 1]
        return "".join(f"\\U{points[i]:08x}-\\U{points[j - 1]:08x}" for i, j in zip([0, *cuts], [*cuts, len(points)]))

    space = "".join(f"\\U{c:08x}" for c in (*range(9, 14), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
    letter, number = runs("L"), runs("N")
    return re.compile(f"[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d|[{number}]|[^{space}{letter}{number}]+")


PATTERN = _common_pattern()
NEVER = np.int64(1) << 40
LAST = 1 << 40
#: Letters up to which scanning for the lowest rank beats a queue.
SHORT = 64


def byte_letters() -> list[str]:
    """The printable stand-in for each byte: itself where it is printable Latin-1, else the next code point from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, cache_words: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special: dict[str, int] = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.names: dict[int, str] = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.letters = byte_letters()
        self.bytes_of = {c: i for i, c in enumerate(self.letters)}
        spans: dict[str, set[int]] = {}
        for t in self.vocab:
            if len(t) > 2:
                spans.setdefault(t[:3], {1, 2}).add(len(t))
        self.spans = {k: tuple(sorted(v, reverse=True)) for k, v in spans.items()}
        size = max(self.names) + 1
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.born = np.full(size, -1, np.int64)  # the rank of the merge that makes a token; -1: a single letter
        ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            ranks.setdefault((i, j), (rank, k))
            if self.born[k] < 0:
                self.left[k], self.right[k], self.born[k] = i, j, rank
        self.ranks = ranks
        self.rank = {p: r for p, (r, _) in ranks.items()}
        self.result = {r: t for r, t in ranks.values()}
        keys = np.array([i * size + j for i, j in ranks], np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.key_ranks = size, keys[order], np.array([r for r, _ in ranks.values()], np.int64)[order]
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.sound = np.ones(size, bool)  # tokens that the merges give back from their own text
        made = np.flatnonzero(self.born >= 0)
        whole = self.compatible(self.left[made], self.right[made], self.born[made])
        for i, fine in sorted(zip(made.tolist(), whole.tolist()), key=lambda x: self.born[x[0]]):
            self.sound[i] = fine and self.sound[self.left[i]] and self.sound[self.right[i]]
        self.library = Tokenizer.from_file(path)

    def spell(self, word: str) -> str:
        """A word in the vocabulary's letters, with the end mark. Printable ASCII stands for itself."""
        if word.isascii() and word.isprintable():
            return word + END
        return "".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass"))) + END

    def symbols(self, spelled: str) -> list[int]:
        """The single-letter tokens of a spelled word or token, the end mark joined to the last letter."""
        body = spelled.removesuffix(END)
        if body == spelled:
            return [self.vocab[c] for c in spelled]
        return [self.vocab[c] for c in body[:-1]] + [self.vocab[body[-1] + END]]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the lowest rank first, of equal ranks the leftmost. Long words use a queue."""
        ids, n = list(ids), len(ids)
        if n <= SHORT:
            rank, result = self.rank, self.result
            near = [rank.get(p, LAST) for p in zip(ids, ids[1:])]
            while near and (low := min(near)) < LAST:
                i = near.index(low)
                ids[i : i + 2] = [result[low]]
                del near[i]
                if i:
                    near[i - 1] = rank.get((ids[i - 1], ids[i]), LAST)
                if i < len(near):
                    near[i] = rank.get((ids[i], ids[i + 1]), LAST)
            return ids
        ahead, behind, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(self.ranks[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.ranks]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = ahead[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = self.ranks[a, b][1], False
            ahead[i] = ahead[j]
            if ahead[i] < n:
                behind[ahead[i]] = i
            for x, y in ((behind[i], i), (i, ahead[i])):
                if x >= 0 and y < n and (p := (ids[x], ids[y])) in self.ranks:
                    heapq.heappush(queue, (self.ranks[p][0], x, *p))
        return [t for t, live in zip(ids, alive) if live]

    def propose(self, spelled: str) -> list[int]:
        """Greedy longest match from the left, over the token lengths that the next three characters allow."""
        out, at, n, vocab, spans = [], 0, len(spelled), self.vocab, self.spans
        mark = n - len(END)  # no token ends from here to n: the end mark stays with the last letter
        while at < n:
            for size in spans.get(spelled[at : at + 3], (2, 1)):
                if ((end := at + size) < mark or end == n) and (t := vocab.get(spelled[at:end])) is not None:
                    out.append(t)
                    at = end
                    break
            else:
                raise KeyError(spelled[at:])
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging each pair; NEVER where no merge joins it."""
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.key_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair stands as it is (or, with ``until``, stands up to the merge of that rank).

        Going back in time, the token made later is taken apart first (of equal ranks, the right one, as merges go from
        the left), and the merge of what then meets at the border must not have come before that undone merge.
        """
        a, b = a.copy(), b.copy()
        good = self.sound[a] & self.sound[b]
        limit, on_tie = np.full(len(a), NEVER) if until is None else until.copy(), np.zeros(len(a), bool)
        live = np.flatnonzero(good)
        while len(live):
            x, y = a[live], b[live]
            rank = self.rank_of(x, y)
            lim = limit[live]
            bad = (rank < lim) | ((rank == lim) & on_tie[live])
            good[live[bad]] = False
            bx, by = self.born[x], self.born[y]
            take_left = bx > by
            done = bad | ((bx < 0) & (by < 0))
            limit[live] = np.where(take_left, bx, by)
            on_tie[live] = ~take_left
            a[live] = np.where(take_left, self.right[x], x)
            b[live] = np.where(take_left, y, self.left[y])
            live = live[~done]
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each pre-split word (in the file's lower-case form)."""
        spelled = [self.spell(w) for w in words]
        proposals = [self.propose(s) for s in spelled]
        flat = np.fromiter((t for p in proposals for t in p), np.int64)
        which = np.repeat(np.arange(len(words)), [len(p) for p in proposals])
        inner = np.flatnonzero(which[1:] == which[:-1])
        good = self.compatible(flat[inner], flat[inner + 1])
        failed = set(which[inner[~good]].tolist()) | set(which[~self.sound[flat]].tolist())
        for i in failed:
            proposals[i] = self.merge(self.symbols(spelled[i]))
        self.failures = len(failed)
        return proposals

    def pieces(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens.

        Letters outside COMMON are classed differently by different Unicode versions, so such texts are split by the
        library that defines the result.
        """
        if UNCOMMON.search(text):
            split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.bytes_of.__getitem__, w)).decode("utf-8") for w, _ in split]
        text = unicodedata.normalize("NFC", text)
        low = text.lower() if text.isascii() or "Σ" not in text else text.replace("Σ", "σ").lower()
        return PATTERN.findall(low)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > self.cache_words:
            self.cache.clear()
            new = list(words)
        if new:
            for w, ids in zip(new, self.encode_words(new), strict=True):
                self.cache[w] = struct.pack(f"<{len(ids)}I", *ids)

    def parts(self, text: str) -> list[list[str] | int]:
        """A text as runs of words and special tokens' ids."""
        out, at = [], 0
        marks = [(m.start(), m.end()) for m in self.split_special.finditer(text)] if self.split_special and "<|" in text else []
        for start, end in [*marks, (len(text), len(text))]:
            if start > at:
                out.append(self.pieces(text[at:start]))
            if end > start:
                out.append(self.special[text[start:end]])
            at = end
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers; all new words are verified together."""
        split = [self.parts(t or "") for t in texts]
        self.learn({w for parts in split for p in parts if not isinstance(p, int) for w in p})
        get = self.cache.__getitem__
        return [b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in parts) for parts in split]

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, Bpe] = {}
_names: dict[str, dict[int, str]] = {}


def names(path: str) -> dict[int, str]:
    """Token strings by id: all that decoding needs."""
    if path not in _names:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _names[path] = {i: s for s, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
    return _names[path]


def load(path: str) -> Bpe:
    """One encoder for each vocabulary file and worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_column(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ids (BINARY: little-endian unsigned 32-bit). vocabulary: path of the file on every node."""

    def make(rows):
        bpe = load(vocabulary)
        while some := list(islice(rows, 64)):
            yield from zip((key for key, _ in some), bpe.encode_batch([text for _, text in some]))

    return arrow_rows(df, [id_col, text_col], make, T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.BinaryType())]))


def decode_column(df: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ids and decoded: the text that the ids stand for."""

    def make(rows):
        spelled = names(vocabulary)
        for key, ids in rows:
            yield key, ids, " ".join(map(spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    return arrow_rows(df, [id_col, "ids"], make, T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]))


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ids and decoded in one pass: what ``encode_column`` and ``decode_column`` give one after the other."""

    def make(rows):
        bpe = load(vocabulary)
        while some := list(islice(rows, 64)):
            for (key, _), ids in zip(some, bpe.encode_batch([text for _, text in some])):
                yield key, ids, bpe.decode(ids)

    return arrow_rows(df, [id_col, text_col], make, T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]))


def digest_columns(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    back = round_trip(docs, vocabulary)
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every whole document encoded and decoded."""
    return digest_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())

