"""Operator 1, secret scans by grammar inference.

Labelled credentials of public formats are written by a seeded generator (``PER_FORMAT`` of each, a fixed bound). Each
format's prefix tree is folded into a probabilistic automaton: two states are merged when the frequencies of their ends
and next symbols agree within Hoeffding's bound, recursively. The first ``LITERAL`` characters are symbols of their own,
so that prefixes are learned, and their states are merged with states of the same depth only; later characters are
classes. A state's ends and steps sum to one: a share of each is spread evenly over all symbols, and a symbol that was
never seen leads to a state where all are alike. A background automaton is learned in the same way from labelled plain
words. Every candidate string of a text is scored by each format's likelihood against the background, per character;
those over the threshold are spans of the format's kind. The base spans, found by their patterns, always stay.

Null text is empty; repeated rows are scanned alike; texts are scanned whole. Ids may be null.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.common import arrow_rows

ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: What of a base span is scored: all that stands in no other alphabet, up to its end.
TAIL = re.compile(r"[A-Za-z0-9+/_.=-]+$")
#: A word around a span, of which no part is left when the span is taken out.
AROUND = re.compile(r"[A-Za-z0-9_]*")
#: Characters of a candidate at least, and marks that may stand between a credential and its surroundings.
SHORTEST = 16
MARKS = "=/.-"
BASE_KINDS = ("assign", "access", "hex")
#: Labelled credentials of each format, and plain words.
PER_FORMAT = 1500
WORDS = 6000
ALPHA = 0.5
#: Strings that must reach both states for their frequencies to be compared.
EVIDENCE = 10
#: Log-likelihood gain over the background, in nats a character, that makes a candidate a secret.
GAIN = 0.3
#: Share of a state's probability that is spread evenly over all symbols: small for formats, larger for the background, which must be broad.
SPREAD, SPREAD_PLAIN = 1e-3, 0.02

#: Leading characters of a credential that are symbols of their own. Later ones, and all of plain words, are classes; each
#: mark stays itself. A class's probability is shared evenly by its letters, so that likelihoods of both compare.
LITERAL = 6
LETTERS = string.ascii_letters + string.digits + "+/_.=-"
CODE_CLASSES = ("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", string.digits, *"+/_.=-")
WORD_CLASSES = ("aeiou", "cdhlmnrst", "bfgjkpqvwxyz", "AEIOU", "CDHLMNRST", "BFGJKPQVWXYZ", string.digits, *"+/_.=-")


def credentials(kind: str, n: int, seed: int = 5) -> list[str]:
    """``n`` labelled credentials of a public format."""
    rng = random.Random(f"{kind}:{seed}")
    alnum, hexa, url = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "_-"
    some = lambda a, k: "".join(rng.choices(a, k=k))
    make = {
        "github": lambda: f"gh{rng.choice('pousr')}_{some(alnum, 36)}",
        "slack": lambda: f"xox{rng.choice('bap')}-{some(string.digits, 12)}-{some(string.digits, 12)}-{some(alnum, 24)}",
        "stripe": lambda: f"{rng.choice(['sk', 'rk'])}_live_{some(alnum, 24)}",
        "google": lambda: f"AIza{some(url, 35)}",
        "jwt": lambda: f"eyJ{some(url, 33)}.eyJ{some(url, 60)}.{some(url, 43)}",
        "base64": lambda: some(string.ascii_letters + string.digits + "+/", 40),
        "uuid": lambda: "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)),
    }[kind]
    return [make() for _ in range(n)]


FORMATS = ("github", "slack", "stripe", "google", "jwt", "base64", "uuid")
KINDS = (*BASE_KINDS, *FORMATS)


def plain_words(n: int, seed: int = 5) -> list[str]:
    """Labelled non-secrets as long as candidates: run-together words, capitals, addresses, paths, file and class names, dates, numbers."""
    rng = random.Random(f"plain:{seed}")
    parts = ["er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "the", "ing", "tion", "ch", "ck", "x", "k", "p", "m", "b", "gr", "wh", "ly", "qu", "j", "v", "w", "z", "f", "c", "d", "g", "u", "y"]
    word = lambda k: "".join(rng.choices(parts, k=k))
    some = lambda sep, low, high, k=4: sep.join(word(rng.randint(1, k)) for _ in range(rng.randint(low, high)))
    date = lambda sep="-": f"{rng.randint(1990, 2030)}{sep}{rng.randint(1, 12):02d}{sep}{rng.randint(1, 28):02d}"
    ending = lambda: rng.choice(["html", "png", "json", "jpg", "txt", "py", "tar.gz", "pdf", "css"])
    host = lambda: f"{rng.choice(['www.', '', 'en.', 'api.', 'cdn.'])}{word(3)}.{rng.choice(['com', 'org', 'net', 'co.uk', 'de'])}"
    camel = lambda low, high: "".join(word(rng.randint(1, 3)).capitalize() for _ in range(rng.randint(low, high)))
    shapes = [
        lambda: word(rng.randint(6, 16)),
        lambda: word(rng.randint(6, 16)).upper(),
        lambda: word(rng.randint(6, 12)).capitalize() + ".",
        lambda: some("/", 3, 8),
        lambda: some("-", 3, 8),
        lambda: some("_", 3, 8),
        lambda: some("_", 3, 8).upper(),
        lambda: some(".", 3, 8),
        lambda: camel(3, 7),
        lambda: word(2) + camel(2, 6),
        lambda: f"{some('.', 2, 4, 2)}.{camel(2, 4)}",
        lambda: "".join(rng.choices(string.digits, k=rng.randint(16, 30))),
        lambda: rng.choice("=-._") * rng.randint(16, 60),
        lambda: rng.choice("=-") * rng.randint(3, 30) + word(rng.randint(3, 8)) + rng.choice("=-") * rng.randint(3, 30),
        lambda: f"{some('/', 1, 4, 3)}/{word(4)}{rng.choice('_-')}{rng.randint(1, 9999)}.{ending()}",
        lambda: f"{rng.choice(['https', 'http', ''])}//{host()}/{some('/', 1, 3)}",
        lambda: f"//{host()}/{date('/')}/{some('-', 3, 8)}.{ending()}",
        lambda: f"{rng.choice(['https', ''])}//{host()}/{date('/')}/{some('-', 2, 6)}",
        lambda: f"//{host()}/{word(2)}/{rng.randint(100, 99999999)}/{some('_', 2, 5).title()}",
        lambda: f"/{word(1)}/{word(2)}/{word(2)}-{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}/{some('/', 1, 3)}.{ending()}",
        lambda: f"{date()}T{rng.randint(0, 23):02d}-{rng.randint(0, 59):02d}-{rng.randint(0, 59):02d}.{rng.randint(0, 999)}",
        lambda: f"{rng.choice(['IMG', 'DSC', 'VID'])}_{date('')}_{rng.randint(0, 235959):06d}.{ending()}",
        lambda: f"{word(rng.randint(1, 4))}-{rng.randint(0, 99)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}-{word(rng.randint(1, 4))}",
        lambda: f"{word(2)}.{word(2)}_{word(1)}-{word(1)}.{word(1)}.{word(1)}",
    ]
    return [rng.choice(shapes)() for _ in range(n)]


class Automaton:
    """A probabilistic automaton folded from the prefix tree of a sample.

    ``steps[q]``: symbol -> (log probability of one of its characters, next state); ``ends[q]``: log probability of the end.
    State 0 is the first; the two last are where symbols go that a state has never seen, inside the literal prefix and after
    it. There all characters are alike, or, with ``common``, as frequent as in the sample.
    """

    def __init__(self, sample: list[str], classes: tuple[str, ...], literal: int, spread: float, common: bool = False, alpha: float = ALPHA):
        self.literal = literal
        self.fold_class = str.maketrans({c: chr(k + 1) for k, letters in enumerate(classes) for c in letters})
        self.reach, self.stop, self.next, self.flow, self.depth = [0], [0], [{}], [{}], [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        sizes = [dict.fromkeys(LETTERS, 1), {chr(k + 1): len(letters) for k, letters in enumerate(classes)}]
        coded = [self.symbols(s) for s in sample]
        for s in coded:
            self._add(s)
        kept = self._fold()
        name, lost = {q: k for k, q in enumerate(kept)}, [len(kept), len(kept) + 1]
        every = len(LETTERS) + 1  # the end is one more
        self.states, self.steps, self.ends = len(kept), [], []
        for q in kept:
            late, n = self.depth[q] >= literal, self.reach[q]
            away = lost[self.depth[q] + 1 >= literal]
            self.steps.append({a: (math.log((1 - spread) * self.flow[q].get(a, 0) / n / size + spread / every), name[self.next[q][a]] if a in self.next[q] else away) for a, size in sizes[late].items()})
            self.ends.append(math.log((1 - spread) * self.stop[q] / n + spread / every))
        seen = Counter(a for s in coded for a in s[literal:]) if common else {}
        n = sum(seen.values()) + len(sample)
        for late in (0, 1):
            share = {a: (1 - spread) * seen[a] / n / size + spread / every if common and late else 1 / every for a, size in sizes[late].items()}
            self.steps.append({a: (math.log(share[a]), lost[1]) for a in share} if late else {a: (math.log(1 / every), lost[late]) for a in sizes[0]})
            self.ends.append(math.log((1 - spread) * len(sample) / n + spread / every if common else 1 / every))
        del self.reach, self.stop, self.next, self.flow, self.depth

    def symbols(self, s: str) -> str:
        return s[: self.literal] + s[self.literal :].translate(self.fold_class)

    def _add(self, s: str) -> None:
        q = 0
        self.reach[0] += 1
        for a in s:
            if a not in self.next[q]:
                self.next[q][a] = len(self.reach)
                self.reach.append(0), self.stop.append(0), self.next.append({}), self.flow.append({}), self.depth.append(min(self.depth[q] + 1, self.literal))
            self.flow[q][a] = self.flow[q].get(a, 0) + 1
            q = self.next[q][a]
            self.reach[q] += 1
        self.stop[q] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, p: int, q: int) -> bool:
        if self.depth[p] != self.depth[q]:
            return False
        todo, seen = [(p, q)], set()
        while todo:
            p, q = pair = todo.pop()
            if pair in seen:
                continue
            seen.add(pair)
            if self._differ(self.stop[p], self.reach[p], self.stop[q], self.reach[q]):
                return False
            for a in self.next[p].keys() | self.next[q].keys():
                if self._differ(self.flow[p].get(a, 0), self.reach[p], self.flow[q].get(a, 0), self.reach[q]):
                    return False
                if a in self.next[p] and a in self.next[q] and min(self.reach[self.next[p][a]], self.reach[self.next[q][a]]) >= EVIDENCE:
                    todo.append((self.next[p][a], self.next[q][a]))
        return True

    def _merge(self, p: int, q: int) -> None:
        """Fold the tree below ``q`` into the automaton from ``p``."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.reach[p] += self.reach[q]
            self.stop[p] += self.stop[q]
            for a, child in self.next[q].items():
                self.flow[p][a] = self.flow[p].get(a, 0) + self.flow[q][a]
                if a in self.next[p]:
                    todo.append((self.next[p][a], child))
                else:
                    self.next[p][a] = child

    def _fold(self) -> list[int]:
        """The states that are left. Children reached most often come first, so that rare ones join what is well known."""
        red, kept = [0], {0}
        while blue := max(((self.flow[q][a], -q, a) for q in red for a, child in self.next[q].items() if child not in kept), default=None):
            q, a = -blue[1], blue[2]
            child = self.next[q][a]
            for r in red:
                if self._compatible(r, child):
                    self.next[q][a] = r
                    self._merge(r, child)
                    break
            else:
                red.append(child)
                kept.add(child)
        return red

    def log_likelihood(self, s: str) -> float:
        q, total, steps, early = 0, 0.0, self.steps, self.literal
        for k, a in enumerate(self.symbols(s), 1):
            step, q = steps[q][a]
            total += step
            if k == early and q == self.states:  # the literal prefix is over
                q += 1
        return total + self.ends[q]


@lru_cache(maxsize=1)
def learned() -> tuple[dict[str, Automaton], Automaton]:
    """The automaton of each format, and the background's."""
    return {k: Automaton(credentials(k, PER_FORMAT), CODE_CLASSES, LITERAL, SPREAD) for k in FORMATS}, Automaton(plain_words(WORDS), WORD_CLASSES, 0, SPREAD_PLAIN, common=True)


def classify(candidate: str, models) -> tuple[str, float]:
    """The likeliest format of a candidate and its gain over the background, in nats a character."""
    formats, background = models
    best, top = max(((k, a.log_likelihood(candidate)) for k, a in formats.items()), key=lambda x: x[1])
    return best, (top - background.log_likelihood(candidate)) / max(1, len(candidate))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by start, then kind as listed."""
    low = text.lower()  # at least the letters that the patterns fold
    out = []
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0]), s[2]))


def secret_pieces(text: str, start: int, end: int, base: list[tuple[str, int, int]], models, marks: str = MARKS) -> list[tuple[str, int, int, float]]:
    """The secrets of text[start:end]: all of it if it passes, with or without the marks at its ends; else those of its pieces
    around base spans, then of its pieces between each mark in turn. What a base span covers whole adds nothing."""
    whole = start, end
    while start < end and text[start] in MARKS:
        start += 1
    while start < end and text[end - 1] in MARKS:
        end -= 1
    if whole[1] - whole[0] < SHORTEST or any(a <= start and end <= b for _, a, b in base):
        return []
    for a, b in dict.fromkeys([whole, (start, end)]):
        if b - a >= SHORTEST:
            kind, gain = classify(text[a:b], models)
            if gain >= GAIN:
                return [(kind, a, b, round(gain, 6))]
    inside = [(a, b) for _, a, b in base if a < end and start < b]
    if inside:
        pieces, at = [], start
        for a, b in inside:
            pieces.append((at, a))
            at = max(at, b)
        pieces.append((at, end))
    else:
        while marks and text.find(marks[0], start, end) < 0:
            marks = marks[1:]
        if not marks:
            return []
        cuts = [start - 1, *(k for k in range(start, end) if text[k] == marks[0]), end]
        pieces, marks = [(a + 1, b) for a, b in zip(cuts, cuts[1:])], marks[1:]
    return [s for a, b in pieces for s in secret_pieces(text, a, b, base, models, marks)]


def scan(text: str, models) -> list[tuple[str, int, int, float]]:
    """All spans by start, then kind as listed, each with its gain. Base spans are scored too and stay whatever their
    gain; every other candidate is scored, and where it fails, its pieces."""
    base = base_spans(text)
    spans = [(*s, round(classify(TAIL.search(text, s[1], s[2])[0], models)[1], 6)) for s in base]
    for m in CANDIDATE.finditer(text):
        spans += secret_pieces(text, m.start(), m.end(), [s for s in base if s[1] < m.end() and m.start() < s[2]], models)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("gain", T.DoubleType())]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and spans of every row; offsets in code points, end exclusive."""
    models = learned()

    def make(rows):
        for key, text in rows:
            yield key, [dict(zip(("kind", "start", "end", "gain"), s)) for s in scan(text or "", models)]

    return arrow_rows(df, [id_col, text_col], make, T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("spans", SPANS)]))


def redact_text(text: str, models) -> str:
    """The text with every secret's characters replaced by a mark; overlapping spans become one mark. A span that stands
    inside a longer word takes all of it, as base patterns may match a part of a token."""
    spans, out, at = scan(text, models), [], 0
    for _, start, end, _ in spans:
        if end <= at:
            continue
        end = AROUND.match(text, end).end()
        while start > at and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] == "_"):
            start -= 1
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets replaced; n_chars, where present, follows the new text. Null texts stay null."""
    names, models = docs.columns, learned()

    def make(rows):
        at = names.index(text_col)
        for row in rows:
            yield (*row[:at], None if row[at] is None else redact_text(row[at], models), *row[at + 1 :])

    out = arrow_rows(docs, names, make, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
    return out.withColumn("n_chars", F.length(text_col).cast(out.schema["n_chars"].dataType)) if "n_chars" in names else out


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: counts, digest and list of the secrets of every whole document."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(of(*BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
