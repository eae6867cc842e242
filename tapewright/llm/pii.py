r"""Operator 3, personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

All of it is Spark SQL. Offsets come from two passes of one pattern: ``split`` gives the pieces between matches and
``regexp_extract_all`` the matches, so a running sum of their lengths (in code points) places every match.

The patterns give the leftmost non-overlapping matches of the plain ones in ``BASE`` and stay linear on long runs:
possessive repeats never give characters back, and ``(?<![class])|\G`` skips starts inside a run that would fail as its
first character did. Null text is empty and has no spans; rows are kept one to one, repeated ids included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The plain patterns, fixed values, in order of kinds.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Lengths of IBANs by country. Fixed values of the registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "PT", 26: "IS|TR", 27: "FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|PL|SV", 29: "BR|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC", 32: "LC",
}
LINEAR = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": "(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{countries})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, countries in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
#: Cheap tests that any match with a chance must pass.
TRIGGERS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}[\x20]?[A-Z0-9]", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}"}
#: Score of a confirmed match without context, and what words within ``WINDOW`` code points add or take.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
WORDS = {
    "email": "mail|contact|address",
    "ip": "ip|host|server|client|address",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax|contact",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security|taxpayer",
}
AGAINST = "version|order|invoice|serial|isbn|sku|part"
WINDOW = 40
THRESHOLD = 0.6
ADDED = ("iban", "ssn")


def matches(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<start, end, found>> of all matches of ``pattern``, in code points, end exclusive."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    lengths = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(F.length(p).alias("gap"), m.alias("found")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("spans"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["found"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("found")))).alias("spans"))

    return F.aggregate(lengths, start, step, lambda acc: acc["spans"])


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a correct Luhn check digit."""
    back = F.reverse(number)

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN (without spaces) leaves 1 by 97, its first four characters moved to the end and letters as 10 to 35."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def add(rest, c):
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def holds(kind: str, m: Column) -> Column:
    """The validator of a kind, over the matched string."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).isin(0, 1, 2) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))
    if kind == "card":
        return F.when(F.length(digits(m)).between(13, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    return F.lit(True)


def score(text: Column, kind: str, span: Column) -> Column:
    """The kind's prior, 0.3 more with a word for it nearby, 0.2 less with a word against it."""
    begin = F.greatest(span["start"] - WINDOW, F.lit(0))
    near = F.lower(F.concat_ws(" ", F.substring(text, begin + 1, span["start"] - begin), F.substring(text, span["end"] + 1, F.lit(WINDOW))))
    return F.round(F.lit(PRIOR[kind]) + F.when(near.rlike(rf"\b(?:{WORDS[kind]})\b"), 0.3).otherwise(0.0) - F.when(near.rlike(rf"\b(?:{AGAINST})\b"), 0.2).otherwise(0.0), 2)


def spans_of(text: Column, kind: str) -> Column:
    """ARRAY<STRUCT<kind, start, end, score>> of the confirmed spans of one kind, by start."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    may = text.contains("@") if kind == "email" else text.rlike(TRIGGERS[kind])
    kept = F.filter(matches(text, LINEAR[kind]), lambda m: holds(kind, m["found"]))
    scored = F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), score(text, kind, m).alias("score")))
    if kind in ADDED:
        scored = F.filter(scored, lambda s: s["score"] >= THRESHOLD)
    return F.when(may, scored).otherwise(none)


def find_personal_data(df: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``df`` and ``out``: a STRUCT of one span array for each kind. Base kinds keep every confirmed match, whatever its
    score; the added kinds only those whose score reaches ``THRESHOLD``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn(out, F.struct(*(spans_of(text, k).alias(k) for k in LINEAR)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: counts, digest and list of the spans of every whole document, and their scores in the order of the list."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "pii")
    base = F.concat(*(F.col(f"pii.{k}") for k in BASE))
    every = F.concat(base, *(F.col(f"pii.{k}") for k in ADDED))
    return found.select(
        "doc_id",
        *(F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.array_join(F.transform(every, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
