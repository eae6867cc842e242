"""Operator 7, WARC: a normaliser of monolithic gzip archives.

``write_archives`` makes archives as they are often found: many records in one gzip stream, so that no record can be
reached without inflating all before it. ``normalise`` inflates each stream once, in pieces, and rewrites every record
as a gzip member of its own; an archive's members are stored as rows of about ``CHUNK`` bytes of whole members with their
offset in it. ``sidecar`` is the offset index, a table of its own with a row a record: archive, offset, length, page_id,
record_type. ``read_ranges`` takes chosen records out by the sidecar, reading only the rows that hold them;
``read_members`` reads everything. Archives and sidecars are tables in the shared folder, so they work in any store that
Spark writes; an archive's size is bounded by ``ARCHIVE_BYTES`` of records, plus one record.

Payloads meet by their digests alone; where the digests that occur more than once are at most ``BROADCAST_DIGESTS``, counted,
they are sent to every task and pages are not moved at all.

Null html is an empty payload. Rows with equal ids are records of their own: all rows with the largest id of a payload are
responses. An id may be null: it orders before all others, so null ids alone with a payload are all responses. Extra
columns are not read. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.common import arrow_rows, materialize, release

ARCHIVE_BYTES = 8 << 20
LEVEL = 1
#: Bytes that are inflated at once, and of a row of members.
CHUNK = 1 << 20
#: Repeated digests (about 50 bytes each) that may be sent to every task. Beyond it pages are shuffled by digest and salt,
#: a salt for every ``PAGES_A_SALT`` pages of the commonest payload.
BROADCAST_DIGESTS = 500_000
PAGES_A_SALT = 10_000
HEAD_END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1, as in WARC-Payload-Digest without its prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, sum32: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A response holds the payload; a revisit has its length and digest, and names its response."""
    uri = re.sub(r"[\r\n]", " ", url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sum32}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
        payload = b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + HEAD_END + payload + HEAD_END


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(HEAD_END)
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def id_of(field: str) -> int | None:
    at = field.removeprefix("<urn:page:").rstrip(">")
    return int(at) if at else None


def records_of(stream: bytes):
    """The records of a gzip stream (of one or several members), inflated once and cut as they become whole."""
    held, inflate, at = b"", zlib.decompressobj(31), 0
    todo = b""
    while at < len(stream) or todo:
        if not todo:
            todo, at = stream[at : at + CHUNK], at + CHUNK
        held += inflate.decompress(todo, CHUNK)
        todo = inflate.unconsumed_tail
        if inflate.eof:
            todo = inflate.unused_data + todo
            inflate = zlib.decompressobj(31)
        start = 0
        while (head := held.find(HEAD_END, start)) >= 0:
            size = int(re.search(rb"\r\nContent-Length: (\d+)", held[start : head + 2], re.I)[1])
            end = head + len(HEAD_END) + size + len(HEAD_END)
            if end > len(held):
                break
            yield held[start:end]
            start = end
        held = held[start:]
    if held.strip():
        raise ValueError("an archive that ends inside a record")


def typed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to: for each page the largest id of those with an equal payload, null for itself.

    A payload that occurs once needs no partner: the digest table has a row only for each that occurs more often.
    """
    pages = pages.select("page_id", "url", "html").withColumn("_sum", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    repeated = materialize(pages.groupBy("_sum").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1"), "digests")
    n, most = repeated.agg(F.count("*"), F.max("_n")).first()
    if n <= BROADCAST_DIGESTS:
        joined = pages.join(F.broadcast(repeated.drop("_n")), "_sum", "left")
    else:
        salts = -(-most // PAGES_A_SALT)
        salted = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / PAGES_A_SALT).cast("int") - 1))).drop("_n")
        few = repeated.select("_sum", F.ceil(F.col("_n") / PAGES_A_SALT).cast("int").alias("_salts")).where("_salts > 1")  # at most a row for every PAGES_A_SALT pages
        own = pages.withColumn("_all", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
        joined = own.join(F.broadcast(few), "_sum", "left").withColumn("_salt", F.coalesce(F.pmod("_all", "_salts"), F.lit(0))).join(salted, ["_sum", "_salt"], "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """archive, stream: monolithic gzip archives of all pages. Payloads shorter than ``min_payload`` are all responses."""

    def make(rows):
        deflate, parts, size, name = None, [], 0, None
        for page_id, url, html, refers_to in rows:
            payload = (html or "").encode("utf-8", "surrogatepass")
            if deflate is None:
                deflate, parts, size, name = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0, f"{digest(record_id(page_id).encode() + payload[:64])}.warc.gz"
            revisit = refers_to is not None and len(payload) >= min_payload
            record = warc_record(page_id, url, payload, digest(payload), "revisit" if revisit else "response", refers_to)
            parts.append(deflate.compress(record))
            size += len(record)
            if size >= ARCHIVE_BYTES:
                yield name, b"".join([*parts, deflate.flush()])
                deflate = None
        if deflate is not None:
            yield name, b"".join([*parts, deflate.flush()])

    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField("stream", T.BinaryType())])
    return arrow_rows(typed(pages), ["page_id", "url", "html", "refers_to"], make, schema, rows=1)


SPAN = T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType())])


def normalise(archives: DataFrame) -> DataFrame:
    """archive, start, members, index: each archive with every record as its own gzip member, in rows of about ``CHUNK``
    bytes that begin at ``start`` of the archive, and the offset, length, page_id and type of each member."""

    def make(rows):
        for name, stream in rows:
            parts, index, start, at = [], [], 0, 0
            for record in records_of(stream):
                fields, _ = parse_record(record)
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = squeeze.compress(record) + squeeze.flush()
                parts.append(member)
                index.append({"offset": at, "length": len(member), "page_id": id_of(fields["warc-record-id"]), "record_type": fields["warc-type"]})
                at += len(member)
                if at - start >= CHUNK:
                    yield name, start, b"".join(parts), index
                    parts, index, start = [], [], at
            if parts:
                yield name, start, b"".join(parts), index

    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField("start", T.LongType()), T.StructField("members", T.BinaryType()), T.StructField("index", T.ArrayType(SPAN))])
    return arrow_rows(archives, ["archive", "stream"], make, schema, rows=1)


def sidecar(normal: DataFrame) -> DataFrame:
    """archive, start, offset, length, page_id, record_type: a row a record. Of ``normal`` only the index column is read."""
    return normal.select("archive", "start", F.explode("index").alias("at")).select("archive", "start", "at.*")


RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
])


def read_members(normal: DataFrame) -> DataFrame:
    """One row a record, each member inflated alone at its offset: page_id, payload (null in revisits), payload_bytes,
    payload_digest, record_type, refers_to. A response whose payload differs from its digest fails."""

    def make(rows):
        for name, start, members, index in rows:
            for span in index:
                at = span["offset"] - start
                fields, block = parse_record(zlib.decompress(members[at : at + span["length"]], 31))
                kind, total = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and digest(block) != total:
                    raise ValueError(f"{name}: a payload that differs from its digest at {span['offset']}")
                refers = id_of(fields["warc-refers-to"]) if kind == "revisit" else None
                yield id_of(fields["warc-record-id"]), block if kind == "response" else None, int(fields["warc-payload-length"]), total, kind, refers

    return arrow_rows(normal, ["archive", "start", "members", "index"], make, RECORD)


def read_ranges(normal: DataFrame, wanted: DataFrame) -> DataFrame:
    """``read_members`` of the records in ``wanted`` alone (rows of the sidecar). Other rows of ``normal`` are skipped by
    archive and start, and of the rows read only the wanted members are inflated."""
    spans = wanted.groupBy("archive", "start").agg(F.collect_list(F.struct(*(f.name for f in SPAN))).alias("index"))
    return read_members(normal.drop("index").join(spans, ["archive", "start"]))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: archives of all pages, written, normalised with their sidecar, and read back by its offsets."""
    written = materialize(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "warc")
    normal = materialize(normalise(written), "warc-members")
    release(written)
    materialize(sidecar(normal), "warc-sidecar")
    return read_members(normal).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
     q AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM p),
     bits AS (SELECT *, ('0x' || substr(hex, 1, 10))::BIGINT AS a, ('0x' || substr(hex, 11, 10))::BIGINT AS b,
                     ('0x' || substr(hex, 21, 10))::BIGINT AS c, ('0x' || substr(hex, 31, 10))::BIGINT AS d FROM q)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
       list_aggregate(list_transform([a, b, c, d], lambda x: list_aggregate(list_transform(range(8), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> (35 - 5 * i)) & 31)::BIGINT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM bits
"""
