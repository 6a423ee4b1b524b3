"""WARC archives: one transaction (request, response or revisit, metadata) per page, and its assembly.

Records are built with DataFrame functions. Each is compressed as a gzip member of its own, so that a reader can
start at any record, and files are rolled by bytes. Reading inflates a file piece by piece and parses records
by their Content-Length. `assemble` joins the records of a transaction through WARC-Concurrent-To and gives one
nested row per capture.

Defined cases: a null payload is empty; a null url is `about:blank`; a row with a null id is a response of
its own, named `none`; rows that share an id give a capture each, named by id and payload, and rows that share both
have the same records; line breaks in a url are percent-encoded; other columns of the input are ignored; an empty
table gives an archive without records. A file is at most `file_bytes` long, or holds one longer transaction.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from calorgrid.llm import hot, store

FILE_BYTES = 1 << 25  # compressed
PIECE = 1 << 20  # of a file that is inflated at once
LEAST_BYTES = 1000
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, payload binary, fields string"
_SCHEMA = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.string())])


def _urn(kind: str, key: Column, digest: Column) -> Column:
    return F.concat(F.lit(f"<urn:capture:{kind}:"), F.coalesce(key.cast("string"), F.lit("none")), F.lit(":"), F.left(digest, F.lit(16)), F.lit(">"))


def _record(kind: Column | str, rid: Column, date: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """The header of a record and its block; a header whose value is null is left out."""
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: "), rid, F.lit(f"\r\nWARC-Date: {date}"))]
    lines += [F.coalesce(F.concat(F.lit(f"\r\n{k}: "), v), F.lit("")) for k, v in headers]
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write an archive. Of rows with equal payloads of LEAST_BYTES or more, that with the largest key is the
    response and the others are revisits that name it; all smaller payloads are responses.

    Which rows are revisits is found from keys and digests alone; the payloads are shuffled at most once, by key,
    and not at all where the revisits are few enough to be broadcast.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("about:blank")), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(key).cast("long").alias("_key"), plain.alias("_url"), body.alias("_body"))
    rows = rows.withColumn("_n", F.octet_length("_body")).withColumn("_digest", F.sha1("_body"))
    names = rows.where((F.col("_n") >= LEAST_BYTES) & F.col("_key").isNotNull()).groupBy("_digest", "_key").agg(F.count("*").alias("_rows"))
    kept = names.groupBy("_digest").agg(F.max("_key").alias("_keeper"), F.count("*").alias("_copies")).where("_copies > 1")
    again = hot.spread_join(names, kept, ["_digest"], "_copies", "_key").where("_key <> _keeper").select("_key", "_digest", "_keeper", "_rows")
    rows = hot.spread_join(rows, again, ["_key", "_digest"], "_rows", "_url", "left").withColumn("_revisit", F.col("_keeper").isNotNull())

    rid, to = _urn("response", F.col("_key"), F.col("_digest")), F.col("_url")
    shape = F.regexp_extract("_url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_extract("_url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_n").cast("string"), F.lit("\r\n\r\n"))
    http = F.lit("application/http; msgtype=")
    request = _record("request", _urn("request", F.col("_key"), F.col("_digest")), date, [("WARC-Target-URI", to), ("WARC-Concurrent-To", rid), ("Content-Type", F.concat(http, F.lit("request")))], F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), shape, F.lit("\r\n\r\n")))
    profile = F.when(F.col("_revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    response = _record(F.when(F.col("_revisit"), "revisit").otherwise("response"), rid, date, [("WARC-Target-URI", to), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))), ("WARC-Profile", profile), ("WARC-Refers-To", F.when(F.col("_revisit"), _urn("response", F.col("_keeper"), F.col("_digest")))), ("Content-Type", F.concat(http, F.lit("response")))], F.when(F.col("_revisit"), head).otherwise(F.concat(head, F.col("_body").cast("string"))))
    metadata = _record("metadata", _urn("metadata", F.col("_key"), F.col("_digest")), date, [("WARC-Target-URI", to), ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page-id: "), F.coalesce(F.col("_key").cast("string"), F.lit("none")), F.lit("\r\n")))
    records = rows.select(*[r.cast("binary").alias(n) for r, n in ((request, "a"), (response, "b"), (metadata, "c"))])
    store.write_blobs(records.mapInArrow(lambda batches: _files(batches, file_bytes), "content binary"), "content", path, "\0", rows_per_file=1)


def member(record: bytes) -> bytes:
    """A gzip member. Its last byte, the highest of the size, is 0 below 16 MiB; an empty member follows a longer one."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.compress(b"\r\n\r\n") + pack.flush()
    return out if not out[-1] else out + member_of_nothing


member_of_nothing = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def _files(batches, file_bytes: int):
    """The contents of files without their last byte, which is 0 and which the sink adds."""
    held, size = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            one = b"".join(member(c[k].as_py()) for c in batch.columns)
            if held and size + len(one) > file_bytes:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["content"])
                held, size = [], 0
            held.append(one)
            size += len(one)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["content"])


def _inflated(content: bytes):
    """The bytes of a file, plain or of one or many gzip members, in pieces."""
    whole = memoryview(content)
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(whole), PIECE):
            yield whole[at : at + PIECE]
        return
    unpack, at = zlib.decompressobj(31), 0
    while at < len(whole):
        data = whole[at : at + PIECE]
        at += len(data)
        while len(data):
            out = unpack.decompress(data, PIECE)
            if out:
                yield out
            if unpack.eof:
                data, unpack = unpack.unused_data, zlib.decompressobj(31)
            else:
                data = unpack.unconsumed_tail


def parse(content: bytes):
    """Headers and block of the records of one archive file, which is inflated as far as the next record needs."""
    pieces, held = _inflated(content), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while held or more():
        seen = 0
        while (to := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                raise ValueError("a record's header has no end")
        headers = {}
        for line in held[:to].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers["content-length"])
        while len(held) < to + 8 + n:
            if not more():
                raise ValueError("a record's block has no end")
        yield headers, bytes(held[to + 4 : to + 4 + n])
        del held[: to + 8 + n]


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record. payload_bytes and payload_digest are those of the full payload: of a response
    they are computed from its bytes, of a revisit they come from its headers."""

    def records(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse(content.as_py()):
                    kind, body, n, digest, fields = h["warc-type"], None, None, None, None
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        said = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
                        n, digest = (len(body), hashlib.sha1(body).hexdigest()) if kind == "response" else (int(said[1]) if said else None, h.get("warc-payload-digest", "").rpartition(":")[2])
                    elif kind == "metadata":
                        fields = block.decode("utf-8", "replace")
                    rows.append((h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, n, body if payload and kind == "response" else None, fields))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response struct, request struct, metadata array.

    A request or metadata record belongs to the record that its WARC-Concurrent-To names; those that name
    none in the archive keep a row without response. Of several requests the one with the least id stays in
    `request`; different metadata records are in order of their ids.
    """
    main = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct("record_id", "type", "refers_to", "target_uri", "date", "payload_digest", "payload_bytes", "payload").alias("response"))
    side = F.struct("record_id", "target_uri", "date")
    requests = records.where("type = 'request'").groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min(side).alias("request"))
    notes = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "fields").alias("note")).distinct()
    notes = notes.groupBy("capture_id").agg(F.array_sort(F.collect_list("note")).alias("metadata"))
    return main.join(requests.join(notes, "capture_id", "full"), "capture_id", "full")


def digests(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each capture with a response."""
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, ':([^:>]*):[^:>]*>$', 1) as bigint)")
    r = captures.where("response is not null")
    return r.select(number("response.record_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), number("response.refers_to").alias("refers_to"), F.size("metadata").cast("long").alias("n_metadata"))
