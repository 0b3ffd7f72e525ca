"""A content-addressed web archive: each payload once, every record's header by itself.

Records are written as WARC/1.1 files with Spark's own text writer, so that a
task that fails leaves nothing behind. A payload is stored with the first
record that has it (a response); later ones (revisits) have headers only. The
files are read back, each payload is digested anew and held against its
header's digest, and joins by digest put the original records together.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.session import materialize

#: About how many bytes of records a file gets; a file is read by one task.
FILE_BYTES = 8 << 20
#: Payloads of fewer bytes are stored with each record.
LEAST_BYTES = 0
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

END = "\r\n"


def _own(pages: DataFrame) -> DataFrame:
    own = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    return own.withColumn("digest", F.sha2("payload", 256))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(row, page_id, url, digest, size, first, first_row): a record per row of ``pages``, which ``row`` numbers.

    ``first`` and ``first_row`` are the record with the same payload and the smallest
    page_id (none last, ties to the smaller url and row), if not the record
    itself. Payloads are equal if their SHA-256 and sizes are. Only ids and digests meet
    in groups, pre-aggregated; a payload that many pages have is joined back by
    its digest, where adaptive execution may split it.
    """
    known = _own(pages).select("page_id", "url", "digest", F.octet_length("payload").cast("bigint").alias("size"))
    # The numbers hold from here on, as the rows are written once.
    known = materialize(known.withColumn("row", F.monotonically_increasing_id()), "digests")
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "row")).alias("least")
    firsts = known.filter(F.col("size") >= least_bytes).groupBy("digest", "size").agg(least)
    known = known.join(firsts, ["digest", "size"], "left")
    later = F.col("least.row") != F.col("row")
    return known.select("row", "page_id", "url", "digest", "size", F.when(later, F.col("least.page_id")).alias("first"), F.when(later, F.col("least.row")).alias("first_row"))


def _name(page: int | None, row: int) -> str:
    return f"<urn:page:{'' if page is None else page}:{row}>"


def _head(row: int, page: int | None, url: str, digest: str, size: int, first: int | None, first_row: int | None, body: bytes) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first_row is None else 'revisit'}", f"WARC-Record-ID: {_name(page, row)}", f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(body)}",
    ]
    if first_row is None:
        head.append("WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode())
    else:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_name(first, first_row)}", f"WARC-Payload-Length: {size}"]
    return (END.join(head) + END + END).encode()


_RECORD = ["row", "page_id", "url", "digest", "size", "first", "first_row"]


def _once(batches):
    """Rows that are equal in page, url and payload send the payload once per task, whose input is one file split."""
    seen = set()
    for batch in batches:
        keep = []
        for key in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "digest"))):
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _serialise(batches):
    """One value per record: its header, and the payload of a response.

    Rows come sorted by page, url and digest: the payload, then the responses that have it.
    """
    stored = (None, b"")
    for batch in batches:
        out = []
        for *record, payload in zip(*(batch[c].to_pylist() for c in (*_RECORD, "payload"))):
            key = record[1:4]
            if payload is not None:
                stored = key, payload
            elif record[6] is not None:  # a revisit
                out.append(_head(*record, b""))
            elif key != stored[0]:
                raise ValueError(f"no payload for {_name(record[1], record[0])}")
            else:
                out.append(_head(*record, stored[1]) + stored[1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write(pages: DataFrame, found: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the records found of ``pages`` as WARC files of about ``file_bytes`` below ``path``; each ends in two empty lines.

    Responses and payloads are dealt by page, url and digest and sorted, so that a
    task reads a record and its payload one behind the other and holds neither
    for long. Revisits are dealt by their number.
    """
    total = found.select(F.sum(F.when(F.col("first_row").isNull(), F.col("size")).otherwise(0) + 512).alias("n")).first()["n"] or 0
    files = max(1, -(-total // file_bytes))
    rows = found.select(*_RECORD, F.lit(None).cast("binary").alias("payload"))
    payloads = _own(pages).select("page_id", "url", "digest", "payload")
    payloads = payloads.mapInArrow(_once, payloads.schema)
    payloads = payloads.select(*(c if c in ("page_id", "url", "digest") else F.lit(None).cast("bigint").alias(c) for c in _RECORD), "payload")
    key = F.when(F.col("first_row").isNull(), F.xxhash64("page_id", "url", "digest")).otherwise(F.xxhash64("row"))
    dealt = rows.union(payloads).repartition(files, key)
    dealt = dealt.sortWithinPartitions("page_id", "url", "digest", F.col("row").asc_nulls_first())
    values = dealt.mapInArrow(_serialise, "value binary").select(F.col("value").cast("string"))
    writer = values.write.mode("errorifexists").option("lineSep", END + END).option("compression", "gzip")
    writer.option("zlib.compress.level", "BEST_SPEED").text(path)


_HEADER = re.compile(rb"^([^:\r\n]+): ?([^\r\n]*)\r$", re.M)


def _page(name: str) -> int | None:
    page = name.split(":")[2]
    return int(page) if page else None


def _parse(batches, payloads: bool = True):
    for batch in batches:
        for content in batch["content"]:
            data = gzip.decompress(content.as_py())
            rows = {name: [] for name in _PARSED.names}
            at = 0
            while at < len(data):
                stop = data.index(b"\r\n\r\n", at)
                head = data[at : stop + 2]
                fields = {k.decode(): v.decode() for k, v in _HEADER.findall(head)}
                size = int(fields["Content-Length"])
                body = data[stop + 4 : stop + 4 + size]
                at = stop + 4 + size
                if data[at : at + 4] != b"\r\n\r\n":
                    raise ValueError("a record does not end in two empty lines")
                at += 4
                response = fields["WARC-Type"] == "response"
                sha256 = hashlib.sha256(body).hexdigest()
                sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
                if response and (f"sha256:{sha256}" != fields["WARC-Payload-Digest"] or f"sha1:{sha1}" != fields["WARC-Block-Digest"]):
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not the one that was digested")
                rows["page_id"].append(_page(fields["WARC-Record-ID"]))
                rows["record_type"].append(fields["WARC-Type"])
                rows["refers_to"].append(None if response else _page(fields["WARC-Refers-To"]))
                rows["digest"].append(fields["WARC-Payload-Digest"][7:])
                rows["header"].append(head if payloads else None)
                rows["payload"].append(body if response and payloads else None)
                rows["payload_bytes"].append(size if response else None)
                rows["sha1"].append(sha1 if response else None)
                if len(rows["header"]) == 256:
                    yield pa.RecordBatch.from_pydict(rows, _PARSED)
                    rows = {name: [] for name in _PARSED.names}
            yield pa.RecordBatch.from_pydict(rows, _PARSED)


_PARSED = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("header", pa.binary()),
    ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("sha1", pa.string())])


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of WARC files, their payloads verified; without ``payloads``, all but these and the headers."""
    def parse(batches):
        return _parse(batches, payloads)

    files = spark.read.format("binaryFile").load(path + "/part-*").select("content")
    return files.mapInArrow(
        parse, "page_id bigint, record_type string, refers_to bigint, digest string, header binary, payload binary, payload_bytes bigint, sha1 string")


def described(found: DataFrame) -> DataFrame:
    """Per record its full payload's size and digest, revisits by a join with the payload's response.

    The response's side has no payloads, so a response that very many records
    revisit moves small rows.
    """
    columns = ["page_id", "payload_bytes", "sha1", "record_type", "refers_to"]
    responses = found.filter("record_type = 'response'")
    stored = responses.select("digest", F.col("payload_bytes").alias("bytes"), F.col("sha1").alias("base32")).distinct()
    later = found.filter("record_type = 'revisit'").join(stored, "digest", "left")
    later = later.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("base32").alias("sha1"), "record_type", "refers_to")
    return responses.select(columns).union(later).withColumnRenamed("sha1", "payload_digest")


def restore(found: DataFrame) -> DataFrame:
    """(page_id, record_type, header, payload) of all records, revisits with the payload of their response.

    A payload that is revisited has one response.
    """
    columns = ["page_id", "record_type", "header", "payload"]
    responses, later = found.filter("record_type = 'response'"), found.filter("record_type = 'revisit'").drop("payload")
    return responses.select(columns).union(later.join(responses.select("digest", "payload"), "digest", "left").select(columns))


def archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write each row of ``pages`` as a WARC record below ``path``, and describe what is read back.

    Reads ``page_id``, ``url`` and ``html``; other columns play no part. A
    payload is the html in UTF-8, empty for a null. Of records with equal payloads
    of ``least_bytes`` or more, that with the smallest page_id is a response and
    the others revisit it; smaller payloads are all responses. Per record:
    page_id, payload_bytes, payload_digest (SHA-1 in base32, of the full
    payload), record_type and refers_to. Every row is a record: of repeated rows
    one can be the response, and the others refer to its page_id, their own. A
    null page_id is larger than all others; if all records of a payload have
    none, refers_to is null. An empty table gives no record. Blanks and control
    characters of a url are percent-encoded in its header.
    """
    write(pages, materialize(records(pages, least_bytes), "records"), path)
    return described(materialize(read(pages.sparkSession, path, payloads=False).drop("header", "payload"), "archived"))
