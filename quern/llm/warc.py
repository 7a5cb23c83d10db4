"""WARC archives: every capture is written as request, response (or revisit) and metadata records that name each
other by WARC-Concurrent-To, and transactions are assembled again from the archives by those names.

A record ends in two line ends, and so does its header. Spark's text source can therefore write records as rows with
that separator, and read archives back as a stream of pieces, which Content-Length puts together again. Both sides
work on any file system that Spark reads, the write commits like any other, and no archive is held in memory whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import BATCH_ROWS, join_groups, map_texts, materialize
from .near_dup import components

#: Separator of rows: two line ends.
GAP = "\r\n\r\n"
_GAP = GAP.encode()
#: Records of an archive file (three a capture).
RECORDS_PER_FILE = 30_000
#: Records of one nested row; a capture of more has further rows, told apart by `part`.
RECORDS_PER_ROW = 1000
#: Bytes of blocks that the reader hands on at once; a longer block goes alone.
OUT_BYTES = 1 << 21
PRIMARY = ("response", "revisit")
RECORD = (
    "record_id string, record_type string, warc_date string, target_uri string, concurrent_to array<string>, refers_to string, "
    "payload_digest string, content_type string, block binary, complete boolean, archive string"
)
# fixed values of the format: digits of base 32, and of the base that Spark converts to
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a binary or text column in upper-case base 32: eight groups of 20 bits, four digits each."""
    whole = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(whole, 5 * g + 1, 5), 16, 32), 4, "0") for g in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


# ---------------------------------------------------------------------------------------------
# writing


def _uuid(name: Column) -> Column:
    """A record id from the MD5 of a name."""
    h = F.md5(name)
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, own: Column, date: str, block: Column, content_type: Column, **fields: Column) -> Column:
    """The text of a record without the separator that ends it; fields that are null are left out."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value))
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind), line("WARC-Record-ID", own), F.lit(f"\r\nWARC-Date: {date}")]
    lines += [line(name.replace("_", "-"), value) for name, value in fields.items()]
    lines += [line("Content-Type", content_type), line("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("", *lines), F.lit(GAP), block)


def _target(url: Column) -> Column:
    """A url as a header value: white space and control characters are escaped, null stays null."""
    bad = r"[\x00-\x20\x7f]"
    return F.when(url.rlike(bad), F.regexp_replace(F.url_encode(url), "%(3A|2F|3F|23|26|3D)", "%$1")).otherwise(url)


def captures_to_write(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_sha (of the payload's content), payload (null in a revisit), payload_bytes,
    payload_digest, record_type: one row per row of `pages`.

    Of rows of equal payload (null: empty) that of the smallest page_id (null last, then by url) is the response.
    Repeated rows that could all be it give one response and revisits.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("payload"))
    rows = rows.withColumn("payload_sha", F.sha2(F.col("payload").cast("binary"), 256))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.col("url").isNull().alias("late"), "url")
    same = rows.select("payload_sha", order.alias("first")).groupBy("payload_sha", "first").agg(F.count(F.lit(1)).alias("copies"))
    firsts = same.groupBy("payload_sha").agg(F.min(F.struct("first", "copies")).alias("least"), F.sum("copies").alias("n_rows"))
    firsts = firsts.where("n_rows > 1").select("payload_sha", F.col("least.first").alias("first"), F.col("least.copies").alias("copies"), "n_rows")
    joined = join_groups(rows.withColumn("own", order), firsts, "payload_sha", "n_rows")
    facts = [F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload").cast("binary")).alias("payload_digest")]
    leads = F.col("first").isNull() | (F.col("own") == F.col("first"))
    base = ["page_id", "url", "payload_sha"]
    kinds = F.when(leads, F.lit("response")).otherwise(F.lit("revisit"))
    plain = joined.where(~(leads & (F.coalesce("copies", F.lit(1)) > 1)))
    plain = plain.select(*base, F.when(leads, F.col("payload")).alias("payload"), *facts, kinds.alias("record_type"))
    # copies of a whole row: once with its payload, and as often again without as there are more of it
    group = joined.where(leads & (F.col("copies") > 1)).groupBy(*base).agg(F.first("payload").alias("payload"), F.first("copies").alias("copies"))
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("number")
    group = group.select(*base, "payload", *facts, number)
    first = F.col("number") == 1
    repeated = group.select(*base, F.when(first, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(first, F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"))
    return plain.unionByName(repeated)


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes gzipped archives with three records for every row of `pages` (page_id, url, html).

    The response's payload is the html in UTF-8 (null: empty). A revisit has no payload and refers to the record of the
    response, with the HTTP header of the full payload. The metadata record holds page_id and url as JSON, so any url,
    null and malformed ones too, comes back as it was. Other columns are ignored; an empty table writes no records.
    """
    rows = captures_to_write(pages)
    response_id = _uuid(F.concat(F.lit("response "), F.col("payload_sha")))
    rows = rows.withColumn("seed", F.uuid()).withColumn("target", _target(F.col("url")))
    is_response = F.col("record_type") == "response"
    own = F.when(is_response, response_id).otherwise(F.concat(F.lit("<urn:uuid:"), F.col("seed"), F.lit(">")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(GAP))
    http = F.concat(head, F.coalesce("payload", F.lit("")))
    rest = F.regexp_extract("target", "://(.*)$", 1)
    path_of = F.regexp_extract(F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1), "^/?(.*)$", 1)
    ask = F.concat(F.lit("GET /"), F.coalesce(path_of, F.lit("")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), F.lit(GAP))
    about = F.to_json(F.struct("page_id", "url"), {"ignoreNullFields": "false"})
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    earlier = lambda value: F.when(~is_response, value)
    records = F.array(
        _record(F.lit("request"), _uuid(F.concat(F.lit("request "), F.col("seed"))), date, ask, F.lit("application/http; msgtype=request"), WARC_Target_URI=F.col("target"), WARC_Concurrent_To=own),
        _record(F.col("record_type"), own, date, http, F.lit("application/http; msgtype=response"), WARC_Target_URI=F.col("target"), WARC_Payload_Digest=digest, WARC_Refers_To=earlier(response_id), WARC_Profile=earlier(F.lit(IDENTICAL))),
        _record(F.lit("metadata"), _uuid(F.concat(F.lit("metadata "), F.col("seed"))), date, about, F.lit("application/json"), WARC_Target_URI=F.col("target"), WARC_Concurrent_To=own),
    )
    text = rows.select(F.explode(records).alias("value"))
    text.write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


# ---------------------------------------------------------------------------------------------
# reading

_NAMES = {
    "warc-type": "record_type",
    "warc-record-id": "record_id",
    "warc-date": "warc_date",
    "warc-target-uri": "target_uri",
    "warc-refers-to": "refers_to",
    "warc-payload-digest": "payload_digest",
    "content-type": "content_type",
}


def _header(head: bytes) -> tuple[dict, int | None]:
    """Fields of a record's header and the length of its block; a continued line belongs to the field before it."""
    out: dict = {"concurrent_to": []}
    lines, length = [], None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    for line in lines:
        name, _, value = line.partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "warc-concurrent-to":
            out["concurrent_to"].append(value)
        elif name == "content-length" and value.isdigit():
            length = int(value)
        elif name in _NAMES:
            out[_NAMES[name]] = value
    return out, length


class _Assembler:
    """Puts the pieces of one archive together: as bytes again, cut where the lengths of blocks say.

    A block may itself hold separators, or end in a line end that the separator after it takes in.
    """

    def __init__(self, archive: str):
        self.archive, self.fields, self.length = archive, None, 0
        self.held: list[bytes] = []
        self.size = 0

    def _keep(self, data: bytes) -> None:
        self.held, self.size = [data], len(data)

    def feed(self, piece: bytes) -> Iterator[dict]:
        """The records that this piece completes."""
        self.held += [piece, _GAP]
        self.size += len(piece) + len(_GAP)
        while self.size >= (1 if self.fields is None else self.length + len(_GAP)):
            data = b"".join(self.held)
            if self.fields is not None:
                end = self.length + len(_GAP)
                yield self.fields | {"block": data[: self.length], "complete": data[self.length : end] == _GAP}
                self.fields = None
                self._keep(data[end:])
                continue
            head, _, data = data.lstrip(b"\r\n").partition(_GAP)
            self._keep(data)
            if not head.startswith(b"WARC/"):
                if head:
                    yield {"block": head, "complete": False}
                continue
            self.fields, length = _header(head)
            if length is None:
                yield self.fields | {"block": b"", "complete": False}
                self.fields = None
            else:
                self.length = length

    def close(self) -> Iterator[dict]:
        """The torn record at the end, if there is one."""
        if self.fields is not None:
            yield self.fields | {"block": b"".join(self.held)[: -len(_GAP)], "complete": False}


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "record_type", "warc_date", "target_uri", "concurrent_to", "refers_to", "payload_digest", "content_type", "block", "complete", "archive"]
    kinds = [pa.list_(pa.string()) if n == "concurrent_to" else pa.binary() if n == "block" else pa.bool_() if n == "complete" else pa.string() for n in names]
    reader, out, held = None, [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def add(archive: str, records: Iterator[dict]) -> None:
        nonlocal held
        for record in records:
            out.append(record | {"archive": archive})
            held += len(record["block"])

    for pieces in batches:
        for at, archive in enumerate(pieces.column(1).to_pylist()):
            if reader is None or reader.archive != archive:
                if reader:
                    add(reader.archive, reader.close())
                reader = _Assembler(archive)
            add(archive, reader.feed(pieces.column(0)[at].as_py()))
            if held > OUT_BYTES or len(out) >= BATCH_ROWS:
                yield batch()
                out, held = [], 0
    if reader:
        add(reader.archive, reader.close())
    if out:
        yield batch()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzipped archives (*.gz) below `path`: RECORD's columns.

    Blocks may hold any bytes. A record whose block is shorter or longer than its header says (a torn end), or that has
    no length, is given with `complete` false, and so is text between records. Records of one archive are read by one task.
    """
    lines = spark.read.option("lineSep", GAP).option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").text(path)
    pieces = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("archive"))
    return map_texts(pieces, _assembled, RECORD)


def with_payload_facts(records: DataFrame) -> DataFrame:
    """Adds payload_bytes and payload_digest (bare): of the payload in a response, as its HTTP header and the record's
    say in a revisit; null in other records and where a block has no HTTP header."""
    text = F.col("block").cast("string")
    cut = F.instr(text, GAP)
    # positions in bytes: the header before the cut may hold any characters
    at = F.octet_length(F.substring(text, F.lit(1), cut - 1)) + len(GAP) + 1
    payload = F.expr("substring(block, quern_at, greatest(0, octet_length(block) - quern_at + 1))")
    head = F.substring(text, F.lit(1), cut)
    told = F.regexp_extract(head, r"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})", 1)
    known = (cut > 0) & F.col("complete")
    n_bytes = F.when(known & (F.col("record_type") == "response"), F.octet_length("quern_payload").cast("long"))
    n_bytes = n_bytes.when(known & (F.col("record_type") == "revisit") & (told != ""), told.try_cast("long"))
    digest = F.when(known & (F.col("record_type") == "response"), base32_sha1(F.col("quern_payload")))
    digest = digest.when(F.col("record_type") == "revisit", F.regexp_replace("payload_digest", "^(?i)sha1:", ""))
    out = records.withColumn("quern_at", F.when(cut > 0, at).otherwise(1)).withColumn("quern_payload", payload)
    out = out.withColumn("quern_bytes", n_bytes).withColumn("payload_digest", F.coalesce(digest, F.lit(None).cast("string")))
    return out.withColumn("payload_bytes", F.col("quern_bytes")).drop("quern_at", "quern_payload", "quern_bytes")


# ---------------------------------------------------------------------------------------------
# assembly


def _captures(records: DataFrame) -> DataFrame:
    """(node, root) of all records that name another or are named: root is the smallest id of the capture.

    Where no record that is named names another itself, and none names two (what most writers do), the named ones are
    the middles of all captures, and one aggregation finds the smallest ids. Otherwise components are sought.
    """
    links = records.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b")).where("a is not null and a <> b").distinct()
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e"))
    ends = ends.groupBy("e.id").agg(F.sum("e.out").alias("out"), F.max("e.into").alias("into"))
    if not ends.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty():
        return components(links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")))
    middles = links.groupBy("b").agg(F.min("a").alias("least"), F.count(F.lit(1)).alias("n_rows")).withColumn("root", F.least("b", "least"))
    middles = materialize(middles)
    named = join_groups(links, middles.select("b", "root", "n_rows"), "b", "n_rows").select(F.col("a").alias("node"), "root")
    return named.unionByName(middles.select(F.col("b").alias("node"), "root"))


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, part, n_records, and arrays responses, requests, metadata, others of
    the columns of `records` (record_id, record_type, concurrent_to and any others).

    Records belong to one capture where WARC-Concurrent-To leads from one to the other, in either direction and over
    any number of records; capture_id is the smallest record id among them. A name that no record bears still joins
    those that name it. Responses and revisits of one name come first; a capture may lack any of the kinds. A record
    without an id is a capture of its own with the null id. A capture of more than RECORDS_PER_ROW records is dealt over
    rows of about that many by the hash of the ids (`part` from 0). Records that share an id are all kept.
    """
    roots = materialize(_captures(records)).select(F.col("node").alias("record_id"), F.col("root").alias("capture_id"))
    own = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("record"), "record_id", "record_type")
    placed = own.where("record_id is not null").join(roots, "record_id", "left").withColumn("capture_id", F.coalesce("capture_id", "record_id"))
    sizes = placed.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n_records"))
    placed = join_groups(placed, sizes.withColumn("n_rows", F.col("n_records")), "capture_id", "n_rows")
    part = F.pmod(F.xxhash64("record_id"), F.ceil(F.col("n_records") / RECORDS_PER_ROW).cast("long"))
    kinds = {"responses": F.col("record_type").isin(*PRIMARY), "requests": F.col("record_type") == "request", "metadata": F.col("record_type") == "metadata"}
    known = F.coalesce(kinds["responses"] | kinds["requests"] | kinds["metadata"], F.lit(False))
    kinds["others"] = ~known
    rows = placed.withColumn("part", part.cast("int")).groupBy("capture_id", "part", "n_records")
    rows = rows.agg(*(F.collect_list(F.when(test, F.col("record"))).alias(name) for name, test in kinds.items()))
    # records without an id meet nothing: each is a row of its own, without a group
    none = F.array().cast(ArrayType(own.schema["record"].dataType))
    single = own.where("record_id is null")
    single = single.select(F.lit(None).cast("string").alias("capture_id"), F.lit(0).alias("part"), F.lit(1).cast("long").alias("n_records"), *(F.when(F.coalesce(test, F.lit(False)), F.array("record")).otherwise(none).alias(name) for name, test in kinds.items()))
    return rows.unionByName(single)


def pages_of(captures: DataFrame) -> DataFrame:
    """One row per capture with a response or revisit: page_id and url as its metadata record says, record_type,
    record_id, refers_to (a record id), payload_bytes, payload_digest. Columns are null where a capture lacks the record."""
    answer, about = F.try_element_at("responses", F.lit(1)), F.try_element_at("metadata", F.lit(1))
    told = F.from_json(about["block"].cast("string"), "page_id long, url string")
    out = captures.where(F.size("responses") > 0).select(answer.alias("answer"), told.alias("told"))
    return out.select("told.page_id", "told.url", *(f"answer.{c}" for c in ("record_type", "record_id", "refers_to", "payload_bytes", "payload_digest")))


def archived(pages: DataFrame, path: str) -> DataFrame:
    """Writes `pages` as archives below `path`, reads them back, and gives one row per page: page_id, payload_bytes,
    payload_digest, record_type, refers_to (page_id of the response that a revisit refers to, null in a response), url.

    Edge cases are those of write_archives and captures_to_write.
    """
    spark = pages.sparkSession
    write_archives(pages, path)
    records = with_payload_facts(read_archives(spark, path))
    # blocks of answers have been read into their facts: only those of metadata travel on
    small = F.when(F.col("record_type") == "metadata", F.col("block")).alias("block")
    small = records.select("record_id", "record_type", "concurrent_to", "refers_to", "payload_bytes", "payload_digest", small)
    rows = materialize(pages_of(transactions(materialize(small))))
    named = rows.where("record_type = 'response'").select(F.col("record_id").alias("response_id"), F.col("page_id").alias("response_page"))
    uses = rows.where("refers_to is not null").groupBy("refers_to").agg(F.count(F.lit(1)).alias("n_rows"))
    names = uses.join(named, F.col("refers_to") == F.col("response_id")).select("refers_to", "response_page", "n_rows")
    revisits = join_groups(rows.where("refers_to is not null"), names, "refers_to", "n_rows").withColumn("refers_to", F.col("response_page"))
    first = rows.where("refers_to is null").withColumn("refers_to", F.lit(None).cast("long")).withColumn("response_page", F.lit(None).cast("long"))
    return first.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
