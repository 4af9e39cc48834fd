"""WARC archives: written by Spark's text writer, read by its text reader, segments put together again.

Writing. A page is one record. Of pages with equal payloads the one with the largest id is a ``response``; the others
``revisit`` it and hold no payload. A response's block is an HTTP answer in chunked transfer framing; a block longer than
a segment goes on in ``continuation`` records. Records are lines of a text file whose line separator is the two line
breaks after a WARC record, so Spark's commit protocol holds for archives on any file system, and a part of a task that
is run again leaves no second copy. Chunks end inside every ``WARC/1.`` of a payload, so that this text starts records only.

Reading. The separator of lines is the end of a record with the start of the next one, so files are read as streams,
compressed or not, and no file is held in memory. In each file records are cut by their declared lengths, so a payload may
hold the separator, and one that the reader misses between two of its buffers costs no record. Continuation records are
grouped by the identifier of their origin, ordered by segment number, and checked: numbers 1, 2, ... to the one that
declares the total length, and that length. Then the chunked framing is decoded. A record that fails a check has a ``problem`` and no payload.

Defined results: a null payload is empty; a null id is smaller than all others and stays null; rows that share the
largest id of their payload are all responses, and revisits name that id; an equal row that is written twice is read
twice; a very long payload is one record of many segments; an empty table gives empty archives and no rows. Columns but
id, url and payload are not written. Spaces and control characters, which may not stand in a header, are percent-encoded
in the url and stay so.
"""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import common
from rankforge.operators.joins import beside
from rankforge.session import scratch_path, written

#: Fixed values of the format.
START, BREAK = b"WARC/1.", b"\r\n"
LINE_END = "\r\n\r\n"
SEPARATOR = LINE_END.encode() + START
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
ANSWER = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
BASE32, BASE32_HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Bytes of a chunk, and of a record's block before it goes on in a continuation record.
CHUNK, SEGMENT = 4096, 8192
RECORD = ("kind string, record_id string, origin string, segment int, total bigint, page_id string, target_uri string, "
          "refers_to string, payload_digest string, block binary, problem string")
FIELDS = [f.split()[0] for f in RECORD.split(", ")]


def digest(payload: Column) -> Column:
    """SHA-1 of the bytes in base32."""
    code = F.sha1(payload)
    fives = [F.lpad(F.conv(F.substring(code, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fives), BASE32_HEX, BASE32)


def header(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [START + b"1", *(f"{k}: {v}".encode() for k, v in fields if v is not None),
             b"Content-Length: %d" % len(block)]
    return BREAK.join(lines) + BREAK + BREAK + block


def header_uri(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing; a chunk ends at ``size`` bytes and inside every start of a record."""
    cuts = sorted({*range(0, len(payload), size), *(m.start() + 1 for m in re.finditer(re.escape(START), payload)),
                   len(payload)})
    parts = [b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(cuts, cuts[1:])]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; a ``ValueError`` where the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(BREAK, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size:at + size + 2] != BREAK:
            raise ValueError("a chunk is shorter than its size")
        parts.append(body[at:at + size])
        at += size + 2


def records_of(page_id: str | None, url: str | None, payload: bytes, code: str, keeper: str | None, revisit: bool,
               segment: int) -> Iterator[bytes]:
    """The records of one page."""
    def name(*parts: object) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"

    own = [("WARC-Date", DATE), ("WARC-Target-URI", header_uri(url)), ("X-Page-ID", page_id)]
    shown = ("WARC-Payload-Digest", f"sha1:{code}")
    kind = ("Content-Type", "application/http;msgtype=response")
    if revisit:
        yield header([("WARC-Type", "revisit"), ("WARC-Record-ID", name("revisit", page_id, url, code)), *own, shown,
                      ("WARC-Profile", PROFILE), ("WARC-Refers-To", name("response", keeper, code)), kind],
                     ANSWER + BREAK)
        return
    block = ANSWER + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    record = name("response", page_id, code)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", record), *own, shown, kind]
    if len(block) <= segment:
        yield header(first, block)
        return
    yield header([*first, ("WARC-Segment-Number", 1)], block[:segment])
    last = -(-len(block) // segment)
    for i in range(2, last + 1):
        yield header([("WARC-Type", "continuation"), ("WARC-Record-ID", name("continuation", page_id, code, i)),
                      *own, ("WARC-Segment-Origin-ID", record), ("WARC-Segment-Number", i),
                      ("WARC-Segment-Total-Length", len(block) if i == last else None)],
                     block[(i - 1) * segment:i * segment])


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
          segment: int = SEGMENT, compression: str = "gzip") -> None:
    """Write a record for every page to archives below ``path``."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")).withColumn(
        "code", digest(F.col("payload")))
    # Payloads of one page need no keeper. Counts and largest ids are taken by partial aggregation.
    shared = written(rows.groupBy("code").agg(F.max("page_id").alias("keeper"), F.count("*").alias("_rows")).where(
        F.col("_rows") > 1), "payloads")
    joined = beside(rows, shared, ["code"], F.col("page_id"))
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    given = joined.select(F.col("page_id").cast("string"), "url", "payload", "code", F.col("keeper").cast("string"),
                          revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "payload"):
            out = []
            for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns))):
                out += records_of(*row, segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = given.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", LINE_END).option("compression", compression).text(path)


def parsed(record: bytes) -> dict:
    """The fields of one whole record."""
    head, _, block = record.partition(BREAK + BREAK)
    said = {}
    for line in head.split(BREAK)[1:]:
        name, _, value = line.partition(b":")
        said[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = said.get("content-length", "")
    known = block[:int(length)] if length.isdigit() else block
    problem = None
    if not length.isdigit() or len(known) < int(length):
        problem = "a record is shorter than its declared length"
    code = said.get("warc-payload-digest", "").partition(":")
    number = {k: int(said[k]) if said.get(k, "").isdigit() else None
              for k in ("warc-segment-number", "warc-segment-total-length")}
    uri = said.get("warc-target-uri")
    return {"kind": said.get("warc-type"), "record_id": said.get("warc-record-id"),
            "origin": said.get("warc-segment-origin-id", said.get("warc-record-id")),
            "segment": number["warc-segment-number"], "total": number["warc-segment-total-length"],
            "page_id": said.get("x-page-id"), "target_uri": uri and uri.strip("<>"),
            "refers_to": said.get("warc-refers-to"), "payload_digest": code[2] if code[0] == "sha1" else None,
            "block": known, "problem": problem}


def wanted(record: bytes) -> int:
    """How long a record is by its own words; its present length if it has none."""
    head = record.partition(BREAK + BREAK)[0]
    said = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head)
    return len(head) + len(BREAK + BREAK) + int(said[1]) if said else len(record)


class Lines:
    """The lines of one file as records, by their declared lengths.

    A line that holds a further separator is several records. One that is too short goes on in the next lines if a record
    of its length ends where one of them does; else it is a damaged record of its own.
    """

    def __init__(self) -> None:
        self.open: deque[bytes] = deque()
        self.need = self.length = 0

    def add(self, line: bytes) -> Iterator[bytes]:
        self.open.append(line if self.open else line.removeprefix(START))
        self.length += len(self.open[-1]) + len(SEPARATOR) * (len(self.open) > 1)
        if len(self.open) == 1:
            self.need = wanted(self.open[0])
        return self.take(False)

    def begin(self) -> None:
        if self.open:
            self.need, self.length = wanted(self.open[0]), sum(map(len, self.open)) + len(SEPARATOR) * (len(self.open) - 1)

    def take(self, ended: bool) -> Iterator[bytes]:
        while self.open:
            if self.length < self.need and not ended:
                return
            # So many lines reach the declared length.
            count, length = 1, len(self.open[0])
            while length < self.need and count < len(self.open):
                length += len(SEPARATOR) + len(self.open[count])
                count += 1
            lines = [self.open.popleft() for _ in range(count)]
            whole_lines = SEPARATOR.join(lines)
            rest = whole_lines[self.need:]
            if count > 1 and (length < self.need or rest not in (b"", LINE_END.encode()) and not rest.startswith(SEPARATOR)):
                self.open.extendleft(reversed(lines[1:]))
                yield lines[0]
            else:
                yield whole_lines[:self.need]
                if rest.startswith(SEPARATOR):
                    self.open.appendleft(rest.removeprefix(SEPARATOR))
            self.begin()
        self.length = 0


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``, with the columns of ``RECORD``."""
    lines = spark.read.option("lineSep", SEPARATOR.decode()).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        file, lines = None, Lines()
        for part in common.slices(batches, "value"):
            for at, value in zip(part.column("file").to_pylist(), part.column("value").to_pylist()):
                if at != file:
                    yield from lines.take(True)
                    file, lines = at, Lines()
                yield from lines.add(value)
        yield from lines.take(True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"segment": pa.int32(), "total": pa.int64(), "block": pa.binary()}

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[f] for r in rows], kinds.get(f, pa.string())) for f in FIELDS], names=FIELDS)

        rows, size = [], 0
        for record in joined(batches):
            rows.append(parsed(record))
            size += len(record)
            if size >= common.SLICE_BYTES:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    return lines.mapInArrow(run, RECORD)


def decoded(block: bytes) -> tuple[bytes | None, str | None]:
    """The payload of an HTTP answer, or what is wrong with it."""
    head, gap, body = block.partition(BREAK + BREAK)
    if not gap:
        return None, "an answer has no end of its header"
    if not re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head):
        return body, None
    try:
        return dechunked(body), None
    except ValueError:
        return None, "the chunked framing is broken"


def whole(parts: list[dict]) -> tuple[bytes | None, str | None]:
    """The block of a record from its segments, in any order."""
    parts = sorted(parts, key=lambda x: x["segment"])
    if [x["segment"] for x in parts] != list(range(1, len(parts) + 1)):
        return None, "segments are missing or differ"
    block = b"".join(x["block"] for x in parts)
    if parts[-1]["total"] is None or any(x["total"] is not None for x in parts[:-1]):
        return None, "no last segment"
    if parts[-1]["total"] != len(block):
        return None, "segments do not have the declared total length"
    return block, None


def payloads(found: DataFrame) -> DataFrame:
    """Responses and revisits, segments put together: identifiers, ``payload`` (null in revisits) and ``problem``."""
    columns = ["kind", "record_id", "page_id", "target_uri", "refers_to", "payload_digest"]
    schema = ", ".join(f"{c} string" for c in columns) + ", payload binary, problem string"
    named = F.struct(*columns)
    alone = found.where("segment is null and kind in ('response', 'revisit')").select(
        *columns, "problem", F.array(F.struct(F.lit(1).alias("segment"), F.octet_length("block").cast("bigint").alias(
            "total"), "block")).alias("parts"))
    # Equal records meet as one before the shuffle; a record of one writer has the segments of one payload.
    joined = found.where("segment is not null").groupBy("origin").agg(
        F.max(F.when(F.col("segment") == 1, named)).alias("x"), F.max("problem").alias("problem"),
        F.count_if(F.col("segment") == 1).alias("copies"),
        F.collect_set(F.struct("segment", "total", "block")).alias("parts"))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.col("copies"), F.lit(1))))
    rows = alone.unionByName(joined.withColumn("_copy", copies).select("x.*", "problem", "parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, done = [], 0, 0
            for at in range(batch.num_rows):
                problem = batch.column("problem")[at].as_py()
                payload = None
                if batch.column("kind")[at].as_py() != "revisit" and problem is None:
                    block, problem = whole(batch.column("parts")[at].as_py())
                    if problem is None:
                        payload, problem = decoded(block)
                held.append((payload, problem))
                size += len(payload or b"")
                if size >= common.SLICE_BYTES or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).slice(done, len(held)) for c in columns), pa.array([h[0] for h in held], pa.binary()),
                         pa.array([h[1] for h in held], pa.string())], names=[*columns, "payload", "problem"])
                    held, size, done = [], 0, at + 1

    return rows.mapInArrow(run, schema)


def resolved(found: DataFrame) -> DataFrame:
    """Each row of :func:`payloads` with size and digest of its full payload, of revisits that of the response."""
    thin = written(found.withColumns({
        "payload_bytes": F.octet_length("payload").cast("bigint"), "found_digest": digest(F.col("payload"))}).drop(
        "payload"), "captures")
    asked = thin.where("kind = 'revisit'").groupBy(F.col("refers_to").alias("record_id")).agg(F.count("*").alias("_rows"))
    answers = thin.where("kind = 'response'").groupBy("record_id").agg(
        F.max(F.struct("payload_bytes", "found_digest", F.col("page_id").alias("origin_id"))).alias("seen"))
    known = written(asked.join(answers, "record_id").select(
        F.col("record_id").alias("refers_to"), "seen", "_rows"), "answers")
    revisits = beside(thin.where("kind = 'revisit'").drop("payload_bytes", "found_digest"), known, ["refers_to"],
                      F.col("record_id"))
    revisits = revisits.select("*", "seen.*").drop("seen")
    rows = thin.where("kind is distinct from 'revisit'").withColumn("origin_id", F.lit(None).cast("string")).unionByName(revisits)
    wrong = F.when(F.col("found_digest").isNull(), F.lit("no answer for a revisit")).when(
        F.col("found_digest") != F.col("payload_digest"), F.lit("the payload has another digest"))
    return rows.withColumn("problem", F.coalesce("problem", wrong))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    write(pages, path)
    kind = pages.schema["page_id"].dataType
    found = resolved(payloads(records(spark, path)))
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", F.col("found_digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("origin_id").cast(kind).alias("refers_to"), "problem")


SQL = """
WITH coded AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS code FROM pages),
named AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (('0x' || substr(code, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) % 32, 1)), 'string_agg', '') AS payload_digest,
    max(page_id) OVER (PARTITION BY code) AS keeper
  FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM named"""
