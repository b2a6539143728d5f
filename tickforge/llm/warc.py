"""WARC archives with a chunked record table.

Records are written as plain lines of a Spark text table whose line ends are CRLF, which makes
every file of it a WARC file.  A payload longer than CHUNK is cut into a first record and
`continuation` records, WARC's own segments, so no row is longer than a chunk.  Reading parses
each archive into rows (record identifier, chunk number, data) and carries a digest on from chunk to chunk; a
whole payload is never put together.

Archives are parsed once, into a written chunk table.  Records of one chunk are digested where they are parsed.  Chunks of longer records are
sorted by record and number and digested as a stream, whatever file they came from.

A file is unpacked by one task at a time, a record in memory; it is read whole, packed, so as many records are put in a file as
keep it under FILE_BYTES unpacked, were all as long as the longest.

Defined cases
* null html: an empty payload; null url: no target URI; null page id: no identifier, read back as null.
* Repeated rows: each is a record of its own.  Of equal payloads of at least MIN_BYTES, the rows
  with the smallest page id are responses (several if that id repeats); a null id counts as
  largest, and payloads that only null ids have are all responses.
* Very long payloads go in chunks of CHUNK bytes; no row but the page itself is longer.
* An empty table gives archives without records.  Extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, arrow_batches, fresh, materialize, table

CHUNK = 256 << 10
#: Bytes of a file, unpacked, and records of it at most.
FILE_BYTES, PER_FILE = 128 << 20, 20_000
MIN_BYTES = 100
#: The profile of a revisit of an equal payload, and the one date that all records bear, as pages have none.
PROFILE, DATE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def assign(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, refers_to, refers_url) with a null refers_to for responses.

    Repeated payloads are found by digest with partial minima, over digests alone.  The table of those that repeat is broadcast up to BROADCAST_IDS rows, so that no
    payload is shuffled; a longer one is joined by digest, which adaptive execution splits if one payload has very many rows.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    seen = p.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "first", "first_url")
    seen = materialize(seen, "repeated-payloads")
    if seen.count() <= BROADCAST_IDS:
        seen = F.broadcast(seen)
    later = (F.col("first").isNotNull()) & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return p.join(seen, F.col("digest") == F.col("d"), "left").withColumns({"refers_to": F.when(later, F.col("first")), "refers_url": F.when(later, F.col("first_url"))}).drop("d", "first", "first_url")


def write_archives(records: DataFrame, path: str, chunk: int = CHUNK, per_file: int | None = None) -> None:
    """Write (page_id, url, payload, payload_bytes, digest, refers_to, refers_url) as gzipped WARC files under path."""
    if per_file is None:
        longest = records.agg(F.max(F.least("payload_bytes", F.lit(chunk))).alias("n")).first()["n"] or 1
        per_file = max(1, min(PER_FILE, FILE_BYTES // (longest + 1024)))
    revisit = F.col("refers_to").isNotNull()
    stored = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    segments = F.greatest(F.lit(1), F.ceil(stored / chunk)).cast("int")
    # The identifier is drawn before the chunks part, so all chunks of a row have the same.
    one = records.withColumn("record", F.concat(F.lit("urn:uuid:"), F.expr("uuid()"))).withColumn("segments", segments)
    rows = one.withColumn("no", F.explode(F.sequence(F.lit(1), F.col("segments"))))
    data = F.when(revisit, F.lit(b"")).otherwise(F.substring("payload", (F.col("no") - 1) * chunk + 1, chunk))
    rows = rows.withColumn("data", data)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
    if_set = lambda c, x: F.when(c, x).otherwise(F.lit(""))
    first = F.col("no") == 1
    many = F.col("segments") > 1
    one_line = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", "%0A")
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(~first, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.when(first, F.col("record")).otherwise(F.concat("record", F.lit("-"), F.col("no"))), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        if_set(F.col("url").isNotNull(), line("WARC-Target-URI", one_line("url"))),
        if_set(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id"))),
        line("X-Payload-Length", F.col("payload_bytes")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        if_set(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To-Date", F.lit(DATE)), line("X-Refers-To-Page-ID", F.coalesce(F.col("refers_to").cast("string"), F.lit(""))))),
        if_set(revisit & F.col("refers_url").isNotNull(), line("WARC-Refers-To-Target-URI", one_line("refers_url"))),
        if_set(many, line("WARC-Segment-Number", F.col("no"))),
        if_set(~first, line("WARC-Segment-Origin-ID", F.concat(F.lit("<"), F.col("record"), F.lit(">")))),
        if_set(many & (F.col("no") == F.col("segments")), line("WARC-Segment-Total-Length", F.col("payload_bytes"))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length("data")),
    )
    # header CRLF, payload CRLF, empty line CRLF: the text writer ends each value with CRLF.
    out = rows.select(F.concat(head, F.lit(CRLF), F.col("data").cast("string"), F.lit(CRLF)).alias("value"))
    out.write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record; a block is at most a chunk long."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        header = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            header[name.lower()] = value.strip()
        yield header, stream.read(int(header["content-length"]))
        stream.read(4)


CHUNKS = "record string, chunk int, total int, page_id long, url string, record_type string, refers_to long, declared string, payload_bytes long, digest string, data binary"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table.  total is 1 for a record of one chunk, whose digest is there; chunks of longer records have their data."""
    arrow_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        names, kinds = zip(*((x.split()[0], types[x.split()[1]]) for x in CHUNKS.split(", ")), strict=True)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                with gzip.open(io.BytesIO(memoryview(content.as_buffer()))) as f:
                    for h, block in parse(f):
                        number, whole = int(h.get("warc-segment-number", 1)), "warc-segment-number" not in h
                        number_of = lambda k, h=h: int(h[k]) if k in h else None
                        declared, kind = h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"]
                        digest = declared if kind == "revisit" else hashlib.sha256(block).hexdigest() if whole else None
                        length = number_of("x-payload-length") if kind == "revisit" else len(block)
                        record = h.get("warc-segment-origin-id", h["warc-record-id"])
                        rows.append((record, number, 1 if whole else 0, number_of("x-page-id"), h.get("warc-target-uri"), kind, number_of("x-refers-to-page-id"), declared, length, digest, None if whole else block))
                        held += 0 if whole else len(block)
                        if len(rows) >= 1000 or held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, CHUNKS)


def digest_chunks(chunks: DataFrame) -> DataFrame:
    """One row a record from the chunks of long records: sorted, then hashed as a stream, a chunk in memory at a time."""
    kept = ("record", "page_id", "url", "refers_to", "declared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        sha, length = hashlib.sha256(), 0

        def done() -> pa.RecordBatch:
            row = {k: now[k] for k in kept} | {"payload_bytes": length, "digest": sha.hexdigest()}
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for b in batches:
            for i in range(b.num_rows):
                row = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
                if now is None or row["record"] != now["record"]:
                    if now is not None:
                        yield done()
                    now, sha, length = row, hashlib.sha256(), 0
                sha.update(row["data"])
                length += len(row["data"])
        if now is not None:
            yield done()

    sorted_chunks = chunks.select(*kept, "chunk", "data").repartition("record").sortWithinPartitions("record", "chunk")
    return sorted_chunks.mapInArrow(run, "record string, page_id long, url string, refers_to long, declared string, payload_bytes long, digest string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record under path."""
    chunks = materialize(read_chunks(spark, path), "warc-chunks")
    short = chunks.where("total = 1").select("page_id", "url", "payload_bytes", "digest", "declared", "record_type", "refers_to")
    long = digest_chunks(chunks.where("total = 0")).select("page_id", "url", "payload_bytes", "digest", "declared", F.lit("response").alias("record_type"), "refers_to")
    r = short.unionByName(long)
    wrong = F.raise_error(F.concat(F.lit("payload digest differs from the declared one, page "), F.col("page_id").cast("string")))
    return r.select("page_id", "url", "payload_bytes", F.when(F.col("digest") == F.col("declared"), F.col("digest")).otherwise(wrong).alias("payload_digest"), "record_type", "refers_to")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh(spark, "warc")
    write_archives(assign(table(spark, sf_dir, "pages")), path)
    return read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.h AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""

QUERIES = {"op5_warc": op5_warc}
SQL = {"op5_warc": OP5_SQL}
