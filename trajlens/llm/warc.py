"""WARC archives as a chunked record table.

Writing: payloads longer than a segment become a record and its continuation
records, so no record is longer than a segment; repeated payloads become
revisit records. Spark writes the archives, one file per task, into a folder
all executors share.

Reading: an archive is streamed line by line. What a task holds is one line
and one chunk, never a payload: a chunk's bytes go to the payload's running
digest and out as a row.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a payload in one record.
SEGMENT = 1 << 18
#: Bytes of a payload in one row of the chunked table.
CHUNK = 1 << 16
#: Equal payloads of at least so many bytes are stored once.
REVISIT_FROM = 1000
_URN = "urn:trajlens:page:"
_END = "\r\n\r\n"

CHUNK_DDL = ("record_id string, page_id long, record_type string, refers_to long, chunk_no long, chunk_bytes long, bytes_so_far long, "
             "digest_so_far string, last boolean, intact boolean, data binary")
_SCHEMA = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("chunk_no", pa.int64()), ("chunk_bytes", pa.int64()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()),
    ("last", pa.bool_()), ("intact", pa.bool_()), ("data", pa.binary())])


def _lines(*fields: tuple[str, Column | None]) -> Column:
    """Header lines; a field with a null value is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\r\n")), F.lit("")) for k, v in fields])


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The text of each WARC record, its closing line breaks left out; segments of a payload follow each other.

    Of equal payloads of at least REVISIT_FROM bytes, that of the largest id
    is a response and the others revisit it. A row that repeats the largest id
    is a response too. A null payload is empty; a null id revisits, where a
    payload with an id is equal, and is a response otherwise.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("n", F.octet_length("payload").cast("long"))
    # Ids and digests alone decide; of the payloads, only the row's own moves, by an id that is not skewed.
    small = rows.where(F.col("n") >= REVISIT_FROM).select("page_id", "digest", "n")
    kept = small.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
    revisits = (small.join(kept.where("copies > 1"), ["digest", "n"])
                .where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
                .groupBy(F.col("page_id").alias("from"), F.col("digest").alias("of")).agg(F.max("refers_to").alias("refers_to")))
    typed = rows.join(revisits.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("from")) & (F.col("digest") == F.col("of")), "left")

    revisit = F.col("refers_to").isNotNull()
    payload = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    typed = typed.select("page_id", "url", "digest", "n", "refers_to", payload.alias("payload"))
    segments = F.greatest(F.lit(1), F.ceil(F.length("payload") / SEGMENT))
    cut = typed.withColumn("segments", segments).withColumn("segment", F.explode(F.sequence(F.lit(1).cast("long"), F.col("segments"))))
    cut = cut.withColumn("part", F.when(F.col("segments") == 1, F.col("payload")).otherwise(
        F.substring(F.col("payload"), ((F.col("segment") - 1) * SEGMENT + 1).cast("int"), F.lit(SEGMENT))))
    first, several = F.col("segment") == 1, F.col("segments") > 1
    http = F.when(first, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                                  F.col("n").cast("string"), F.lit(_END))).otherwise(F.lit(""))
    block = F.concat(http, F.col("part"))
    urn = F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    header = _lines(
        ("WARC-Type", F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.when(first, urn).otherwise(F.concat(F.regexp_replace(urn, ">$", "#"), F.col("segment").cast("string"), F.lit(">")))),
        ("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        ("WARC-Refers-To", F.when(first, F.concat(F.lit(f"<{_URN}"), F.col("refers_to").cast("string"), F.lit(">")))),
        ("WARC-Profile", F.when(first & revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Segment-Number", F.when(several, F.col("segment"))),
        ("WARC-Segment-Origin-ID", F.when(~first, urn)),
        ("WARC-Segment-Total-Length", F.when(several & (F.col("segment") == F.col("segments")), F.col("n"))),
        ("Content-Type", F.when(first, F.lit("application/http;msgtype=response")).otherwise(F.lit("application/octet-stream"))),
        ("Content-Length", F.octet_length(block)))
    return cut.select(F.concat(F.lit("WARC/1.1\r\n"), header, F.lit("\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, folder: str, **columns: str) -> None:
    """Write the records of ``pages`` as gzip archives into ``folder``, which all executors share."""
    records(pages, **columns).write.option("lineSep", _END).option("compression", "gzip").text(folder)


class _Reader:
    """The rows of one archive stream. It holds a header, one line and at most one chunk of a payload."""

    def __init__(self, chunk: int, with_data: bool):
        self.chunk, self.with_data = chunk, with_data
        self.header: dict[str, str] | None = None
        self.left = 0          # bytes of the block and its closing line breaks
        self.in_http = False
        self.payload: dict | None = None
        self.held = bytearray()

    def line(self, line: bytes) -> Iterator[tuple]:
        if self.left:
            yield from self._block(line + b"\n")
        elif self.header is None:
            if line.startswith(b"WARC/"):
                self.header = {}
        elif line in (b"\r", b""):
            yield from self._begin()
        else:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            self.header[name.strip().lower()] = value.strip()

    def _begin(self) -> Iterator[tuple]:
        h, kind = self.header, self.header["warc-type"]
        self.left = int(h["content-length"]) + len(_END)
        if kind == "continuation":
            self.in_http = False
        else:
            if self.payload:
                yield from self._finish()
            self.in_http = True
            self.payload = {"id": h["warc-record-id"].strip("<>"), "type": kind, "refers": _page(h.get("warc-refers-to")),
                            "said": h.get("warc-payload-digest", "").removeprefix("sha1:"), "length": None,
                            "digest": hashlib.sha1(usedforsecurity=False), "bytes": 0, "chunks": 0}

    def _block(self, data: bytes) -> Iterator[tuple]:
        whole, data = len(data), data[:max(0, self.left - len(_END))]  # the line breaks after a record are no content
        self.left -= whole
        if self.in_http:
            if data in (b"\r\n", b"\n"):
                self.in_http = False
            elif data.lower().startswith(b"content-length:"):
                self.payload["length"] = int(data.split(b":")[1])
        elif data:
            self.held += data
            while len(self.held) >= self.chunk:
                yield self._row(bytes(self.held[:self.chunk]), False)
                del self.held[:self.chunk]
        if self.left <= 0:
            self.header, self.left = None, 0

    def _row(self, data: bytes, last: bool) -> tuple:
        p = self.payload
        p["digest"].update(data)
        p["bytes"] += len(data)
        p["chunks"] += 1
        revisit = p["type"] == "revisit"
        digest = p["said"] if revisit else p["digest"].hexdigest()
        intact = None if not last else revisit or (digest == p["said"] and p["length"] in (None, p["bytes"]))
        return (p["id"], _page(p["id"]), p["type"], p["refers"], p["chunks"] - 1, len(data),
                p["length"] if revisit else p["bytes"], digest, last, intact, data if self.with_data else None)

    def _finish(self) -> Iterator[tuple]:
        yield self._row(bytes(self.held), True)
        self.held.clear()
        self.payload = None

    def end(self) -> Iterator[tuple]:
        if self.payload:
            yield from self._finish()


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(_URN)
    return int(number) if number else None


def read_chunks(spark: SparkSession, folder: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``folder``.

    One row per chunk, numbered from 0 in each record; every record has a last
    row (``last``), which may be empty and holds the digest and length of the
    whole payload, and whether they are those the archive states (``intact``).
    A revisit has one row, with the digest and length its headers state.
    Without ``with_data`` the chunks' bytes are left out. An archive is read in
    order by one task, and again from its start if that task is lost.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, held, file = _Reader(chunk, with_data), [], 0, None
        for batch in batches:
            for line, path in zip(batch.column(0), batch.column(1).to_pylist()):
                if path != file:
                    rows += reader.end()
                    reader, file = _Reader(chunk, with_data), path
                for row in reader.line(line.as_py()):
                    rows.append(row)
                    held += row[5] if with_data else 0
                if len(rows) >= 4096 or held > 1 << 24:
                    yield _batch(rows)
                    rows, held = [], 0
        rows += reader.end()
        if rows:
            yield _batch(rows)

    lines = spark.read.option("lineSep", "\n").schema("value string").text(folder)
    return lines.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file")).mapInArrow(read, CHUNK_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def archive_pages(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write ``pages`` as archives, read them back and give a row per record: its type, digest and length.

    Records with an empty payload have length 0. Repeated rows give repeated
    records, an empty table gives none, and columns of other names are not read.
    """
    write_archives(pages, folder, **columns)
    whole = read_chunks(pages.sparkSession, folder, with_data=False).where("last")
    return whole.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"),
                        "record_type", "refers_to", "intact")
