"""WARC archives: a deterministic sharded writer and a reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.registry import query, table
from sheetwise.llm.stored import stored
from sheetwise.llm.text import NO_ID, row_id
from sheetwise.session import checkpoint_folder

MANIFEST = "file string, temporary string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
#: about what headers add to a payload
HEAD_BYTES = 512
#: record ids are derived from the page, so the same table gives the same archives
SPACE = uuid.UUID("5d0f2d4e-6f0b-5c57-9a52-0d6d4f3f7a10")


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path in it; executors reach what Spark reaches."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member; no time of writing in it."""
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def _page_fields(page: int, url: str | None, digest: str, date: str) -> list[tuple[str, str]]:
    fields = [("WARC-Record-ID", _name(page, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page != NO_ID:
        fields.append(("X-Page-ID", str(page)))
    return [*fields, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]


def _name(page: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page} {digest}')}>"


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def response_record(page: int, url: str | None, payload: bytes, date: str) -> bytes:
    return record("response", _page_fields(page, url, digest32(payload), date), _http(len(payload)) + payload)


def revisit_record(page: int, url: str | None, digest: str, size: int, first: int, date: str) -> bytes:
    fields = _page_fields(page, url, digest, date)
    fields += [("WARC-Refers-To", _name(first, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    if first != NO_ID:
        fields.append(("X-Refers-To-Page-ID", str(first)))
    return record("revisit", fields, _http(size))


def _unsigned(pages: pa.Array) -> np.ndarray:
    """Ids as unsigned numbers in the same order, so that differences do not overflow."""
    return pages.to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)


def _bins(narrow: DataFrame, spans: list[tuple[int, int, int]]) -> dict[int, int]:
    """The bytes in each bin of ``step`` ids of the ``spans`` (low, high, step), by the bin's first id."""
    low, high, step = (np.array(x, np.uint64) for x in zip(*spans))

    @F.arrow_udf("long")
    def first_of(pages: pa.Array) -> pa.Array:
        ids = _unsigned(pages)
        at = np.searchsorted(low, ids, side="right") - 1
        begin, width = low[np.maximum(at, 0)], step[np.maximum(at, 0)]
        inside = (at >= 0) & (ids <= high[np.maximum(at, 0)])
        first = np.where(inside, begin + (ids - begin) // width * width, np.uint64(0))
        return pa.array((first ^ np.uint64(1 << 63)).view(np.int64), mask=~inside)

    found = narrow.select(first_of("page").alias("bin"), "weight").filter("bin is not null").groupBy("bin").agg(F.sum("weight").alias("weight"))
    return {r["bin"] + (1 << 63): r["weight"] for r in found.collect()}


def page_parts(narrow: DataFrame, part_bytes: int, bins: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of about ``part_bytes`` of ``(page, weight)``: first ids (unsigned), first part numbers and parts of each range.

    The bytes are counted exactly by bins of ids. A bin that holds more than a part is cut into finer bins,
    all of them together in a pass, until it is small enough or a single id; neighbouring bins are then put
    together. Nothing is sampled, so the same pages have the same parts. A single id above a part is a
    range of several parts. The driver holds some thousand numbers, or ``bins`` for each part at most.
    """
    ends = narrow.agg(F.min("page"), F.max("page"), F.sum("weight")).first()
    if ends[0] is None:
        return np.zeros(1, np.uint64), np.zeros(1, np.int64), np.ones(1, np.int64)
    low, high = ends[0] + (1 << 63), ends[1] + (1 << 63)
    each = max(bins, 16 * math.ceil(ends[2] / part_bytes))
    open_spans, closed = [(low, high, -(-(high - low + 1) // each))], []
    while open_spans:
        weights, again = _bins(narrow, open_spans), []
        starts = np.array([s[0] for s in open_spans], np.uint64)
        for first, weight in sorted(weights.items()):
            _, high, step = open_spans[int(np.searchsorted(starts, np.uint64(first), side="right")) - 1]
            last = min(high, first + step - 1)
            if weight > part_bytes and last > first:
                again.append((first, last, -(-(last - first + 1) // bins)))
            else:
                closed.append((first, weight))
        open_spans = again
    begin, number, count, held = [], [], [], 0
    for first, weight in sorted(closed):
        if not begin or held + weight > part_bytes:
            number.append(number[-1] + count[-1] if begin else 0)
            begin.append(first)
            count.append(max(1, math.ceil(weight / part_bytes)))
            held = 0
        held += weight
    return np.array(begin, np.uint64), np.array(number, np.int64), np.array(count, np.int64)


def write_archives(
    pages: DataFrame,
    folder: str,
    min_payload: int = 0,
    part_bytes: int = 32 << 20,
    roll_bytes: int = 16 << 20,
    date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Write a WARC record per page into ``folder``; returns the manifest (file, records, bytes, sha256).

    Of pages with equal payloads of at least ``min_payload`` bytes the one with the smallest id becomes a
    ``response``, the others ``revisit`` it with headers only. Ranges of pages of about ``part_bytes`` are found
    by exact counts (``page_parts``), pages of one id above that are divided by their digest. Records are sorted
    by page inside their part, so a task holds one page at a time; a file is rolled once it holds ``roll_bytes``
    compressed. Record ids, headers and digests follow from the page alone, files and their names from the
    table: the same table gives the same archives, byte for byte.

    A task writes under temporary names of its own and reports them; Spark commits the reports of one
    attempt per task, only those files are renamed (which may be repeated), and the manifest written last makes
    the archive valid. What lost attempts left is removed.

    Cases: a null html is an empty payload; a missing url has no target; a missing page id counts as
    the smallest and has no id in the record; rows that share the smallest id and the payload are all
    responses; repeated rows are written each; an empty table gives no file.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(row_id(id_col).alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    narrow = stored(rows.select("page", "digest", F.octet_length("payload").alias("size")))
    firsts = narrow.filter(F.col("size") >= min_payload).groupBy("digest").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    firsts = firsts.filter(F.col("first") < F.col("last"))
    again = narrow.select("page", "digest").join(firsts, "digest").filter(F.col("page") > F.col("first")).select("page", "digest", "first").distinct()
    begin, number, count = page_parts(narrow.select("page", (F.col("size") + HEAD_BYTES).alias("weight")), part_bytes)
    sent = spark.sparkContext.broadcast((begin, number, count))

    @F.arrow_udf("int")
    def part_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        begin, number, count = sent.value
        for pages, digests in batches:
            at = np.searchsorted(begin, _unsigned(pages), side="right") - 1
            prefix = np.array([int(d[:8], 16) if n > 1 else 0 for d, n in zip(digests.to_pylist(), count[at].tolist())], np.int64)
            yield pa.array((number[at] + (prefix * count[at] >> 32)).astype(np.int32))

    # a page that revisits another is preceded by a row that says so: it lies in the same part
    role = again.select("page", "digest", F.lit(0).alias("kind"), "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    page = rows.select("page", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "url", "payload")
    placed = role.unionByName(page).withColumn("part", part_of("page", "digest"))
    placed = placed.repartitionById(int(number[-1] + count[-1]), "part").sortWithinPartitions("part", "page", "digest", "kind", "url")
    numbered = placed.select("part", "page", "digest", "kind", "first", "url", "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        system.create_dir(f"{path}/_temporary", recursive=True)
        done, out, seen, revisit = [], None, None, None

        def close():
            out.close()
            done.append((name, temporary, records, size, seen.hexdigest()))

        for batch in batches:
            for part, page, digest, kind, first, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    revisit = page, digest, first
                    continue
                if out is None:
                    name = f"part-{part:06d}-{len(done):06d}.warc.gz"
                    temporary = f"_temporary/{uuid.uuid4()}.warc.gz"
                    out, seen, records, size = system.open_output_stream(f"{path}/{temporary}", compression=None), hashlib.sha256(), 0, 0
                    info = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    seen.update(info)
                    size += len(info)
                if revisit and revisit[:2] == (page, digest):
                    member = revisit_record(page, url, digest32(payload), len(payload), revisit[2], date)
                else:
                    member = response_record(page, url, payload, date)
                out.write(member)
                seen.update(member)
                records, size = records + 1, size + len(member)
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        columns = [pa.array([d[i] for d in done], t) for i, t in enumerate([pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()])]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "temporary", "records", "bytes", "sha256"])

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        for batch in batches:
            for name, temporary in zip(batch.column("file").to_pylist(), batch.column("temporary").to_pylist()):
                if system.get_file_info(f"{path}/{temporary}").type != fs.FileType.NotFound:
                    system.move(f"{path}/{temporary}", f"{path}/{name}")
            yield batch

    numbered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/_reported")
    reported = spark.read.parquet(f"{folder}/_reported")
    reported.mapInArrow(commit, MANIFEST).drop("temporary").write.parquet(f"{folder}/_manifest")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return spark.read.parquet(f"{folder}/_manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive; raises on a damaged one."""
    with gzip.GzipFile(fileobj=stream) as plain:
        while line := plain.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record: {line[:40]!r}")
            fields = {}
            while (line := plain.readline()) not in (b"\r\n", b""):
                key, _, value = line.decode().partition(":")
                fields[key.lower()] = value.strip()
            block = plain.read(int(fields["content-length"]))
            if len(block) != int(fields["content-length"]) or plain.read(4) != b"\r\n\r\n":
                raise ValueError("a record is cut off")
            if fields["warc-block-digest"] != f"sha1:{digest32(block)}":
                raise ValueError("a block does not match its digest")
            yield fields, block


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The page records of the files that the manifest in ``folder`` lists, one row per record.

    ``payload`` is null for a revisit; ``payload_bytes`` and ``payload_digest`` are those of the full payload.
    Each task streams its files record by record and checks every block against its digest.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        rows, held = [], 0
        number = lambda x: int(x) if x is not None else None
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for fields, block in parse(stream):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
                        rows.append((number(fields.get("x-page-id")), fields.get("warc-target-uri"), kind, number(fields.get("x-refers-to-page-id")), fields["warc-payload-digest"].removeprefix("sha1:"), length, body if kind == "response" else None))
                        held += len(body)
                        if held > 4 << 20 or len(rows) >= 4096:
                            yield batch_of(rows)
                            rows, held = [], 0
        yield batch_of(rows)

    files = spark.read.parquet(f"{folder}/_manifest").select("file")
    return files.repartition(max(1, files.count()), F.xxhash64("file")).mapInArrow(read, RECORD)


@query("op10_warc_round_trip")
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4()}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
