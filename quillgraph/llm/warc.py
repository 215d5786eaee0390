"""WARC archives: a normaliser for monolithic gzip files, a writer and a reader.

An archive is a row run (archive, block, content): its bytes in blocks of bounded size, written by Spark's own writer to any store
Spark reaches, so a lost executor costs a retried task and never half an archive. The normaliser inflates the single gzip stream of
an archive block by block, rewrites every record as a gzip member of its own and lists each member's offset in a sidecar index; it
holds one record and one block at a time. An archive that ends early or cannot be read to its end is reported with what was read and
what was left; its whole records before that place are kept. ``archive_blocks`` reads real files, ``export_files`` writes real files and indexes.
"""
from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.runtime import scratch_path, stage
from quillgraph.llm.common import small_or_joined

BLOCK_BYTES = 1 << 20
ARCHIVE_BYTES = 64 << 20
TASK_BLOCKS = 64
LEVEL = 6
BLOCKS = "archive string, block long, content binary"
ROWS = "archive string, block long, content binary, offset long, length long, record_id string, record_type string, target string, digest string"
_END = b"\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, target: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record with its payload, or a revisit that keeps the HTTP head and names the response."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if target is not None:
        head.append("WARC-Target-URI: " + " ".join(target.splitlines()))
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    else:
        body += payload
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + _END + body + _END


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


class Records:
    """Feeds on inflated bytes and yields whole records; holds the unfinished one only. Raises ValueError on a length that is none."""

    def __init__(self):
        self.rest = bytearray()
        self.need = 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.rest += data
        while len(self.rest) >= max(self.need, 1):
            at = self.rest.find(_END)
            if at < 0:
                return
            head = headers_of(bytes(self.rest[:at]))
            size = at + len(_END) + int(head.get("content-length", 0)) + len(_END)
            if size < at + 2 * len(_END):
                raise ValueError("negative length")
            if len(self.rest) < size:
                self.need = size
                return
            yield head, bytes(self.rest[:size])
            del self.rest[:size]
            self.need = 0


def member(raw: bytes) -> bytes:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def _column_rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows that hold about one block of content."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row[2] or b"")
        if size >= BLOCK_BYTES:
            yield pa.record_batch([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema=schema)


_BLOCK_SCHEMA = pa.schema([("archive", pa.string()), ("block", pa.int64()), ("content", pa.binary())])
_ROW_SCHEMA = pa.schema([("archive", pa.string()), ("block", pa.int64()), ("content", pa.binary()), ("offset", pa.int64()), ("length", pa.int64()),
                         ("record_id", pa.string()), ("record_type", pa.string()), ("target", pa.string()), ("digest", pa.string())])


def _monolithic(batches):
    """Records to archives, each one gzip stream; a new archive starts after ARCHIVE_BYTES."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()

    def rows():
        roll, block, seen, out, squeeze = 0, 0, 0, bytearray(), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for record_id, target, payload, refers_to in _column_rows(batches, ["record_id", "target", "payload", "refers_to"]):
            if seen >= ARCHIVE_BYTES:
                out += squeeze.flush()
                yield f"{part:06d}-{roll:05d}", block, bytes(out)
                roll, block, seen, out, squeeze = roll + 1, 0, 0, bytearray(), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            raw = record_bytes(record_id, target, (payload or "").encode(), refers_to)
            out += squeeze.compress(raw)
            seen += len(raw)
            while len(out) >= BLOCK_BYTES:
                yield f"{part:06d}-{roll:05d}", block, bytes(out[:BLOCK_BYTES])
                del out[:BLOCK_BYTES]
                block += 1
        if seen:
            out += squeeze.flush()
            yield f"{part:06d}-{roll:05d}", block, bytes(out)
    yield from _batches(rows(), _BLOCK_SCHEMA)


class Normaliser:
    """Takes the blocks of one archive in order and gives block rows (content set), index rows (offset set) and, where the archive is
    damaged, one row with neither: bytes read under block, bytes left of an unfinished record under length, the reason as type."""

    def __init__(self, name: str):
        self.name, self.records, self.out = name, Records(), bytearray()
        self.inflate, self.read, self.offset, self.block, self.wrong = zlib.decompressobj(47), 0, 0, 0, None

    def _kept(self, plain: bytes) -> Iterator[tuple]:
        for head, raw in self.records.feed(plain):
            own = member(raw)
            digest = head.get("warc-payload-digest", "")
            yield (self.name, self.block, None, self.offset, len(own), head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), digest.removeprefix("sha1:") or None)
            self.out += own
            self.offset += len(own)
            if len(self.out) >= BLOCK_BYTES:
                yield from self._flushed()

    def _flushed(self) -> Iterator[tuple]:
        if self.out:
            yield (self.name, self.block, bytes(self.out), *[None] * 6)
            self.out, self.block = bytearray(), self.block + 1

    def take(self, data: bytes) -> Iterator[tuple]:
        if self.wrong:
            return
        self.read += len(data)
        try:
            while data:
                if self.inflate.eof:  # a file that already has several members
                    self.inflate = zlib.decompressobj(47)
                plain = self.inflate.decompress(data, BLOCK_BYTES)
                data = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
                yield from self._kept(plain)
        except (zlib.error, ValueError) as e:
            self.wrong = f"unreadable: {e}"

    def finish(self) -> Iterator[tuple]:
        try:
            while not self.wrong and not self.inflate.eof and (plain := self.inflate.decompress(b"", BLOCK_BYTES)):
                yield from self._kept(plain)
        except (zlib.error, ValueError) as e:
            self.wrong = f"unreadable: {e}"
        yield from self._flushed()
        if not self.wrong and not self.inflate.eof:
            self.wrong = "the stream has no end"
        if not self.wrong and self.records.rest:
            self.wrong = "the last record has no end"
        if self.wrong:
            yield (self.name, self.read, None, None, len(self.records.rest), None, self.wrong, None, None)


def _normalised(batches):
    def rows():
        at = None
        for archive, _, content in _column_rows(batches, ["archive", "block", "content"]):
            if at is None or archive != at.name:
                if at:
                    yield from at.finish()
                at = Normaliser(archive)
            yield from at.take(content)
        if at:
            yield from at.finish()
    yield from _batches(rows(), _ROW_SCHEMA)


def write_archives(records: DataFrame) -> DataFrame:
    """records (record_id, target, payload string, refers_to) -> monolithic archives as a written block table."""
    return stage(records.select("record_id", "target", "payload", "refers_to").mapInArrow(_monolithic, BLOCKS), "warc-raw")


def archive_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Real .warc.gz files as a block table; Spark's reader holds one whole file at a time."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    number = F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / BLOCK_BYTES).cast("int") - 1))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), number.alias("n"), "content").select(
        "archive", F.col("n").cast("long").alias("block"), F.substring("content", F.col("n") * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES)).alias("content"))


def normalise(blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, index, damaged) of the rewritten archives: blocks (archive, block, content) of whole members; per record (archive,
    block, offset, length, record_id, record_type, target, digest), offsets counted from the archive's first byte; and per archive
    that could not be read to its end (archive, bytes_read, bytes_left, reason), where bytes_left counts the inflated bytes of the
    record that has no end. Tasks hold about ``TASK_BLOCKS`` blocks each, however many archives there are."""
    spark = blocks.sparkSession
    path = scratch_path(spark, "warc")
    tasks = -(-blocks.count() // TASK_BLOCKS)
    placed = blocks.repartition(tasks, "archive") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else blocks.repartition("archive")
    rows = placed.sortWithinPartitions("archive", "block").mapInArrow(_normalised, ROWS).withColumn(
        "kind", F.when(F.col("content").isNotNull(), "data").when(F.col("offset").isNotNull(), "index").otherwise("damaged"))
    rows.write.partitionBy("kind").parquet(path)
    every = spark.read.schema(f"{ROWS}, kind string").parquet(path)
    damaged = every.filter("kind = 'damaged'").select("archive", F.col("block").alias("bytes_read"), F.col("length").alias("bytes_left"), F.col("record_type").alias("reason"))
    return every.filter("kind = 'data'").select("archive", "block", "content"), every.filter("kind = 'index'").drop("kind", "content"), damaged


def must_be_whole(damaged: DataFrame) -> None:
    """Raises ValueError if an archive is damaged; names ten of them at most."""
    found = damaged.orderBy("archive").limit(10).collect()
    if found:
        raise ValueError("damaged archives: " + "; ".join(f"{r.archive} ({r.reason}, {r.bytes_read} bytes read, {r.bytes_left} left)" for r in found))


def read_records(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """(record_id, record_type, refers_to, payload_bytes, payload_digest, payload): every record fetched by its index entry from its
    block, inflated alone and checked against its digest. A revisit has no payload; its size is that of the response it names."""
    entries = index.groupBy("archive", "block").agg(F.min("offset").alias("base"), F.collect_list(F.struct("offset", "length")).alias("entries"))

    def run(batches):
        names = ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        batch_of = lambda out: pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)
        for batch in batches:
            for content, base, wanted in _column_rows(iter([batch]), ["content", "base", "entries"]):
                out, held = [], 0
                for e in wanted:
                    a = e["offset"] - base
                    raw = zlib.decompress(content[a:a + e["length"]], 31)
                    head_end = raw.index(_END)
                    head, body = headers_of(raw[:head_end]), raw[head_end + 4:-4]
                    http_end = body.index(_END)
                    size = int(headers_of(body[:http_end])["content-length"])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    payload = body[http_end + 4:] if head["warc-type"] == "response" else None
                    if payload is not None and (len(payload) != size or digest_of(payload) != digest):
                        raise ValueError(f"damaged record {head['warc-record-id']}")
                    out.append((head["warc-record-id"], head["warc-type"], head.get("warc-refers-to"), size, digest, payload))
                    held += len(raw)
                    if held >= BLOCK_BYTES:  # a block of well-packing records inflates to many times its size
                        yield batch_of(out)
                        out, held = [], 0
                yield batch_of(out)
    return blocks.join(entries, ["archive", "block"]).select("content", "base", "entries").mapInArrow(
        run, "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def export_files(blocks: DataFrame, index: DataFrame, folder: str) -> None:
    """Writes <archive>.warc.gz and <archive>.idx (offset, length, record id per line) to a folder mounted on all executors. A file
    appears under its name only when whole, so retried tasks do no harm."""
    def put(batches):
        name, file = None, None
        for batch in batches:
            for archive, _, line, content in _column_rows(iter([batch]), ["archive", "at", "line", "content"]):
                for suffix, data in ((".warc.gz", content), (".idx", line.encode() if line else None)):
                    if data is not None:
                        key = archive + suffix
                        if key != name:
                            if file:
                                file.close()
                                os.replace(file.name, os.path.join(folder, name))
                            name, file = key, open(os.path.join(folder, f".{key}.{os.getpid()}"), "wb")
                        file.write(data)
        if file:
            file.close()
            os.replace(file.name, os.path.join(folder, name))
        yield pa.record_batch([pa.array([], pa.int64())], names=["n"])
    line = F.concat_ws("\t", "offset", "length", "record_id")
    rows = (blocks.select("archive", F.lit(0).alias("kind"), F.col("block").alias("at"), F.lit(None).cast("string").alias("line"), "content")
            .unionByName(index.select("archive", F.lit(1).alias("kind"), F.col("offset").alias("at"), F.concat(line, F.lit("\n")).alias("line"), F.lit(None).cast("binary").alias("content"))))
    rows.repartition("archive").sortWithinPartitions("archive", "kind", "at").mapInArrow(put, "n long").count()


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """record_id, target, payload, refers_to per page. Of equal payloads of at least ``least_bytes`` bytes the record with the
    smallest page_id is the response and the others revisit it.

    A null html is an empty payload. A null page_id is never the smallest, except among nulls alone: those are all responses.
    Repeated rows of the smallest page_id are all responses. Only digests are grouped, so a payload that a third of all pages
    share costs one partial row per task.
    """
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target"), payload.alias("payload"),
                         F.unhex(F.sha1(payload.cast("binary"))).alias("sha"), F.octet_length(payload).alias("bytes"))
    first = given.filter(F.col("bytes") >= least_bytes).groupBy("sha", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("sha").alias("_s"), F.col("bytes").alias("_b"), "first")

    joined = given.join(small_or_joined(first), (F.col("sha") == F.col("_s")) & (F.col("bytes") == F.col("_b")), "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(urn(F.col("page_id")).alias("record_id"), "target", "payload", F.when(other, urn(F.col("first"))).alias("refers_to"))


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, "page:(-?[0-9]+)>", 1).try_cast("long")


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages to archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to, one row per page. An empty
    table gives no rows; very long pages are kept whole; other columns are dropped. A damaged archive is an error."""
    blocks, index, damaged = normalise(write_archives(with_revisits(pages, least_bytes)))
    must_be_whole(damaged)
    got = read_records(blocks, index)
    return got.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
