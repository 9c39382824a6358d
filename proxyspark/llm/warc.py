"""Web archives in compressed WARC files, one Zstandard dictionary per file.

A file starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary
built from the first records of that file; every record after it is a frame of
its own, compressed with that dictionary, so that any record can be read alone.
Pages with equal large payloads are stored once: the page with the largest id
is the ``response``, the others are ``revisit`` records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from itertools import chain

import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyspark.llm.common import rows_batch, shared_folder
from proxyspark.llm.tokenfiles import WholeFile, filesystem

#: Payloads of fewer bytes are always stored in full.
SMALL_PAYLOAD = 1000
#: Pages of one payload, the empty one too, are looked up in so many parts.
SALTS = 32
#: The dictionary of a file is built from at most so many of its first records
#: and bytes, and has at most so many bytes itself.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 4 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"

_DICT_MAGIC = 0x184D2A5D  # fixed value: the skippable frame that holds a dictionary
_PART = "part long, n_records long, n_bytes long"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
_CONTROL = re.compile("[\x00-\x20\x7f]")


def with_revisits(pages: DataFrame, small: int = SMALL_PAYLOAD) -> DataFrame:
    """``page_id, url, payload, payload_digest, refers_to`` of every row.

    Payloads count as equal if their SHA-1 and length are. ``refers_to`` is the
    largest page id with that payload, null for that page itself, for payloads
    of under ``small`` bytes, and for rows that repeat that page's id. Only payloads
    that several rows have are looked up, and copies are dealt by their page's id.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    last = (rows.where(F.col("n_bytes") >= small).groupBy("payload_digest", "n_bytes")
            .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return (rows.join(last, ["payload_digest", "n_bytes", "salt"], "left")
            .withColumn("refers_to", F.when(F.col("last") != F.coalesce("page_id", F.col("last") - 1), F.col("last")))
            .select("page_id", "url", "payload", "payload_digest", "refers_to"))


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of the answer and no payload."""
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else ""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {target or f'urn:page:{page_id}'}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url:
        head.append("Has-URL: 1")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To-Page: {refers_to}",
                 f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from archived records; their plain bytes where they are too
    few or too alike for the builder."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:].rjust(8, b" "),
                                             dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(pages: DataFrame, folder: str, small: int = SMALL_PAYLOAD) -> DataFrame:
    """A record per row of ``pages`` in ``part-NNNNN.warc.zst`` files; returns the
    parts written. Null html is an empty payload; extra columns are ignored;
    an empty table writes no file."""
    rows = with_revisits(pages, small)

    def write(batches):
        part, out, n, size = TaskContext.get().partitionId(), None, 0, 0
        records = (
            record(*row) for b in batches
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(),
                           b.column(3).to_pylist(), b.column(4).to_pylist()))
        samples, taken = [], 0
        for data in records:
            samples.append(data)
            taken += len(data)
            if len(samples) >= SAMPLE_RECORDS or taken >= SAMPLE_BYTES:
                break
        if not samples:
            return
        words = dictionary_of(samples)
        compress = zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=True).compress
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        out = WholeFile(fs, f"{path}/part-{part:05d}.warc.zst")
        out.write(struct.pack("<II", _DICT_MAGIC, len(words.as_bytes())) + words.as_bytes())
        for data in chain(samples, records):
            frame = compress(data)
            out.write(frame)
            n, size = n + 1, size + len(frame)
        out.close()
        yield rows_batch(_PART, [[part], [n], [size]])

    rows.mapInArrow(write, _PART).write.parquet(f"{folder}/parts")
    return read_parts(pages.sparkSession, folder)


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_PART).parquet(f"{folder}/parts")


def records_of(stream, block: int = 1 << 16):
    """The records of one file, a frame at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != _DICT_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    data = stream.read(size)
    kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind))
    rest = b""
    while rest := rest or stream.read(block):
        frame, got = reader.decompressobj(), []
        while True:
            got.append(frame.decompress(rest))
            rest = frame.unused_data
            if frame.eof:
                break
            rest = stream.read(block)
            if not rest:
                raise ValueError("the archive ends within a record")
        yield b"".join(got)


def parse(data: bytes) -> tuple:
    """A record's row, with digest and length taken anew from a stored payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    kind, page = fields["WARC-Type"], fields.get("Page-ID")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size, html, refers_to = int(fields["Payload-Length"]), None, fields.get("WARC-Refers-To-Page")
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"record of page {page}: payload and headers differ")
        html = payload.decode(errors="replace")
    return (page and int(page), size, digest, kind, refers_to and int(refers_to),
            fields["WARC-Target-URI"] if "Has-URL" in fields else None, html)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, html``; the html of a revisit is that of the page referred to
    and is left null. Length and digest are of the bytes as they were given; where these
    are no UTF-8, html has a replacement character."""
    parts = read_parts(spark, folder)
    n = max(1, parts.count())

    def read(batches):
        fs, path = filesystem(folder)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{path}/part-{part:05d}.warc.zst", compression=None) as stream:
                    rows, size = [], 0
                    for data in records_of(stream):
                        rows.append(parse(data))
                        size += len(data)
                        if size > 16 << 20:
                            yield rows_batch(_RECORD, list(zip(*rows)))
                            rows, size = [], 0
                    if rows:
                        yield rows_batch(_RECORD, list(zip(*rows)))

    return parts.repartition(n, "part").mapInArrow(read, _RECORD)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to ``folder`` (by default a new one in the shared folder) and read the archives back."""
    folder = folder or shared_folder(spark, "warc")
    write_archives(pages, folder)
    return read_archives(spark, folder)
