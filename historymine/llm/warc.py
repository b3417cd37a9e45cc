"""WARC archives of dictionary-compressed records, written and read by Spark.

A file is a sequence of Zstandard frames: first a skippable frame that holds
the dictionary, then one frame per record, each of which can be decompressed
alone with that dictionary. Files are written through Spark's text sink, so any
store Spark can write to will do and a repeated task replaces its file: a frame
is one value, and the line separator is itself an empty skippable frame, which
every Zstandard reader passes over.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from historymine.llm.common import hash_share, map_rows
from historymine.session import scratch_path

DICTIONARY_MAGIC = 0x184D2A5D  # fixed value: the skippable frame that holds a dictionary
SEPARATOR = "P*M\x18\x00\x00\x00\x00"  # an empty skippable frame with magic 0x184D2A50
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_BYTES = 64 << 10
SAMPLED_RECORDS = 1_000  # bounds what the dictionary is built from ...
SAMPLED_RECORD_BYTES = 64 << 10  # ... together with this: longer records are archived, not sampled
LEAST_REVISIT_BYTES = 1_000
DATE = "2024-01-01T00:00:00Z"
RECORD_URI = "urn:record:"


def _header(lines: list[tuple[str, str]], first: str) -> bytes:
    return "".join([first, "\r\n", *[f"{k}: {v}\r\n" for k, v in lines], "\r\n"]).encode()


def _uri(url: str | None) -> str:
    """A URL fit for a header line: white space and control characters are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:unknown")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit, which repeats the HTTP header and names the response."""
    revisit = refers_to is not None
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    name = lambda i: f"<{RECORD_URI}{'' if i is None else i}>"
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    return _header(lines, "WARC/1.1") + block + b"\r\n\r\n"


def _fields(header: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in header.decode().split("\r\n")[1:])


def parse_record(record: bytes) -> tuple:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)``; a revisit has no payload of its own."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda key: int(n) if (n := fields[key][1 + len(RECORD_URI) : -1]) else None
    length = int(_fields(http)["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return (
        number("WARC-Record-ID"), fields["WARC-Target-URI"], length, digest, fields["WARC-Type"],
        number("WARC-Refers-To") if revisit else None, None if revisit else payload,
    )


def skippable(content: bytes, magic: int = DICTIONARY_MAGIC) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def frames(content: bytes) -> Iterator[tuple[int, int, int]]:
    """``(magic, start, end)`` of each frame: block headers give the lengths, nothing is decompressed."""
    at = 0
    while at < len(content):
        magic, length = struct.unpack_from("<II", content, at) if at + 8 <= len(content) else (FRAME_MAGIC, 0)
        if magic >> 4 == 0x184D2A5:
            end = at + 8 + length
        else:
            parameters = zstandard.get_frame_parameters(content[at : at + 18])
            end = at + zstandard.frame_header_size(content[at : at + 18])
            last = False
            while not last:
                block = int.from_bytes(content[end : end + 3], "little")
                last, kind, size = block & 1, block >> 1 & 3, block >> 3
                end += 3 + (1 if kind == 1 else size)
            end += 4 * parameters.has_checksum
        yield magic, at, end
        at = end


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Train on whole records; where they are too few or too small to train on, their bytes serve as raw content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def plan_records(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``(page_id, url, payload, sha1, refers_to)``: who is archived in full and who revisits.

    Only digests are grouped; html moves once, by its unique page id.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    keyed = rows.select("page_id", "sha1", F.octet_length("payload").alias("n"), F.md5("payload").alias("md5")).where(F.col("n") >= least_bytes)
    same = ["sha1", "n", "md5"]
    winners = keyed.groupBy(*same).agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisits = keyed.join(winners.drop("copies"), same).where("page_id <> winner").select("page_id", "sha1", F.col("winner").alias("refers_to")).distinct()
    return rows.join(revisits, ["page_id", "sha1"], "left")


def write_archives(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write a record per page to WARC files below ``path``.

    The dictionary is trained on a bounded sample of archived records: about
    ``SAMPLED_RECORDS`` chosen by a hash of the page id, of at most
    ``SAMPLED_RECORD_BYTES`` each. Every record is written, of any length, one
    file per partition.

    Null html counts as an empty payload. A page without id is written under an
    empty record name, always as a response. Rows with the id and payload of the
    chosen response are all responses. A null url becomes ``urn:unknown``.
    An empty table writes no record.
    """
    n_pages = pages.count()
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    picked = rows.where(hash_share(F.col("page_id"), SAMPLED_RECORDS, n_pages) & (F.octet_length("payload") <= SAMPLED_RECORD_BYTES))
    samples = sorted(record_bytes(r[0], r[1], bytes(r[2]), r[3], None, date) for r in picked.withColumn("sha1", F.sha1("payload")).collect())
    dictionary = build_dictionary(samples)

    def pack():
        compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        opened = False

        def one(row):
            nonlocal opened
            page_id, url, payload, sha1, refers_to = row
            if not opened:  # a task writes one file
                yield (skippable(dictionary),)
                opened = True
            yield (compressor.compress(record_bytes(page_id, url, payload, sha1, refers_to, date)),)

        return one

    packed = map_rows(plan_records(pages).select("page_id", "url", "payload", "sha1", "refers_to"), pack, "frame binary")
    packed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)`` of every record below ``path``."""

    def unpack():
        def one(row):
            content, decompressor = row[0], zstandard.ZstdDecompressor()
            for magic, start, end in frames(content):
                if magic == DICTIONARY_MAGIC:
                    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[start + 8 : end]))
                elif magic == FRAME_MAGIC:
                    yield parse_record(decompressor.decompress(content[start:end]))

        return one

    files = spark.read.format("binaryFile").load(path).select("content")
    return map_rows(files, unpack, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared scratch folder and read their records back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
