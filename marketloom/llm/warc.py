"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame a record.

Writers put whole archives of bounded size into a folder that all executors share, and list them in a
manifest; readers take archives from the manifest and decode one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Tables, likely

#: Fixed values of the format: the skippable frame's magic number and those of a frame and of a dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records and bytes after which an archive is closed, and records that its dictionary is fitted on.
RECORDS, BYTES, SAMPLE = 4000, 64 << 20, 200
#: Archives that one task reads, where there are many.
READ = 4


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_dictionary(payloads: list[bytes]) -> bytes:
    """Trained on the payloads given; where they are too few, their own bytes serve as a raw one."""
    some = [p[:16384] for p in payloads if p]
    if len(some) >= 20:
        try:
            return zstandard.train_dictionary(32768, some, k=200, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(some)[-32768:] or b"WARC/1.1\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit keeps the HTTP head alone, whose Content-Length still is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:x-page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": "".join(c for c in url or "" if c not in "\r\n"),
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{sha}",
        **({"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:x-page:{refers_to}>"} if revisit else {}),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers, block and HTTP length; raises ValueError where one of them is not as stated."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {raw[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    for need in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if need not in fields:
            raise ValueError(f"no {need}")
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes; {size} stated")
    http, found, payload = rest[:size].partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/1."):
        raise ValueError("no HTTP head")
    stated = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != stated or digest(payload) != sha):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is not as stated")
    return fields | {"payload": payload, "payload_bytes": stated, "payload_digest": sha}


def page_of(uri: str) -> int | None:
    return int(x) if (x := uri.removeprefix("<urn:x-page:").removesuffix(">")) else None


class Writer:
    """An archive that is written record by record."""

    def __init__(self, out, dictionary: bytes):
        self.out = out
        out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)

    def add(self, raw: bytes) -> None:
        self.out.write(self.compressor.compress(raw))


def read_archive(source, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The decoded frames of an archive, one after another; memory holds one frame.

    The dictionary may itself be a Zstandard frame. A file that ends within a frame raises ValueError.
    """
    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError(f"no leading skippable frame: {magic:#x}")
    raw = source.read(size)
    if len(raw) != size:
        raise ValueError("the dictionary is cut short")
    if raw[:4] == struct.pack("<I", FRAME):
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
    frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    rest = source.read(chunk)
    while rest:
        frame, parts = frames.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise ValueError("the archive ends within a frame")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else source.read(chunk)
        yield b"".join(parts)
        rest = rest or source.read(chunk)


#: Names that Spark has for stores which the library of archives' files knows by another.
STORES = {"s3a": "s3", "s3n": "s3"}


def library_uri(uri: str) -> str:
    """A path of Spark's as that library has it: a store's own name, and three slashes before a local path."""
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return uri
    if scheme == "file" and not rest.startswith("//"):
        rest = "//" + rest
    return f"{STORES.get(scheme, scheme)}:{rest}"


def write_archives(tables: Tables, records: DataFrame) -> DataFrame:
    """Writes (page_id, url, html, key, refers_to, revisit), key the SHA-1 of html, and returns the saved manifest (path, records, bytes).

    A file's name holds the task attempt, so that an attempt run again never writes over a listed file,
    and what a failed attempt leaves is never listed.
    """
    folder = tables.path("warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(library_uri(folder))
        fs.create_dir(base, recursive=True)
        rows = (r for b in batches for at in range(0, b.num_rows, 256) for r in b.slice(at, 256).to_pylist())
        nth = 0
        row = next(rows, None)
        while row is not None:
            waiting = []
            while row is not None and len(waiting) < SAMPLE:
                waiting.append(row)
                row = next(rows, None)
            name = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}-{nth:04d}.warc.zst"
            nth += 1
            with fs.open_output_stream(name) as out:
                to = Writer(out, make_dictionary([(r["html"] or "").encode() for r in waiting if not r["revisit"]]))
                count = size = 0
                waiting.reverse()
                while waiting or row is not None and count < RECORDS and size < BYTES:
                    if waiting:
                        r = waiting.pop()
                    else:
                        r, row = row, next(rows, None)
                    payload = (r["html"] or "").encode()
                    to.add(record(r["page_id"], r["url"], payload, base64.b32encode(r["key"]).decode(), len(payload), r["refers_to"], r["revisit"]))
                    count, size = count + 1, size + len(payload)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{os.path.basename(name)}"], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return tables.save(records.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) a record of the listed archives.

    Raises ValueError where a header, a length, a digest or the number of records is not as stated.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def rows(path: str, count: int) -> Iterator[tuple]:
        fs, at = pafs.FileSystem.from_uri(library_uri(path))
        with fs.open_input_stream(at) as f:
            n = 0
            for n, raw in enumerate(read_archive(f), 1):  # noqa: B007
                r = parse(raw)
                revisit = r["WARC-Type"] == "revisit"
                yield (page_of(r["WARC-Record-ID"]), r["WARC-Target-URI"], r["payload_bytes"], r["payload_digest"], r["WARC-Type"], page_of(r["WARC-Refers-To"]) if revisit else None, *([r["payload"]] * with_payload))
            if n != count:
                raise ValueError(f"{path} has {n} records; {count} are listed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.to_pylist():
                part: list[tuple] = []
                for r in rows(m["path"], m["records"]):
                    part.append(r)
                    if len(part) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)
                        part = []
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    tasks = max(2, manifest.sparkSession.sparkContext.defaultParallelism, manifest.count() // READ)
    return manifest.select("path", "records").repartition(tasks, "path").mapInArrow(run, schema)


#: Rows of one payload that a task may join, at least, and payloads with more rows than that at most.
COPIES, HOT = 10_000, 100_000


def mark_revisits(tables: Tables, pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) beside key (the payload's SHA-1), refers_to and revisit.

    Of equal payloads (null html: empty) the row with the largest page_id is the response and the
    others revisit it. Rows that share that id are all responses, as are payloads whose ids are all null.
    Payloads that occur once are not shuffled, but for their digests. Those with the most rows, of which
    there are HOT at most at any input, are broadcast; a join brings the others theirs.
    """
    keyed = pages.select("page_id", "url", "html", F.unhex(F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8"))).alias("key"))
    counts = keyed.groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    twice = tables.save(counts.where("n > 1 AND last IS NOT NULL"), "twice")
    most = max(COPIES, (twice.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = twice.where(F.col("n") > most).select("key", F.col("last").alias("hot"))
    cold = twice.where(F.col("n") <= most).select("key", "last")
    asked = likely(keyed.join(F.broadcast(hot), "key", "left"), "key", cold.select("key"), "_cold")
    met = asked.where("_cold AND hot IS NULL").join(cold, "key", "left").select("page_id", "url", "html", "key", "last")
    out = met.union(asked.where("NOT _cold OR hot IS NOT NULL").select("page_id", "url", "html", "key", "hot"))
    revisit = F.coalesce(~F.col("last").eqNullSafe(F.col("page_id")) & F.col("last").isNotNull(), F.lit(False))
    return out.select("page_id", "url", "html", "key", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives pages and returns what reading the archives back gives, a row a page.

    A null html is an empty payload, a null url an empty one; line ends in urls are left out. Null ids
    stay null and are never referred to while others share the payload. Repeated rows are records each.
    Other columns are not archived. An empty table gives no archive and no row.
    """
    tables = Tables(spark)
    marked = mark_revisits(tables, pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    return read_archives(write_archives(tables, marked))
