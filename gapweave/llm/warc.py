"""WARC archives compressed record by record with a shared Zstandard dictionary.

``write`` lays a frame of pages out as WARC/1.1 files in a folder. A file begins with a skippable
frame holding the dictionary (magic 0x184D2A5D, the dictionary itself a Zstandard frame), followed by
one Zstandard frame per record, so that a reader can seek to any record. ``read`` gives the records back.

Of pages with equal payloads of at least ``least`` bytes, the one with the largest id is stored as a
response and the others as revisits that name it. Null ids are the smallest; of equal ids the largest target counts, and of rows
that are equal in both one is the response. A null payload counts as empty, a null url as an
empty target. No pages give no archive.

The dictionary is made before the archives, from records picked by hash over all pages, long ones from anywhere within; it stands in front
of every file.

Files are written through the file system of the folder's URI, each under a name of its attempt; the
manifest, a table that Spark commits, names the files that count. Leftovers of lost tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm.files import opened
from gapweave.llm.skew import join_counted
from gapweave.llm.tokens import column
from gapweave.session import settle_table

SKIPPABLE = 0x184D2A5D
#: Bytes of an archive after which the next begins; of records that the dictionary is trained on, some, and at most of
#: one record; and its size.
FILE_BYTES, TRAIN_BYTES, PIECE_BYTES, DICTIONARY_BYTES = 64 << 20, 2 << 20, 1 << 14, 64 << 10
LEVEL = 5
DATE = "2024-01-01T00:00:00Z"
KINDS = ("response", "revisit")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan(pages: DataFrame, page_id: str = "page_id", payload: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """id, target, payload, kind, refers_to of every page. Only ids and digests meet by digest, and those of very frequent payloads stay where
    they are; pages that are equal in all of it travel once, with their number."""
    own = F.coalesce(F.col(payload), F.lit(""))
    page = F.struct(F.col(page_id).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("target"), F.unhex(F.sha1(own)).alias("digest"))
    rows = pages.select(page.alias("k"), own.alias("payload"))
    ids = settle_table(rows.groupBy("k").agg(F.count("*").alias("copies"), F.max(F.octet_length("payload")).alias("size")), "page-ids")
    ids = ids.select("k", F.col("k.digest").alias("digest"), "copies", "size")
    repeated = ids.where(F.col("size") >= least).groupBy("digest").agg(
        F.sum("copies").alias("n"), F.count("*").alias("rows"), F.max(F.struct(F.col("k.id").alias("id"), F.col("k.target").alias("target"))).alias("last")).where("n > 1").drop("n")
    met = join_counted(ids.select("k", "digest"), settle_table(repeated, "payloads"), "digest", "rows", ids.count()).where("last IS NOT NULL").select("k", "last")
    whole = rows.groupBy("k").agg(F.first("payload").alias("payload"), F.count("*").alias("copies")).join(met, "k", "left")
    each = whole.select("k", "payload", "last", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    again = F.col("last").isNotNull() & ~((F.struct(F.col("k.id").alias("id"), F.col("k.target").alias("target")) == F.col("last")) & (F.col("copy") == 1))
    return each.select("k.id", "k.target", "payload", F.when(again, KINDS[1]).otherwise(KINDS[0]).alias("kind"), F.when(again, F.col("last.id")).alias("refers_to"))


def dictionary(pages: DataFrame, payload: str = "html") -> bytes:
    """A dictionary from about TRAIN_BYTES of records, picked by hash over all pages; of a long one a piece from anywhere within."""
    own = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    taken = F.least(F.octet_length(own), F.lit(PIECE_BYTES))
    total = pages.agg(F.sum(taken)).first()[0] or 0
    if not total:
        return _dictionary([])
    h, grain = F.xxhash64(own, *[F.col(c).cast("string") for c in ("page_id", "url") if c in pages.columns]), 1 << 30
    begin = F.pmod(F.shiftright(h, 31), F.greatest(F.octet_length(own) - PIECE_BYTES, F.lit(0)) + 1).cast("int") + 1
    picked = pages.where(F.pmod(h, F.lit(grain)) < int(min(1.0, TRAIN_BYTES / total) * grain))
    pieces = picked.select(h.alias("h"), F.substring(own, begin, F.lit(PIECE_BYTES)).alias("x")).collect()
    return _dictionary([_record("response", f"<urn:page:{i}>", "http://", payload_digest(r["x"]), bytes(r["x"]), str(i), None) for i, r in enumerate(sorted(pieces, key=lambda r: (r["h"], bytes(r["x"]))))])


def _record(kind: str, record_id: str, target: str, digest: str, payload: bytes, page: str, refers: str | None) -> bytes:
    """One record. The payload of a response follows an HTTP header; a revisit has the header alone."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        body += payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", "".join(c for c in target if c >= " ")),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("X-Page-ID", page), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), *([("WARC-Refers-To", f"<urn:page:{refers}>")] if refers is not None else [])]
    head.append(("Content-Length", str(len(body))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained on the samples; too few or too uniform ones give their own bytes as the dictionary."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def write(planned: DataFrame, folder: str, trained: bytes) -> DataFrame:
    """Write the archives with that dictionary; returns the manifest (path, records, bytes), itself a table."""
    inner = zstandard.ZstdCompressor(level=LEVEL).compress(trained)
    frame = struct.pack("<II", SKIPPABLE, len(inner)) + inner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        out, made = None, []
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained))
        for batch in batches:
            ids, targets, kinds, refers = (column(batch, c).to_pylist() for c in ("id", "target", "kind", "refers_to"))
            records = []
            for i, page in enumerate(column(batch, "payload")):
                data = page.as_buffer().to_pybytes()
                ref = None if refers[i] is None else str(refers[i])
                records.append(_record(kinds[i], f"<urn:page:{ids[i]}>", targets[i], payload_digest(data), data, "" if ids[i] is None else str(ids[i]), ref))
            for r in records:
                if out is None:
                    path = f"{root.rstrip('/')}/part-{part:05d}-{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(path, compression=None)
                    out.write(frame)
                    made.append([path, 0, len(frame)])
                packed = coder.compress(r)
                out.write(packed)
                made[-1][1] += 1
                made[-1][2] += len(packed)
                if made[-1][2] >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        for path, n, size in made:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    return settle_table(planned.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record of one archive."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary in front")
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(stream.read(size)))
    reader = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=words).stream_reader(stream, read_across_frames=True), 1 << 20)
    while line := reader.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := reader.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            fields[name] = value.strip()
        body = reader.read(int(fields["Content-Length"]))
        if reader.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")
        yield fields, body


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """page (text of the id), target, record_type, payload_digest, payload_bytes, refers_to, payload
    (null for a revisit), of every record of the manifest's files. Digests are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page", "target", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in column(batch, "path").to_pylist():
                fs, at = opened(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for f, body in _records(stream):
                        payload = body.partition(b"\r\n\r\n")[2]
                        digest, refers = f["WARC-Payload-Digest"].removeprefix("sha1:"), f.get("WARC-Refers-To")
                        if f["WARC-Type"] == "response" and payload_digest(payload) != digest:
                            raise ValueError(f"payload of {f['WARC-Record-ID']} is damaged")
                        rows.append((f["X-Page-ID"] or None, f["WARC-Target-URI"], f["WARC-Type"], digest, int(f["X-Payload-Length"]),
                                     refers and refers[len("<urn:page:"):-1], payload.decode() if f["WARC-Type"] == "response" else None))
                        held += len(body)
                        if held > 8 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(run, "page string, target string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload string")


def digests(pages: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back."""
    kind = pages.schema["page_id"].dataType
    back = read(pages.sparkSession, write(plan(pages), folder, dictionary(pages)))
    return back.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
