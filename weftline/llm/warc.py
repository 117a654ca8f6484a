"""WARC archives in Zstandard: one frame for each record, the dictionary in the leading skippable frame.

Writing: each task streams its rows into archives of bounded size under a folder that all executors share.  A dictionary is
trained on the first records of the archive, put into a skippable frame (magic 0x184D2A5D) at its start, and used by every
frame that follows.  Files carry a fresh name for each attempt and count only if the manifest, which Spark commits, names
them; so a retried task or a lost executor leaves no half archive in the result.

Reading: one archive is one unit of work.  The reader loads the dictionary, decodes frame by frame from a stream, and checks
of each record: the version line, the required headers, that the block is as long as Content-Length says, the closing blank
lines, that the frame holds nothing else, and the digests.  A fault raises ``ValueError``; nothing is skipped.

Defined cases: a null payload is an empty one; a null id is written without its header and read back as null; an empty table
makes no archive and reads as no rows.  Rows that share the largest id of their payload are all responses.  A very long
payload is one record, and the most that a task holds beside its buffer.  Other columns play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import new_dir

#: Fixed by the format of compressed archives.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT = 1000
SALTS = 32
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def planned(pages: DataFrame, id_col: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest and refers_to of each record to write.

    Only payloads that occur more than once meet the rows again, and both sides are salted: a payload that a third of all
    rows share is dealt over SALTS keys.  The maximum for each payload is aggregated before the shuffle.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("salt", F.pmod(F.hash("page_id"), F.lit(SALTS)))
    long = F.length("payload") >= min_bytes
    same = rows.where(long).groupBy("digest").agg(F.max("page_id").alias("of"), F.count("*").alias("n")).where("n > 1")
    same = same.select("digest", "of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = rows.join(same, ["digest", "salt"], "left")
    return met.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("of")), F.col("of")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest if page_id is None else ''}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One whole record.  A revisit has the HTTP header of its response and no payload, so its length is known too."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = [] if url is None else [f"WARC-Target-URI: {''.join(url.split())}"]  # a header is one line
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    head += target + ([] if page_id is None else [f"WARC-Page-ID: {page_id}"])
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most size bytes, or raw content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\r\n\r\n"


def write_archives(records: DataFrame, path: str, archive_bytes: int = 64 << 20, dict_bytes: int = 32 << 10, sample_bytes: int = 1 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Archives of about archive_bytes of records each under path; returns the manifest (file, n_records) as a table.

    records: as from planned().  Memory of a task: the sample that trains a dictionary, and one compressed buffer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        held: list[bytes] = []
        state: dict = {"size": 0, "out": None}

        def opened() -> None:
            raw = trained([x[:8192] for x in held], dict_bytes)
            state["name"] = f"{uuid.uuid4().hex}.warc.zst"
            state["out"] = fs.open_output_stream(f"{root}/{state['name']}", compression=None)  # not what the suffix says
            packed = zstandard.ZstdCompressor(level=19).compress(raw)
            state["out"].write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
            state["n"] = state["written"] = 0
            state["coder"] = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True, write_checksum=True)

        def flushed() -> None:
            if held and state["out"] is None:
                opened()
            for x in held:
                state["out"].write(state["coder"].compress(x))
                state["n"] += 1
                state["written"] += len(x)
            held.clear()
            state["size"] = 0

        def closed() -> None:
            if state["out"] is not None:
                state["out"].close()
                done.append((f"{path}/{state['name']}", state["n"]))
                state["out"] = None

        for batch in batches:
            for row in batch.to_pylist():
                x = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], date)
                held.append(x)
                state["size"] += len(x)
                if state["out"] is not None or state["size"] >= sample_bytes:
                    flushed()
                if state["out"] is not None and state["written"] >= archive_bytes:
                    closed()
        flushed()
        closed()
        yield pa.RecordBatch.from_pydict({"file": pa.array([x[0] for x in done], pa.string()), "n_records": pa.array([x[1] for x in done], pa.int64())})

    spark = records.sparkSession
    records.mapInArrow(run, "file string, n_records long").write.parquet(f"{path}/manifest")
    return spark.read.schema("file string, n_records long").parquet(f"{path}/manifest")


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The content of each frame of an archive, in order, from a stream with read(n)."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    raw = stream.read(size)
    if len(raw) != size:
        raise ValueError("the dictionary frame is cut off")
    if raw[:4] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 30)
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    rest = b""
    while True:
        frame, parts = coder.decompressobj(), []
        while not frame.eof:
            rest = rest or stream.read(chunk)
            if not rest:
                if parts:
                    raise ValueError("the last frame is cut off")
                return
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def parsed(data: bytes) -> dict:
    """The fields of the one record that a frame holds; ValueError for anything that a valid record is not."""
    head, gap, body = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    if missing := [x for x in REQUIRED if x.lower() not in fields]:
        raise ValueError(f"missing headers: {missing}")
    if not fields["content-length"].isdigit() or len(body) != int(fields["content-length"]) + 4 or body[-4:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(body) - 4} bytes; Content-Length is {fields['content-length']}")
    http, gap, payload = body[:-4].partition(b"\r\n\r\n")
    lengths = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or not lengths:
        raise ValueError("no HTTP header with a length")
    kind, size = fields["warc-type"], int(lengths[0])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    number = lambda x: int(fields[x]) if x in fields else None
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload is not what its length and digest say")
    if kind == "revisit" and (payload or number("warc-refers-to-page-id") is None):
        raise ValueError("a revisit has a payload, or refers to nothing")
    if kind not in ("response", "revisit"):
        raise ValueError(f"unknown type {kind!r}")
    return {"page_id": number("warc-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to-page-id"), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives named in files.file; without payload that column is null, though it is still checked."""
    columns = [x.split() for x in RECORD.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, types[kind]) for name, kind in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                fs, path = pa.fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        row = parsed(data)
                        rows.append(row if payload else row | {"payload": None})
                        size += len(data) if payload else 200
                        if size > 8 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, files.count())
    return files.select("file").repartition(min(n, 4096)).mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, payload: bool = False, **names: str) -> DataFrame:
    """Writes a record for each row, then reads all archives back."""
    return read_archives(write_archives(planned(pages, **names), new_dir(pages.sparkSession, "warc")), payload)
