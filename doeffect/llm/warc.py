"""Dictionary-compressed WARC writer and reader.

A Zstandard dictionary is trained on pieces of the payloads and stored in a
leading skippable frame of every archive, before a ``warcinfo`` record; each
record is a frame of its own, so one record can be read without the others.
Of records with equal payloads (of at least ``LEAST`` bytes) the one with the
smallest id is a response, the others are revisits that refer to it and repeat
no payload.

The sample is of pieces from anywhere in the payloads, those of least hash
over all pieces of all distinct payloads.  It is bounded, as the dictionary
is: a hundred times its size is what training makes use of.  Only compression
depends on it.

Every task writes its archive under a name of its own attempt and renames
it when it is complete, so a lost executor leaves no half archive behind.

NULL html is an empty payload.  A NULL id is no smallest id (unless no other
has the payload); repeated rows with the smallest id are all responses, with
record ids of their own, and revisits then name their url and date alone.
NULL urls leave their header out.  An empty table gives no archives.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_dir

LEAST = 100  # bytes of a payload that others may refer to
DICTIONARY_BYTES = 64 << 10
PIECE = 2048  # characters
PIECES = 100 * DICTIONARY_BYTES // PIECE  # the dictionary is trained on
LEVEL = 3
DICTIONARY_MAGIC = 0x184D2A5D  # fixed value: skippable frame that holds a dictionary
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def train(pages: DataFrame, text_col: str = "html", most: int = PIECES) -> bytes:
    """A dictionary from the ``most`` pieces of least hash; empty if there are none."""
    import zstandard as zstd

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = pages.select(F.xxhash64(text).alias("h"), F.length(text).alias("n"), text.alias("t")).where(F.col("n") > 0)
    # A payload's pieces, by its hash: copies have the same.
    numbers = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE).cast("int"))
    place = F.col("place") * PIECE + 1
    # First the hashes alone, then the few texts that have them.
    hashed = texts.select("h", F.explode(numbers).alias("place")).select(F.xxhash64("h", "place").alias("p"))
    least = [r.p for r in hashed.distinct().orderBy("p").limit(most).collect()]
    if not least:
        return b""
    wanted = F.filter(numbers, lambda i: F.xxhash64("h", i) <= max(least))
    picked = texts.select("h", "t", F.explode(wanted).alias("place")).select(
        F.xxhash64("h", "place").alias("p"), F.substr("t", place, F.lit(PIECE)).alias("t")
    )
    rows = picked.groupBy("p").agg(F.min("t").alias("t")).collect()
    samples = [r.t.encode() for r in sorted(rows)]
    total = sum(map(len, samples))
    if not total:
        return b""
    try:
        return zstd.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), samples).as_bytes()
    except zstd.ZstdError:  # too little to train on
        return b"".join(samples)[-DICTIONARY_BYTES:]


def dictionary(raw: bytes):
    import zstandard as zstd

    return zstd.ZstdCompressionDict(raw) if raw else None


def _header(value: str) -> str:
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in value)


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def stored_id(page_id, digest: str) -> str:
    """The id of the one response that has the payload of its revisits."""
    return record_id(f"{page_id}:{digest}")


def info(name: str) -> bytes:
    """The record that opens an archive."""
    block = b"software: doeffect.llm.warc\r\nformat: WARC File Format 1.1\r\n"
    lines = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: {record_id(name)}",
        f"WARC-Date: {DATE}",
        f"WARC-Filename: {name.rpartition('/')[2]}",
        "Content-Type: application/warc-fields",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id, url, payload: bytes, digest: str, revisit: bool, own_id: str, first=None) -> bytes:
    """The bytes of one record; a revisit's block has the HTTP header alone.
    ``first`` is what a revisit says of its response: page id, url, rows with that id."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {own_id}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
        if first is not None:
            first_id, first_url, rows = first
            lines += [f"X-Refers-To-Page-ID: {first_id}", f"WARC-Refers-To-Date: {DATE}"]
            if first_url is not None:
                lines.append(f"WARC-Refers-To-Target-URI: {_header(first_url)}")
            if rows == 1:
                lines.append(f"WARC-Refers-To: {stored_id(first_id, digest)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict | None:
    """What a record says of its page (None if it is of none); a response's
    digest is taken from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
    }


def _filesystem(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def plan(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", url_col: str = "url") -> DataFrame:
    """Every page with its digest, and the id its payload is stored under."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text.alias("html")
    ).withColumn("digest", F.sha2("html", 256))
    # One row a payload, from per-task minima; a hot payload's rows are split by the adaptive join.
    large = rows.where(F.octet_length("html") >= LEAST)
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = large.groupBy("digest").agg(F.min(named).alias("first"), F.lit(True).alias("large"))
    # How many rows have that id: counted by (payload, id) first.
    times = large.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n"))).alias("times")
    )
    first = first.join(times, "digest").select(
        "digest", "large", F.when(F.col("first").isNotNull(), F.struct("first.page_id", "first.url", "times.n")).alias("first")
    )
    revisit = F.col("large").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", revisit.alias("revisit"), "first.page_id", "first.url", "first.n"
    ).toDF("page_id", "url", "html", "digest", "revisit", "first_id", "first_url", "first_rows")


def write(pages: DataFrame, folder: str, **columns) -> DataFrame:
    """Write ``pages`` as archives in ``folder``; one row (path, records, bytes) for each."""
    raw = train(pages, columns.get("text_col", "html"))

    def run(batches):
        import zstandard as zstd
        from pyspark import TaskContext

        context = TaskContext.get()
        out = None
        compressor = zstd.ZstdCompressor(level=LEVEL, dict_data=dictionary(raw))
        n = size = 0
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, digest, revisit, *first = (batch.column(c)[row].as_py() for c in range(8))
                if out is None:
                    files, base = _filesystem(folder)
                    files.create_dir(base, recursive=True)
                    name = f"{base}/pages-{context.partitionId():06d}.warc.zst"
                    part = f"{name}.{context.taskAttemptId()}.part"
                    out = files.open_output_stream(part, compression=None)
                    if raw:
                        size += out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
                    size += out.write(compressor.compress(info(name)))
                stored = not revisit and page_id is not None and first == [page_id, first[1], 1]
                own = stored_id(page_id, digest) if stored else record_id(f"{name}:{n}")
                first = first if first[0] is not None else None
                size += out.write(compressor.compress(record(page_id, url, html.encode(), digest, revisit, own, first)))
                n += 1
        if out is not None:
            out.close()
            files.move(part, name)
            uri = f"{folder.rstrip('/')}/{name.rpartition('/')[2]}"
            yield pa.RecordBatch.from_pylist([{"path": uri, "records": n, "bytes": size}])

    written = plan(pages, **columns).mapInArrow(run, "path string, records long, bytes long")
    ensure_checkpoint_dir(pages.sparkSession)
    return written.checkpoint()


def frames(stream, chunk: int = 1 << 20):
    """The decompressed frames of an archive, one by one."""
    import zstandard as zstd

    held = stream.read(8)
    magic, length = struct.unpack("<II", held) if len(held) == 8 else (0, 0)
    decompressor = zstd.ZstdDecompressor()
    if magic == DICTIONARY_MAGIC:
        decompressor = zstd.ZstdDecompressor(dict_data=dictionary(stream.read(length)))
        held = b""
    while True:
        held = held or stream.read(chunk)
        if not held:
            return
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not held and not (held := stream.read(chunk)):
                raise ValueError("archive ends within a frame")
            parts.append(frame.decompress(held))
            held = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def read(archives: DataFrame) -> DataFrame:
    """What the records of the archives (column ``path``) say of their pages."""

    def run(batches):
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORDS.split(", ")])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place = _filesystem(path)
                with files.open_input_stream(place, compression=None) as stream:
                    rows = []
                    for raw in frames(stream):
                        if (row := parse(raw)) is not None:
                            rows.append(row)
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema).select(names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema).select(names)

    return archives.select("path").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` under the session's checkpoint folder and read the archives back."""
    return read(write(pages, scratch_dir(pages.sparkSession, "warc")))


def digest(records: DataFrame) -> DataFrame:
    return records.drop("url")


def oracle_sql() -> str:
    """The digest in DuckDB, over the table ``pages``."""
    return f"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM rows),
kinds AS (SELECT *, strlen(html) >= {LEAST} AND page_id IS DISTINCT FROM first AS revisit FROM firsts)
SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first END AS refers_to
FROM kinds
"""
