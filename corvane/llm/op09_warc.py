"""WARC archives in Zstandard frames: writer and reader.

An archive begins with a skippable frame that holds a Zstandard dictionary,
trained on a bounded sample of its own payloads; each record follows as one
frame of its own. The archives are written by Spark's text writer, so that
they land in any file system and survive lost executors: a line is a frame
(raw bytes), and the line separator is an empty skippable frame, which every
Zstandard reader passes over.

Records with equal payloads of ``least`` bytes or more: the one with the
largest page id is the response, the others are revisits that refer to it.

The reader takes whole archives (their size is bounded by the writer), loads
the dictionary, decodes frame by frame, and checks version, headers, lengths,
the end of each record and the payload's digest; a fault raises an error that names
the archive and the place.

Defined results
* a null html is an empty payload; a null url is written as ``about:blank``;
* control characters and spaces in a url are percent-encoded;
* equal payloads under equal largest ids (repeated rows) are all responses;
* a null page id is smaller than all others and is read back as null;
* whole payloads are written, however long; other columns stay out, whatever their names;
* an empty table makes no archive and gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import materialize, new_path

from . import common

LEAST_BYTES = 0
#: Payload bytes in an archive, about, at every size of the input; it stands in memory as a whole when read.
ARCHIVE_BYTES = 16 * 1024 * 1024
#: Bytes of the archive that the decoder is given at a time: a record costs the same in archives of any size.
SLICE_BYTES = 16 * 1024
#: The dictionary: its size, and how many payload bytes of the archive it is trained on at most.
DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLE_RECORDS = 64 * 1024, 4 * 1024 * 1024, 1000
LEVEL = 3
#: Payloads that occur more than once (about 60 bytes each) are broadcast up to this number, counted first.
BROADCAST_HOLDERS = 2_000_000

#: Fixed values of the formats.
DICTIONARY_MAGIC, EMPTY_MAGIC, SKIPPABLE, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0x184D2A50, 0xFD2FB528
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SEPARATOR = struct.pack("<II", EMPTY_MAGIC, 0).decode("ascii")

SCHEMA = "archive string, page_id string, target_uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, html binary"


class ArchiveError(ValueError):
    """A fault in an archive."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def _urn(page_id: str | None) -> str:
    """No id is no text: a page whose id is the text ``null`` keeps it."""
    return "<urn:page>" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: str | None, url: str | None, payload: bytes | None, refers_to: str | None, n_bytes: int, digest: str) -> bytes:
    """One WARC record; ``payload`` None makes a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode("ascii")
    block = http + (payload or b"")
    head = [
        VERSION,
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too little to train on, the samples as raw content (may be empty)."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def frames(records: list[bytes], sample: list[bytes]) -> Iterator[bytes]:
    """The dictionary's skippable frame, then a frame for each record."""
    import zstandard

    raw = _dictionary(sample)
    yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None, write_checksum=True)
    for one in records:
        yield compressor.compress(one)


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An archive for each partition: its first payloads train the dictionary, later ones stream through."""
    import zstandard

    held: list[bytes] = []
    sample: list[bytes] = []
    size, compressor = 0, None

    def start() -> tuple[list[bytes], object]:
        raw = _dictionary(sample)
        data = zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None
        return [struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw], zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True)

    for batch in batches:
        out: list[bytes] = []
        for row in batch.itertuples(index=False):
            payload = None if row.revisit else bytes(row.payload)
            one = record(row.page_id, row.url, payload, row.refers_to, int(row.n_bytes), row.digest)
            if compressor is not None:
                out.append(compressor.compress(one))
                continue
            held.append(one)
            size += len(one)
            sample.append(one[: 128 * 1024])
            if size >= SAMPLE_BYTES or len(sample) >= SAMPLE_RECORDS:
                first, compressor = start()
                out += first + [compressor.compress(h) for h in held]
                held = []
        if out:
            yield pd.DataFrame({"frame": out})
    if compressor is None and held:
        first, compressor = start()
        yield pd.DataFrame({"frame": first + [compressor.compress(h) for h in held]})


def write(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES, archives: int | None = None) -> None:
    """Write a record for every row of ``pages`` to archives below ``path``."""
    common.check_columns(pages, page, url, html)
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(page).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1("payload"))
    # who holds a payload is found on narrow rows, and copies are summed before they are shuffled
    narrow = materialize(rows.select("page_id", "sha", "n_bytes"), "payloads")
    holder = narrow.filter(F.col("n_bytes") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1").select("sha", "holder")
    if archives is None:
        total = narrow.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
        archives = max(1, -(-total // ARCHIVE_BYTES))
    holder = materialize(holder, "holders")
    # payloads move once, to their archives; beyond the bound they meet the holders by digest, hot ones split by the adaptive join
    joined = rows.join(F.broadcast(holder) if holder.count() <= BROADCAST_HOLDERS else holder, "sha", "left")
    revisit = F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id"))
    joined = joined.select(
        F.col("page_id").cast("string").alias("page_id"), "url", "n_bytes", "sha", revisit.alias("revisit"),
        F.when(revisit, F.col("holder").cast("string")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )

    @F.pandas_udf("string")
    def base32(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda h: base64.b32encode(bytes.fromhex(h)).decode("ascii"))

    joined = joined.withColumn("digest", base32("sha")).drop("sha")
    placed = joined.repartition(archives, F.xxhash64("page_id", "url"))
    placed.mapInPandas(_encode, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


def _headers(head: bytes, at: str) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != VERSION:
        raise ArchiveError(f"{at}: not a {VERSION} record")
    found: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"{at}: faulty header line")
        if name.lower() in found:
            raise ArchiveError(f"{at}: {name} occurs twice")
        found[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-target-uri", "warc-payload-digest"):
        if name not in found:
            raise ArchiveError(f"{at}: {name} is missing")
    return found


def _page(urn: str, at: str) -> str | None:
    m = re.fullmatch(r"<urn:page(?::(.*))?>", urn, re.DOTALL)
    if not m:
        raise ArchiveError(f"{at}: faulty record id")
    return m[1]


def parse(one: bytes, at: str) -> dict:
    """The fields of a decoded record, checked."""
    head, gap, rest = one.partition(b"\r\n\r\n")
    if not gap:
        raise ArchiveError(f"{at}: no end of headers")
    h = _headers(head, at)
    if not h["content-length"].isdigit():
        raise ArchiveError(f"{at}: faulty content length")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"{at}: content length {n} doesn't fit the record")
    block = rest[:n]
    if h.get("warc-block-digest", "sha1:" + digest_of(block)) != "sha1:" + digest_of(block):
        raise ArchiveError(f"{at}: faulty block digest")
    http, gap, body = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length: (\d+)\r?$", http)
    if not gap or not http.startswith(b"HTTP/1.") or not length:
        raise ArchiveError(f"{at}: faulty HTTP header")
    kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(body) != int(length[1]) or digest_of(body) != digest:
            raise ArchiveError(f"{at}: the payload doesn't fit its length or digest")
        refers = None
    elif kind == "revisit":
        if body or "warc-refers-to" not in h or h.get("warc-profile") != PROFILE:
            raise ArchiveError(f"{at}: faulty revisit")
        refers = _page(h["warc-refers-to"], at)
    else:
        raise ArchiveError(f"{at}: unknown type {kind}")
    return {
        "page_id": _page(h["warc-record-id"], at), "target_uri": h["warc-target-uri"], "record_type": kind, "refers_to": refers,
        "payload_bytes": int(length[1]), "payload_digest": digest, "html": body if kind == "response" else None,
    }


def decode(data: bytes, name: str) -> Iterator[dict]:
    """The records of one archive."""
    import zstandard

    if not data:
        return
    place, decoder, view = 0, None, memoryview(data)
    while place < len(data):
        at = f"{name} at {place}"
        if len(data) - place < 8:
            raise ArchiveError(f"{at}: cut off")
        magic, size = struct.unpack_from("<II", data, place)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if place + 8 + size > len(data):
                raise ArchiveError(f"{at}: skippable frame is cut off")
            if place == 0:
                if magic != DICTIONARY_MAGIC:
                    raise ArchiveError(f"{at}: no dictionary")
                raw = data[8 : 8 + size]
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None)
            place += 8 + size
            continue
        if magic != FRAME_MAGIC or decoder is None:
            raise ArchiveError(f"{at}: no frame")
        part, pieces, size = decoder.decompressobj(), [], SLICE_BYTES
        try:
            while not part.eof and place < len(data):
                pieces.append(part.decompress(view[place : place + size]))
                place = min(len(data), place + size)
                size *= 2  # a large frame takes few slices; what is behind a small one is short
        except zstandard.ZstdError as fault:
            raise ArchiveError(f"{at}: {fault}") from fault
        if not part.eof:
            raise ArchiveError(f"{at}: frame is cut off")
        place -= len(part.unused_data)
        yield parse(b"".join(pieces), at)


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows, size = [], 0
            for one in decode(bytes(content), path):
                rows.append({"archive": path} | one)
                size += one["payload_bytes"] if one["html"] is not None else 0
                if len(rows) >= 2000 or size >= 8 * 1024 * 1024:
                    yield pd.DataFrame(rows)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path`` (columns as in SCHEMA)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(_decode, SCHEMA)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    write(common.table(spark, sf_dir, "pages"), path)
    rows = read(spark, path)
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


#: DuckDB has no base32: the digest's five bytes at a time make eight letters.
OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS b FROM pages),
s AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
d AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest FROM s),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS holder, count(*) OVER (PARTITION BY h) AS n FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id IS DISTINCT FROM holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM m
"""

QUERIES = {"op9_warc": op9_warc}
ORACLE_SQL = {"op9_warc": OP9_SQL}
