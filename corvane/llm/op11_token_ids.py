"""Token ids in binary files: frequency-ranked ids in a byte-aligned code.

Texts are encoded once, in place. The ids are counted over all documents, and
an id's rank by frequency is what is written: the 256 most frequent ids take a
byte, the next 65,280 two. A file is a row of blocks, each of at most
``BLOCK_IDS`` ids:

    magic, then as 32-bit numbers: runs, ids, data bytes, crc32 of what follows
    for each run: document id (64 bits), ids of it in this block (32 bits), flags (8 bits)
    control bytes: two bits an id, its length less one, four ids a byte, lowest bits first
    data bytes: the ranks, lowest byte first, without their leading zero bytes
    a line feed

All numbers are little-endian. Control and data bytes stand apart, so that a
reader finds the length of every code by a look-up of whole control bytes in a
table, and all places by a running sum: numpy decodes a block without a loop.
A document may go over several blocks, so no block grows with a text.

Documents are written in ascending order of their ids by a range sort; a file
is one range. ``write`` leaves three things below its path: ``data`` (the
files), ``ranks`` (rank, id, n) and ``files`` (part, n_docs, n_ids, start).
The blocks are written by Spark's text writer (a line is a block), so they go
to any file system, and a lost executor costs its own files only.

Words between ASCII white space are encoded on their own and remembered:
the tokenizer's pattern never reaches over white space, and its vocabulary
has none, so the ids are those of the whole text (``words_apart=False`` for a
tokenizer where this isn't so).

Defined results
* a null or empty text is the end id alone; whole texts are encoded, however long;
* a null document id is the smallest;
* repeated rows, and different texts under one id, are documents of their own,
  ordered by a hash of the text, then by their place in the input;
* an empty table makes no data and reads back as no rows;
* other columns stay out, whatever their names.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import arrow_rows, materialize, new_path

from . import common

VOCABULARY, END_ID = "word_bpe_49k.json", 1
#: Ids of a block at most; ids of a file, about, at every size (files are read whole: some 12 MB).
BLOCK_IDS, FILE_IDS = 64 * 1024, 8_000_000
#: Texts of an Arrow batch, and words (some thirty bytes each) that a process remembers at most.
BATCH_ROWS, CACHE_WORDS = 1024, 1_500_000
#: Starts of files (16 bytes each) are broadcast up to this number, counted first.
BROADCAST_FILES = 1_000_000
MAGIC, HEADER, RUN, BREAK = b"CVT1", struct.Struct("<4sIIII"), np.dtype([("doc", "<i8"), ("n", "<u4"), ("flags", "u1")]), b"\n"
#: Flags of a run.
NULL_ID, BEGINS, ENDS = 1, 2, 4

ENCODED = "doc_id long, text_hash long, row long, n long, ids binary, id int, times long"
DECODED = "part int, place long, doc_id long, start long, n_tokens long, ids_crc32 long"


class FormatError(ValueError):
    """A fault in a file."""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words in small letters without their last mark, and those marks: many words are one so. The tokenizer does both to
    ASCII texts itself; a word that may hold a special token, which it looks for first, stays as it is."""
    plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
    low = pc.if_else(plain, pc.ascii_lower(words), words)
    marked = pc.and_(plain, pc.match_substring_regex(low, "[a-z][.,;:!?]$"))
    none = pa.scalar("", words.type)
    return pc.if_else(marked, pc.utf8_slice_codeunits(low, 0, -1), low), pc.if_else(marked, pc.utf8_slice_codeunits(low, -1), none)


def _spread(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``flat``, one behind the other; where each ends, from 0."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return flat[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])], ends


class Encoder:
    """Ids of texts. ``path`` None: the default vocabulary, where this machine has it.

    Words met before are kept as one Arrow array and their ids as one numpy array, some thirty bytes a word;
    beyond ``CACHE_WORDS`` the first half stays, which has the frequent ones.
    """

    def __init__(self, path: str | None = None, words_apart: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer, self.words_apart = Tokenizer.from_file(path or tokenizer_path()), words_apart
        self.words = pa.array([], pa.large_string())
        self.ids, self.ends = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        ids, n = array("I"), []
        for begin in range(0, len(texts), 4096):
            for e in self.tokenizer.encode_batch_fast(texts[begin : begin + 4096], add_special_tokens=False):
                n.append(len(e))
                ids.extend(e.ids)
        return np.array(ids, dtype=np.uint32), np.array(n, dtype=np.int64)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where distinct words stand among those that are kept; new ones are added."""
        if len(self.words) + len(words) > CACHE_WORDS:
            half = min(len(self.words), CACHE_WORDS // 2)
            self.words, self.ends = pa.concat_arrays([self.words.slice(0, half)]), self.ends[: half + 1].copy()
            self.ids = self.ids[: self.ends[-1]].copy()
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            ids, n = self._library(new.to_pylist())
            place[place < 0] = len(self.words) + np.arange(len(new))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
            self.ids, self.words = np.concatenate([self.ids, ids]), pa.concat_arrays([self.words, new])
        return place

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.fill_null("").cast(pa.large_string())
        if not self.words_apart:
            flat, n = self._library(texts.to_pylist())
            return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []
        # U+001C to U+001F are no white space to the tokenizer's pattern, nor to this split
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        stems, marks = (part.dictionary_encode() for part in _parts(words.dictionary))
        both = pa.concat_arrays([stems.dictionary, marks.dictionary]).unique()
        place = self._places(both)
        which = [place[pc.index_in(x.dictionary, value_set=both).to_numpy()][x.indices.to_numpy()] if len(x) else np.zeros(0, dtype=np.int64) for x in (stems, marks)]
        # stems and marks by turns, then the words' occurrences
        turns = np.stack(which, axis=1).reshape(-1)
        ids, ends = _spread(self.ids, self.ends[turns], self.ends[turns + 1] - self.ends[turns])
        begin, chosen = ends[::2], words.indices.to_numpy()
        flat, ends = _spread(ids, begin[:-1][chosen], np.diff(begin)[chosen])
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=1)
def _encoder(path: str | None, words_apart: bool) -> Encoder:
    """This process's encoder: the words that it knows outlive a task."""
    return Encoder(path, words_apart)


def pack(ids: np.ndarray) -> bytes:
    """Ids between two jobs: 16 bits each where all fit, and 32 where not, told apart by a byte, compressed."""
    import zstandard

    small = not len(ids) or int(ids.max()) < 65536
    return zstandard.ZstdCompressor(level=1).compress((b"\x02" if small else b"\x04") + ids.astype("<u2" if small else "<u4").tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(raw, dtype="<u2" if raw[:1] == b"\x02" else "<u4", offset=1).astype(np.uint32)


def _encode(path: str | None, words_apart: bool, end_id: int | None):
    names = [c.split()[0] for c in ENCODED.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = _encoder(path, words_apart), np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            end = [] if end_id is None else [end_id]
            found = [np.concatenate([ids, np.array(end, dtype=np.uint32)]) for ids in encoder.encode(batch.column("text"))]
            seen = np.bincount(np.concatenate(found).astype(np.int64)) if found else counts[:0]
            if len(seen) > len(counts):
                counts = np.concatenate([counts, np.zeros(len(seen) - len(counts), dtype=np.int64)])
            counts[: len(seen)] += seen
            nulls = pa.nulls(len(found))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names[:3]), pa.array([len(f) for f in found], pa.int64()), pa.array([pack(f) for f in found], pa.binary()), nulls.cast(pa.int32()), nulls.cast(pa.int64())], names=names
            )
        held = np.flatnonzero(counts)
        none = pa.nulls(len(held))
        yield pa.RecordBatch.from_arrays([*(none.cast(pa.int64()) for _ in range(4)), none.cast(pa.binary()), pa.array(held, pa.int32()), pa.array(counts[held], pa.int64())], names=names)

    return work


# -- the code

#: By control byte: the lengths of its four codes.
_LENGTHS = 1 + np.array([[c >> 2 * k & 3 for k in range(4)] for c in range(256)], dtype=np.int64)
#: By length: the bits of a code.
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = ranks.astype("<u4")
    over = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = over
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= over[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths)
    if (int(ends[-1]) if n else 0) != len(data):
        raise FormatError("control and data bytes don't fit")
    padded = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    at = ends - lengths
    return (padded[at] | padded[at + 1] << 8 | padded[at + 2] << 16 | padded[at + 3] << 24) & _MASKS[lengths]


def block(runs: list[tuple[int | None, int, int]], ranks: np.ndarray) -> bytes:
    """A block without its line feed. runs: document id, number of ids, flags."""
    head = np.array([(0 if d is None else d, n, f | (NULL_ID if d is None else 0)) for d, n, f in runs], dtype=RUN).tobytes()
    control, data = encode_ranks(ranks)
    body = head + control + data
    return HEADER.pack(MAGIC, len(runs), len(ranks), len(data), zlib.crc32(body)) + body


def blocks(content: bytes, decode: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Runs and ranks of each block of a file; without ``decode`` the runs alone."""
    place = 0
    while place < len(content):
        if len(content) - place < HEADER.size:
            raise FormatError(f"at {place}: cut off")
        magic, n_runs, n, n_data, crc = HEADER.unpack_from(content, place)
        if magic != MAGIC:
            raise FormatError(f"at {place}: no block")
        begin, n_control = place + HEADER.size, -(-n // 4)
        end = begin + n_runs * RUN.itemsize + n_control + n_data
        body = content[begin:end]
        if content[end : end + 1] != BREAK or decode and zlib.crc32(body) != crc:
            raise FormatError(f"at {place}: the block is damaged or cut off")
        runs = np.frombuffer(body, dtype=RUN, count=n_runs)
        at = n_runs * RUN.itemsize
        if int(runs["n"].sum()) != n:
            raise FormatError(f"at {place}: runs don't fit the ids")
        yield runs, decode_ranks(body[at : at + n_control], body[at + n_control :], n) if decode else None
        place = end + 1


def _to_blocks(rank_of: np.ndarray):
    """Blocks of the documents of a partition, in their order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[int | None, int, int]] = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            out = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ranks, begin = rank_of[unpack(data)], 0
                while begin < len(ranks) or begin == 0:
                    part = ranks[begin : begin + BLOCK_IDS - size]
                    runs.append((doc_id, len(part), BEGINS * (begin == 0) | ENDS * (begin + len(part) == len(ranks))))
                    held.append(part)
                    size, begin = size + len(part), begin + len(part)
                    if size == BLOCK_IDS:
                        out.append(block(runs, np.concatenate(held)))
                        runs, held, size = [], [], 0
                    if not len(ranks):
                        break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["block"])
        if runs:
            yield pa.RecordBatch.from_arrays([pa.array([block(runs, np.concatenate(held))], pa.binary())], names=["block"])

    return work


def write(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int | None = END_ID, words_apart: bool = True, file_ids: int = FILE_IDS) -> None:
    """Encode ``text`` of all rows and write the ids below ``path``. tokenizer: a file that all executors have (None: the default one)."""
    common.check_columns(docs, doc, text)
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    with arrow_rows(spark, BATCH_ROWS):
        encoded = materialize(rows.mapInArrow(_encode(tokenizer, words_apart, end_id), ENCODED), "encoded")
    # the table of ranks has one row for each id of the vocabulary that occurs
    counts = encoded.filter("id IS NOT NULL").groupBy("id").agg(F.sum("times").alias("n")).orderBy(F.col("n").desc(), "id").toArrow()
    ids = counts.column("id").to_numpy()
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    ranks = spark.createDataFrame(pa.table({"rank": pa.array(np.arange(len(ids)), pa.int32()), "id": counts.column("id").cast(pa.int32()), "n": counts.column("n").cast(pa.int64())}))
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    parts = max(1, -(-int(counts.column("n").to_numpy().sum()) // file_ids))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash"), F.col("row")]
    ordered = encoded.filter("id IS NULL").select("doc_id", "text_hash", "row", "ids").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    with arrow_rows(spark, BATCH_ROWS):
        made = ordered.select("doc_id", "ids").mapInArrow(_to_blocks(rank_of), "block binary")
        made.select(F.col("block").cast("string").alias("value")).write.option("lineSep", BREAK.decode()).option("compression", "none").text(f"{path}/data")
    rows, before = [], 0
    for r in sorted(_files(spark, path).mapInArrow(_sizes, "part int, n_docs long, n_ids long").collect()):  # one row a file
        rows.append((*r, before))
        before += r["n_ids"]
    spark.createDataFrame(rows, "part int, n_docs long, n_ids long, start long").coalesce(1).write.parquet(f"{path}/files")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents and ids a file has: its runs alone are read."""
    for batch in batches:
        for part, content in zip(batch.column("part").to_pylist(), batch.column("content").to_pylist(), strict=True):
            n_docs = n_ids = 0
            for runs, _ in blocks(content, decode=False):
                n_docs, n_ids = n_docs + int(np.count_nonzero(runs["flags"] & ENDS)), n_ids + int(runs["n"].sum())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_docs]), pa.array([n_ids])], names=["part", "n_docs", "n_ids"])


def _decode(id_of: np.ndarray, whole: bool):
    """A row for each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, place, start, n, crc, held, size = [], 0, 0, 0, 0, [], 0
                for runs, ranks in blocks(content):
                    ids = id_of[ranks].astype("<u4")
                    at = 0
                    for doc_id, length, flags in runs.tolist():
                        own = ids[at : at + length]
                        if flags & BEGINS:
                            n, crc, held = 0, 0, []
                        n, crc = n + length, zlib.crc32(own.tobytes(), crc)
                        at += length
                        if whole:
                            held.append(own)
                        if flags & ENDS:
                            rows.append((part, place, None if flags & NULL_ID else doc_id, start, n, crc, np.concatenate(held).astype(np.int32) if whole else None))
                            place, start, size = place + 1, start + n, size + n
                            if len(rows) >= 5000 or whole and size >= 1 << 20:
                                yield _rows(rows, whole)
                                rows, size = [], 0
                if rows:
                    yield _rows(rows, whole)

    return work


def _rows(rows: list[tuple], whole: bool) -> pa.RecordBatch:
    part, place, doc_id, start, n, crc, ids = zip(*rows, strict=True)
    columns = {"part": pa.array(part, pa.int32()), "place": pa.array(place, pa.int64()), "doc_id": pa.array(doc_id, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
    if whole:
        columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part"), "content")


def _read(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """Documents of the files: part, place and start within the file, doc_id, n_tokens, ids_crc32, and the ids if ``whole``."""
    table = spark.read.schema("rank int, id int").parquet(f"{path}/ranks").toArrow()
    id_of = np.zeros(table.num_rows, dtype=np.uint32)
    id_of[table.column("rank").to_numpy()] = table.column("id").to_numpy()
    return _files(spark, path).mapInArrow(_decode(id_of, whole), DECODED + (", ids array<int>" if whole else ""))


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """All documents below ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids (array) unless ``ids`` is False."""
    files = spark.read.schema("part int, start long").parquet(f"{path}/files").select("part", F.col("start").alias("before"))
    if files.count() <= BROADCAST_FILES:
        files = F.broadcast(files)
    found = _read(spark, path, ids).join(files, "part")
    return found.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    write(common.table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read(spark, path, ids=False)


QUERIES = {"op11_token_ids": op11_token_ids}
ORACLE_SQL: dict = {}
