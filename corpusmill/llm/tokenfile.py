"""Token-id files: documents' ids in zstandard frames under one shared dictionary, with an offset index.

A file is  magic, header, frames, index, footer:
  magic   8 bytes, b"CMTOK\\x00\\x01\\n"
  header  32 bytes, the SHA-256 of the dictionary that the frames need
  frames  one zstandard frame for each document, in ascending id order: its ids as little-endian unsigned 16- or 32-bit integers
  index   for each document 28 bytes, little-endian: id int64, offset uint64, frame bytes uint32, ids uint64 (its top bit set: the id is null)
  footer  offset of the index uint64, documents uint64, ids uint64, width of an id uint32, magic
A document is read with one range read of the index and one of its frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, open_fs, shared_path, write_whole
from .tokens import END, encoder

MAGIC = b"CMTOK\x00\x01\n"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("n", "<u8")])
ENTRY = struct.Struct("<qQIQ")
FOOTER = struct.Struct("<QQQI8s")
#: The dictionary is trained on so many documents, so many bytes of each at most, to so many bytes.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 16_384, 65_536
LEVEL = 3
#: Text bytes of a file at most, on the average: more files than partitions are written where partitions would be larger.
FILE_BYTES = 256 << 20
NULL = 1 << 63


def serialize(ids: bytes, width: int) -> bytes:
    """ids as little-endian uint32 bytes -> width-byte integers."""
    return ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of the samples; where they are too few to train, their own bytes serve as a raw one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b"\x00" * 8


class Writer:
    """Collects frames in ascending order; parts() yields the file's bytes."""

    def __init__(self, dictionary: bytes, width: int) -> None:
        self.hash, self.width = hashlib.sha256(dictionary).digest(), width
        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=LEVEL)  # digested once, not for each frame
        self.frame = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True).compress
        self.index, self.docs, self.ids = bytearray(), 0, 0

    def parts(self, docs):
        """docs: (doc_id, uint32 id bytes)."""
        yield MAGIC + self.hash
        at = len(MAGIC) + 32
        for doc_id, ids in docs:
            frame = self.frame(serialize(ids, self.width))
            self.index += ENTRY.pack(doc_id or 0, at, len(frame), len(ids) // 4 + (NULL if doc_id is None else 0))
            self.docs += 1
            at += len(frame)
            self.ids += len(ids) // 4
            yield frame
        yield bytes(self.index)
        yield FOOTER.pack(at, self.docs, self.ids, self.width, MAGIC)


class Reader:
    """Random access to one file by range reads."""

    def __init__(self, uri: str, dictionary: bytes) -> None:
        filesystem, path = open_fs(uri)
        self.source = filesystem.open_input_file(path)
        size = self.source.size()
        index_at, n, self.ids, self.width, magic = FOOTER.unpack(self.source.read_at(FOOTER.size, size - FOOTER.size))
        head = self.source.read_at(len(MAGIC) + 32, 0)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{uri}: not a token file")
        if head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: written with another dictionary")
        self.index = np.frombuffer(self.source.read_at(n * INDEX.itemsize, index_at), dtype=INDEX).copy()
        self.null = self.index["n"] >= NULL  # they stand first
        self.index["n"] &= NULL - 1
        self.plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress

    def ids_at(self, place: int) -> np.ndarray:
        row = self.index[place]
        raw = self.plain(self.source.read_at(int(row["size"]), int(row["offset"])))
        return np.frombuffer(raw, dtype="<u2" if self.width == 2 else "<u4").astype("<u4")

    def ids_of(self, doc_id: int) -> np.ndarray:
        nulls = int(self.null.sum())
        place = nulls + int(np.searchsorted(self.index["doc_id"][nulls:], doc_id))
        if place == len(self.index) or self.index["doc_id"][place] != doc_id:
            raise KeyError(doc_id)
        return self.ids_at(place)

    def scan(self, chunk: int = 8 << 20):
        """(doc_id, ids) in file order, reading frames in runs of about chunk bytes."""
        k = 0
        while k < len(self.index):
            first, end = int(self.index["offset"][k]), k + 1
            while end < len(self.index) and int(self.index["offset"][end] + self.index["size"][end]) - first <= chunk:
                end += 1
            run = self.source.read_at(int(self.index["offset"][end - 1] + self.index["size"][end - 1]) - first, first)
            for row, null in zip(self.index[k:end], self.null[k:end], strict=True):
                at = int(row["offset"]) - first
                raw = self.plain(run[at : at + int(row["size"])])
                yield (None if null else int(row["doc_id"])), np.frombuffer(raw, dtype="<u2" if self.width == 2 else "<u4").astype("<u4")
            k = end

    def close(self) -> None:
        self.source.close()


def write_files(docs: DataFrame, vocabulary: str | None = None, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bytes]:
    """Encode docs, append the end id to each, write files in ascending id order -> (manifest, dictionary).

    manifest(part, uri, docs, ids, before): a row for each file in order; before: ids of all earlier files. Null text is
    empty (the end id alone); null ids come first; rows of one id are ordered by text hash. An empty table writes no file.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 500)
    enc = encoder(vocabulary)
    width = 2 if enc.library.get_vocab_size() <= 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    share = int(min(1.0, 1.5 * SAMPLE_DOCS / max(n, 1)) * (1 << 30))  # so that a task sends its share of the sample, not a whole one
    hashed = rows.select(F.xxhash64("doc_id").alias("h"), F.substring("text", 1, SAMPLE_BYTES).alias("text")).where(F.pmod("h", F.lit(1 << 30)) <= share)
    drawn = hashed.orderBy("h").limit(SAMPLE_DOCS)
    end = END.to_bytes(4, "little")
    samples = [serialize(enc.encode(r.text)[: SAMPLE_BYTES * 4 // width] + end, width) for r in drawn.select("text").collect()]
    dictionary = train_dictionary(samples)
    folder = shared_path(spark, "tokens")
    shared = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    out = pa.schema([("part", pa.int32()), ("uri", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])

    def write(batches):
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(vocabulary).encode
        stream = ((i, encode(t) + end) for batch in batches for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        first = next(stream, None)
        if first is None:
            return
        writer, uri = Writer(shared.value, width), f"{folder}/part-{part:06d}.tok"

        def chain():
            yield first
            yield from stream

        write_whole(uri, writer.parts(chain()))
        yield arrow_rows(out, [[part], [uri], [writer.docs], [writer.ids]])

    placed = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = sorted(placed.mapInArrow(write, "part int, uri string, docs long, ids long").collect())
    before, manifest = 0, []
    for part, uri, n, ids in made:
        manifest.append((part, uri, n, ids, before))
        before += ids
    return spark.createDataFrame(manifest, "part int, uri string, docs long, ids long, before long"), dictionary


def read_files(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """manifest of write_files -> (doc_id, start, n_tokens, ids_crc32) per document, read back from the files."""
    spark = manifest.sparkSession
    shared = spark.sparkContext.broadcast(dictionary)
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for uri, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, rows = Reader(uri, shared.value), []
                for doc_id, ids in reader.scan():
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids)))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield arrow_rows(out, list(zip(*rows, strict=True)))
                        rows = []
                if rows:
                    yield arrow_rows(out, list(zip(*rows, strict=True)))
                reader.close()

    files = manifest.count()
    return manifest.select("uri", "before").repartition(max(files, 1)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_tokenfile(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_files(*write_files(docs))
