"""Members of tar chunks by identifier, without unpacking to disk."""

from __future__ import annotations

import hashlib
import re
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER = re.compile(r"(?:^|/)(\d{4}\.\d{4,6})(?:\.(?:gz|tar|tex|pdf)|$|/)")


def member_id(name: str) -> str | None:
    m = MEMBER.search(name)
    return m.group(1) if m else None


def _opened(uri: str):
    """A stream of a file by URI or local path."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + uri[5:].lstrip("/"))
    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_stream(path)


class _Digested:
    """Reads a stream and keeps the MD5 of what was read."""

    def __init__(self, stream) -> None:
        self.stream, self.md5 = stream, hashlib.md5()

    def read(self, n: int = -1) -> bytes:
        chunk = self.stream.read(n) if n >= 0 else self.stream.read()
        self.md5.update(chunk)
        return chunk


def read_members(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(chunk, md5, arxiv_id, payload) for each member that names a paper; a chunk is streamed by one task, a member at a time.

    With wanted(chunk, arxiv_ids): the chunks by name that are read at all, and the papers wanted of each; a chunk is left as
    soon as all of its papers were found, and md5 is null then. Without it every chunk is read whole; md5 is the chunk's, on
    a last row without a paper.
    """
    out = pa.schema([("chunk", pa.string()), ("md5", pa.string()), ("arxiv_id", pa.string()), ("payload", pa.binary())])

    def members(batches):
        for batch in batches:
            for chunk, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left = None if ids is None else set(ids)
                row = lambda md5, i, raw, chunk=chunk: pa.RecordBatch.from_pydict({"chunk": [chunk], "md5": [md5], "arxiv_id": [i], "payload": [raw]}, schema=out)
                with _opened(chunk) as raw:
                    held = _Digested(raw)
                    with tarfile.open(fileobj=held, mode="r|*") as tar:
                        for m in tar:
                            if m.isfile() and (found := member_id(m.name)) and (left is None or found in left):
                                yield row(None, found, tar.extractfile(m).read())
                                if left is not None:
                                    left.discard(found)
                                    if not left:
                                        break
                    if left is None:
                        while held.read(1 << 20):
                            pass
                        yield row(held.md5.hexdigest(), None, None)

    files = spark.read.format("binaryFile").load(path).select("path")
    if wanted is None:
        files = files.withColumn("ids", F.lit(None).cast("array<string>"))
    else:
        name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
        asked = wanted.select(name("chunk").alias("_n"), F.col("arxiv_ids").alias("ids")).where("size(ids) > 0")
        files = files.withColumn("_n", name("path")).join(asked, "_n").select("path", "ids")
    return files.mapInArrow(members, "chunk string, md5 string, arxiv_id string, payload binary")


def matching(members: DataFrame, wanted: DataFrame) -> DataFrame:
    return members.join(wanted.select("arxiv_id"), "arxiv_id", "left_semi")


def checksum_failures(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks whose MD5 is not the manifest's."""
    name = F.regexp_extract("chunk", r"([^/]+)$", 1)
    got = members.where("md5 is not null").select(name.alias("_f"), "md5").distinct()
    want = manifest.select(F.regexp_extract("filename", r"([^/]+)$", 1).alias("_f"), "md5sum")
    return got.join(want, "_f").where("md5 <> md5sum").select(F.col("_f").alias("filename"), "md5", "md5sum")
