"""Media columns: a Spark data source over archives of stored members.

The writer turns texts into lossless 8-bit grey images, one archive (zip, members stored) per task; the
manifest that the commit writes names the archives that count, so failed or repeated attempts leave no
rows. The reader plans byte ranges over the archives' directories and streams members as Arrow batches.
Each member is fetched by its offset and retried alone.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import shared_dir

WIDTH = 576
MANIFEST = "manifest.json"
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, padded with 255 to a positive multiple of WIDTH; 255 never occurs in UTF-8."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """The payload as rows of WIDTH grey samples, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    plain = np.zeros((len(rows), WIDTH + 1), np.uint8)
    plain[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png() made; ValueError for anything else."""
    if media[:8] != SIGNATURE:
        raise ValueError("not an image of this format")
    at, data, width = 8, [], 0
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean, deviation and histogram entropy of the samples."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p, v = n[n > 0] / n.sum(), np.flatnonzero(n)
    mean = float((p * v).sum())
    return f"{WIDTH}x{len(payload) // WIDTH};mean={mean:.3f};sd={float((p * (v - mean) ** 2).sum()) ** 0.5:.3f};bits={float(-(p * np.log2(p)).sum()):.4f}"


@dataclass
class _Archive(WriterCommitMessage):
    path: str
    size: int


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class MediaArchives(DataSource):
    """format("media_archives"): options path, split_bytes (32 MB), batch_bytes (8 MB), tries (4)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "member string, media binary"

    def reader(self, schema):
        return MediaReader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        return MediaWriter(dict(self.options))


class MediaWriter(DataSourceArrowWriter):
    """Takes rows (name, text); a member is called <place in its archive>/<name>."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Archive:
        fs, root = pafs.FileSystem.from_uri(self.root)
        fs.create_dir(root, recursive=True)
        path = f"{root}/{uuid.uuid4().hex}.zip"
        with fs.open_output_stream(path) as out:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                k = 0
                for batch in iterator:
                    for name, text in zip(batch["name"].to_pylist(), batch["text"]):
                        archive.writestr(zipfile.ZipInfo(f"{k}/{name}"), to_png(payload_of(text.as_py())))
                        k += 1
        if not k:  # a task without rows leaves no archive
            fs.delete_file(path)
            return _Archive("", 0)
        return _Archive(path, fs.get_file_info(path).size)

    def commit(self, messages: list[_Archive | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.root)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps([[m.path, m.size] for m in messages if m and m.size]).encode())

    def abort(self, messages: list[_Archive | None]) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.root)
        for m in messages:
            if m and m.size:
                fs.delete_file(m.path)


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.split = int(options.get("split_bytes", 32 << 20))
        self.batch = int(options.get("batch_bytes", 8 << 20))
        self.tries = int(options.get("tries", 4))

    def partitions(self) -> list[_Range]:
        """Byte ranges of the archives in the manifest. Directories stay with the tasks."""
        fs, root = pafs.FileSystem.from_uri(self.root)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as lines:
            archives = json.loads(lines.read())
        return [_Range(path, at, at + self.split) for path, size in archives for at in range(0, size, self.split)] or [_Range("", 0, 0)]

    def fetch(self, fs, archive, info: zipfile.ZipInfo, path: str) -> tuple[bytes, zipfile.ZipFile]:
        """One member by its offset, its checksum tested. A failure reopens the archive for this member alone."""
        for k in range(self.tries):
            try:
                return archive.read(info), archive
            except (OSError, EOFError, zipfile.BadZipFile, zlib.error):
                if k + 1 == self.tries:
                    raise
                time.sleep(0.05 * 2**k)
                archive = zipfile.ZipFile(fs.open_input_file(path))
        raise OSError(path)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.root)
        archive = zipfile.ZipFile(fs.open_input_file(partition.path))
        names, media, size = [], [], 0
        for info in archive.infolist():
            if partition.start <= info.header_offset < partition.end:
                data, archive = self.fetch(fs, archive, info, partition.path)
                names.append(info.filename)
                media.append(data)
                size += len(data)
                if size >= self.batch:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(media, pa.binary())], ["member", "media"])
                    names, media, size = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(media, pa.binary())], ["member", "media"])


def store(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes every row's text as a member of an archive; returns the folder, in the shared one by default."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    spark.dataSource.register(MediaArchives)
    docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"), F.col(text_col).alias("text")).write.format("media_archives").mode("append").save(path)
    return path


def media_columns(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores all texts, then reads them back: one row per row of `docs`.

    id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Null text:
    empty, so WIDTH bytes of padding. A null id stays null. Repeated rows are members of their own; an
    empty table gives no rows; other columns are ignored. Ids are numbers.
    """
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    stored = store(docs, path=path, id_col=id_col, text_col=text_col)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for media in pdf["media"]:
                payload = from_png(media)
                rows.append((
                    len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                    len(media), hashlib.sha256(media).hexdigest(), feature(payload),
                ))
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            out.insert(0, "name", pdf["member"].str.partition("/")[2].to_numpy())
            yield out

    read = docs.sparkSession.read.format("media_archives").load(stored)
    rows = read.mapInPandas(measure, "name string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return rows.select(F.when(F.col("name") != "null", F.col("name")).cast(kind).alias(id_col), *rows.columns[1:])
