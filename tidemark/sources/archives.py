"""ZIP archives as a data source: entries are dealt to tasks as byte ranges, nothing is unpacked to a folder.

``spark.read.format("zip_entries")`` reads each archive's directory once, on the driver, and deals its entries
to partitions of about ``part_bytes`` compressed bytes.  A task opens the archive at an entry's
offset and inflates it as a stream, so it holds one block, or one entry where ``whole`` documents are asked for.

Rows are ``archive, entry, line, value, error``.  With ``whole`` an entry is one row; else each line is one,
numbered from 1.  An entry that can't be read (damaged, encrypted, an unknown method, another checksum) has one
row with its ``error`` and a null value instead; a damaged archive has one row with a null ``entry``.  Lines of a
damaged entry that come before the damage are not given.

Options: ``suffixes`` (comma-separated, of entry names, any case), ``whole`` (true or false), ``part_bytes``.
The path is one URI, or several separated by commas, each with ``*`` and ``?`` in its last part, of any file system that
Arrow opens (local, HDFS, S3 and so on).
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import posixpath
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, entry string, line bigint, value string, error string"
ARROW = pa.schema([("archive", pa.string()), ("entry", pa.string()), ("line", pa.int64()), ("value", pa.string()), ("error", pa.string())])
BLOCK = 1 << 20
LINES = 20_000  # to a batch


@dataclass
class Entry:
    name: str
    offset: int
    packed: int
    size: int
    crc: int
    method: int
    encrypted: bool


@dataclass
class Part(InputPartition):
    archive: str
    entries: list[Entry] = field(default_factory=list)
    error: str | None = None

    def __init__(self, archive: str, entries: list[Entry] | None = None, error: str | None = None):
        super().__init__(0)
        self.archive, self.entries, self.error = archive, entries or [], error


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def matching(paths: str) -> list[str]:
    """The archives of comma-separated patterns, sorted within each."""
    found = []
    for pattern in paths.split(","):
        system, path = _open(pattern)
        folder, last = posixpath.split(path)
        if not any(c in last for c in "*?"):
            found.append(pattern)
            continue
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file and fnmatch.fnmatchcase(f.base_name, last))
        found += [posixpath.join(posixpath.split(pattern)[0], n) for n in names]
    return found


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"]
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", "").split(",") if s.strip())
        self.whole = options.get("whole", "false").lower() == "true"
        self.part_bytes = int(options.get("part_bytes", 32 << 20))

    def partitions(self) -> list[Part]:
        parts = []
        for archive in matching(self.paths):
            try:
                system, path = _open(archive)
                with system.open_input_file(path) as file, zipfile.ZipFile(io.BufferedReader(file)) as z:
                    entries = [Entry(e.filename, e.header_offset, e.compress_size, e.file_size, e.CRC, e.compress_type, bool(e.flag_bits & 1)) for e in z.infolist() if not e.is_dir()]
            except (OSError, ValueError, zipfile.BadZipFile) as why:
                parts.append(Part(archive, error=f"{type(why).__name__}: {why}"))
                continue
            held = 0
            for entry in sorted((e for e in entries if not self.suffixes or e.name.lower().endswith(self.suffixes)), key=lambda e: e.offset):
                if not parts or parts[-1].archive != archive or held >= self.part_bytes:
                    parts.append(Part(archive))
                    held = 0
                parts[-1].entries.append(entry)
                held += entry.packed
        return parts or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.error:
            yield _rows([(part.archive, None, None, None, part.error)])
        if not part.entries:
            return
        system, path = _open(part.archive)
        with system.open_input_file(path) as file:
            for entry in part.entries:
                try:
                    # first to its end for the checksum: what goes on to Spark can't be taken back
                    for _ in _inflated(file, entry):
                        pass
                except (OSError, ValueError, zlib.error, struct.error) as why:
                    yield _rows([(part.archive, entry.name, None, None, f"{type(why).__name__}: {why}")])
                    continue
                blocks = _inflated(file, entry)
                if self.whole:
                    yield _rows([(part.archive, entry.name, 1, b"".join(blocks).decode("utf-8", "replace"), None)])
                    continue
                rest, number = b"", 0
                for block in blocks:
                    lines = (rest + block).split(b"\n")
                    rest = lines.pop()
                    for k in range(0, len(lines), LINES):
                        some = lines[k : k + LINES]
                        yield _rows([(part.archive, entry.name, number + i, line.rstrip(b"\r").decode("utf-8", "replace"), None) for i, line in enumerate(some, 1)])
                        number += len(some)
                if rest:
                    yield _rows([(part.archive, entry.name, number + 1, rest.rstrip(b"\r").decode("utf-8", "replace"), None)])


def _inflated(file: pa.NativeFile, entry: Entry) -> Iterator[bytes]:
    """The bytes of an entry in blocks, checked against its size and checksum at the end."""
    if entry.encrypted or entry.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError("encrypted" if entry.encrypted else f"compression method {entry.method}")
    file.seek(entry.offset)
    header = file.read(30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError("no entry at its offset")
    name, extra = struct.unpack("<HH", header[26:30])
    file.seek(entry.offset + 30 + name + extra)
    inflate = zlib.decompressobj(-15) if entry.method == zipfile.ZIP_DEFLATED else None
    left, size, crc = entry.packed, 0, 0
    while left:
        packed = file.read(min(BLOCK, left))
        if not packed:
            raise ValueError("the archive ends inside an entry")
        left -= len(packed)
        while packed:  # a block inflates to many; they are taken one by one
            out = inflate.decompress(packed, BLOCK) if inflate else packed
            packed = inflate.unconsumed_tail if inflate else b""
            size, crc = size + len(out), zlib.crc32(out, crc)
            yield out
    if inflate:
        out = inflate.flush()
        size, crc = size + len(out), zlib.crc32(out, crc)
        yield out
    if (size, crc) != (entry.size, entry.crc):
        raise ValueError("size or checksum differs")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(ARROW)], schema=ARROW)


class ZipEntries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options))


def read_zip(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (), whole: bool = False, part_bytes: int = 32 << 20) -> DataFrame:
    """``archive, entry, line, value, error`` of the entries of ZIP archives."""
    spark.dataSource.register(ZipEntries)
    return spark.read.format("zip_entries").options(suffixes=",".join(suffixes), whole=str(whole).lower(), part_bytes=str(part_bytes)).load(path)


def first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, header`` of paths: the first line of each file, without a byte order mark."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        heads = []
        for name in names:
            system, path = _open(name)
            with system.open_input_stream(path) as file:
                head = b""
                while b"\n" not in head and (more := file.read(4096)):
                    head += more
            heads.append(head.split(b"\n")[0].rstrip(b"\r").decode("utf-8-sig", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(heads, pa.string())], ["file", "header"])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, length, sha256`` of paths, read a block at a time, however long a file is."""
    for batch in batches:
        names, lengths, sums = batch.column(0).to_pylist(), [], []
        for name in names:
            system, path = _open(name)
            digest, size = hashlib.sha256(), 0
            with system.open_input_stream(path) as file:
                while block := file.read(BLOCK):
                    digest.update(block)
                    size += len(block)
            lengths.append(size)
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lengths, pa.int64()), pa.array(sums, pa.string())], ["file", "length", "sha256"])
