"""The data source `run_archive`: members of zip and tar archives as rows, read in planned ranges and written as archives."""

from __future__ import annotations

import bz2
import fnmatch
import io
import lzma
import posixpath
import struct
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: sample: the name of its folder; path: where a file lies below that; member: its base name.
FILES = "sample string, path string, member string, content string"
ENDINGS = (".zip", ".tar", ".tar.gz", ".tgz")
#: Rows go on in batches of about so many bytes, and a partition has about so many bytes of an archive.
BATCH, PARTITION = 16 << 20, 64 << 20
#: The records of a zip file's directory.
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_STORED, _DEFLATED, _BZIP2, _LZMA = 0, 8, 12, 14


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), posixpath.abspath(path))


def safe(name: str) -> bool:
    """A path that stays below the archive's root."""
    n = posixpath.normpath(name)
    return not (n.startswith(("/", "..")) or n in (".", "") or "\\" in n or ".." in name.split("/"))


@dataclass
class Wanted:
    """Which members are read: those below a prefix, whose base names match a pattern, and what becomes of paths that leave the archive."""

    prefix: str
    names: list[str]
    unsafe: str

    def __call__(self, archive: str, name: str) -> bool:
        if not safe(name):
            if self.unsafe == "reject":
                raise ValueError(f"unsafe path in {archive}: {name}")
            return False
        base = name.rsplit("/", 1)[-1]
        return name.startswith(self.prefix) and bool(base) and (not self.names or any(fnmatch.fnmatchcase(base, x) for x in self.names))


@dataclass
class Range(InputPartition):
    """A part of an archive: of a zip file's directory, or of a plain tar file; or a whole compressed tar file."""

    path: str
    kind: str
    start: int
    stop: int
    shift: int = 0


def _directory(f) -> tuple[int, int, int]:  # noqa: ANN001
    """Where a zip file's directory begins and ends, and how far its offsets are off."""
    f.seek(0, 2)
    size = f.tell()
    back = min(size, (1 << 16) + 22)
    f.seek(size - back)
    tail = f.read(back)
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("not a zip file: it has no directory")
    length, offset = struct.unpack("<2L", tail[at + 12 : at + 20])
    end = size - back + at
    if at >= 20 and tail[at - 20 : at - 16] == _LOCATOR:
        where = struct.unpack("<Q", tail[at - 12 : at - 4])[0]
        f.seek(where)
        record = f.read(56)
        if record[:4] == _END64:
            length, offset, end = *struct.unpack("<2Q", record[40:56]), where
    return end - length, end, end - length - offset


@dataclass
class Entry:
    name: str
    flags: int
    method: int
    crc: int
    packed: int
    size: int
    offset: int
    length: int


def _entries(f, start: int, stop: int) -> Iterator[Entry]:  # noqa: ANN001
    """The entries of a part of a zip file's directory, read in steps."""
    f.seek(start)
    rest, buffer = stop - start, b""

    def need(n: int) -> None:
        nonlocal rest, buffer
        while len(buffer) < n:
            got = f.read(min(rest, 1 << 20))
            if not got:
                raise ValueError("the directory of a zip file ends early")
            rest -= len(got)
            buffer += got

    while rest or buffer:
        need(46)
        if buffer[:4] != _ENTRY:
            return
        flags, method = struct.unpack("<2H", buffer[8:12])
        crc, packed, size = struct.unpack("<3L", buffer[16:28])
        name, extra, comment = struct.unpack("<3H", buffer[28:34])
        offset = struct.unpack("<L", buffer[42:46])[0]
        length = 46 + name + extra + comment
        need(length)
        title, more = buffer[46 : 46 + name], buffer[46 + name : 46 + name + extra]
        buffer = buffer[length:]
        while len(more) >= 4:  # wide sizes and offsets stand in a field of their own
            tag, n = struct.unpack("<2H", more[:4])
            wide = list(struct.unpack(f"<{n // 8}Q", more[4 : 4 + n // 8 * 8])) if tag == 1 else []
            if wide and size == 0xFFFFFFFF:
                size = wide.pop(0)
            if wide and packed == 0xFFFFFFFF:
                packed = wide.pop(0)
            if wide and offset == 0xFFFFFFFF:
                offset = wide.pop(0)
            more = more[4 + n :]
        yield Entry(title.decode("utf-8" if flags & 0x800 else "cp437"), flags, method, crc, packed, size, offset, length)


def _content(f, e: Entry, shift: int) -> bytes:  # noqa: ANN001
    if e.flags & 1:
        raise ValueError(f"{e.name} is encrypted")
    f.seek(e.offset + shift)
    head = f.read(30)
    if head[:4] != _LOCAL:
        raise ValueError(f"{e.name} isn't where the directory says")
    name, extra = struct.unpack("<2H", head[26:30])
    f.seek(e.offset + shift + 30 + name + extra)
    raw = f.read(e.packed)
    if e.method == _DEFLATED:
        raw = zlib.decompress(raw, -15)
    elif e.method == _BZIP2:
        raw = bz2.decompress(raw)
    elif e.method == _LZMA:
        props = struct.unpack("<H", raw[2:4])[0]
        raw = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[lzma._decode_filter_properties(lzma.FILTER_LZMA1, raw[4 : 4 + props])]).decompress(raw[4 + props :])
    elif e.method != _STORED:
        raise ValueError(f"{e.name} has an unknown compression: {e.method}")
    if zlib.crc32(raw) != e.crc:
        raise ValueError(f"{e.name} is damaged")
    return raw


def _tar(f, mode: str) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:  # noqa: ANN001
    """Members one after the other; none is remembered."""
    with tarfile.open(fileobj=f, mode=mode) as t:
        while (m := t.next()) is not None:
            yield t, m
            t.members.clear()


def planned(path: str, most: int = PARTITION) -> Iterator[Range]:
    """The ranges of an archive that are read by themselves, of about `most` bytes each: only sizes and offsets are looked at."""
    store, at = opened(path)
    if at.endswith(".zip"):
        with store.open_input_file(at) as f:
            start, end, shift = _directory(f)
            here, begun, size = start, start, 0
            for e in _entries(f, start, end):
                here, size = here + e.length, size + e.packed + e.length
                if size >= most:
                    yield Range(path, "zip", begun, here, shift)
                    begun, size = here, 0
            if begun < here:
                yield Range(path, "zip", begun, here, shift)
    elif at.endswith(".tar"):
        with store.open_input_file(at) as f:
            begun = 0
            for _, m in _tar(f, "r:"):
                if m.offset - begun >= most:
                    yield Range(path, "tar", begun, m.offset)
                    begun = m.offset
            yield Range(path, "tar", begun, f.size())
    else:
        yield Range(path, "tar.gz", 0, 0)  # can't be split: read as a stream


def members(part: Range, wanted: Wanted) -> Iterator[tuple[str, bytes]]:
    """The names and contents of the wanted members of a range, one in memory at a time."""
    store, at = opened(part.path)
    if part.kind == "zip":
        with store.open_input_file(at) as f:
            for e in sorted((e for e in _entries(f, part.start, part.stop) if wanted(part.path, e.name)), key=lambda e: e.offset):
                yield e.name, _content(f, e, part.shift)
        return
    plain = part.kind == "tar"
    with store.open_input_file(at) if plain else store.open_input_stream(at, compression=None) as f:
        if plain:
            f.seek(part.start)
        for t, m in _tar(f, "r:" if plain else "r|*"):
            if plain and m.offset >= part.stop:
                return
            if m.isfile() and wanted(part.path, m.name):
                yield m.name, t.extractfile(m).read()


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("partitionBytes", PARTITION))
        below = options.get("subpath", "").strip("/")
        self.wanted = Wanted(f"{below}/" if below else "", [x for x in options.get("members", "").split(",") if x], options.get("unsafe", "skip"))
        if self.wanted.unsafe not in ("skip", "reject"):
            raise ValueError("unsafe is skip or reject")

    def partitions(self) -> list[InputPartition]:
        store, at = opened(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        if info.type == fs.FileType.File:
            found = [self.path]
        else:
            names = sorted(x.path for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(ENDINGS) and not x.base_name.startswith(("_", ".")))
            found = [f"{scheme}{n}" for n in names]
        return [r for p in found for r in planned(p, self.most)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for name, raw in members(part, self.wanted):
            parts = name.split("/")
            at = next((i for i, x in enumerate(parts[:-1]) if "__" in x), -1)
            if at < 0:
                continue
            rows.append((parts[at], "/".join(parts[at + 1 :]), parts[-1], raw.decode("utf-8", "replace")))
            size += len(raw)
            if size > BATCH:
                yield _batch(rows)
                rows, size = [], 0
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in FILES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names=names)


@dataclass
class Packed(WriterCommitMessage):
    at: str
    name: str


class ArchiveWriter(DataSourceWriter):
    """One archive for each partition, under a name of its own until the job has ended; a task that runs twice leaves one."""

    def __init__(self, options: dict, schema):  # noqa: ANN001
        self.path, self.kind, self.columns = options["path"], options.get("kind", "zip"), schema.names
        if self.kind not in ("zip", "tar", "tar.gz"):
            raise ValueError("kind is zip, tar or tar.gz")
        if not {"sample", "path", "content"} <= set(self.columns):
            raise ValueError("an archive is written from the columns sample, path and content")

    def write(self, rows) -> Packed:  # noqa: ANN001
        store, at = opened(self.path)
        store.create_dir(at, recursive=True)
        name = uuid.uuid4().hex
        pending = f"{at}/_pending-{name}"
        n = 0
        with store.open_output_stream(pending, compression=None) as out:
            pack = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) if self.kind == "zip" else tarfile.open(fileobj=out, mode="w|gz" if self.kind == "tar.gz" else "w|")
            with pack:
                for row in rows:
                    if row["sample"] is None or row["path"] is None:
                        continue
                    n += 1
                    title, raw = f"{row['sample']}/{row['path']}", (row["content"] or "").encode()
                    if self.kind == "zip":
                        pack.writestr(title, raw)
                    else:
                        info = tarfile.TarInfo(title)
                        info.size = len(raw)
                        pack.addfile(info, io.BytesIO(raw))
        if not n:
            store.delete_file(pending)
            return Packed("", "")
        return Packed(pending, f"part-{name}.{self.kind}")

    def commit(self, messages: list[Packed | None]) -> None:
        store, at = opened(self.path)
        for m in messages:
            if m is not None and m.at:
                store.move(m.at, f"{at}/{m.name}")

    def abort(self, messages: list[Packed | None]) -> None:
        store, _ = opened(self.path)
        for m in messages:
            if m is not None and m.at:
                store.delete_file(m.at)


class RunArchives(DataSource):
    """spark.read.format("run_archive"): a .zip, .tar, .tar.gz or .tgz file or a folder of them, as rows (sample, path, member, content).

    Options: path; subpath (only what lies below it); members (shell patterns of base names,
    by commas: others aren't unpacked); unsafe (skip or reject paths that leave the archive);
    partitionBytes. A zip file is split by its directory, a plain tar file at its headers, so
    one archive is read by many tasks; a compressed tar file is one stream. An archive may have
    any size; one member at a time is in memory. Files are opened where pyarrow opens them:
    local paths and file, hdfs, s3, gs and abfs URIs.

    df.write.format("run_archive") packs rows (sample, path, content), one archive for each
    partition; option kind: zip, tar or tar.gz. Rows without a sample or path are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "run_archive"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> ArchiveReader:  # noqa: ANN001
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:  # noqa: ANN001
        return ArchiveWriter(self.options, schema)
