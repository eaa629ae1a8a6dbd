"""WAV files as a Python data source that reads one file in many tasks, and a sink that writes one archive a task.

`wav_ranges` lists files and archives on the driver and reads the headers of single files only; samples are read by ranges of at most
`frames` frames. A task reads one range of a single file, or several where there are very many; of an archive it takes a span of bytes, with all
ranges that begin there, and looks up the members itself, so that neither their number nor the length of a range sets the number of tasks. `wav_bundle` writes the rows (name, wav) of a partition into one ZIP archive (stored, not packed,
so that members can be read by ranges) beside the target; archives move there when all tasks are done, and a failed
job leaves none."""

from __future__ import annotations

import struct
import uuid
import zipfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from undertone.sources.wav import layout, samples

#: Frames (samples of all channels) in a range, if the option `frames` doesn't say.
FRAMES = 1 << 20
#: Bytes of an archive that make a task, and about how many tasks there are at most (beside one for each file).
SPAN, TASKS = 1 << 20, 2_048
#: Samples that go to Spark together; a range is never cut.
ROWS = 1 << 14
_HEAD = 1 << 16


@dataclass
class Range:
    at: int
    kind: int
    bits: int
    channels: int
    first: int
    frames: int


@dataclass
class Span(InputPartition):
    """The ranges of a file or an archive that begin between two of its bytes."""

    path: str
    begin: int
    end: int


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def _ranges(head: bytes, at: int, step: int, begin: int, end: int):
    """The ranges of a WAV file whose bytes begin with `head` at a place in its file, those that begin between two bytes."""
    kind, bits, channels, _, body, length = layout(head)
    width = channels * bits // 8
    skipped = max(0, -(-(begin - at - body) // (width * step)))
    for first in range(skipped * step, min(length // width, max(0, -(-(end - at - body) // width))), step):
        yield Range(at + body + first * width, kind, bits, channels, first, min(step, length // width - first))


def _members(file, begin: int, end: int):
    """(name, where its bytes begin, size) of the WAV files in an archive that lie between two bytes, or partly do."""
    with zipfile.ZipFile(file) as archive:
        found = [i for i in archive.infolist() if i.filename.lower().endswith(".wav") and i.compress_type == zipfile.ZIP_STORED]
    for info in found:
        # a member's own header is 30 bytes and two fields of at most 65,535
        if info.header_offset < end and info.header_offset + 30 + 2 * 65_535 + info.file_size > begin:
            file.seek(info.header_offset)
            name, extra = struct.unpack_from("<HH", file.read(30), 26)
            yield info.filename, info.header_offset + 30 + name + extra, info.file_size


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("frames", FRAMES))

    def partitions(self) -> list[Span]:
        system, root = _system(self.path)
        info = system.get_file_info(root)
        files = [info] if info.is_file else system.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.is_file and f.path.lower().endswith((".wav", ".zip")) and "/_" not in f.path.removeprefix(root))
        least, out = sum(size for _, size in files) // TASKS, []
        for path, size in files:
            if path.endswith(".zip"):
                span = max(SPAN, least)
                cuts = [*range(0, size, span), size]
            else:
                with system.open_input_file(path) as file:
                    _, bits, channels, _, body, length = layout(file.read(min(_HEAD, size)))
                width = channels * bits // 8
                span = width * self.step * max(1, -(-least // (width * self.step)))
                cuts = [*range(body, body + length // width * width, span), body + length]
            out += [Span(path, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out or [Span("", 0, 0)]

    def read(self, part: Span):
        if part.end == part.begin:
            return
        system, _ = _system(self.path)
        held, n = [], 0
        with system.open_input_file(part.path) as file:
            for name, r in self._found(file, part):
                file.seek(r.at)
                x = samples(file.read(r.frames * r.channels * r.bits // 8), r.kind, r.bits).reshape(-1, r.channels)
                held += [(name, c, r.first, np.ascontiguousarray(x[:, c])) for c in range(r.channels)]
                n += x.size
                if n >= ROWS:
                    yield _rows(held)
                    held, n = [], 0
        if held:
            yield _rows(held)

    def _found(self, file, part: Span):
        """(name, range) of what begins in the span."""
        own, size = part.path.rsplit("/", 1)[-1], file.size()
        members = _members(file, part.begin, part.end) if part.path.endswith(".zip") else [("", 0, size)]
        for member, at, length in members:
            file.seek(at)
            for r in _ranges(file.read(min(_HEAD, length)), at, self.step, part.begin, part.end):
                yield own + (f"!{member}" if member else ""), r


def _rows(held: list) -> pa.RecordBatch:
    """Rows of (name, channel, first place, samples)."""
    size = [len(x) for *_, x in held]
    names = pa.array([name for name, *_ in held]).take(pa.array(np.repeat(np.arange(len(held)), size)))
    return pa.RecordBatch.from_arrays([names, pa.array(np.repeat(np.array([c for _, c, _, _ in held], np.int32), size)), pa.array(np.concatenate([np.arange(first, first + len(x)) for _, _, first, x in held])), pa.array(np.concatenate([x for *_, x in held]))], ["file", "ch", "idx", "x"])


class WavRanges(DataSource):
    """file, ch, idx and x of WAV files, single or in archives, below the option `path`."""

    @classmethod
    def name(cls) -> str:
        return "wav_ranges"

    def schema(self) -> str:
        return "file string, ch int, idx bigint, x double"

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    path: str
    files: int


class BundleWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.work = options["path"], f"_{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        system, root = _system(self.path)
        system.create_dir(f"{root}/{self.work}")
        path, n = f"{root}/{self.work}/{uuid.uuid4().hex}.zip", 0
        with system.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for row in rows:  # one file's bytes at a time
                archive.writestr(f"{row.name}.wav", bytes(row.wav))
                n += 1
        return Written(path, n)

    def commit(self, messages) -> None:
        system, root = _system(self.path)
        for i, m in enumerate(sorted((m for m in messages if m is not None and m.files), key=lambda m: m.path)):
            system.move(m.path, f"{root}/bundle-{i:05d}-{self.work[1:9]}.zip")
        system.delete_dir(f"{root}/{self.work}")

    def abort(self, messages) -> None:
        system, root = _system(self.path)
        if system.get_file_info(f"{root}/{self.work}").type != pafs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.work}")


class WavBundle(DataSource):
    """A sink for rows of name (string) and wav (binary): one archive for each partition that has rows, below the option `path`."""

    @classmethod
    def name(cls) -> str:
        return "wav_bundle"

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavRanges)
    spark.dataSource.register(WavBundle)
