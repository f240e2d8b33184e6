"""A streaming source that tails growing logs of lines.

The offset of a stream is a number of bytes for each file.  A file's newest
offset stands after its last line end, so a line that is still being written is
left for a later batch, and each line comes once.  What was appended is read in
ranges of bounded size; a range has the lines that begin in it.  Files are
reached through Arrow's file systems, by URI, so they may lie in any store that
both driver and executors reach.

    spark.dataSource.register(TailSource)
    spark.readStream.format("tail").option("path", uri).load()
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BLOCK = 1 << 16
#: bytes of a range
RANGE = 32 << 20


class ShrunkLog(RuntimeError):
    """A log is shorter than what was read of it: it was cut or replaced."""


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str, suffix: str) -> dict[str, int]:
    """Sizes of a folder's logs (or of the one log), by path inside the file system."""
    from pyarrow import fs

    store, root = _opened(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return {info.path: info.size}
    if info.type == fs.FileType.NotFound:
        return {}
    return {f.path: f.size for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith((".", "_"))}


def whole_lines(file, start: int, size: int) -> int:
    """Where the last whole line ends, not before ``start``: reads back from the end, a block at a time."""
    at = size
    while at > start:
        begin = max(start, at - BLOCK)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return start


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a log that ends a line at ``stop``; the first range of a batch begins a line."""

    path: str
    start: int
    end: int
    stop: int
    first: bool


def lines_of(file, part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in a range, without their ends."""
    at = part.start if part.first else part.start - 1
    file.seek(at)
    rest, skip = b"", not part.first
    while at < part.stop:
        data = file.read(min(BLOCK, part.stop - at))
        if not data:
            return
        begin = at - len(rest)
        at += len(data)
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            if not skip:
                if begin >= part.end:
                    return
                yield begin, line
            skip = False
            begin += len(line) + 1
        if not skip and begin >= part.end:
            return


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.range = options["path"], options.get("suffix", ""), int(options.get("rangeBytes", RANGE))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, _ = _opened(self.path)
        out = {}
        for path, size in sorted(_files(self.path, self.suffix).items()):
            with store.open_input_file(path) as file:
                out[path] = whole_lines(file, 0, size)
        return {p: n for p, n in out.items() if n}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            if stop < begin:
                raise ShrunkLog(f"{path} had {begin} bytes of whole lines and has {stop}")
            out += [Range(path, at, min(at + self.range, stop), stop, at == begin) for at in range(begin, stop, self.range)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = _opened(self.path)
        with store.open_input_file(partition.path) as file:
            for at, line in lines_of(file, partition):
                yield partition.path, at, line.removesuffix(b"\r").decode(errors="replace")


class LineReader(DataSourceReader):
    """The lines of logs as they are, a last one without its end too."""

    def __init__(self, options: dict):
        self.tail, self.suffix = TailReader(options), options.get("suffix", "")

    def partitions(self) -> list[Range]:
        return self.tail.partitions({}, _files(self.tail.path, self.suffix))

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from self.tail.read(partition)
        if partition.end == partition.stop:
            store, _ = _opened(self.tail.path)
            with store.open_input_file(partition.path) as file:
                at = whole_lines(file, 0, partition.stop)
                file.seek(at)
                if rest := file.read(partition.stop - at):
                    yield partition.path, at, rest.decode(errors="replace")


class TailSource(DataSource):
    """``path``: a log or a folder of logs; ``suffix``: of the names that count; ``rangeBytes``: of a task."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tailed(spark: SparkSession, path: str, suffix: str = ""):
    """The whole lines of a growing log, or of all in a folder, as a stream (file, at, line)."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", path).option("suffix", suffix).load()
