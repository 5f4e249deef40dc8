"""Log files that grow, as a stream: each whole line once, across restarts, renames and cuts.

An offset is, for each file, how far it has been read. A file is known by its number in the file system where there is one, so one that is renamed (rotated) goes on
under its new name and the one that takes its name begins at 0; elsewhere by its path. A file that has become shorter than its offset, or whose first bytes have changed, was
cut or written anew and begins at 0. Ranges end at the last line feed, so a line that is still being written waits for its end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.text import log_level
from .shared import open_fs

SCHEMA = "file string, at long, line string"
#: Bytes of a range that one task reads, and of a look for the last line feed; first bytes by which a file is known again.
RANGE, LOOK, HEAD = 64 << 20, 64 << 10, 64


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, stop: int) -> None:
        """Lines that begin in start to end; the file is read to stop at most."""
        self.path, self.start, self.end, self.stop = path, start, end, stop


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, size: int) -> None:
        self.folder, self.size = folder, size

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> list[tuple[str, str, int]]:
        """Key, path and size of each log file."""
        import os

        from pyarrow import fs

        system, path = open_fs(self.folder)
        local = isinstance(system, fs.LocalFileSystem)
        found = [f for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
        return [(str(os.stat(f.path).st_ino) if local else f.path, f.path, f.size) for f in found]

    def _read(self, path: str, start: int, size: int) -> bytes:
        system, _ = open_fs(self.folder)
        with system.open_input_file(path) as f:
            f.seek(start)
            return f.read(size)

    def _head(self, path: str, n: int) -> int:
        return zlib.crc32(self._read(path, 0, n))

    def _last_line(self, path: str, size: int) -> int:
        """Where the last whole line ends."""
        at = size
        while at > 0:
            start = max(0, at - LOOK)
            if (cut := self._read(path, start, at - start).rfind(b"\n")) >= 0:
                return start + cut + 1
            at = start
        return 0

    def latestOffset(self) -> dict:
        out = {}
        for key, path, size in self._files():
            end = self._last_line(path, size)
            n = min(HEAD, end)
            out[key] = [path, end, n, self._head(path, n)]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = []
        for key, (path, stop, _, _) in sorted(end.items()):
            _, begin, n, head = start.get(key, [path, 0, 0, 0])
            if stop < begin or n and self._head(path, n) != head:
                begin = 0
            found += [_Range(path, a, min(a + self.size, stop), stop) for a in range(begin, stop, self.size)]
        return found

    def read(self, partition: _Range) -> Iterator[tuple]:
        system, _ = open_fs(self.folder)
        with system.open_input_file(partition.path) as f:
            at = partition.start
            if at:  # a line that began before belongs to the range before
                f.seek(at - 1)
                place, cut = at - 1, -1
                while cut < 0:
                    if place >= partition.end or not (more := f.read(LOOK)):
                        return
                    cut = more.find(b"\n")
                    at, place = place + cut + 1, place + len(more)
            f.seek(at)
            held = b""
            while at < partition.end:
                more = f.read(min(1 << 20, partition.stop - at - len(held)))
                held += more
                *lines, held = held.split(b"\n")
                for line in lines:
                    if at >= partition.end:
                        return
                    yield partition.path, at, line.removesuffix(b"\r").decode("utf-8", "replace")
                    at += len(line) + 1
                if not more:
                    return

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """spark.readStream.format("growing_logs").option("path", folder)."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))


def stream(spark: SparkSession, folder: str, size: int = RANGE) -> DataFrame:
    """file, at (byte), line, level of each line as the files of a folder grow."""
    spark.dataSource.register(LogSource)
    rows = spark.readStream.format("growing_logs").option("path", folder).option("range", str(size)).load()
    return rows.withColumn("level", log_level(F.col("line")))
