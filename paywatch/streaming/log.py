"""A stream over append-only JSON logs, with byte offsets per file.

A folder of files is a topic, each file one of its partitions. An offset holds how
many bytes of each file have been handed out, always up to a line's end, so a restarted query
goes on where its log says and a replayed micro-batch reads the same bytes again. Large gains
are cut into pieces of PIECE bytes; a line belongs to the piece it begins in.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

PIECE = 1 << 23
TAIL = 1 << 16
NAME = "paywatch_log"


class Piece(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("the log needs a path")
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        ends = {
            info.base_name: whole_lines(system, info.path, info.size)
            for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            if info.is_file and not info.base_name.startswith(("_", "."))
        }
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        return [
            Piece(name, at, min(at + PIECE, stop))
            for name, stop in sorted(after.items()) for at in range(before.get(name, 0), stop, PIECE)
        ]

    def read(self, partition: Piece) -> Iterator[tuple[str, int, str]]:
        system, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        with system.open_input_file(f"{folder.rstrip('/')}/{partition.file}") as file:
            at = partition.start
            if at:
                # The line that the piece before has begun is its own.
                file.seek(at - 1)
                at += len(_line(file)) - 1
            while at < partition.stop:
                file.seek(at)
                line = _line(file)
                if not line:
                    return
                yield partition.file, at, line.decode("utf-8", "replace").rstrip("\r\n")
                at += len(line)

    def commit(self, end: dict) -> None:
        """Nothing is held back for a replay: the log stays."""


def _line(file) -> bytes:
    """The bytes up to and with the next line's end."""
    out = b""
    while chunk := file.read(TAIL):
        end = chunk.find(b"\n")
        if end >= 0:
            return out + chunk[: end + 1]
        out += chunk
    return out


def whole_lines(system: fs.FileSystem, path: str, size: int) -> int:
    """Bytes up to the last line's end."""
    with system.open_input_file(path) as file:
        stop = size
        while stop > 0:
            start = max(0, stop - TAIL)
            file.seek(start)
            end = file.read(stop - start).rfind(b"\n")
            if end >= 0:
                return start + end + 1
            stop = start
    return 0


class JsonLog(DataSource):
    """Rows (partition, offset, value); ``path`` is a folder that the driver and all executors reach."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "partition string, offset long, value string"

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(self.options)


def register(spark: SparkSession) -> str:
    """Make the source known to the session; returns its format name."""
    spark.dataSource.register(JsonLog)
    return NAME
