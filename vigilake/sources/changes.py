"""Change logs of registries as a data source with a cursor.

A log is a folder of JSON lines, dealt by the serial number of the change to folders block=0, block=1 and so on of SIZE serials each. The
cursor is the last serial read; it is the stream's offset, so Spark keeps it in the checkpoint, and any range can be read again.

    spark.dataSource.register(ChangeLog)
    spark.readStream.format("changelog").schema("serial long, package string").option("path", path).load()
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Serials of a block.
SIZE = 10_000


def write_changes(changes: DataFrame, path: str, size: int = SIZE) -> None:
    """Appends changes(serial, ...) to a log. Serials may have gaps, and must be larger than those that were read."""
    rows = changes.withColumn("block", F.floor(F.col("serial") / size))
    rows.repartition("block").sortWithinPartitions("block", "serial").write.mode("append").partitionBy("block").json(path)


@dataclass
class _Range(InputPartition):
    """The files of a block, and the serials wanted: over start, up to end."""

    files: list[str]
    start: int
    end: int


class _Log:
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.size = schema, int(options.get("size", SIZE))
        self.where = options["path"]

    def system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.where) if "://" in self.where or self.where.startswith("file:") else (fs.LocalFileSystem(), self.where)

    def blocks(self) -> list[tuple[int, str]]:
        system, root = self.system()
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted((int(f.base_name.removeprefix("block=")), f.path) for f in found if f.base_name.startswith("block="))

    def files(self, folder: str) -> list[str]:
        return sorted(f.path for f in self.system()[0].get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".json"))

    def rows(self, files: list[str]) -> Iterator[dict]:
        system = self.system()[0]
        for file in files:
            with system.open_input_stream(file) as raw:
                rest = b""
                while piece := raw.read(1 << 20):
                    *lines, rest = (rest + piece).split(b"\n")
                    yield from map(json.loads, filter(None, lines))
                if rest:
                    yield json.loads(rest)

    def head(self) -> int:
        """The last serial of the log: only its last block is read."""
        blocks = self.blocks()
        return max((row["serial"] for row in self.rows(self.files(blocks[-1][1]))), default=0) if blocks else 0

    def ranges(self, start: int, end: int) -> list[_Range]:
        wanted = [path for block, path in self.blocks() if (block + 1) * self.size > start + 1 and block * self.size <= end]
        return [_Range(self.files(path), start, end) for path in wanted] or [_Range([], start, end)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        arrow, held = to_arrow_schema(self.schema), []
        for row in self.rows(part.files):
            if part.start < row["serial"] <= part.end:
                held.append(row)
            if len(held) >= 5000:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)


class _Reader(_Log, DataSourceReader):
    def partitions(self) -> list[_Range]:
        return self.ranges(-1, self.head())


class _StreamReader(_Log, DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.since = options.get("since", "-1")

    def initialOffset(self) -> dict:
        """After the serial in the option since, from the start without one; "now" passes over all that is there."""
        return {"serial": self.head() if self.since == "now" else int(self.since)}

    def latestOffset(self) -> dict:
        return {"serial": self.head()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return self.ranges(start["serial"], end["serial"])


class ChangeLog(DataSource):
    """Options: path; size of blocks, as written; since, a serial or "now", for a stream without a checkpoint."""

    @classmethod
    def name(cls) -> str:
        return "changelog"

    def schema(self) -> str:
        return "serial long, package string, version string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(schema, dict(self.options))


def packages(changes: DataFrame) -> DataFrame:
    """Changes of packages: those without a name, and of the registry's own design documents, are none."""
    return changes.where("package <> '' and not startswith(package, '_design/')")
