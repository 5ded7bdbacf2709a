"""A stream of live windows: every refresh is a Parquet file of a folder, files in the order of their names.

    spark.dataSource.register(SnapshotSource)
    snapshots = spark.readStream.format("snapshot_files").load("/data/refreshes")
    new = new_segments(snapshots)

The offset is the last file's name, so a query that starts again from its
checkpoint reads the files of an unfinished batch again, and no others twice. A file is
one task, so a refresh comes whole. Files must be put in place whole, and under
names that sort behind those before them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "stream_id long, refresh long, seg_pos long, seg_index long, name string, unix_time long, duration double"
TYPES = pa.schema([("stream_id", pa.int64()), ("refresh", pa.int64()), ("seg_pos", pa.int64()), ("seg_index", pa.int64()), ("name", pa.string()), ("unix_time", pa.int64()), ("duration", pa.float64())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Refresh(InputPartition):
    path: str
    name: str


class SnapshotReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def names(self) -> list[str]:
        system, path = opened(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(x.base_name for x in found if x.is_file and not x.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(self.names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Refresh]:
        return [Refresh(self.path, x) for x in self.names() if start["last"] < x <= end["last"]]

    def read(self, partition: Refresh) -> Iterator[pa.RecordBatch]:
        system, path = opened(partition.path)
        yield from pq.read_table(f"{path}/{partition.name}", filesystem=system, columns=TYPES.names).cast(TYPES).to_batches()

    def commit(self, end: dict) -> None:
        """Files are left where they are."""


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshot_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options["path"])
