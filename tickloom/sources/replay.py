"""A stream's source of recorded packets: a folder of Parquet files that grows, each row group once, in the order of the files' names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "tickloom_packets"


class Group(InputPartition):
    """A row group of a file."""

    def __init__(self, path: str, group: int):
        self.path, self.group = path, group


class Recorded(DataSource):
    """Option path: a folder, as a URI that Arrow's file systems know. Its schema must be given. Files are complete when they get their
    name and don't change; names of later ones are greater."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return Reader(self.options["path"], schema.fieldNames())


class Reader(DataSourceStreamReader):
    """Offsets are numbers of files: a batch holds those that came since the one before, a task one of their row groups. After a restart
    the numbers still mean the same files, so nothing is read twice or left out."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def _files(self) -> list[str]:
        where, root = fs.FileSystem.from_uri(self.path)
        found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(x.path for x in found if x.is_file and x.base_name.endswith(".parquet") and x.base_name[0] not in "._")

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self._files())}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        where, _ = fs.FileSystem.from_uri(self.path)
        return [Group(p, k) for p in self._files()[start["files"] : end["files"]] for k in range(pq.ParquetFile(p, filesystem=where).num_row_groups)]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.path)
        with pq.ParquetFile(partition.path, filesystem=where) as file:
            yield from file.read_row_group(partition.group, columns=self.names).select(self.names).to_batches(max_chunksize=10_000)

    def commit(self, end: dict) -> None:
        pass


def stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The packets recorded below path, and those that will be."""
    spark.dataSource.register(Recorded)
    return spark.readStream.format(NAME).schema(schema).option("path", path).load()
