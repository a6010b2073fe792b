"""Blob files as a data source, read record by record.

    spark.dataSource.register(BlobSource)
    spark.read.format("record_blobs").option("path", directory).load()

A partition is a file; a task holds one record at a time, so files and records
may be of any size. The directory must be mounted by all executors; for other
stores see ``blob_files.read_blobs``, which has the same columns. Options:
check_data (true).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratalog.sources.blob_files import _COLUMNS, SCHEMA, unpack_blob


class BlobSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_blobs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BlobReader(self.options)


class BlobFile(InputPartition):
    def __init__(self, blob_id: int, path: str):
        super().__init__(blob_id)
        self.blob_id, self.path = blob_id, path


class BlobReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file:")
        self.check_data = options.get("check_data", "true").lower() != "false"

    def partitions(self) -> list[BlobFile]:
        """The files named {prefix}.{id}.blob, by id."""
        found = []
        for name in os.listdir(self.path):
            parts = name.split(".")
            if len(parts) == 3 and parts[2] == "blob" and parts[1].isdigit():
                found.append(BlobFile(int(parts[1]), os.path.join(self.path, name)))
        return sorted(found, key=lambda p: p.blob_id) or [BlobFile(-1, "")]

    def read(self, partition: BlobFile) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:

            def at(place: int, n: int) -> bytes:
                f.seek(place)
                return f.read(n)

            for n, r in enumerate(unpack_blob(at, self.check_data, os.path.getsize(partition.path))):
                row = {**dict.fromkeys(_COLUMNS), "blob_id": partition.blob_id, "seq": (partition.blob_id << 32) + n, **r}
                yield tuple(row[c] for c in _COLUMNS)
