"""Landed board documents as a data source: ``format("boards")`` in batch and in streams, with offsets by file.

Documents land as JSON lines (source_type, source_external_key, fetched_at, body), one directory a landing whose name sorts after
those before it. A partition is some files; a stream's offset is the last file that it has read, so a stream that
is started again goes on behind it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "boards"
SCHEMA = "source_type string, source_external_key string, fetched_at timestamp, body string"
#: Files a task, and bytes of documents a batch that it hands on.
FILES_A_TASK = 16
BATCH_BYTES = 1 << 22


def land(documents: DataFrame, path: str, landing: int) -> None:
    """Write documents as landing number ``landing``; the same number again replaces it."""
    rows = documents.select("source_type", "source_external_key", F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("fetched_at"), "body")
    rows.write.mode("overwrite").json(f"{path}/{landing:012d}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BoardDocuments)


class Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


def _store(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[str]:
    """Names of the files that are whole, in order: a landing counts when its mark of success is there."""
    store, root = _store(path)
    found = [f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file]
    done = {f.rsplit("/", 1)[0] for f in found if f.endswith("/_SUCCESS")}
    return sorted(f for f in found if f.rsplit("/", 1)[0] in done and f.endswith(".json"))


def _dealt(names: list[str]) -> list[Files]:
    return [Files(names[i : i + FILES_A_TASK]) for i in range(0, max(1, len(names)), FILES_A_TASK)]


def _documents(path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    store, _ = _store(path)
    kinds = [pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string()]
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    rows: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=columns)

    for name in names:
        with store.open_input_stream(name) as stream:
            for line in _lines(stream):
                x = json.loads(line)
                at = x.get("fetched_at")
                rows.append((x.get("source_type"), x.get("source_external_key"), at and datetime.fromisoformat(at), x.get("body")))
                size += len(line)
                if size >= BATCH_BYTES:
                    yield made()
                    rows, size = [], 0
    yield made()


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from (line for line in whole if line)
    if rest:
        yield rest


class BoardReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        return _dealt(_listed(self.path))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _documents(self.path, partition.names)


class BoardStream(DataSourceStreamReader):
    """Offsets are the names of the last files read, so they need no count of what was there before."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(_listed(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _dealt([f for f in _listed(self.path) if start["last"] < f <= end["last"]])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _documents(self.path, partition.names)

    def commit(self, end: dict) -> None:
        pass


class BoardDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BoardReader:
        return BoardReader(self.options["path"])

    def streamReader(self, schema) -> BoardStream:
        return BoardStream(self.options["path"])
