"""A data source of documents in a folder: ``<doc_id>.txt`` with the printed text, ``<doc_id>.json`` with truth and meta.

    spark.dataSource.register(BillFolder)
    df.write.format("bills").mode("append").save(folder)
    spark.read.format("bills").load(folder)

The reader shares the documents out to partitions of ``files`` each (an option, 256), so only names pass through the driver; texts are
read where they are needed. The writer's tasks write to a staging folder of their own; what counts is moved to its place when
all have ended, the truth last, so a document is there with both files or not at all, and an aborted write leaves
nothing. ``overwrite`` first removes the documents that are there. The folder must be a path that driver and executors share.

Defined cases: a text without a truth, or a truth without a text, is no document; a null text is an empty one; rows with a null doc_id are an error, as
are ids that are no file names; of rows with one id the last that is moved stays.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "doc_id string, text string, truth string, meta map<string,string>"
FILES = 256


@dataclass
class Names(InputPartition):
    names: list[str]


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class BillReader(DataSourceReader):
    def __init__(self, folder: str, files: int):
        self.folder, self.files = folder, files

    def partitions(self) -> list[InputPartition]:
        found = {"txt": set(), "json": set()}
        for entry in os.scandir(self.folder):
            name, _, kind = entry.name.rpartition(".")
            if kind in found and not name.startswith("."):
                found[kind].add(name)
        names = sorted(found["txt"] & found["json"])
        return [Names(names[i : i + self.files]) for i in range(0, len(names), self.files)] or [Names([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for name in partition.names:
            at = Path(self.folder, name)
            told = json.loads(at.with_name(f"{name}.json").read_text(encoding="utf-8"))
            yield name, at.with_name(f"{name}.txt").read_bytes().decode("utf-8"), told["truth"], told["meta"]


class BillWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.staging = f"{folder}/.staging-{uuid.uuid4().hex}"
        os.makedirs(self.staging, exist_ok=True)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        own = Path(self.staging, uuid.uuid4().hex)  # an attempt's own: of one that is run again only the last counts
        own.mkdir()
        names = []
        for row in iterator:
            name = row["doc_id"]
            if not name or name.startswith(".") or "/" in name or "\0" in name:
                raise ValueError(f"no file name: {name!r}")
            (own / f"{name}.txt").write_bytes((row["text"] or "").encode("utf-8"))
            (own / f"{name}.json").write_text(json.dumps({"truth": row["truth"], "meta": row["meta"]}, ensure_ascii=False), encoding="utf-8")
            names.append(name)
        return Staged(str(own), names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.overwrite:
            for entry in list(os.scandir(self.folder)):
                if entry.is_file() and entry.name.endswith((".txt", ".json")):
                    os.unlink(entry.path)
        for staged in filter(None, messages):
            for name in staged.names:
                for kind in ("txt", "json"):
                    os.replace(f"{staged.folder}/{name}.{kind}", f"{self.folder}/{name}.{kind}")
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class BillFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bills"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> str:
        return self.options["path"].removeprefix("file://")

    def reader(self, schema: StructType) -> DataSourceReader:
        return BillReader(self._folder(), int(self.options.get("files", FILES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        os.makedirs(self._folder(), exist_ok=True)
        return BillWriter(self._folder(), overwrite)
