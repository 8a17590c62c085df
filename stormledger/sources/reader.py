"""``spark.read.format("hazard_feed")``: whole feed documents as records, in batches and as a stream.

    register(spark)
    spark.read.format("hazard_feed").load("/shared/feeds")
    spark.readStream.format("hazard_feed").load("/shared/feeds")

Each file below the path is one RSS, Atom or CAP document or one JSON document of alerts. Each of its items is a row
(feed, position, root, record, reason): ``feed`` is the file's path below the root, ``record`` a flat JSON object of the item's
fields. A document that can't be read is one row, with its text as the record and a reason. Files are read by tasks, a task per
``bytesPerPartition``; one document must fit a task, all of them need not.
"""

from __future__ import annotations

import json
import posixpath
import time
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RECORD = "feed string, position int, root string, record string, reason string"
#: Names under which a JSON document holds its alerts, tried in this order.
JSON_LISTS = ("alerts", "nowcastDetails", "data", "records")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _flat(item: ET.Element) -> dict[str, str]:
    """Fields by local name, nested ones lifted up; the first filled one of a name counts. A link's address may be an attribute."""
    out: dict[str, str] = {}
    for child in item:
        name = _local(child.tag) if isinstance(child.tag, str) else ""
        found = _flat(child) if len(child) and name not in ("title", "description", "summary", "content") else {name: (child.get("href") if name == "link" else None) or "".join(child.itertext()).strip()}
        for key, value in found.items():
            if key and not out.get(key):
                out[key] = value
    return out


def _items(root: ET.Element) -> list[ET.Element]:
    kind = _local(root.tag).lower()
    if kind == "alert":
        return [root]
    wanted = {"rss": ("item",), "feed": ("entry",)}.get(kind, ("item", "entry", "alert"))
    return next((found for name in wanted if (found := list(root.iterfind(f".//{{*}}{name}")))), [])


def records(feed: str, body: str) -> Iterator[tuple[str, int, str, str, str | None]]:
    """The records of one document; none of an empty one. A document with a type declaration isn't read, as it may define entities."""
    text = body.strip().lstrip("﻿")
    if not text:
        return
    if text[0] in "[{":
        try:
            data = json.loads(text)
        except (ValueError, RecursionError):
            yield feed, 0, "json", text, "malformed"
            return
        lists = [data[k] for k in JSON_LISTS if isinstance(data.get(k), list)] if isinstance(data, dict) else [data]
        for i, record in enumerate(lists[0] if lists else [data]):
            yield feed, i, "json", json.dumps(record, ensure_ascii=False), None if isinstance(record, dict) else "malformed"
        return
    if "<!DOCTYPE" in text:
        yield feed, 0, "xml", text, "document type"
        return
    try:
        root = ET.fromstring(text.encode("utf-8", "replace"))
    except (ET.ParseError, ValueError, LookupError):  # an unknown encoding is a LookupError
        yield feed, 0, "xml", text, "malformed"
        return
    for i, item in enumerate(_items(root)):
        yield feed, i, _local(root.tag).lower(), json.dumps(_flat(item), ensure_ascii=False), None


@dataclass
class Files(InputPartition):
    paths: list[str]


class _Folder:
    def __init__(self, options):
        if not options.get("path"):
            raise ValueError("a feed needs a path")
        self.path, self.most = options["path"], int(options.get("bytesPerPartition", 64 << 20))
        self.settle = float(options.get("settleSeconds", 0))

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def listed(self) -> list[tuple[int, str, int]]:
        """(time, path, size) of the files, by time and path; names that begin with a dot or an underscore are none."""
        from pyarrow import fs

        system, root = self._open()
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in found)

    def packed(self, files: Iterable[tuple[int, str, int]]) -> list[Files]:
        out: list[Files] = []
        room = 0
        for _, path, size in files:
            if not out or room < size:
                out.append(Files([]))
                room = self.most
            out[-1].paths.append(path)
            room -= size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        system, root = self._open()
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                body = stream.read().decode("utf-8", "replace")
            yield from records(posixpath.relpath(path, root), body)


class FeedReader(_Folder, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.packed(self.listed()) or [Files([])]


class FeedStream(_Folder, DataSourceStreamReader):
    """The offset is the time and path of the last file. ``settleSeconds`` leaves the youngest files to a later batch, so that none which
    shows up late with an earlier time is passed over. A planned batch that runs again reads the same files."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        settled = [f for f in self.listed() if f[0] <= (time.time() - self.settle) * 1e9]
        return {"time": settled[-1][0], "path": settled[-1][1]} if settled else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, last = (start["time"], start["path"]), (end["time"], end["path"])
        return self.packed(f for f in self.listed() if after < f[:2] <= last)

    def commit(self, end: dict) -> None:
        """Files stay where they are; the offsets are kept in the checkpoint."""


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hazard_feed"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)


def read_documents(documents: DataFrame, feed: str = "feed", body: str = "xml") -> DataFrame:
    """The same records of documents that are rows of a table already; a null document has none."""

    def split(batches):
        import pandas as pd

        for frame in batches:
            rows = [r for f, b in zip(frame["feed"], frame["body"], strict=True) if b is not None for r in records(f, b)]
            yield pd.DataFrame(rows, columns=["feed", "position", "root", "record", "reason"])

    return documents.select(documents[feed].cast("string").alias("feed"), documents[body].alias("body")).mapInPandas(split, RECORD)
