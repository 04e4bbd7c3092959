"""A mailbox's change history as a stream: a Python data source whose offset is the history id.

The folder holds pages <n>.json, each {"historyId": n, "messages": [{"id", "raw"}]}; a client that fetches pages from a mail
service writes them there. A restart goes on after the last committed history id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, InputPartition, SimpleDataSourceStreamReader


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


def pages(folder: str, after: int) -> list[tuple[int, Path]]:
    return sorted((int(p.stem), p) for p in Path(folder).glob("*.json") if p.stem.isdigit() and int(p.stem) > after)


def rows(path: Path) -> Iterator[tuple]:
    page = json.loads(path.read_text())
    for m in page.get("messages", []):
        yield (int(page["historyId"]), str(m["id"]), m.get("raw"))


class HistoryReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.most = options["path"], int(options.get("maxPagesPerTrigger", 100))

    def initialOffset(self) -> dict:
        return {"historyId": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        new = pages(self.folder, start["historyId"])[: self.most]
        end = {"historyId": new[-1][0] if new else start["historyId"]}
        return iter([r for _, p in new for r in rows(p)]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for n, p in pages(self.folder, start["historyId"]) if n <= end["historyId"] for r in rows(p)])


class HistorySource(DataSource):
    """spark.dataSource.register(HistorySource); spark.readStream.format("mail_history").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "mail_history"

    def schema(self) -> str:
        return "history_id long, message_id string, raw string"

    def simpleStreamReader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)

    def reader(self, schema):
        from pyspark.sql.datasource import DataSourceReader

        folder = self.options["path"]

        class Batch(DataSourceReader):
            def partitions(self):
                return [Page(str(p)) for _, p in pages(folder, 0)] or [Page("")]

            def read(self, partition):
                yield from rows(Path(partition.path)) if partition.path else ()

        return Batch()
