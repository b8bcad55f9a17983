"""Writers."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Row

from keelson.sources.files import resolve

log = logging.getLogger("keelson")


def append_text(rows: DataFrame, url: str) -> None:
    """One part file a task, added to what is there."""
    rows.write.mode("append").text(resolve(url))


def append_table(rows: DataFrame, url: str, kind: str = "parquet") -> None:
    rows.write.mode("append").format(kind).save(resolve(url))


def write_json_documents(rows: DataFrame, url: str) -> None:
    """A JSON document a line; stands in for a document store."""
    rows.write.mode("append").json(resolve(url))


def write_mongodb(rows: DataFrame, uri: str, database: str, collection: str) -> None:
    rows.write.format("mongodb").mode("append").option("connection.uri", uri).option("database", database).option("collection", collection).save()


class DocumentWriter:
    """Commits single JSON documents from the driver, in batches, to any callable that takes a list."""

    def __init__(self, send=None, batch: int = 1024):
        self.send, self.batch, self.waiting = send, batch, []

    def commit(self, document: str) -> bool:
        """False for an empty document or where no target is set up."""
        if not document or self.send is None:
            return False
        self.waiting.append(document)
        if len(self.waiting) >= self.batch:
            self.flush_all()
        return True

    def flush_all(self) -> None:
        if self.send is None:
            raise ValueError("no target is set up")
        if self.waiting:
            self.send(self.waiting)
            self.waiting = []


def log_rows(rows: DataFrame, most: int = 20) -> list[Row]:
    """The first rows, to the log; returns what was logged."""
    shown = rows.take(most)
    for r in shown:
        log.info("%s", r)
    return shown
