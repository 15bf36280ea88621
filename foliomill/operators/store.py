"""A versioned store of Parquet tables: each save writes a new version and then swaps a pointer."""

from __future__ import annotations

import html
import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators import state

#: Colours of marks, in order of first use.
PALETTE = ("#ffd54f", "#81c784", "#64b5f6", "#e57373", "#ba68c8", "#4db6ac")


class Store:
    """SNK-1..5, DML-1..11: tables below a folder that Spark can read and write.

    ``table/v<version>-<id>`` are data; ``_pointers`` is a table of rows
    (table, version, path), of which the latest of each table counts. What is
    read is never overwritten, so readers keep a consistent version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_pointers")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.parquet(f"{self.path}/_pointers") if system.exists(folder) else None

    def current(self, table: str) -> tuple[int, str] | None:
        """Version and path of a table."""
        pointers = self._pointers()
        row = pointers.where(F.col("table") == table).orderBy(F.desc("version")).first() if pointers is not None else None
        return (row.version, row.path) if row else None

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """SRC-13: a table as of its latest or another version."""
        pointers = self._pointers()
        if pointers is None:
            raise KeyError(table)
        found = pointers.where(F.col("table") == table)
        row = (found.where(F.col("version") == version) if version else found.orderBy(F.desc("version"))).first()
        if row is None:
            raise KeyError(table)
        return self.spark.read.parquet(row.path)

    def save(self, table: str, rows: DataFrame) -> int:
        """The next version of a table."""
        held = self.current(table)
        version = (held[0] if held else 0) + 1
        path = f"{self.path}/{table}/v{version}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(path)
        pointer = self.spark.createDataFrame([(table, version, path, time.time())], "table string, version int, path string, at double")
        pointer.coalesce(1).write.mode("append").parquet(f"{self.path}/_pointers")
        return version

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> int:
        """DML-1: rows replace those of equal key."""
        return self.save(table, state.upsert(self.read(table), rows, keys) if self.current(table) else rows)

    def replace_documents(self, table: str, rows: DataFrame) -> int:
        """SNK-1: a document's rows are replaced as a whole."""
        if not self.current(table):
            return self.save(table, rows)
        kept = self.read(table).join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
        return self.save(table, kept.unionByName(rows))

    def append(self, table: str, rows: DataFrame) -> int:
        """SNK-3..5: adds rows."""
        return self.save(table, self.read(table).unionByName(rows) if self.current(table) else rows)

    def delete_documents(self, tables: Iterable[str], gone: DataFrame) -> None:
        """DML-6: drops documents from each of the tables."""
        for table in tables:
            if self.current(table):
                self.save(table, self.read(table).join(gone.select("doc_id").distinct(), "doc_id", "left_anti"))


def review_page(title: str, sections: list[tuple[str, str]], found: list[dict]) -> str:
    """SNK-6: sections with their extractions marked, a legend with counts, and what could not be aligned."""
    colours: dict[str, str] = {}
    for x in found:
        colours.setdefault(x["extraction_class"], PALETTE[len(colours) % len(PALETTE)])
    legend = "".join(f'<li style="background:{c}">{html.escape(k)}: {sum(x["extraction_class"] == k for x in found)}</li>' for k, c in sorted(colours.items()))
    parts = []
    for section, content in sections:
        at, body = 0, []
        for x in sorted((x for x in found if x["section_id"] == section and x.get("char_start") is not None), key=lambda x: x["char_start"]):
            if x["char_start"] >= at:
                note = html.escape(json.dumps(x.get("attributes", {}), sort_keys=True), quote=True)
                body.append(html.escape(content[at : x["char_start"]]))
                body.append(f'<mark style="background:{colours[x["extraction_class"]]}" title="{note}">{html.escape(content[x["char_start"] : x["char_end"]])}</mark>')
                at = x["char_end"]
        parts.append(f"<h2>{html.escape(section)}</h2><p>{''.join(body)}{html.escape(content[at:])}</p>")
    lost = "".join(f"<li>{html.escape(x['extraction_text'])}</li>" for x in found if x.get("char_start") is None)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ul>{legend}</ul>{''.join(parts)}" + (f"<h2>Not aligned</h2><ul>{lost}</ul>" if lost else "")
