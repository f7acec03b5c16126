"""``page_text``: a data source of pages from files of a format that a plug-in parses.

    spark.dataSource.register(PageTextSource)
    spark.read.format("page_text").option("pattern", "*.pdf").option("parser", "package.module:parse").load(folder)

A parser takes a file's bytes and returns a sequence: its length is the number of pages, an item is a
page's text. The default splits text at form feeds. A task reads files of ``bytes`` (32 MB) together; a
larger file is shared out by ranges of its pages, so that one long document is the work of many tasks.
Planning lists files and opens none.

Columns are document_id (the file's path), pdf_page (from 1), text and error. With a schema that lacks
``text`` no page is parsed. A file that can't be opened, or parsed, is one row with an error and no page,
a page that can't be is a row with its number; a file without pages, an empty folder and a folder that
doesn't exist have no rows. ``null`` from a parser is an empty page.
"""

from __future__ import annotations

import fnmatch
import importlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

Parser = Callable[[bytes], Sequence[str | None]]
SCHEMA = "document_id string, pdf_page int, text string, error string"
TYPES = {"document_id": pa.string(), "pdf_page": pa.int32(), "text": pa.string(), "error": pa.string()}
#: Rows of a batch, and their characters, at most (but for one page).
ROWS, CHARACTERS = 1024, 4 << 20


def form_feeds(data: bytes) -> list[str]:
    """Pages of plain UTF-8 text."""
    return data.decode("utf-8").split("\f") if data else []


def named(parser: str) -> Parser:
    """The function that a text like ``package.module:name`` names."""
    module, _, name = parser.partition(":")
    return getattr(importlib.import_module(module), name)


@dataclass
class Share(InputPartition):
    """Files, each with which of how many ranges of its pages."""

    files: list[tuple[str, int, int]]


def shares(files: list[tuple[str, int]], size: int) -> list[Share]:
    """(path, bytes) of files as tasks of a size."""
    out, small, held = [], [], 0
    for path, n in files:
        parts = -(-n // size)
        if parts > 1:
            out += [Share([(path, i, parts)]) for i in range(parts)]
            continue
        if small and held + n > size:
            out, small, held = [*out, Share(small)], [], 0
        small, held = [*small, (path, 0, 1)], held + n
    return [*out, Share(small)] if small else out


class PageTextReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.fieldNames()
        unknown = set(self.names) - set(TYPES)
        if unknown:
            raise ValueError(f"page_text has no {sorted(unknown)}")
        self.folder, self.pattern = options.get("path"), options.get("pattern", "*")
        if not self.folder:
            raise ValueError("page_text needs a path")
        self.size, self.parser = int(options.get("bytes", 32 << 20)), options.get("parser", f"{__name__}:form_feeds")

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size or 0) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern))
        return shares(files, self.size)

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.folder)
        rows, held = [], 0
        for path, share, parts in partition.files if partition else []:
            for row in self.pages(system, path, share, parts):
                rows.append(row)
                held += len(row[2] or "")
                if len(rows) >= ROWS or held >= CHARACTERS:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def pages(self, system, path: str, share: int, parts: int) -> Iterator[tuple[str, int | None, str | None, str | None]]:
        """A share of a file's pages; a file's error is in its first share."""
        try:
            with system.open_input_stream(path) as f:
                pages = named(self.parser)(f.read())
            n = len(pages)
        except Exception as e:  # noqa: BLE001 - whatever a plug-in raises is the row's error
            if share == 0:
                yield path, None, None, f"{type(e).__name__}: {e}"
            return
        for i in range(n * share // parts, n * (share + 1) // parts):
            try:
                yield path, i + 1, (pages[i] or "") if "text" in self.names else None, None
            except Exception as e:  # noqa: BLE001
                yield path, i + 1, None, f"{type(e).__name__}: {e}"

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = dict(zip(TYPES, zip(*rows, strict=True), strict=True))
        return pa.record_batch([pa.array(columns[n], TYPES[n]) for n in self.names], self.names)


class PageTextSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageTextReader:
        return PageTextReader(schema, dict(self.options))


def read_page_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", parser: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects): document_id, pdf_page, text of what was parsed; document_id, pdf_page, error of the rest."""
    spark.dataSource.register(PageTextSource)
    read = spark.read.format("page_text").option("pattern", pattern)
    rows = (read.option("parser", parser) if parser else read).load(folder)
    return rows.filter(F.col("error").isNull()).drop("error"), rows.filter(F.col("error").isNotNull()).drop("text")
