"""One ordered JSON document as a sink of Spark: tasks write sorted parts, the commit merges them. The same rows give the same bytes."""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "ordered_document"


def _place(path: str):
    """The file system of a path and the path in it; whatever Arrow opens."""
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


@dataclass
class Part(WriterCommitMessage):
    path: str | None
    rows: int


class DocumentSource(DataSource):
    """Options: path; order, the names of columns to order by, parted by commas; head, a JSON object that stands before the rows."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(dict(self.options), [f.name for f in schema.fields], overwrite)


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool) -> None:
        self.path, self.names, self.overwrite = options["path"], names, overwrite
        self.order = options["order"].split(",")
        self.head = json.loads(options.get("head", "{}"))
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def _key(self, line: str) -> tuple:
        row = json.loads(line)
        return tuple((row[c] is not None, row[c] if row[c] is not None else 0) for c in self.order)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        """The rows of a task, which are sorted, a line each; a task that is run again writes another part, and only the parts that are
        reported are merged."""
        fs, folder = _place(self.parts)
        fs.create_dir(folder, recursive=True)
        path, n, out = f"{folder}/{uuid.uuid4().hex}", 0, None
        for row in iterator:
            out = out or fs.open_output_stream(path)
            out.write((json.dumps({c: row[c] for c in self.names}, ensure_ascii=False) + "\n").encode())
            n += 1
        if out:
            out.close()
        return Part(path if out else None, n)

    def _lines(self, fs, path: str) -> Iterator[str]:
        import io

        with fs.open_input_stream(path) as f:
            for line in io.TextIOWrapper(io.BufferedReader(f), "utf-8", newline="\n"):
                yield line.rstrip("\n")

    def commit(self, messages: list) -> None:
        """The head, then the rows of all parts in order, one at a time; the document appears when it is whole."""
        fs, path = _place(self.path)
        if not self.overwrite and fs.get_file_info(path).type.name != "NotFound":
            self.abort(messages)
            raise FileExistsError(self.path)
        whole = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(whole) as out:
            head = json.dumps(self.head, ensure_ascii=False, indent=1, sort_keys=True)
            out.write((head[:-1].rstrip() + ("," if self.head else "") + '\n "rows": [').encode())
            between = "\n  "
            for line in heapq.merge(*(self._lines(fs, m.path) for m in messages if m and m.path), key=self._key):
                out.write((between + line).encode())
                between = ",\n  "
            out.write(b"\n ]\n}\n")
        if self.overwrite and fs.get_file_info(path).type.name != "NotFound":
            fs.delete_file(path)
        fs.move(whole, path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, folder = _place(self.parts)
        if fs.get_file_info(folder).type.name != "NotFound":
            fs.delete_dir(folder)


def write_document(rows: DataFrame, path: str, order: list[str], head: dict | None = None, overwrite: bool = True) -> None:
    """rows as one document {head..., "rows": [...]}, ordered by `order`, nulls first, which must tell all rows apart. No clock is in it."""
    spark = rows.sparkSession
    spark.dataSource.register(DocumentSource)
    sorted_parts = rows.sortWithinPartitions(*order)
    sorted_parts.write.format(NAME).mode("overwrite" if overwrite else "append").option("path", path).option("order", ",".join(order)).option("head", json.dumps(head or {})).save()


def read_document(spark: SparkSession, path: str, head: str, rows: str) -> tuple[DataFrame, DataFrame]:
    """The head (one row) and the rows of a document; head and rows are their schemas."""
    doc = spark.read.schema(f"{head}, `rows` array<struct<{rows}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.drop("rows"), doc.selectExpr("inline(`rows`)")
