"""A Python data source that reads a tree of Markdown files.

Register with ``register(spark)``; then ``spark.read.format("markdown_dir").load(path)`` gives ``(doc_key,
raw, source_path)``. Paths with a component that begins with a dot, symbolic links, and files with another
suffix are skipped; bytes that aren't UTF-8 raise. The driver only lists; batches of files are read by tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanwright.functions.markdown import SUFFIXES

BATCH_BYTES = 32 << 20


def list_files(root: str) -> list[tuple[str, str, int]]:
    """``(doc_key, path, size)`` of all files to read, sorted by key."""
    found = []
    for folder, folders, files in os.walk(root):
        folders[:] = [f for f in folders if not f.startswith(".") and not os.path.islink(os.path.join(folder, f))]
        for name in files:
            path = os.path.join(folder, name)
            if name.startswith(".") or os.path.splitext(name)[1].lower() not in SUFFIXES or os.path.islink(path) or not os.path.isfile(path):
                continue
            found.append((Path(path).relative_to(root).as_posix(), path, os.path.getsize(path)))
    return sorted(found)


class FileBatch(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class MarkdownReader(DataSourceReader):
    def __init__(self, root: str):
        if not os.path.isdir(root):
            raise FileNotFoundError(root)
        self.root = root

    def partitions(self) -> list[InputPartition]:
        batches: list[InputPartition] = []
        batch: list[tuple[str, str]] = []
        size = 0
        for key, path, n in list_files(self.root):
            if batch and size + n > BATCH_BYTES:
                batches.append(FileBatch(batch))
                batch, size = [], 0
            batch.append((key, path))
            size += n
        return [*batches, FileBatch(batch)]

    def read(self, partition: FileBatch) -> Iterator[tuple[str, str, str]]:
        for key, path in partition.files:
            with open(path, encoding="utf-8") as f:  # universal line ends
                yield key, f.read(), path


class MarkdownDirectory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown_dir"

    def schema(self) -> str:
        return "doc_key string, raw string, source_path string"

    def reader(self, schema) -> MarkdownReader:
        return MarkdownReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MarkdownDirectory)


def load_directory(spark: SparkSession, root: str, source: str | None = None, captured_at=None):
    """A directory as a snapshot: ``(header, documents)``."""
    from spanwright.operators.snapshots import build_snapshot, load_markdown

    register(spark)
    documents = load_markdown(spark.read.format("markdown_dir").load(root))
    return build_snapshot(documents, source if source is not None else root, captured_at)
