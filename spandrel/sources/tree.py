"""A source tree as a data source of Spark: ``spark.read.format("source_tree").load(root)``.

Folders that are not scanned are left out before they are listed; names of folders above the root don't matter. Files go to partitions of about ``PARTITION_BYTES``. Every file gives a row, also an empty, an
unreadable or a too large one: ``status`` says which, and text is then null (empty for an empty file). Roots are local paths or URIs that pyarrow's file systems know.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spandrel.sources.scan import LANGUAGES, MAX_BYTES, SKIPPED

PARTITION_BYTES = 32 << 20
#: What opening a file counts beside its bytes.
OPEN_BYTES = 64 << 10


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


def system(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def listed(root: str, endings: tuple[str, ...]) -> Iterator[tuple[str, int]]:
    """path (from the root) and size of the files with one of ``endings``, folder by folder."""
    files, top = system(root.rstrip("/"))
    todo = [top]
    while todo:
        for info in sorted(files.get_file_info(fs.FileSelector(todo.pop())), key=lambda i: i.path):
            if info.type == fs.FileType.Directory:
                if info.base_name not in SKIPPED:
                    todo.append(info.path)
            elif info.base_name.lower().endswith(endings):
                yield info.path[len(top) + 1 :], info.size or 0


def dealt(files: Iterator[tuple[str, int]], most: int) -> list[Files]:
    """Partitions of about ``most`` bytes, an opened file counting as OPEN_BYTES more."""
    out, size = [], most
    for path, length in files:
        weight = min(length, MAX_BYTES) + OPEN_BYTES
        if size + weight > most and (not out or out[-1].files):
            out.append(Files([]))
            size = 0
        out[-1].files.append((path, length))
        size += weight
    return out


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/")
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        return dealt(listed(self.root, tuple(e for _, es, *_ in LANGUAGES for e in es)), self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, top = system(self.root)
        lang = {e: name for name, es, *_ in LANGUAGES for e in es}
        for path, length in partition.files:
            text, status = None, "too large"
            if length <= MAX_BYTES:
                try:
                    with files.open_input_stream(f"{top}/{path}") as f:
                        raw = f.read()
                    text, status = raw.decode("utf-8", "replace"), "ok" if raw else "empty"
                except OSError:
                    status = "unreadable"
            yield path, lang.get("." + path.rpartition(".")[2].lower()), length, status, text


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, lang string, length long, status string, text string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
