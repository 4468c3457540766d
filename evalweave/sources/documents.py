"""Small JSON documents as a Spark data source: files are chosen before they are read.

    documents.register(spark)
    spark.read.format("json_documents").option("path", folder).option("pattern", "*_summary.json").load()

Rows are (path, file_name, cell, value): ``cell`` is the file name without the fixed end of the pattern,
``value`` the text, for ``parse_json`` or ``from_json``.  Equality and IN filters on file_name and cell
choose files by their names.  With the option ``newest`` only the file greatest by path is read; with
``key`` the greatest that is a JSON object whose member ``key`` is an object.  Files are dealt out by their
sizes.  The tasks open the files themselves: the folder is a path that every executor mounts, or a URI
that pyarrow opens.  Folders that only Spark reaches take the functions of ``readers``.
"""

from __future__ import annotations

import fnmatch
import json
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

PARTITION_BYTES = 32 << 20
SCHEMA = "path string, file_name string, cell string, value string"


@dataclass(frozen=True)
class Chosen(InputPartition):
    """Files of one task."""

    paths: tuple[str, ...]


def _store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if re.match(r"^[a-z][a-z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _text(store, path: str) -> str:
    with store.open_input_stream(path) as file:
        return file.read().decode("utf-8")


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"].rstrip("/"), options.get("pattern", "*.json")
        self.newest = options.get("newest", "false").lower() == "true"
        self.key = options.get("key")
        self.wanted: list[tuple[str, frozenset]] = []

    def cell_of(self, name: str) -> str:
        tail = re.sub(r".*[*?\]]", "", self.pattern)
        return name[: len(name) - len(tail)] if tail and name.endswith(tail) else name

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on names are settled here; Spark applies the others."""
        for f in filters:
            names = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            # With ``newest`` a filter must apply after the choice, not before.
            if names is None or self.newest or f.attribute not in (("file_name",), ("cell",)):
                yield f
            else:
                self.wanted.append((f.attribute[0], frozenset(names)))

    def partitions(self) -> list[Chosen]:
        from pyarrow import fs

        store, root = _store(self.path)
        files = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = info.base_name
            if info.type == fs.FileType.File and fnmatch.fnmatchcase(name, self.pattern) and not name.startswith(("_", ".")):
                of = {"file_name": name, "cell": self.cell_of(name)}
                if all(of[column] in names for column, names in self.wanted):
                    files.append((info.path, info.size or 0))
        files.sort()
        if self.newest:
            found = next((p for p, _ in reversed(files) if self._fits(store, p)), None)
            return [Chosen((found,))] if found else [Chosen(())]
        out, held, size = [], [], 0
        for path, length in files:
            if held and size + length > PARTITION_BYTES:
                out.append(Chosen(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += length
        return [*out, Chosen(tuple(held))]

    def _fits(self, store, path: str) -> bool:
        if self.key is None:
            return True
        try:
            doc = json.loads(_text(store, path))
        except ValueError:
            return False
        return isinstance(doc, dict) and isinstance(doc.get(self.key), dict)

    def read(self, partition: Chosen) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            yield path, name, self.cell_of(name), _text(store, path)


class JsonDocuments(DataSource):
    """The source ``json_documents``; options path, pattern, newest and key."""

    @classmethod
    def name(cls) -> str:
        return "json_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonDocuments)


# Workers receive the classes by value and need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
