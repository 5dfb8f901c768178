"""Remote listings as Spark data sources: spaces, pages, attachments, drives, items, and an incremental delta stream.

``spark.read.format("remote_listing")`` reads one kind page by page, a partition for each parent (the pages of a space, the
items of a drive): from a folder of JSON exports, or from a client of one's own, named by the option ``client`` as
``module:function`` (called with the options). A filter on the parent's column leaves the other parents unasked. A page that fails
is asked for again at its cursor. ``spark.readStream.format("remote_delta")`` hands out changed items with the token as offset.
Register both with ``register(spark)``.
"""

from __future__ import annotations

import importlib
import json
import time
from abc import ABC, abstractmethod
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader

SCHEMAS = {
    "spaces": "id string, key string, name string, type string, description string, homepage_id string",
    "pages": "id string, title string, space_id string, space_key string, parent_id string, version int, author string, created_at string, modified_at string, summary string",
    "attachments": "id string, page_id string, filename string, media_type string, file_size bigint, comment string",
    "drives": "id string, site_id string, name string, description string, owner string, created_at string, modified_at string, used_bytes bigint",
    "items": "id string, drive_id string, parent_id string, name string, is_folder boolean, size bigint, mime_type string, author string, modified_by string, created_at string, modified_at string",
}


#: The column of a kind that names what its rows hang on, and the kind of that.
PARENTS = {"pages": ("space_id", "spaces"), "attachments": ("page_id", "pages"), "items": ("drive_id", "drives")}


class Client(ABC):
    """What a remote system offers: rows of a kind in pages, file content, and changes since a token."""

    @abstractmethod
    def page(self, kind: str, parent: str | None, cursor: str | None, limit: int) -> tuple[list[dict], str | None]:
        """Up to ``limit`` rows of a kind, of one parent if one is given, from a cursor on (None: the beginning), and the next cursor (None: no more)."""

    def list(self, kind: str, parent: str | None = None, limit: int = 500) -> Iterable[dict]:
        """All rows, page after page."""
        cursor, more = None, True
        while more:
            rows, cursor = self.page(kind, parent, cursor, limit)
            yield from rows
            more = cursor is not None

    def parents(self, kind: str) -> list[str] | None:
        """Ids of what rows of this kind hang on; None if they are listed at once."""
        return [r["id"] for r in self.list(PARENTS[kind][1])] if kind in PARENTS else None

    def content(self, item_id: str) -> bytes:
        raise NotImplementedError

    def delta(self, token: str | None) -> tuple[list[dict], str]:
        """Items changed after the token, and the next token."""
        rows = sorted((r for r in self.list("items") if (r.get("modified_at") or "") > (token or "")), key=lambda r: (r.get("modified_at") or "", r["id"]))
        return rows, max([r.get("modified_at") or "" for r in rows] + [token or ""])


class FolderClient(Client):
    """JSON exports under a folder of any file system: a file ``kind.json`` (an array, or an object with results or value), or a folder ``kind`` of files with a
    row a line, in folders ``parent=id`` if they are kept by parent."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)

    def _files(self, path: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".json") and f.size)

    def _read(self, path: str) -> str:
        with self.fs.open_input_stream(path) as f:
            return f.read().decode()

    def _whole(self, kind: str) -> list[dict] | None:
        from pyarrow import fs

        path = f"{self.root}/{kind}.json"
        if self.fs.get_file_info(path).type != fs.FileType.File:
            return None
        got = json.loads(self._read(path))
        return got if isinstance(got, list) else got.get("results", got.get("value", []))

    def parents(self, kind: str) -> list[str] | None:
        from pyarrow import fs

        if kind not in PARENTS:
            return None
        whole = self._whole(kind)
        if whole is not None:
            return sorted({str(r[PARENTS[kind][0]]) for r in whole if r.get(PARENTS[kind][0]) is not None}) + [""] * any(r.get(PARENTS[kind][0]) is None for r in whole)
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{kind}", allow_not_found=True))
        return sorted(f.base_name.removeprefix("parent=") for f in found if f.base_name.startswith("parent=")) or None

    def page(self, kind: str, parent: str | None, cursor: str | None, limit: int) -> tuple[list[dict], str | None]:
        """Cursors are file and line; of a single file the row's place."""
        whole = self._whole(kind)
        if whole is not None:
            rows = whole if parent is None else [r for r in whole if str(r.get(PARENTS[kind][0]) or "") == parent]
            at = int(cursor or 0)
            return rows[at : at + limit], str(at + limit) if at + limit < len(rows) else None
        files = self._files(f"{self.root}/{kind}" if parent is None else f"{self.root}/{kind}/parent={parent}")
        number, at = map(int, (cursor or "0:0").split(":"))
        if number >= len(files):
            return [], None
        lines = self._read(files[number]).splitlines()
        rows = [json.loads(x) for x in lines[at : at + limit]]
        if at + limit < len(lines):
            return rows, f"{number}:{at + limit}"
        return rows, f"{number + 1}:0" if number + 1 < len(files) else None


def open_client(options: dict) -> Client:
    if "client" not in options:
        return FolderClient(options["path"])
    module, name = options["client"].split(":")
    return getattr(importlib.import_module(module), name)(options)


def _columns(kind: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in SCHEMAS[kind].split(", ")]


def _row(r: dict, kind: str) -> tuple:
    cast = {"int": int, "bigint": int, "boolean": bool, "string": str}
    return tuple(None if r.get(n) is None else cast[t](r[n]) for n, t in _columns(kind))


class Parent(InputPartition):
    """The rows of one kind that hang on some parents; None: all rows of the kind."""

    def __init__(self, parents: list[str] | None):
        super().__init__(None)
        self.parents = parents


class _Reader(DataSourceReader):
    """Options: kind, path or client, limit (rows of a page), tries (of a page), wait (seconds before the second try, doubled for each further one), partitions (at most; parents are dealt out over them)."""

    def __init__(self, options: dict):
        self.options, self.kind, self.wanted = options, options["kind"], None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """A condition on the parent's column chooses partitions; all conditions are also checked by Spark."""
        column = PARENTS.get(self.kind, ("",))[0]
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (column,):
                values = {str(v) for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None}
                self.wanted = values if self.wanted is None else self.wanted & values
            yield f

    def partitions(self):
        parents = self._tried(lambda: open_client(self.options).parents(self.kind))
        if parents is None:
            return [Parent(None)]
        held = [p for p in parents if self.wanted is None or p in self.wanted]
        n = max(1, min(len(held), int(self.options.get("partitions", 10_000))))
        return [Parent(held[k::n]) for k in range(n)]

    def _tried(self, call):
        tries, wait = int(self.options.get("tries", 4)), float(self.options.get("wait", 0.5))
        for k in range(tries):
            try:
                return call()
            except (OSError, TimeoutError):
                if k + 1 == tries:
                    raise
                time.sleep(wait * 2**k)

    def read(self, partition):
        client, limit = open_client(self.options), int(self.options.get("limit", 500))
        for parent in [None] if partition.parents is None else partition.parents:
            cursor, more = None, True
            while more:
                rows, cursor = self._tried(lambda p=parent, c=cursor: client.page(self.kind, p, c, limit))
                for r in rows:
                    yield _row(r, self.kind)
                more = cursor is not None


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_listing"

    def schema(self) -> str:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Delta(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.client = FolderClient(options["path"])

    def initialOffset(self) -> dict:
        return {"token": ""}

    def read(self, start: dict):
        rows, token = self.client.delta(start["token"])
        return iter([_row(r, "items") for r in rows]), {"token": token}

    def readBetweenOffsets(self, start: dict, end: dict):
        rows, _ = self.client.delta(start["token"])
        return iter([_row(r, "items") for r in rows if (r.get("modified_at") or "") <= end["token"]])

    def commit(self, end: dict) -> None:
        return None


class DeltaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_delta"

    def schema(self) -> str:
        return SCHEMAS["items"]

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Delta(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ListingSource, DeltaSource):
        spark.dataSource.register(source)
