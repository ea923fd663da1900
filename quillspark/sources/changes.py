"""A streaming source of a folder's changes: creations, updates and deletions between two listings.

``spark.dataSource.register(FolderChanges)``, then
``spark.readStream.format("folder_changes").option("path", root).option("state", folder)``.

An offset is the number of a listing.  Each trigger lists the folder; a listing that differs
from the last is written to the state folder, dealt into buckets by path, under a new number.
A batch is the difference of two numbered listings, read bucket by bucket by the tasks, so a
batch that runs again after a failure gives the same rows, and a stream that starts again goes
on from its last listing.  Listings older than the committed one are removed.

Rows: ts (the file's time; for a deletion the time of the listing that misses it), op (create,
modify, delete) and path within the folder, as ``domain_events`` takes them.  Both folders may lie
in any file system that Arrow opens by URI (local paths, hdfs, s3).
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BUCKETS = 16


class Store:
    """The numbered listings of a state folder."""

    def __init__(self, root: str, state: str, buckets: int) -> None:
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        self.state_files, self.state = fs.FileSystem.from_uri(state) if "://" in state else (fs.LocalFileSystem(), state)
        self.root, self.state, self.buckets = self.root.rstrip("/"), self.state.rstrip("/"), buckets

    def listed(self) -> dict[str, list[int]]:
        """Path within the folder: time in microseconds, and size."""
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        return {f.path[len(self.root) :].lstrip("/"): [(f.mtime_ns or 0) // 1000, f.size] for f in found if f.type == fs.FileType.File}

    def numbers(self) -> list[int]:
        """Listings that were written whole."""
        from pyarrow import fs

        found = self.state_files.get_file_info(fs.FileSelector(self.state, allow_not_found=True))
        return sorted(int(f.base_name[5:]) for f in found if f.type == fs.FileType.File and f.base_name.startswith("done-"))

    def write(self, number: int, files: dict[str, list[int]]) -> None:
        parts: list[dict[str, list[int]]] = [{} for _ in range(self.buckets)]
        for path, what in files.items():
            parts[zlib.crc32(path.encode()) % self.buckets][path] = what
        self.state_files.create_dir(f"{self.state}/listing-{number}", recursive=True)
        for bucket, part in enumerate(parts):
            with self.state_files.open_output_stream(f"{self.state}/listing-{number}/{bucket}.json") as out:
                out.write(json.dumps(part).encode())
        with self.state_files.open_output_stream(f"{self.state}/done-{number}") as out:  # last: a listing without it doesn't count
            out.write(json.dumps({"at": time.time_ns() // 1000, "buckets": self.buckets}).encode())

    def read(self, number: int, bucket: int) -> dict[str, list[int]]:
        if not number:
            return {}
        with self.state_files.open_input_stream(f"{self.state}/listing-{number}/{bucket}.json") as f:
            return json.loads(f.read())

    def at(self, number: int) -> int:
        with self.state_files.open_input_stream(f"{self.state}/done-{number}") as f:
            return json.loads(f.read())["at"]

    def drop(self, number: int) -> None:
        self.state_files.delete_file(f"{self.state}/done-{number}")
        self.state_files.delete_dir(f"{self.state}/listing-{number}")


class _Bucket(InputPartition):
    def __init__(self, start: int, end: int, bucket: int) -> None:
        self.start, self.end, self.bucket = start, end, bucket


class _Reader(DataSourceStreamReader):
    def __init__(self, store: tuple[str, str, int]) -> None:
        self.store = store

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        store = Store(*self.store)
        last = max(store.numbers(), default=0)
        now = store.listed()
        before: dict[str, list[int]] = {}
        for bucket in range(store.buckets):
            before |= store.read(last, bucket)
        if now != before:
            last += 1
            store.write(last, now)
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Bucket(start["listing"], end["listing"], b) for b in range(self.store[2])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store = Store(*self.store)
        when = lambda micros: datetime.fromtimestamp(micros / 1e6, timezone.utc)
        old, new = store.read(partition.start, partition.bucket), store.read(partition.end, partition.bucket)
        for path, (at, size) in sorted(new.items()):
            if path not in old:
                yield when(at), "create", path
            elif old[path] != [at, size]:
                yield when(at), "modify", path
        for path in sorted(set(old) - set(new)):
            yield when(store.at(partition.end)), "delete", path

    def commit(self, end: dict) -> None:
        store = Store(*self.store)
        for number in store.numbers():
            if number < end["listing"]:
                store.drop(number)


class FolderChanges(DataSource):
    """Options: path, state, and buckets (tasks of a batch)."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "ts timestamp, op string, path string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader((self.options["path"], self.options["state"], int(self.options.get("buckets", BUCKETS))))
