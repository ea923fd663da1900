"""A batch data source of page-vector files: ``format("page_vectors")`` reads and writes ``.bin`` files in a folder.

``spark.dataSource.register(PageVectors)``; rows are pages (slug, dim, model, body_hash, chunks).
Reading deals the files to tasks by size; files that can't be decoded are passed over, or are an
error with ``mode`` ``failfast``.  Writing puts each task's files in a folder of its own below
``_pending``; only when all tasks have ended are they moved into place, so a failed job leaves
nothing that a reader sees, and a task that ran twice counts once.  With ``overwrite`` the
folder's other files go at the commit.  A slug that two tasks wrote is an error before any
file is moved.  The folder may lie in any file system that Arrow opens by URI.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .vectorfiles import decode, encode

SCHEMA = "slug string, dim int, model string, body_hash string, chunks array<struct<index:int,start:int,end:int,vector:array<float>>>"
#: Bytes of the files that a task reads, about.
TASK_BYTES = 32 << 20
_SLUG = re.compile(r"[A-Za-z0-9._-]+")


def _opened(folder: str):
    """The file system and path of a folder."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    return files, path.rstrip("/")


def _listed(folder: str) -> list[tuple[str, int]]:
    """Name and size of the folder's vector files, by name."""
    from pyarrow import fs

    files, path = _opened(folder)
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".bin"))


class _Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, folder: str, strict: bool) -> None:
        self.folder, self.strict = folder, strict

    def partitions(self) -> list[InputPartition]:
        parts: list[list[str]] = [[]]
        held = 0
        for name, size in _listed(self.folder):
            if parts[-1] and held + size > TASK_BYTES:
                parts.append([])
                held = 0
            parts[-1].append(name)
            held += size
        return [_Files(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, path = _opened(self.folder)
        for name in partition.names:
            with files.open_input_stream(f"{path}/{name}") as f:
                data = f.read()
            try:
                dim, model, digest, chunks = decode(data)
            except ValueError:
                if self.strict:
                    raise
                continue
            yield name.removesuffix(".bin"), dim, model, digest, [{"index": i, "start": a, "end": b, "vector": v} for i, a, b, v in chunks]


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, path = _opened(self.folder)
        own = f"{path}/_pending/{self.job}/{uuid.uuid4().hex}"  # another folder for each attempt
        files.create_dir(own, recursive=True)
        names = []
        for row in iterator:
            if not row.slug or not _SLUG.fullmatch(row.slug) or row.slug.strip(".") != row.slug:
                raise ValueError(f"no page name: {row.slug!r}")
            chunks = sorted((c["index"], c["start"], c["end"], list(c["vector"])) for c in row.chunks or [])
            with files.open_output_stream(f"{own}/{row.slug}.bin") as out:
                out.write(encode(row.dim, row.model, row.body_hash, chunks))
            names.append(f"{row.slug}.bin")
        return _Written(own, names)

    def commit(self, messages: list) -> None:
        files, path = _opened(self.folder)
        names = [n for m in messages for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            twice = sorted({n for n in names if names.count(n) > 1})[:5]
            raise ValueError(f"pages that came twice: {', '.join(twice)}")
        for m in messages:
            for name in m.names:
                files.move(f"{m.folder}/{name}", f"{path}/{name}")
        if self.overwrite:
            kept = set(names)
            for name, _ in _listed(self.folder):
                if name not in kept:
                    files.delete_file(f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Nothing of this job stays in the pending folder."""
        from pyarrow import fs

        files, path = _opened(self.folder)
        if files.get_file_info(f"{path}/_pending/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{path}/_pending/{self.job}")


class PageVectors(DataSource):
    """Options: path, and mode (``permissive`` or ``failfast``) for reading."""

    @classmethod
    def name(cls) -> str:
        return "page_vectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("mode", "permissive").lower() == "failfast")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)
