"""Files on any storage that executors reach: plain paths or URIs that Arrow knows (s3, gs, hdfs)."""

from __future__ import annotations

import os
import re
import stat
import uuid
from collections.abc import Iterable, Iterator

from pyarrow import fs


def is_local(location: str) -> bool:
    """Plain paths and ``file:`` URIs, with or without an empty authority."""
    return location.startswith("file:") or not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", location)


def local_path(location: str) -> str:
    return re.sub(r"\Afile:(?://(?=/))?", "", location)


def absolute(location: str) -> str:
    """One name per place, so that overlapping roots are recognised."""
    return os.path.abspath(local_path(location)) if is_local(location) else location.rstrip("/")


def open_storage(location: str) -> tuple[fs.FileSystem, str]:
    """The file system of a location and the path inside it."""
    if is_local(location):
        return fs.LocalFileSystem(), local_path(location)
    return fs.FileSystem.from_uri(re.sub(r"\As3[an]:", "s3:", location))  # Hadoop's names for S3


def list_dir(location: str) -> Iterator[tuple[str, bool, int]]:
    """``(name, is_dir, size)`` of directories and regular files, one by one; links and unreadable places are left out."""
    if is_local(location):
        try:
            with os.scandir(local_path(location)) as entries:
                for e in entries:
                    try:
                        info = e.stat(follow_symlinks=False)
                    except OSError:
                        continue
                    if stat.S_ISDIR(info.st_mode):
                        yield e.name, True, 0
                    elif stat.S_ISREG(info.st_mode):
                        yield e.name, False, info.st_size
        except OSError:
            pass
        return
    system, path = open_storage(location)
    try:
        infos = system.get_file_info(fs.FileSelector(path, recursive=False))
    except OSError:
        return
    for i in infos:
        if i.type in (fs.FileType.Directory, fs.FileType.File):
            yield i.base_name, i.type == fs.FileType.Directory, i.size or 0


def file_size(location: str) -> int | None:
    """Size of a file, None for a directory; a place that does not exist is an error."""
    system, path = open_storage(location)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(location)
    return info.size if info.type == fs.FileType.File else None


def read_file(location: str) -> tuple[bytes | None, str | None]:
    """``(bytes, error)``; both None when the file has vanished."""
    try:
        system, path = open_storage(location)
        with system.open_input_stream(path) as f:
            return f.read(), None
    except FileNotFoundError:
        return None, None
    except OSError as e:
        return None, str(e)


def remove_file(location: str) -> None:
    """Delete a file; one that is not there is no error, so that a task may be repeated."""
    system, path = open_storage(location)
    if system.get_file_info(path).type == fs.FileType.File:
        system.delete_file(path)


def move_file(location: str, target: str) -> None:
    """Give a file its last name; when it already has it, that is no error, so that a task may be repeated."""
    system, path = open_storage(location)
    _, to = open_storage(target)
    system.create_dir(os.path.dirname(to), recursive=True)
    try:
        system.move(path, to)
    except OSError:
        kinds = [i.type for i in system.get_file_info([path, to])]
        if kinds != [fs.FileType.NotFound, fs.FileType.File]:
            raise


CHUNK_BYTES = 8 << 20


def chunks_of(location: str) -> Iterator[bytes]:
    system, path = open_storage(location)
    with system.open_input_stream(path) as f:
        while chunk := f.read(CHUNK_BYTES):
            yield chunk


def write_at(location: str, at: int, chunks: Iterable[bytes]) -> None:
    """Write into a file from byte ``at`` on, leaving its other bytes; for mounted storage alone."""
    path = local_path(location)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(os.open(path, os.O_CREAT | os.O_WRONLY, 0o666), "wb") as f:
        f.seek(at)
        for chunk in chunks:
            f.write(chunk)


class StagedFile:
    """Write under a passing name, then rename: a repeated or lost task leaves no half file."""

    def __init__(self, location: str):
        self.system, self.path = open_storage(location)
        self.passing = f"{self.path}.{uuid.uuid4().hex}.part"
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.stream = self.system.open_output_stream(self.passing)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def commit(self) -> None:
        self.stream.close()
        self.system.move(self.passing, self.path)


class PassingFile:
    """A file in a run's own folder, under a name of its own: a repeated or lost task leaves nothing that counts."""

    def __init__(self, folder: str, name: str | None = None):
        self.location = f"{folder}/{name or uuid.uuid4().hex}"
        system, path = open_storage(self.location)
        system.create_dir(os.path.dirname(path), recursive=True)
        self.stream = system.open_output_stream(path)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
