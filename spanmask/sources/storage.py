"""File systems by URI, for work inside tasks."""
from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache


def absolute(folder: str) -> str:
    return folder if ":" in folder else os.path.abspath(folder)


@lru_cache(maxsize=1)
def _local():
    from pyarrow import fs
    return fs.LocalFileSystem()


def open_fs(uri: str):
    """(file system, path in it) of a path or URI."""
    if "://" not in uri:
        return _local(), uri.removeprefix("file:")
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def files_in(folder: str) -> Iterator[tuple[str, str, int]]:
    """(path, name, bytes) of the files directly in ``folder``, one after the other."""
    from pyarrow import fs
    system, path = open_fs(folder)
    if isinstance(system, fs.LocalFileSystem):           # a local listing is streamed
        prefix = "file://" if "://" in folder else ""
        with os.scandir(path) as entries:
            for e in entries:
                if e.is_file():
                    yield prefix + e.path, e.name, e.stat().st_size
    else:
        scheme = folder.split("://")[0] + "://"
        for f in system.get_file_info(fs.FileSelector(path)):
            if f.type == fs.FileType.File:
                yield scheme + f.path, f.base_name, f.size
