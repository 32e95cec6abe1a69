"""Byte access to files for Python data sources: local paths, and any store that Arrow's file systems open by URI."""

from __future__ import annotations

import io

from pyarrow import fs


def opened(path: str):
    """File system and path within it; a path without scheme is local."""
    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def writes_in_place(path: str) -> bool:
    """Whether tasks can write parts of one file side by side: on local and mounted paths."""
    return isinstance(opened(path)[0], fs.LocalFileSystem)


def input_file(path: str):
    """A seekable stream that reads 64 KB ahead."""
    store, inner = opened(path)
    return io.BufferedReader(store.open_input_file(inner), 1 << 16)


def file_size(path: str) -> int:
    store, inner = opened(path)
    return store.get_file_info(inner).size or 0


def files_below(path: str, suffix: str = "") -> list[str]:
    """The file itself, or the files right in a folder, in the order of their names; hidden ones and markers are left out."""
    store, inner = opened(path)
    info = store.get_file_info(inner)
    if info.type != fs.FileType.Directory:
        return [path]
    found = [f for f in store.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File]
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.base_name[:1] not in "._" and f.base_name.endswith(suffix))
