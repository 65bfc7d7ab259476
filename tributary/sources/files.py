"""Files by path or URI, for data sources that Python reads and writes on executors: names are listed once, bytes are read
where they are needed."""

from __future__ import annotations

import fnmatch
import os

from pyarrow import fs


def resolved(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or of a local path."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, of the files of the folder, or of those that match in the last part; in order of names."""
    files, own = resolved(path)
    head, _, last = own.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in files.get_file_info(fs.FileSelector(head, allow_not_found=True)) if fnmatch.fnmatch(f.base_name, last)]
    else:
        info = files.get_file_info(own)
        found = files.get_file_info(fs.FileSelector(own)) if info.type == fs.FileType.Directory else [info]
    kept = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return [(_uri(path, f.path), f.size) for f in sorted(kept, key=lambda f: f.path)]


def _uri(given: str, path: str) -> str:
    """The path in the form that the given one has."""
    if "://" not in given:
        return f"file://{path}" if given.startswith("file:") else path
    scheme, _, rest = given.partition("://")
    authority = "" if rest.startswith("/") else rest.partition("/")[0]
    return f"{scheme}://{authority}{path}" if path.startswith("/") else f"{scheme}://{path}"


def opened(path: str):
    """A file that can be read anywhere in it."""
    files, own = resolved(path)
    return files.open_input_file(own)
