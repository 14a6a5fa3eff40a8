"""Files in the shared folder, on whatever file system it is."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def at(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return fs, path.rstrip("/")


class Whole:
    """A file that appears under its name once it is complete; a task that runs again replaces it by an equal one."""

    def __init__(self, uri: str):
        self.fs, self.path = at(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream = self.fs.open_output_stream(self.part, compression=None)
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def listed(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(name, bytes) of the complete files under a folder."""
    fs, path = at(uri)
    infos = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=True))
    return sorted((x.path[len(path) + 1 :], x.size) for x in infos if x.type == pafs.FileType.File and x.path.endswith(suffix))
