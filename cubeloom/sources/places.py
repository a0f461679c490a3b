"""Names of outputs in any store: local paths as they are, others as URIs that pyarrow opens."""

from __future__ import annotations

import posixpath
import re
from pathlib import Path

from pyarrow import fs


class Uri(str):
    """A file or folder of a store that is not mounted; ``/`` goes below it, as it does for a path."""

    __slots__ = ()

    def __truediv__(self, name: object) -> Uri:
        return Uri(f"{self.rstrip('/')}/{name}")

    @property
    def name(self) -> str:
        return posixpath.basename(self)

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self)

    def exists(self) -> bool:
        store, at = self.store()
        return store.get_file_info(at).type != fs.FileType.NotFound

    def write(self, data: bytes) -> None:
        """The whole file, under its name only once it is whole."""
        store, at = self.store()
        draft = posixpath.join(posixpath.dirname(at), f".{posixpath.basename(at)}.draft")
        with store.open_output_stream(draft, compression=None) as out:
            out.write(data)
        if self.exists():
            store.delete_file(at)
        store.move(draft, at)

    def delete(self) -> None:
        store, at = self.store()
        store.delete_file(at)

    def make_folder(self) -> None:
        store, at = self.store()
        store.create_dir(at, recursive=True)


def local_path(path: str) -> str | None:
    """The path in the file system that driver and tasks have mounted, if that is what ``path`` means."""
    if re.match(r"file:", path):
        return "/" + re.sub(r"^file:/+", "", path)
    return None if re.match(r"[a-z][a-z0-9+.-]+:", path) else path


def place(path: str | Path) -> Path | Uri:
    """A path, or the URI of something elsewhere."""
    local = local_path(str(path))
    return Uri(path) if local is None else Path(local)
