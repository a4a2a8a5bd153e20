"""Files on shared storage, opened for reading by ranges."""

from __future__ import annotations

from typing import BinaryIO
from urllib.parse import unquote, urlparse


def open_at(path: str) -> BinaryIO:
    """A seekable file: a plain path or ``file:`` URI on this machine, or any file system that pyarrow knows."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path) if parsed.scheme else path, "rb")  # noqa: SIM115 - the caller closes it
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)
