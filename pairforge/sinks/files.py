"""Single files written by tasks, in any store that Arrow opens."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the name of the file in it."""
    local = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(local if "://" in local else f"file://{local}")


def put(path: str, data: bytes) -> str:
    """Write a file whole or not at all: under another name first, then renamed. A repeated task writes it again."""
    store, name = open_store(path)
    folder, _, last = name.rpartition("/")
    store.create_dir(folder, recursive=True)
    draft = f"{folder}/.{last}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, name)
    return path


def copy(source: str, target: str) -> None:
    store, name = open_store(source)
    with store.open_input_file(name) as file:
        put(target, file.read())
