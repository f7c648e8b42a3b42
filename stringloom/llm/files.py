"""Files of arrays in the shared folder: written by tasks, mapped into memory by workers."""
from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Write a file under another name and rename it."""
    system, path = _fs(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, path)


def get(uri: str) -> np.ndarray:
    """A file as bytes in mapped memory; one that isn't in a mounted folder is mapped from an unnamed copy."""
    from pyarrow import fs

    system, path = _fs(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with tempfile.TemporaryFile() as copy, system.open_input_stream(path) as f:
        while block := f.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, np.uint8, "r") if copy.tell() else np.zeros(0, np.uint8)


def pack(arrays: dict[str, np.ndarray], **more) -> bytes:
    """Arrays one after the other, at multiples of 8, after a line that says where."""
    head, at, parts = {}, 0, []
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x).tobytes()
        head[name] = [x.dtype.str, at, len(x)]
        raw += b"\0" * (-len(raw) % 8)
        at += len(raw)
        parts.append(raw)
    line = json.dumps({"arrays": head, **more}).encode()
    line += b" " * (-(len(line) + 8) % 8)
    return len(line).to_bytes(8, "little") + line + b"".join(parts)


def unpack(raw: np.ndarray) -> tuple[dict[str, np.ndarray], dict]:
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    body = raw[8 + n :]
    return {k: body[at : at + np.dtype(d).itemsize * m].view(d) for k, (d, at, m) in head.pop("arrays").items()}, head
