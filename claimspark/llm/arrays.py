"""Sorted arrays in the shared folder: written by tasks, mapped into memory by workers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np

from claimspark.llm.common import process_cache


def packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    held = io.BytesIO()
    for a in arrays:
        np.save(held, a, allow_pickle=False)
    return zstandard.ZstdCompressor(level=1).compress(held.getvalue())


def unpacked(data: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    held = io.BytesIO(zstandard.ZstdDecompressor().decompress(data))
    return [np.load(held, allow_pickle=False) for _ in range(n)]


def _filesystem(uri: str):
    """A file system and the path in it; plain paths and ``file:`` are the machine's own (a shared mount)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(uri))


def store(uri: str, name: str, values: np.ndarray) -> None:
    """Write an array under its final name in one step, so a repeated or parallel attempt does no harm."""
    system, path = _filesystem(uri)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        held = io.BytesIO()
        np.save(held, values, allow_pickle=False)
        out.write(held.getbuffer())
    system.move(part, f"{path}/{name}.npy")


MOST_MAPPED = 8192     # arrays that a worker keeps mapped


def mapped(uri: str, name: str) -> np.ndarray | None:
    """An array of the shared folder, mapped into memory; None if it was never written."""
    known = process_cache("arrays")
    if (uri, name) not in known:
        if len(known) >= MOST_MAPPED:
            known.clear()
        known[uri, name] = _map(uri, name)
    return known[uri, name]


def _map(uri: str, name: str) -> np.ndarray | None:
    """Map a file, or a nameless copy of it where the store is none that can be mapped."""
    from pyarrow import fs

    system, path = _filesystem(uri)
    path = f"{path}/{name}.npy"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    if isinstance(system, fs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    with tempfile.NamedTemporaryFile(suffix=".npy") as copy:
        with system.open_input_stream(path) as source:
            while chunk := source.read(1 << 22):
                copy.write(chunk)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")


def look_up(uri: str, bucket: int, kind: str, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Places of ``sought`` in a bucket's sorted array (-1: not there), and the values beside it."""
    keys = mapped(uri, f"{kind}-keys-{bucket}")
    if keys is None or not len(keys):
        return np.full(len(sought), -1, dtype=np.int64), None
    order = np.argsort(sought)
    at = np.empty(len(sought), dtype=np.int64)
    at[order] = np.searchsorted(keys, sought[order])
    at[at == len(keys)] = len(keys) - 1
    at[np.asarray(keys[at]) != sought] = -1
    return at, mapped(uri, f"{kind}-values-{bucket}")


def in_buckets(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, and the places where it does."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part
