"""Files of packs, on any store that pyarrow opens: paths without a scheme are local."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq


def canonical(path: str) -> str:
    return path.rstrip("/") if re.match(r"\w+:", path) else os.path.realpath(path)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(canonical(path))


def is_dir(path: str) -> bool:
    store, at = _open(path)
    return store.get_file_info(at).type == fs.FileType.Directory


def folders(path: str) -> list[str]:
    """Names of the folders in a folder, sorted."""
    store, at = _open(path)
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.Directory)


def read_text(path: str) -> str:
    store, at = _open(path)
    with store.open_input_stream(at, compression=None) as f:
        return f.read().decode()


def write_text(path: str, text: str) -> None:
    """Written beside its place, then moved there."""
    store, at = _open(path)
    with store.open_output_stream(f"{at}.part") as f:
        f.write(text.encode())
    store.move(f"{at}.part", at)


def delete(path: str) -> None:
    store, at = _open(path)
    if store.get_file_info(at).type == fs.FileType.Directory:
        store.delete_dir(at)


#: Beside a folder: what takes its place, and what it takes the place of.
NEW, OLD = ".part", ".old"


def _move(store: fs.FileSystem, at: str, to: str) -> None:
    store.move(at, to)


def replace(path: str, to: str, last: str = "pack") -> None:
    """A folder takes the place of another, which stays beside it until that is done: what breaks off between is mended by settle().

    On a store that cannot move folders files are copied one by one next to those that are there, whose names differ, the table ``last`` at the end;
    what was there goes when all is in place.
    """
    store, at = _open(path)
    there = _open(to)[1]
    try:
        delete(to + OLD)
        if is_dir(to):
            _move(store, there, there + OLD)
        _move(store, at, there)
    except OSError:
        settle(to)
        _copy_in(store, at, there, last)
        delete(path)
    delete(to + OLD)


def settle(path: str) -> None:
    """Where a replacement broke off between its steps: the old folder is put back."""
    if not is_dir(path) and is_dir(path + OLD):
        store, at = _open(path)
        _move(store, at + OLD, at)


def _copy_in(store: fs.FileSystem, at: str, to: str, last: str) -> None:
    def below(folder: str) -> list[str]:
        return [f.path[len(folder) + 1 :] for f in store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File]

    order = lambda names: sorted(names, key=lambda n: n.startswith(f"{last}/"))
    new, old = below(at), set(below(to))
    for name in order(new):
        store.create_dir(f"{to}/{name}".rsplit("/", 1)[0], recursive=True)
        store.copy_file(f"{at}/{name}", f"{to}/{name}")
    for name in reversed(order(old - set(new))):
        store.delete_file(f"{to}/{name}")
    for folder in {n.split("/")[0] for n in old} - {n.split("/")[0] for n in new}:
        store.delete_dir(f"{to}/{folder}")


def stamp(path: str) -> tuple:
    """Names, sizes and times of the files in a folder, which tell whether it has been written anew; empty if it is not there."""
    store, at = _open(path)
    return tuple(sorted((f.base_name, f.size, f.mtime_ns) for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.type == fs.FileType.File))


def size(path: str) -> int:
    """Bytes of the files in a folder, at any depth."""
    store, at = _open(path)
    return sum(f.size or 0 for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def parquets(path: str) -> list[str]:
    """Names of the files of a Parquet table, sorted."""
    return [name for name, *_ in stamp(path) if not name.startswith((".", "_"))]


def ends(path: str, column: str) -> tuple | None:
    """The least and largest value of a column by the footer of a Parquet file; () of a file without rows, None where the footer does not tell."""
    store, at = _open(path)
    with store.open_input_file(at) as f:
        meta = pq.read_metadata(f)
    if not meta.num_rows:
        return ()
    groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
    i = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == column)
    told = [g.column(i).statistics for g in groups if g.num_rows]
    if any(x is None or not x.has_min_max for x in told):
        return None
    return min((x.min for x in told)), max((x.max for x in told))


def batches(path: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Columns of a Parquet file in its order, so many rows at a time."""
    store, at = _open(path)
    with store.open_input_file(at) as f:
        yield from (b for b in pq.ParquetFile(f).iter_batches(rows, columns=columns, use_threads=False) if len(b))


def sha256(path: str, limit_mb: int | None = None) -> str:
    """The digest of a file, or of its first megabytes, read in pieces."""
    store, at = _open(path)
    digest, left = hashlib.sha256(), None if limit_mb is None else limit_mb << 20
    with store.open_input_stream(at, compression=None) as f:
        while piece := f.read(1 << 20 if left is None else min(1 << 20, left)):
            digest.update(piece)
            left = None if left is None else left - len(piece)
    return digest.hexdigest()
