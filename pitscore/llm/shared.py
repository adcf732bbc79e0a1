"""Arrays in the cluster's shared folder that workers write once and map into memory."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow.fs as pafs

from pitscore.sources.io import scratch_path

#: Maps a worker keeps open; the system limits them.
MOST_MAPS = 10_000
_open: dict[str, np.ndarray] = {}


def _local(uri: str) -> str | None:
    """The path of a folder that is mounted on every node, or None for a remote store."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:") :].lstrip("/")
    return None if "://" in uri else uri


def shared_path(spark, name: str) -> str:
    """A new folder in the shared one, with the file system that Spark takes it to be on: a path without a
    scheme is one of the cluster's default store, not of each worker's disk."""
    place = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def save(uri: str, array: np.ndarray) -> None:
    """Writes an array under its final name in one step, so a repeated task leaves one whole file."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, array)
        os.replace(part, path)
        return
    store, name = pafs.FileSystem.from_uri(uri)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        np.save(f, array)
    store.move(part, name)


def load(uri: str) -> np.ndarray:
    """The array as a read-only memory map; one from a remote store is first copied to this worker."""
    if uri not in _open:
        if len(_open) >= MOST_MAPS:
            _open.clear()
        path = _local(uri)
        if path is None:
            store, name = pafs.FileSystem.from_uri(uri)
            path = os.path.join(tempfile.mkdtemp(prefix="arrays-"), os.path.basename(name))
            with store.open_input_stream(name) as src, open(path, "wb") as dst:
                while chunk := src.read(1 << 20):
                    dst.write(chunk)
        _open[uri] = np.load(path, mmap_mode="r")
    return _open[uri]


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark) -> None:
    """Sends this package to the workers once per application, so that tasks can import it.

    Rows here are texts of many kilobytes. Where the session still has Spark's own default for the rows of
    an Arrow batch, it is lowered, so that a batch takes some megabytes of a worker's memory.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
