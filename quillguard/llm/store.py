"""Files that the driver and every executor share.

Intermediate tables and operator files go to the folder named by ``spark.checkpoint.dir``.
A folder of our own is made only where the setting is absent and Spark runs in one process.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

_made: list[str] = []


#: Bytes of a batch that Spark hands to a Python worker; the default, 64 MB of text on both sides of
#: the pipe, is too much for an executor that runs several.
ARROW_BYTES = "2m"


def prepare(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, and bound Arrow batches where the session does not."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def base(spark: SparkSession) -> str:
    """URI of the shared folder."""
    prepare(spark)
    uri = spark.conf.get("spark.checkpoint.dir", None)
    if uri:
        return uri
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="quillguard-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    _made.append(f"file://{own}")
    return f"file://{own}"


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a new empty folder below the shared one; it is deleted when the driver's Python ends."""
    uri = f"{base(spark).rstrip('/')}/quillguard/{name}-{uuid.uuid4().hex}"
    make(uri)
    _made.append(uri)
    return uri


def saved(df: DataFrame, uri: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends at files that all executors see."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def _at(uri: str):
    """File system and path of a URI; None stands for the local file system."""
    p = urlparse(uri)
    if p.scheme in ("", "file"):
        return None, p.path
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make(uri: str) -> None:
    fs, path = _at(uri)
    if fs is None:
        os.makedirs(path, exist_ok=True)
    else:
        fs.create_dir(path, recursive=True)


def opened(uri: str):
    """A seekable binary reader."""
    fs, path = _at(uri)
    return open(path, "rb") if fs is None else fs.open_input_file(path)


class Target:
    """A file that appears under its name only when it is complete.

    Each attempt of a task writes a file of its own; the rename makes a repeated or speculative
    attempt harmless, because every attempt writes the same bytes.
    """

    def __init__(self, uri: str):
        self.fs, self.path = _at(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        if self.fs is None:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self.file = open(self.part, "wb")
        else:
            self.file = self.fs.open_output_stream(self.part)

    def __enter__(self):
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if self.fs is None:
            os.replace(self.part, self.path) if kind is None else os.unlink(self.part)
        elif kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def drop(uri: str) -> None:
    fs, path = _at(uri)
    if fs is None:
        shutil.rmtree(path, ignore_errors=True)
    else:
        fs.delete_dir(path)


@atexit.register
def _clear() -> None:
    for uri in _made:
        try:
            drop(uri)
        except Exception:  # noqa: BLE001  a folder that is gone already
            pass


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
