"""The folder that all executors share, and what the store there can tell."""

from __future__ import annotations

import hashlib
import re
import tempfile
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. Only a session that names none and
    runs in one process (a test) gets one under the temporary folder; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return (named or f"{tempfile.gettempdir()}/folioscope-shared").rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    fs, where = _path(spark, path)
    return fs.rename(where, _path(spark, to)[1])


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, read by the driver."""
    fs, where = _path(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all; one of that name is an error."""
    fs, where = _path(spark, path)
    part = _path(spark, f"{path}.part")[1]
    stream = fs.create(part, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    if fs.exists(where) or not fs.rename(part, where):
        raise FileExistsError(path)


def next_number(spark: SparkSession, folder: str) -> int:
    """A number above all that were given out before, whatever clocks say; only to be asked for under a lock. What was given out last is the
    name of a file, and the file before it is deleted after."""
    last = last_version(spark, folder)
    write_text(spark, f"{folder}/{last + 1:08d}", "")
    if last:
        remove(spark, f"{folder}/{last:08d}")
    return last + 1


def last_version(spark: SparkSession, folder: str) -> int:
    """The greatest of the files under ``folder`` that are named by eight digits, 0 if there is none."""
    fs, where = _path(spark, folder)
    if not fs.exists(where):
        return 0
    return max((int(n) for f in fs.listStatus(where) if re.fullmatch(r"\d{8,}", n := f.getPath().getName())), default=0)


def fingerprint(rows: DataFrame) -> str:
    """A digest of the files that a DataFrame reads: names, sizes and times of change, by one listing of each folder."""
    spark = rows.sparkSession
    wanted: dict[str, set[str]] = {}
    for name in rows.inputFiles():
        wanted.setdefault(name.rpartition("/")[0], set()).add(name.rpartition("/")[2])
    said = []
    for folder in sorted(wanted):
        fs, where = _path(spark, folder)
        for status in fs.listStatus(where):
            name = status.getPath().toUri().getRawPath().rpartition("/")[2]
            if name in wanted[folder]:
                said.append(f"{folder}/{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(said)).encode()).hexdigest()[:16]


LOCK_WAIT_S, LOCK_STALE_S, LOCK_RETRY_S = 5.0, 30.0, 0.025


@contextmanager
def locked(spark: SparkSession, path: str, wait_s: float = LOCK_WAIT_S, stale_s: float = LOCK_STALE_S):
    """Holds the file ``path`` while the block runs. Another holder is waited for; a file that is older than
    ``stale_s`` was left by one that died, and is taken over."""
    fs, where = _path(spark, path)
    ends = time.monotonic() + wait_s
    while not fs.createNewFile(where):
        try:
            age = time.time() - fs.getFileStatus(where).getModificationTime() / 1000
        except Exception:  # given back in the meantime
            continue
        if age > stale_s:
            fs.delete(where, False)
        elif time.monotonic() > ends:
            raise TimeoutError(f"another writer holds {path}")
        else:
            time.sleep(LOCK_RETRY_S)
    try:
        yield
    finally:
        fs.delete(where, False)
