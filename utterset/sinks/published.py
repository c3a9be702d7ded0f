"""Tables published as versions behind one pointer.

A version is a folder of its own, written whole before anybody can find it.  The
pointer is a small file that names the current version and is replaced by one
rename, so a reader sees the old table or the new one and a failed write leaves the
old one as it was.  Old versions stay until ``drop_versions``: a reader that has
begun keeps its files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


def _at(spark: SparkSession, path: str):
    """(Hadoop path, its file context)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place)
    return whole, hadoop.FileContext.getFileContext(whole.toUri(), spark._jsc.hadoopConfiguration())


def read_pointer(spark: SparkSession, path: str) -> str | None:
    """Name of the current version, or None where nothing has been published."""
    place, _ = _at(spark, f"{path}/{POINTER}")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return str(stream.readUTF())
    finally:
        stream.close()


def _write_pointer(spark: SparkSession, path: str, version: str) -> None:
    draft, files = _at(spark, f"{path}/_draft-{version}")
    stream = draft.getFileSystem(spark._jsc.hadoopConfiguration()).create(draft, True)
    try:
        stream.writeUTF(version)
    finally:
        stream.close()
    place, _ = _at(spark, f"{path}/{POINTER}")
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark._sc._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files.rename(draft, place, options)


def publish(
    df: DataFrame, path: str, write: Callable[[DataFrame, str], None] | None = None, version: str | None = None
) -> str:
    """Write ``df`` as a new version of ``path`` and make it current; returns the version's name.

    ``write(df, folder)`` defaults to Parquet.  If it raises, the pointer has not moved.
    """
    spark = df.sparkSession
    version = version or f"v-{uuid.uuid4().hex[:12]}"
    folder = f"{path}/{version}"
    if write:
        write(df, folder)
    else:
        df.write.parquet(folder)
    _write_pointer(spark, path, version)
    return version


def current_folder(spark: SparkSession, path: str) -> str:
    """The folder of the current version."""
    version = read_pointer(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing has been published at {path}")
    return f"{path}/{version}"


def resolve(spark: SparkSession, path: str) -> str:
    """Where to read ``path``: its current version if it is published, else itself."""
    version = read_pointer(spark, path)
    return path if version is None else f"{path}/{version}"


def versions(spark: SparkSession, path: str) -> list[str]:
    place, _ = _at(spark, path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        listed = system.listStatus(place)
    except Py4JJavaError:
        return []
    return sorted(str(s.getPath().getName()) for s in listed if s.isDirectory())


def drop_versions(spark: SparkSession, path: str) -> list[str]:
    """Delete every version but the current one, unfinished ones included; returns their names."""
    kept = read_pointer(spark, path)
    old = [v for v in versions(spark, path) if v != kept]
    for version in old:
        place, _ = _at(spark, f"{path}/{version}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return old
