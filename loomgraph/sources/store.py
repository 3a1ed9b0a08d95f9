"""Small files of a folder that driver and executors share.

The driver reads and writes them by the session's own file systems, so any
store that Spark reaches will do; tasks use Arrow's.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _at(spark, path)
    return store.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    store, at = _at(spark, path)
    store.delete(at, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no such folder."""
    store, at = _at(spark, folder)
    return sorted(x.getPath().getName() for x in store.listStatus(at)) if store.exists(at) else []


def read_json(spark: SparkSession, path: str) -> Any:
    """A file of JSON; None where it is missing or doesn't parse."""
    store, at = _at(spark, path)
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()


def replace_json(spark: SparkSession, path: str, value: Any) -> None:
    """Write a file of JSON beside ``path`` and rename it over: readers see the
    old file or the new one, never a part."""
    jvm = spark.sparkContext._jvm
    store, at = _at(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = store.create(fresh, True)
    try:
        stream.write(json.dumps(value, sort_keys=True).encode())
    finally:
        stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.makeQualified(at).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    files.rename(fresh, at, how)


# ---- in tasks

def opened(uri: str):
    """(file system, path) of a folder, for tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", uri))


def read_bytes(files, path: str) -> bytes | None:
    """A file's bytes; None where there is no file."""
    from pyarrow import fs

    if files.get_file_info(path).type != fs.FileType.File:
        return None
    with files.open_input_stream(path) as stream:
        return stream.read()


def place_bytes(files, path: str, content: bytes) -> None:
    """Write a file beside ``path`` and move it there, so that nobody reads a part."""
    files.create_dir(os.path.dirname(path), recursive=True)
    fresh = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with files.open_output_stream(fresh) as stream:
            stream.write(content)
        files.move(fresh, path)
    except BaseException:
        if read_bytes(files, fresh) is not None:
            files.delete_file(fresh)
        raise
