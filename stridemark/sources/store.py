"""What Spark's writers leave to their callers: names that only one writer gets, and renames that take effect at once."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str):
    """Hadoop's path, and the file system that it is on."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    path, fs = at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless one of that name is there; whether it was written. Of several writers one succeeds.

    That needs a store that refuses to create what is there, as HDFS does. Local files get their name by a link, since
    Hadoop's local file system looks first and writes then.
    """
    hadoop, fs = at(spark, path)
    data = text.encode()
    if fs.exists(hadoop):
        return False
    fs.mkdirs(hadoop.getParent())
    try:
        if fs.getScheme() == "file":
            local = hadoop.toUri().getPath()
            draft = f"{local}.{uuid.uuid4().hex}.draft"
            with open(draft, "wb") as out:
                out.write(data)
            try:
                os.link(draft, local)  # a name for what is written already, or an error if the name is taken
            finally:
                os.remove(draft)
        else:
            out = fs.create(hadoop, False)
            out.write(bytearray(data))
            out.close()
    except Exception as error:
        if fs.exists(hadoop):
            return False
        raise error
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """A small file that ``put_if_absent`` wrote."""
    hadoop, fs = at(spark, path)
    into = fs.open(hadoop)
    try:
        return bytes(into.readNBytes(1 << 20)).decode()
    finally:
        into.close()


def rename(spark: SparkSession, old: str, new: str) -> None:
    path, fs = at(spark, old)
    if not fs.rename(path, at(spark, new)[0]):
        raise OSError(f"{old} can't be renamed")


def delete(spark: SparkSession, path: str) -> None:
    hadoop, fs = at(spark, path)
    fs.delete(hadoop, True)
