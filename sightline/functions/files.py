"""Whole files and folders that appear once and complete, through the file system that the path lies in."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _system(spark, path)
    return system.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder that do not start with a dot or an underscore; none, if there is no such folder."""
    where, system = _system(spark, folder)
    found = [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []
    return sorted(n for n in found if n[0] not in "._")


def staging(folder: str) -> str:
    """A name that readers skip, for what is not yet published."""
    return f"{folder.rstrip('/')}/_staged_{uuid.uuid4().hex}"


def publish(spark: SparkSession, staged: str, target: str) -> bool:
    """Moves a staged file or folder to its name in one step, unless that exists: then the staged one goes and the answer is False."""
    jvm, (old, system), (new, _) = spark._jvm, _system(spark, staged), _system(spark, target)
    system.mkdirs(new.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.makeQualified(old).toUri(), spark._jsc.hadoopConfiguration())
    options = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(system.makeQualified(old), system.makeQualified(new), options)
    except Exception:
        taken = system.exists(new)
        system.delete(old, True)
        if not taken:
            raise
        return False
    return True


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, system = _system(spark, path)
    stream = system.create(where, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def copy(spark: SparkSession, source: str, target: str) -> None:
    (a, one), (b, two) = _system(spark, source), _system(spark, target)
    two.mkdirs(b.getParent())
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(one, a, two, b, False, spark._jsc.hadoopConfiguration())
