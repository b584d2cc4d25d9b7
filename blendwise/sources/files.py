"""Final names for files that Spark wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession


def rename_parts(spark: SparkSession, staged: str, target: str, name: Callable[[str, int], str]) -> None:
    """Move the part files of ``staged/<column>=<value>/`` to ``target/<name(value, part number)>``.

    Data are written by the executors; this only renames files, through Hadoop's file system interface.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(target))
    for folder in files.listStatus(path(staged)):
        if not folder.isDirectory() or "=" not in folder.getPath().getName():
            continue
        value = folder.getPath().getName().split("=", 1)[1]
        found = [s.getPath() for s in files.listStatus(folder.getPath())]
        parts = [p for p in found if p.getName().startswith("part-")]
        for number, part in enumerate(sorted(parts, key=lambda p: p.getName())):
            final = path(f"{target}/{name(value, number)}")
            if not files.rename(part, final):
                raise OSError(f"{final.toString()} exists already")
    files.delete(path(staged), True)
