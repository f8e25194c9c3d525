"""Folders of runs on whatever file system the session's paths name."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def run_folder(spark: SparkSession, work_dir: str | None = None) -> str:
    """A new folder for one run: below ``work_dir``, else ``spark.checkpoint.dir``, else the warehouse."""
    base = (
        work_dir
        or spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("spark.sql.warehouse.dir")
    )
    return f"{base.rstrip('/')}/rules-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, whatever that is."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of a run."""
    folder, system = hadoop_path(spark, path)
    system.delete(folder, True)


def claim_folder(spark: SparkSession, path: str, mode: str) -> None:
    """Make ``path`` free to write to: refuse what is there (``error``), delete it (``overwrite``) or leave it (``append``)."""
    if mode not in ("error", "overwrite", "append"):
        raise ValueError(f"mode is error, overwrite or append, not {mode}")
    folder, system = hadoop_path(spark, path)
    if system.exists(folder):
        if mode == "error":
            raise FileExistsError(path)
        if mode == "overwrite":
            remove_folder(spark, path)


def last_part(spark: SparkSession, path: str, name: str) -> int:
    """The largest number n of a directory ``name=n`` in a folder; 0 where there is none."""
    folder, system = hadoop_path(spark, path)
    found = [status.getPath().getName() for status in system.listStatus(folder)] if system.exists(folder) else []
    return max((int(n[len(name) + 1 :]) for n in found if n.startswith(f"{name}=")), default=0)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    target, system = hadoop_path(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = system.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(target, False)
    system.rename(part, target)


def read_text(spark: SparkSession, path: str) -> str:
    # One line: the manifest has no line feed.
    return spark.read.text(path, wholetext=True).first()["value"]
