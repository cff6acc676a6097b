"""Folders for tables a query writes on the way to its result.

Every executor has to see them, and they must outlive any executor. The cluster
names the shared folder in ``spark.checkpoint.dir``. Without it, tables go beside
the session's warehouse, which only a plain local session may have on its own disk.
No setting is changed. A run's folder is removed when the application ends.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

SETTING, WAREHOUSE = "spark.checkpoint.dir", "spark.sql.warehouse.dir"


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named.rstrip("/")
    folder = spark.conf.get(WAREHOUSE, None) or ""
    alone = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
    if not folder or not alone and not re.match(r"(?!file:)[a-z0-9+.-]+:", folder):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    return folder.rstrip("/") + "/.millrace"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it names it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder that does not exist yet, for one run; it goes when the application ends."""
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    system, path = file_system(spark, base)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return f"{base}/data"
