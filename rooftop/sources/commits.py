"""A log of what was completed: small files that are there whole or not at all.

An entry is written under another name and then renamed to its own, which fails
if that exists.  So of several attempts one is logged, and a reader never sees a
half-written entry.  (The file system must refuse to rename onto a file, as HDFS
and local disks do.)  The log lies in a folder whose name starts with an
underscore, which table readers skip.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


class CommitLog:
    """Entries by id under ``path``/_log; ``fields`` (DDL) names the fields of an entry beside ``id``."""

    def __init__(self, path: str, fields: str = ""):
        self.folder = path.rstrip("/") + "/_log"
        self.schema = ", ".join(filter(None, ["id string", fields]))

    def _file(self, spark: SparkSession, entry: str):
        return spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{quote(entry, safe='')}.json")

    def has(self, spark: SparkSession, entry: str) -> bool:
        file = self._file(spark, entry)
        return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)

    def add(self, spark: SparkSession, entry: str, values: Mapping[str, object] | None = None) -> bool:
        """Log ``entry``; False if it is there already (the first one stays)."""
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        file = self._file(spark, entry)
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/.{uuid.uuid4().hex}.draft")
        fs = file.getFileSystem(conf)
        out = fs.create(draft, False)
        try:
            out.write(bytearray((json.dumps({"id": entry, **(values or {})}) + "\n").encode()))
        finally:
            out.close()
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(file.toUri(), conf).rename(
                fs.makeQualified(draft), fs.makeQualified(file), options)
        except Exception as e:
            fs.delete(draft, False)
            if re.search("FileAlreadyExists", str(e)):
                return False
            raise
        return True

    def entries(self, spark: SparkSession) -> DataFrame:
        """All entries (none before the first)."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).option("pathGlobFilter", "*.json").json(self.folder)
