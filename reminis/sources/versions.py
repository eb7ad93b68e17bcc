"""Which files of a stored table count: numbered versions, each put in place by one rename.

A writer writes new files beside the old ones and then publishes a version that names those that count. Readers take the
highest version and keep to its files, so they see the table before or after a change and never between. Of two writers
that publish one number the second learns that it came too late, and has to start from what the first one made.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


class Versions:
    """The versions under ``path``; what each says is a small JSON object."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path}/_versions"
        jvm = spark.sparkContext._jvm
        self._at, self._jvm = jvm.org.apache.hadoop.fs.Path, jvm
        self._configuration = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._at(self.path).getFileSystem(self._configuration)

    def current(self) -> tuple[int, dict]:
        """The highest version and its content; 0 and nothing before the first."""
        folder = self._at(self.path)
        if not self._files.exists(folder):
            return 0, {}
        names = [x.getPath().getName() for x in self._files.listStatus(folder)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, {}
        stream = self._files.open(self._at(f"{self.path}/{max(numbers):012d}.json"))
        try:
            return max(numbers), json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, content: dict) -> bool:
        """Make ``content`` version ``number``; False where that number is taken."""
        draft = self._at(f"{self.path}/{uuid.uuid4().hex}.tmp")
        stream = self._files.create(draft, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._configuration)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(draft, self._at(f"{self.path}/{number:012d}.json"), none)
        except Exception as e:  # noqa: BLE001  a Java error, told apart by its class
            self._files.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where it is unset on one machine, a
    temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="reminis-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Changes with the files under ``paths``: their names, sizes and times."""
    jvm, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        listed = at.getFileSystem(configuration).listStatus(at)
        found += sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in listed)
    return uuid.uuid5(uuid.NAMESPACE_URL, repr(found)).hex
