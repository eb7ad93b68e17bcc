"""Stored logs that don't grow without bound: compacted event logs, and keys that were seen.

``EventLog`` keeps events (deletions, embedding results) as appended files. ``compact`` reduces what is there to one row for
each key, writes that as a snapshot, and publishes a version that names the snapshot and the event files it covers. Readers
take the snapshot of the highest version and the event files that it does not name, so they see the same before, during
and after a compaction, and what a writer appends meanwhile counts as well. ``vacuum`` deletes what no version from the
current one on needs.

``SeenKeys`` keeps the (user, hash) keys of all exchanges, for ever, in folders by a hash of the key. A batch reads the
folders that its own keys fall in. Keys carry the number of their batch, and a batch looks at those of earlier ones alone,
so a batch that is run again gets the same answer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reminis.sources.versions import Versions


class EventLog:
    """Events under ``path``; ``reduce`` makes one event for each key of many, and has the events' columns. Reduced events
    may be reduced again, with later ones: the result is that of all events at once."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, reduce: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.reduce = spark, path, schema, reduce
        self.versions = Versions(spark, path)
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def append(self, events: DataFrame, name: str | None = None) -> None:
        """One folder for each append; it counts once it is written as a whole. What has a name replaces what had it before."""
        mode = "overwrite" if name else "error"
        events.select(self.schema.fieldNames()).write.mode(mode).parquet(f"{self.path}/events/{name or uuid.uuid4().hex}")

    def appended(self) -> list[str]:
        """The names of all finished appends."""
        root = self._at(f"{self.path}/events")
        if not self._files.exists(root):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(root)]
        return sorted(n for n in names if self._files.exists(self._at(f"{self.path}/events/{n}/_SUCCESS")))

    def _read(self, content: dict, spare: Collection[str] = ()) -> tuple[DataFrame, list[str]]:
        covered = {*content.get("covered", ()), *spare}
        names = [n for n in self.appended() if n not in covered]
        paths = [f"{self.path}/events/{n}" for n in names]
        if content.get("snapshot"):
            paths.append(f"{self.path}/{content['snapshot']}")
        found = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return self.reduce(found), names

    def read(self) -> DataFrame:
        """One event for each key."""
        return self._read(self.versions.current()[1])[0]

    def compact(self, spare: Collection[str] = ()) -> bool:
        """Whether a snapshot was published; not where another writer came first. Appends named in ``spare`` stay events."""
        number, content = self.versions.current()
        rows, names = self._read(content, spare)
        if not names:
            return False
        folder = f"snapshots/{number + 1}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return self.versions.publish(number + 1, {"snapshot": folder, "covered": sorted({*content.get("covered", ()), *names} & set(self.appended()))})

    def vacuum(self) -> int:
        """Delete the event folders and snapshots that the current version covers; how many. Readers of older versions have to
        be done."""
        content, gone = self.versions.current()[1], 0
        old = [f"events/{n}" for n in content.get("covered", ())]
        if content.get("snapshot"):
            names = [x.getPath().getName() for x in self._files.listStatus(self._at(f"{self.path}/snapshots"))]
            old += [f"snapshots/{n}" for n in names if f"snapshots/{n}" != content["snapshot"]]
        for name in old:
            gone += bool(self._files.delete(self._at(f"{self.path}/{name}"), True))
        return gone


class SeenKeys:
    """Keys (user_id, content_hash) under ``path``, in ``buckets`` folders."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.shape = "user_id string, content_hash string, number long, bucket int"

    def _bucket(self):
        return F.pmod(F.xxhash64("user_id", "content_hash"), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.shape)
        return self.spark.read.schema(self.shape).parquet(self.path)

    def known(self, rows: DataFrame, number: int) -> DataFrame:
        """The stored keys of batches before ``number`` in the buckets that ``rows`` touch."""
        touched = rows.where("content_hash is not null").select(self._bucket().alias("bucket")).distinct().collect()
        return self._stored().where(F.col("bucket").isin(sorted(r.bucket for r in touched))).where(F.col("number") < number)

    def admit(self, rows: DataFrame, number: int) -> DataFrame:
        """``rows`` (user_id, session_id, turn, content_hash, ...) of batch ``number`` whose content their user has never sent
        before, and of one batch the first of each; those without a hash always pass. Their keys are stored."""
        hashed = rows.where("content_hash is not null")
        order = F.struct("session_id", "turn")
        firsts = hashed.groupBy("user_id", "content_hash").agg(F.min(order).alias("__first"))
        new = firsts.join(self.known(rows, number).select("user_id", "content_hash").distinct(), ["user_id", "content_hash"], "left_anti")
        keys = new.select("user_id", "content_hash", F.lit(number).cast("long").alias("number"), self._bucket().alias("bucket"))
        passed = hashed.join(new, ["user_id", "content_hash"]).where(order == F.col("__first")).drop("__first")
        # A batch that is run again writes its keys again, which changes nothing: they are told apart by user and hash.
        keys.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
        return passed.select(rows.columns).unionByName(rows.where("content_hash is null"))
