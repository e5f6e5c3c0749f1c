"""A stored table of pitch classes, by the content of the tracks that they come from.

The table is bucketed by the hash of a packed track, so looking tracks up shuffles them
and never the table. It is kept safe without locks:

* Files are never changed. A writer fills a folder of its own and moves its files, whose
  names no other writer uses, into the table when all of them are whole; one that
  dies leaves nothing there.
* Rows follow from their key, so two writers of the same track write equal rows, and
  readers take one of each key, bucket by bucket.
* Compaction writes a new generation beside the old one and publishes it by
  one rename; readers take the newest. What was added to the old one meanwhile is only
  decoded again. Old generations go by ``vacuum``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.matching import contour_bins
from . import packed

BUCKETS = 256
SCHEMA = "blob string, bins array<tinyint>"


class BinsTable:
    """Bins of ``classes`` pitch classes under ``path``, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, classes: int = 24, buckets: int = BUCKETS):
        self.spark, self.classes, self.buckets = spark, classes, buckets
        self.folder = f"{path.rstrip('/')}/classes={classes}-buckets={buckets}"
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._registered: dict[str, str] = {}

    def _path(self, where: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(where)

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def generations(self) -> list[int]:
        """Numbers of the published generations, the newest last."""
        return [int(n[2:]) for n in self._names(self.folder) if n.startswith("v=")]

    def _generation(self) -> str:
        """The folder of the newest generation; the first one is made if there is none."""
        known = self.generations()
        folder = f"{self.folder}/v={known[-1] if known else 0:06d}"
        if not known:
            self._fs.mkdirs(self._path(folder))
        return folder

    def _table(self, folder: str) -> str:
        """A name by which this session knows the bucketed files of a folder."""
        if folder not in self._registered:
            name = f"humsearch_bins_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (blob STRING, bins ARRAY<TINYINT>) USING parquet CLUSTERED BY (blob) SORTED BY (blob) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
            self._registered[folder] = name
        return self._registered[folder]

    def _staged(self, rows: DataFrame) -> tuple[str, list[str]]:
        """(folder, files) of rows written as buckets to a folder of their own."""
        folder = f"{self.folder}/staging-{uuid.uuid4().hex}"
        self._fs.mkdirs(self._path(folder))
        name = self._table(folder)
        # a task for each bucket, so that a bucket is one file
        rows.select("blob", "bins").repartition(self.buckets, "blob").write.insertInto(name)
        self.spark.sql(f"DROP TABLE {self._registered.pop(folder)}")
        return folder, [n for n in self._names(folder) if n.startswith("part-")]

    def rows(self) -> DataFrame:
        """(blob, bins), one row for each blob."""
        name = self._table(self._generation())
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name).dropDuplicates(["blob"])

    @staticmethod
    def keyed(tracks: DataFrame) -> DataFrame:
        """(track_id, blob, pitch_track) of tracks (id, pitch_track) that have one."""
        return tracks.where("pitch_track is not null").select(F.col("id").cast("long").alias("track_id"), F.md5("pitch_track").alias("blob"), "pitch_track")

    def missing(self, tracks: DataFrame) -> DataFrame:
        """(blob, pitch_track) of the packed tracks that the table hasn't; only they are shuffled."""
        fresh = self.keyed(tracks).select("blob", "pitch_track")
        return fresh.join(self.rows().select("blob").hint("merge"), "blob", "left_anti").dropDuplicates(["blob"])

    def add(self, tracks: DataFrame, mode: str = "FAILFAST") -> None:
        """Decode and store the packed tracks (id, pitch_track) that the table hasn't."""
        decoded = packed.decode_tracks(self.missing(tracks), mode).where("contour is not null")
        folder, files = self._staged(decoded.select("blob", contour_bins(F.col("contour"), self.classes).alias("bins")))
        target = self._generation()
        for name in files:
            self._fs.rename(self._path(f"{folder}/{name}"), self._path(f"{target}/{name}"))
        self._fs.delete(self._path(folder), True)

    def lookup(self, tracks: DataFrame) -> DataFrame:
        """(track_id, bins) of the tracks (id, pitch_track) that the table has with frames."""
        return self.keyed(tracks).select("track_id", "blob").join(self.rows().hint("merge"), "blob").where(F.size("bins") > 0).select("track_id", "bins")

    def bins(self, tracks: DataFrame, mode: str = "FAILFAST") -> DataFrame:
        """``lookup`` after ``add``."""
        self.add(tracks, mode)
        return self.lookup(tracks)

    def compact(self) -> bool:
        """Write a generation of one row a blob and one file a bucket; False if another one was published first."""
        old = self._generation()
        folder, _ = self._staged(self.rows())
        after = f"{self.folder}/v={int(old.rsplit('=', 1)[1]) + 1:06d}"
        # a folder that is there already would take this one in as a part of it
        done = not self._fs.exists(self._path(after)) and self._fs.rename(self._path(folder), self._path(after))
        if not done:
            self._fs.delete(self._path(folder), True)
        return done

    def vacuum(self) -> None:
        """Delete all but the newest generation, and what writers that died have left. No reader or writer may be at work."""
        keep = self._generation().rsplit("/", 1)[1]
        for name in self._names(self.folder):
            if name != keep:
                self._fs.delete(self._path(f"{self.folder}/{name}"), True)
