"""Totals that are refreshed by file: only new and changed files are read again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.functions.columns import named

Reader = Callable[[SparkSession, list[str]], DataFrame]

_FILE, _CHANGED, _SIZE, _VERSION = " file", " changed", " size", " version"


class FileTotals:
    """Sums by group of all files under a path, kept per file in a folder.

    ``keys`` name the groups and ``sums`` the columns that are added up; ``rows`` counts. What a
    refresh reads is written as one more version of the totals, and then a list of all files,
    each with its size, time of change and the version that holds its totals. A refresh that
    fails leaves no list and so changes nothing. Files that are gone are not in the new list.
    """

    def __init__(
        self,
        spark: SparkSession,
        reader: Reader,
        keys: Sequence[str],
        sums: Sequence[str],
        folder: str,
    ):
        self._spark, self._reader = spark, reader
        self._keys, self._sums, self._folder = list(keys), list(sums), folder.rstrip("/")

    def _files(self, path: str) -> DataFrame:
        """Name, time and size of the files; their contents are not read."""
        return (
            self._spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(path)
            .select(
                F.col("path").alias(_FILE),
                F.col("modificationTime").alias(_CHANGED),
                F.col("length").alias(_SIZE),
            )
        )

    def version(self) -> int:
        """Number of the newest list of files; 0 before the first refresh."""
        try:
            lists = self._spark.read.format("binaryFile").option("recursiveFileLookup", True)
            done = lists.option("pathGlobFilter", "*.parquet").load(f"{self._folder}/files")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return 0
            raise
        found = done.select(F.max(F.regexp_extract("path", r"/files/(\d+)/[^/]+$", 1).try_cast("int")))
        return found.first()[0] or 0

    def _list(self, version: int) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/files/{version}")

    def refresh(self, path: str) -> list[str]:
        """Bring the totals up to date; returns the files that were read.

        The names of the files to read go through the driver, as they do for every scan.
        """
        old, now = self.version(), self._files(path)
        if old:
            known = self._list(old)
            same = [now[c].eqNullSafe(known[c]) for c in (_FILE, _CHANGED, _SIZE)]
            state = now.join(known, same, "left").select(
                *[now[c] for c in (_FILE, _CHANGED, _SIZE)],
                F.coalesce(known[_VERSION], F.lit(old + 1)).alias(_VERSION),
            )
            gone = known.join(now, _FILE, "left_anti").limit(1)
        else:
            state, gone = now.withColumn(_VERSION, F.lit(1)), now.limit(0)
        changed = sorted(r[0] for r in state.where(F.col(_VERSION) == old + 1).select(_FILE).collect())
        if not changed and old and gone.isEmpty():
            return []
        if changed:
            self._summed(changed).write.mode("overwrite").parquet(f"{self._folder}/totals/{old + 1}")
        state.coalesce(1).write.mode("overwrite").parquet(f"{self._folder}/files/{old + 1}")
        return changed

    def _summed(self, files: list[str]) -> DataFrame:
        frame = self._reader(self._spark, files)
        group = [F.col("_metadata.file_path").alias(_FILE), *map(named, self._keys)]
        return (
            frame.select(*group, *map(named, self._sums))
            .groupBy(_FILE, *map(named, self._keys))
            .agg(*[F.sum(named(c)).alias(c) for c in self._sums], F.count(F.lit(1)).alias("rows"))
            .withColumn(_FILE, F.regexp_replace(_FILE, "%20", " "))
        )

    def totals(self) -> DataFrame:
        """The sums by group over all files of the newest list."""
        version = self.version()
        if not version:
            raise ValueError("refresh the totals first")
        listed = self._list(version)
        versions = [r[0] for r in listed.select(_VERSION).distinct().collect()]
        parts = None
        for number in versions:
            of = self._spark.read.parquet(f"{self._folder}/totals/{number}")
            part = of.join(listed.where(F.col(_VERSION) == number), _FILE, "left_semi")
            parts = part if parts is None else parts.unionByName(part)
        return parts.groupBy(*map(named, self._keys)).agg(
            *[F.sum(named(c)).alias(c) for c in (*self._sums, "rows")]
        )
