"""Keep typed datasets in executor memory between requests."""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.functions.columns import named

Reader = Callable[[SparkSession, str], DataFrame]


class DatasetReuse:
    """Datasets by path; a dataset is read again once its files have changed.

    Only frames that this object has persisted are ever unpersisted, and callers get the
    base frame for reading: what they derive and persist is theirs to release.
    """

    def __init__(
        self,
        spark: SparkSession,
        reader: Reader,
        level: StorageLevel = StorageLevel.MEMORY_AND_DISK,
    ):
        self._spark = spark
        self._reader = reader
        self._level = level
        self._kept: dict[str, tuple[tuple, DataFrame]] = {}
        self._locks: defaultdict[str, threading.RLock] = defaultdict(threading.RLock)

    def fingerprint(self, path: str) -> tuple | None:
        """Newest change, number and total size of the files; None where nothing lies.

        The binary-file source lists the files; their contents are not selected and so
        not read.
        """
        state = (
            self._spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(path)
            .agg(
                F.max("modificationTime").alias("newest"),
                F.count(F.lit(1)).alias("files"),
                F.sum("length").alias("size"),
            )
            .first()
        )
        return tuple(state) if state["files"] else None

    def load(
        self, path: str, use_cache: bool = True, columns: Sequence[str] | None = None
    ) -> DataFrame:
        """The dataset, kept from now on; only ``columns`` of it, if they are given.

        A dataset kept with other columns gives way to one with those asked for.
        ``use_cache=False`` lets go of what is kept, and keeps nothing.
        """
        with self._locks[path]:
            if not use_cache:
                self.clear(path)
                return self._read(path, columns)
            state = (self.fingerprint(path), tuple(columns) if columns is not None else None)
            kept = self._kept.get(path)
            if kept is not None and kept[0] == state:
                return kept[1]
            if kept is not None:
                kept[1].unpersist()
            frame = self._read(path, columns).persist(self._level)
            self._kept[path] = (state, frame)
            return frame

    def _read(self, path: str, columns: Sequence[str] | None) -> DataFrame:
        frame = self._reader(self._spark, path)
        return frame if columns is None else frame.select(*map(named, columns))

    def preload(self, path: str, columns: Sequence[str] | None = None) -> bool:
        """Read and materialise now; False where there is nothing to read."""
        try:
            if self.fingerprint(path) is None:
                return False
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return False
            raise
        self.load(path, columns=columns).count()
        return True

    def clear(self, path: str | None = None) -> None:
        for key in [path] if path is not None else list(self._kept):
            with self._locks[key]:
                kept = self._kept.pop(key, None)
                if kept is not None:
                    kept[1].unpersist()
