"""Canonical tables as stored tables: derived once per session and state of their sources, then read like any other Parquet."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.runtime import shared_dir

_FOLDERS: dict[tuple[str, str, int], str] = {}
_WRITTEN: set[str] = set()


def source_state(spark: SparkSession, folder: str) -> int:
    """Changes whenever a file below ``folder`` comes, goes, grows or is written anew; metadata only, no job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(found)))


class StagedTables(Mapping[str, DataFrame]):
    """Writes a derived table on first use below the shared folder of the session and reads it back.

    A changed source file starts a new set of tables, so nothing stale is read.

    Everything downstream then starts from a plain scan: short lineage, real
    sizes for the join planner, column pruning and pushed filters.  ``views`` only compute columns of another
    stored table, row by row; they are not stored a second time.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, makers: Mapping[str, Callable[[], DataFrame]], views: Collection[str] = ()):
        self.spark = spark
        self.makers = makers
        self.views = views
        key = (spark.sparkContext.applicationId, sf_dir, source_state(spark, sf_dir))
        if key not in _FOLDERS:
            _FOLDERS[key] = shared_dir(spark, "tables")
        self.folder = _FOLDERS[key]

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.views:
            return self.makers[name]()
        path = f"{self.folder}/{name}"
        if path not in _WRITTEN:
            self.makers[name]().write.mode("overwrite").parquet(path)
            _WRITTEN.add(path)
        return self.spark.read.parquet(path)

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)
