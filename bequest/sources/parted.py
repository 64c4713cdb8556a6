"""Tables in parts by ranges of a key, of which a change rewrites only the parts it touches."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bequest.operators.joins import missing
from bequest.session import folders, remove_folder
from bequest.sources.tables import literal_rows

#: The part of rows without a key.
NO_KEY = -(1 << 62)


class PartedTable:
    """A Parquet table in parts: rows whose keys have the same quotient by `width`.

    A version is a list of parts and of the versions that wrote them.  A change writes the parts it touches
    into a folder of its own and then the new list, so readers of a version keep what they read, and a change
    that fails leaves nothing but a folder the next one replaces.  Width is chosen so that there are some
    thousand parts; a part whose keys are dense is split over files by size.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, width: int) -> None:
        self.spark, self.folder, self.key, self.width = spark, folder, key, width

    def part_of(self) -> Column:
        quotient = F.floor(F.col(self.key).cast("decimal(20,0)") / self.width).cast("long")
        return F.coalesce(quotient, F.lit(NO_KEY)).alias("part")

    def _versions(self) -> list[int]:
        """Versions with a complete list, newest first."""
        hadoop, found = self.spark._jsc.hadoopConfiguration(), []
        for kind, name, path in folders(self.spark, self.folder):
            mark = self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
            if kind == "list" and mark.getFileSystem(hadoop).exists(mark):
                found.append(int(name))
        return sorted(found, reverse=True)

    def version(self) -> int:
        return self._versions()[0]

    def parts(self, version: int | None = None) -> dict[int, int]:
        """The version that wrote each live part; a row for each part, some thousand."""
        version = self.version() if version is None else version
        listed = self.spark.read.schema("part long, written long").parquet(f"{self.folder}/list={version}")
        return {r["part"]: r["written"] for r in listed.collect()}

    def rows(self, version: int | None = None, parts: set[int] | None = None) -> DataFrame:
        """The rows of a version (the newest), of some parts or of all."""
        by_version = defaultdict(list)
        for part, written in self.parts(version).items():
            if parts is None or part in parts:
                by_version[written].append(part)
        schema = self.spark.read.parquet(f"{self.folder}/empty").schema
        frames = []
        for written, listed in sorted(by_version.items()):
            base = f"{self.folder}/version={written}"
            paths = [f"{base}/part={part}" for part in sorted(listed)]
            frames.append(self.spark.read.schema(schema).parquet(*paths))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def create(self, rows: DataFrame) -> PartedTable:
        rows.limit(0).write.mode("overwrite").parquet(f"{self.folder}/empty")  # tells the columns
        self._write(rows, 0, {})
        return self

    def _write(self, rows: DataFrame, version: int, others: dict[int, int]) -> set[int]:
        folder = f"{self.folder}/version={version}"
        stored = rows.withColumn("part", self.part_of()).hint("rebalance", "part")
        stored.sortWithinPartitions("part", self.key).write.mode("overwrite").partitionBy("part").parquet(folder)
        written = {int(name) for kind, name, _ in folders(self.spark, folder) if kind == "part"}
        listed = others | dict.fromkeys(written, version)
        parts = literal_rows(self.spark, sorted(listed.items()), "part long, written long")
        parts.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/list={version}")
        return written

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> set[int]:
        """Replaces the parts of the given keys by what `change` makes of their rows; gives the parts.

        `change` gets the rows of these parts and may alter, drop and add rows within them.  Nothing else is
        read or written, and without keys nothing at all.
        """
        version = self.version()
        live = self.parts(version)
        touched = {r[0] for r in keys.select(self.part_of()).distinct().collect()}  # as many as parts
        if not touched:
            return set()
        others = {part: written for part, written in live.items() if part not in touched}
        self._write(change(self.rows(version, touched)), version + 1, others)
        return touched

    def tidy(self, keep: int = 2) -> None:
        """Removes what none of the newest `keep` versions needs."""
        stay = self._versions()[:keep]
        needed = {(written, part) for version in stay for part, written in self.parts(version).items()}
        for kind, name, path in folders(self.spark, self.folder):
            if kind == "list" and int(name) not in stay:
                remove_folder(self.spark, path)
            if kind == "version":
                gone = [at for k, p, at in folders(self.spark, path) if k == "part" and (int(name), int(p)) not in needed]
                for at in gone if any(written == int(name) for written, _ in needed) else [path]:
                    remove_folder(self.spark, at)


def without(table: PartedTable, keys: DataFrame) -> set[int]:
    """Drops the rows of the given keys."""
    return table.rewrite(keys, lambda rows: missing(rows, keys, table.key))
