"""State tables and outputs of `foreachBatch` jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bequest.operators.joins import matching
from bequest.session import folders, remove_folder
from bequest.sources.tables import literal_rows


#: Buckets by which the rows of a keyed state are sorted, so that a batch skips what it does not touch.
BUCKETS = 256
#: A part stays as it is while it has more than this many times the rows of those behind it.
GROWTH = 2
#: Versions of a published result that stay for readers.
KEEP = 3


class SlotState:
    """A table of a few rows carried from batch to batch in the shared folder.

    Batch n reads what batch n - 1 wrote and writes the other of two slots, so a batch that is
    run again after a failure finds its input untouched and replaces its own half-written slot.
    """

    def __init__(self, folder: str, schema: str):
        self.folder = folder
        self.schema = schema

    def _slot(self, batch_id: int) -> str:
        return f"{self.folder}/slot={batch_id % 2}"

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return literal_rows(spark, [], self.schema)
        return spark.read.schema(self.schema).parquet(self._slot(batch_id - 1))

    def after(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(self._slot(batch_id))


class KeyedState:
    """A keyed table in parts, of which a batch adds one with the rows it changed.

    A key's row in a newer part stands for those in older ones.  A part that has not GROWTH times the rows
    of the parts behind it is merged with them, so parts are few (the logarithm of the rows) and a row is
    written about as often.  Every batch lists the parts that are live after it.  Batch n starts from the
    list of batch n - 1, so a batch that is run again after a failure finds its input untouched and replaces
    what it had written; what neither list needs is removed, so the folder stays within a few times the
    table, however many batches there are.
    """

    def __init__(self, folder: str, schema: str, key: str, buckets: int = BUCKETS):
        self.folder, self.schema, self.key = folder, schema, key
        self.columns = [part.split()[0] for part in schema.split(", ")]
        self.buckets = buckets
        self.bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _listed(self, spark: SparkSession, batch_id: int) -> list[tuple[str, int]]:
        """Live parts after a batch, oldest first, with their rows; as many as the rows' logarithm."""
        if batch_id < 0:
            return []
        listed = spark.read.schema("place int, part string, rows long").parquet(f"{self.folder}/list={batch_id}")
        return [(r["part"], r["rows"]) for r in listed.orderBy("place").collect()]

    def _read(self, spark: SparkSession, parts: list[str], touched: list[int] | None = None) -> DataFrame:
        """The newest row of every key in the parts given, oldest first; of the touched buckets only."""
        stored = f"{self.schema}, bucket int"
        frames = [
            spark.read.schema(stored).parquet(f"{self.folder}/part={part}").withColumn("place", F.lit(place))
            for place, part in enumerate(parts)
        ]
        if not frames:
            return literal_rows(spark, [], self.schema)
        found = reduce(DataFrame.unionByName, frames)
        if touched is not None and len(touched) < self.buckets:
            found = found.where(F.col("bucket").isin(touched))
        if len(frames) > 1:
            newest = F.max_by(F.struct(*self.columns), "place").alias("row")
            found = found.groupBy(self.key).agg(newest).select("row.*")
        return found.select(*self.columns)

    def before(self, changed: DataFrame, batch_id: int) -> DataFrame:
        """The state of the keys of the changed rows, as the batch before left it."""
        spark = changed.sparkSession
        parts = [part for part, _ in self._listed(spark, batch_id - 1)]
        if not parts:
            return literal_rows(spark, [], self.schema)
        touched = [r[0] for r in changed.select(self.bucket).distinct().collect()]  # BUCKETS at most
        return matching(self._read(spark, parts, touched), changed.select(self.key).distinct(), self.key)

    def after(self, changed: DataFrame, batch_id: int) -> None:
        """Takes the new rows of the keys that a batch changed, one for each."""
        spark = changed.sparkSession
        live = self._listed(spark, batch_id - 1)
        added = self._write(changed, f"{batch_id}")
        if added:
            merged, total = [], added
            while live and live[-1][1] <= GROWTH * total:
                part, rows = live.pop()
                merged.insert(0, part)
                total += rows
            part = f"{batch_id}"
            if merged:
                part = f"{batch_id}-merged"
                added = self._write(self._read(spark, [*merged, f"{batch_id}"]), part)
            live.append((part, added))
        rows = [(place, *entry) for place, entry in enumerate(live)]
        listed = literal_rows(spark, rows, "place int, part string, rows long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/list={batch_id}")
        self._remove(spark, batch_id, {part for part, _ in [*live, *self._listed(spark, batch_id - 1)]})

    def _write(self, rows: DataFrame, part: str) -> int:
        """In few files, sorted by bucket; gives the number of rows."""
        stored = rows.select(*self.columns, self.bucket.alias("bucket")).hint("rebalance", "bucket")
        path = f"{self.folder}/part={part}"
        stored.sortWithinPartitions("bucket").write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(f"{self.schema}, bucket int").parquet(path).count()

    def _remove(self, spark: SparkSession, batch_id: int, needed: set[str]) -> None:
        """Parts that the lists of this batch and the one before do not name, and older lists."""
        for kind, name, path in folders(spark, self.folder):
            if (kind == "part" and name not in needed) or (kind == "list" and int(name) < batch_id - 1):
                remove_folder(spark, path)


def _versions(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """Complete versions of a result, newest first."""
    hadoop = spark._jsc.hadoopConfiguration()
    done = []
    for kind, name, path in folders(spark, folder):
        mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        if kind == "version" and mark.getFileSystem(hadoop).exists(mark):
            done.append((int(name), path))
    return sorted(done, reverse=True)


def publish(df: DataFrame, folder: str, batch_id: int, keep: int = KEEP) -> None:
    """A whole result as a new version; readers see the version before until this one is complete.

    The newest `keep` versions stay, so a reader may take as long as keep - 1 batches.
    """
    df.write.mode("overwrite").parquet(f"{folder}/version={batch_id}")
    for _, path in _versions(df.sparkSession, folder)[max(1, keep):]:
        remove_folder(df.sparkSession, path)


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The newest complete version of a result."""
    return spark.read.parquet(_versions(spark, folder)[0][1])


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    """One batch's rows; running the batch again replaces them."""
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
