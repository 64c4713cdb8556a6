"""What the operators share: tables, written intermediates, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bequest.session import fresh_folder

#: Rows an Arrow batch holds, so that batches of long texts stay small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def kept(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read back, for several readers."""
    spark = df.sparkSession
    folder = fresh_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def smallest_hashes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` of the rows, those with the smallest hashes of their key; ties by the key.

    Only about four times as many rows as are wanted are compared with each other.
    """
    wide = 1 << 40
    limit = wide * 4 * most // max(1, rows.count())
    near = rows.filter(F.pmod(F.xxhash64(key), F.lit(wide)) < limit)
    return near.orderBy(F.pmod(F.xxhash64(key), F.lit(wide)), key).limit(most)


#: Edges whose components a task finds at once, and pairs it hands on in a round.
EDGES = 1 << 19
PAIRS = 1 << 16


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of a task's edges (a, b) with the smallest one that these edges connect it to.

    For functions that find edges: what they yield goes through here on its way out of the task.
    """
    up: dict[int, int] = {}
    edges = 0

    def root(node: int) -> int:
        while (above := up.setdefault(node, node)) != node:
            up[node] = node = up[above]
        return node

    def found() -> pa.RecordBatch:
        nodes = [(n, r) for n in list(up) if (r := root(n)) != n]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in nodes], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        edges += batch.num_rows
        if edges >= EDGES:
            edges = 0
            yield found()
    yield found()


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b): a row (node, component) for every node.

    component is the smallest node of the component.  Rounds until every node hangs on a root: a node
    hangs on the smallest node it is paired with, its other pairs become pairs of that one, and it moves up
    to what its smallest hangs on.  The number of pairs never grows; each round is written to the shared
    folder, in few files where it is small.  Few rounds are left where tasks have made `stars` of their edges.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = kept(pairs.filter("a <> b"), f"{name}-edges")
    while True:
        few = -(-pairs.count() // PAIRS) or 1
        lows = pairs.groupBy("a").agg(F.min("b").alias("m"), (F.max("b") > F.min("b")).alias("several"))
        tops = lows.select(F.col("a").alias("m"), F.col("m").alias("top"))
        hung = kept(lows.join(tops, "m", "left").coalesce(few), f"{name}-hung")
        if not hung.filter("several or top is not null").limit(1).count():
            break
        up = hung.select("a", F.coalesce("top", "m").alias("b"))
        other = pairs.join(hung.filter("several").select("a", "m"), "a").filter("b <> m")
        other = other.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).distinct()
        pairs = kept(up.unionByName(other).coalesce(few), f"{name}-pairs")
    nodes = hung.select(F.col("a").alias("node"), F.col("m").alias("component"))
    return nodes.unionByName(hung.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
