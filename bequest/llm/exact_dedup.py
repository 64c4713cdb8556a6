"""Exact deduplication by content sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches
from .words import SPACE_CLASS

#: Characters of the normalised text that the sampled splitters look at.
PREFIX = 32

_SORTED = pa.schema(
    [
        ("id", pa.int64()),
        ("keep_id", pa.int64()),
        ("group_size", pa.int64()),
        ("first", pa.bool_()),
        ("text_sha256", pa.string()),
        ("run", pa.int64()),
        ("edge_text", pa.string()),
    ]
)
_SORTED_DDL = (
    "id long, keep_id long, group_size long, first boolean, text_sha256 string, run long, edge_text string"
)


def _runs_of_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours of one sorted partition.

    A run that may go on in another partition (its prefix and hash are those of the partition's
    first or last row) carries its text once, in edge_text.
    """
    part = TaskContext.get().partitionId()
    pending: list[list] = []  # runs with the key at hand: [text, ids]
    key = first_key = None
    number = 0

    def flush(at_edge: bool, out: dict[str, list]) -> None:
        nonlocal number
        for text, ids in pending:
            run = (part << 40) | number
            number += 1
            size, digest = len(ids), hashlib.sha256(text.encode("utf-8")).hexdigest()
            out["id"] += ids
            out["keep_id"] += [ids[0]] * size
            out["group_size"] += [size] * size
            out["first"] += [True] + [False] * (size - 1)
            out["text_sha256"] += [digest] * size
            out["run"] += [run if at_edge else None] * size
            out["edge_text"] += [text if at_edge else None] + [None] * (size - 1)
        pending.clear()

    for batch in batches:
        out: dict[str, list] = {name: [] for name in _SORTED.names}
        texts, ids = batch.column("norm"), batch.column("id").to_pylist()
        if not len(texts):
            continue
        same = pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.r_[True, ~same]).tolist()
        for start, end in zip(begins, [*begins[1:], len(ids)]):
            text = texts[start].as_py()
            if pending and pending[-1][0] == text:
                pending[-1][1] += ids[start:end]
                continue
            here = (batch.column("prefix")[start].as_py(), batch.column("hash")[start].as_py())
            if here != key:
                flush(key == first_key, out)
                first_key = here if first_key is None else first_key
                key = here
            pending.append([text, ids[start:end]])
        if out["id"]:
            yield pa.RecordBatch.from_pydict(out, _SORTED)
    out = {name: [] for name in _SORTED.names}
    flush(True, out)
    if out["id"]:
        yield pa.RecordBatch.from_pydict(out, _SORTED)


def _normal(text_col: str) -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_CLASS, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of rows whose texts are equal once runs of white space are one space.

    Returns a row for each input row: id_col, keep_id (smallest id of the equal texts), group_size,
    kept, text_sha256 (of the normalised text).  Null texts are empty, and empty texts equal each
    other.  Null ids come last; of repeated rows one is kept.  Other columns are not read.

    Rows are range-partitioned by (prefix, hash, id) at splitters Spark samples, so copies of one
    text may fill many partitions.  Sorted partitions hold equal texts adjacent, and neighbours are
    compared in full.  Runs at the edges of partitions, a few for each, are put together by text.
    """
    small_batches(docs.sparkSession)
    norm = _normal(text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm")).select(
        "id", "norm", F.substring("norm", 1, PREFIX).alias("prefix"), F.xxhash64("norm").alias("hash")
    )
    last = F.col("id").asc_nulls_last()
    ranged = keyed.repartitionByRange("prefix", "hash", last)
    in_order = ranged.sortWithinPartitions("prefix", "hash", "norm", last)
    found = kept(in_order.mapInArrow(_runs_of_equal, _SORTED_DDL), "content-sort")
    edges = found.filter("edge_text is not null").select(
        "run", "edge_text", F.struct(F.col("keep_id").isNull().alias("none"), "keep_id", "run").alias("head"), "group_size"
    )
    whole = edges.groupBy("edge_text").agg(
        F.min("head").alias("head"), F.sum("group_size").alias("total")
    )
    joined = edges.join(whole.withColumnRenamed("head", "lead"), "edge_text").select(
        "run", F.col("lead.keep_id").alias("lead_id"), (F.col("lead.run") == F.col("run")).alias("leads"), "total"
    )
    # At most a few rows for each partition.
    rows = found.drop("edge_text").join(F.broadcast(joined), "run", "left")
    across = F.col("total").isNotNull()
    return rows.select(
        F.col("id").alias(id_col),
        F.when(across, F.col("lead_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("total", "group_size").alias("group_size"),
        (F.col("first") & F.coalesce("leads", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group of equal texts: the one with the smallest id."""
    stays = exact_duplicates(docs, id_col, text_col).filter("kept")
    key = lambda digest: F.concat_ws(":", digest, F.col(id_col).cast("long"))
    wanted = stays.select(key(F.col("text_sha256")).alias("_stays"))
    found = docs.withColumn("_stays", key(F.sha2(_normal(text_col), 256))).join(wanted, "_stays", "left_semi")
    return found.dropDuplicates(["_stays"]).drop("_stays")
