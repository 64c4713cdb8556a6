"""Best-fit packing of documents into sequences, with conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches
from .ngram_join import jaccard_components, joined
from .words import _PLACE, mixed, word_hashes

#: Pieces that are packed together in one task.
SHARD = 8192


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a text, and a hash of them as its duplicate cluster."""
    for batch in batches:
        sizes, clusters = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
        for begin, end, hashed, at in word_hashes(batch.column("text"), True):
            place = np.arange(len(hashed)) - np.repeat(at[:-1], np.diff(at))
            spread = np.r_[np.uint64(0), np.cumsum(mixed(hashed + mixed(place.astype(np.uint64))))]
            sizes[begin:end] = np.diff(at)
            clusters[begin:end] = mixed((spread[at[1:]] - spread[at[:-1]]) * _PLACE[0] + np.diff(at).astype(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("source"), pa.array(sizes), pa.array(clusters.view(np.int64))],
            ["id", "source", "words", "cluster"],
        )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, words, cluster) of every document; equal texts, but for case and space, are a cluster."""
    small_batches(docs.sparkSession)
    read = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")
    )
    return read.mapInArrow(_measure, "id long, source string, words long, cluster long")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the hash of their words as id."""
    for batch in batches:
        (rows,) = _measure(iter([batch]))
        yield pa.RecordBatch.from_arrays([rows.column("cluster"), batch.column("text")], ["id", "text"])


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """As `measured`, but near copies are a cluster too: texts connected by 80 % of common five-word shingles.

    Null ids and ids that repeat are like others: where there are any, texts are joined by the hash of their
    words.  Texts without words have no cluster (null); no documents give no rows.
    """
    own = F.col(id_col).cast("long").alias("id")
    rows, ids = docs.select(own).agg(F.count("*"), F.count_distinct("id")).first()
    if rows == ids:  # every row has an id of its own, by which it is joined
        read = docs.select(own, F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
        cluster = F.when(F.col("words") > 0, F.col("component"))
        return joined(read, 5, 80, 100).select("id", "source", F.col("words").cast("long").alias("words"), cluster.alias("cluster"))
    found = kept(measured(docs, id_col, text_col, source_col), "measured")
    read = docs.select(
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("source"), F.col(text_col).alias("text")
    )
    near = jaccard_components(read.mapInArrow(_keyed, "id long, text string"), 5, 80, 100, "id", "text")
    near = near.filter("component_id <> id").select(F.col("id").alias("cluster"), "component_id").distinct()
    return found.join(near, "cluster", "left").select(
        "id", "source", "words", F.when(F.col("words") > 0, F.coalesce("component_id", "cluster")).alias("cluster")
    )


class Bins:
    """Bins of one shard, ordered by residual; each knows the sources and clusters it holds as bits."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.open: list[tuple[int, int]] = []  # (residual, bin)

    def put(self, length: int, source: int, cluster: int) -> int:
        """The bin with the least residual that holds the piece and shares no bit with it, or a new one."""
        at = bisect_left(self.open, (length, -1))
        while at < len(self.open):
            residual, number = self.open[at]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                del self.open[at]
                break
            at += 1
        else:
            residual, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if residual > length:
            insort(self.open, (residual - length, number))
        return number


_PACKED = "id long, piece int, first_word long, n_words long, bin_id long, place int"


def _packed(capacity: int):
    names = [c.split()[0] for c in _PACKED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "piece", "first_word", "n_words", "source", "cluster")))
            for part, number, piece, first, length, source, cluster in rows:
                if part != shard:
                    shard, bins = part, Bins(capacity)
                    sources: dict[str, int] = {}
                    clusters: dict[int, int] = {}
                    filled: list[int] = []
                one = 0 if source is None else 1 << sources.setdefault(source, len(sources))
                two = 0 if cluster is None else 1 << clusters.setdefault(cluster, len(clusters))
                bin_ = bins.put(length, one, two)
                if bin_ == len(filled):
                    filled.append(0)
                out.append((number, piece, first, length, (part << 32) | bin_, filled[bin_]))
                filled[bin_] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def best_fit_packing(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Packs documents (id, source, words, cluster) into bins of `capacity` words.

    Returns a row for each piece of a document: id, piece, first_word, n_words, bin_id, place (the
    piece's rank in its bin).  A document longer than a bin is cut; its full pieces fill bins of
    their own.  No bin holds two pieces of a source or of a duplicate cluster.  A piece goes to the
    compatible bin with the least room left, longest pieces first (ties: by id).  A document without
    words is a piece of no words without a bin.  A null source or cluster conflicts with nothing;
    null ids and rows that repeat an id are pieces like others.

    Pieces are dealt by hash into shards of about SHARD pieces, each packed by one task; a hot source
    or cluster is spread over all shards.
    """
    rows = pieces.withColumn("cuts", F.greatest(F.ceil(F.col("words") / capacity).cast("int"), F.lit(1)))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    first = F.col("piece").cast("long") * capacity
    rows = rows.select(
        "id",
        "source",
        "cluster",
        "piece",
        first.alias("first_word"),
        F.least(F.col("words") - first, F.lit(capacity)).cast("long").alias("n_words"),
    )
    rows = kept(rows, "pieces")
    shards = max(1, -(-rows.filter("n_words > 0").count() // SHARD))
    shard = F.pmod(F.xxhash64("id", "piece", "source", "cluster"), F.lit(shards))
    order = ["shard", F.desc("n_words"), "id", "piece", "source", "cluster"]
    packed = (
        rows.filter("n_words > 0")
        .withColumn("shard", shard)
        .repartition("shard")
        .sortWithinPartitions(*order)
        .mapInArrow(_packed(capacity), _PACKED)
    )
    none = rows.filter("n_words = 0").select(
        "id", "piece", "first_word", "n_words", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("place")
    )
    return packed.unionByName(none)
