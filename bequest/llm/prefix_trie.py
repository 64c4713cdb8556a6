"""Prefix trie of conversations: a double array for each shard, shared upper nodes merged over all shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, small_batches
from .ngram_join import _bounds, _grouped
from .words import mixed

#: Conversations and turns of a shard; it has more turns only if its last conversation has.
SHARD = 1 << 16
SHARD_TURNS = 1 << 19

_ORDER = ["conv_id", "part", "turn", "one", "two"]
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, one, two, words) of every turn: a 128-bit hash of role and text, and the text's words.

    Null roles and texts are empty; rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("one"),
        F.xxhash64(F.lit(20240607), text, role).alias("two"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).alias("words"),
    )


def shared_starts(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversation c begins anew: with the first h turns of c - c % family, then its own after its first h.

    h = crc32(c as text) % most.  Returns `turns` with `part` (0: lent turns, 1: own ones) and `skip` (own
    turns that drop out), to be put together by `paths`.  A lender with fewer turns lends all, an absent one
    none.
    """
    conv, h = F.col("conv_id"), F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    lends = conv % family == 0
    first = Window.partitionBy("conv_id").orderBy("turn", "one", "two")
    lent = turns.filter(lends).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") < most)
    lent = lent.select(F.col("conv_id").alias("lender"), F.col("rank").cast("long").alias("turn"), "one", "two", "words")
    takers = turns.filter(~lends).select("conv_id", (conv - conv % family).alias("lender"), h.alias("h")).distinct()
    lent = takers.filter("h > 0").join(lent, "lender").filter("turn <= h")
    columns = [*_ORDER, "words", "skip"]
    own = turns.withColumns({"part": F.lit(1), "skip": F.when(lends, 0).otherwise(h).cast("long")}).select(*columns)
    return own.unionByName(lent.withColumns({"part": F.lit(0), "skip": F.lit(0).cast("long")}).select(*columns))


def _path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation; input sorted by conversation and order."""
    for found in _grouped(batches, ["conv_id"]):
        if not found.num_rows:
            continue
        at = _bounds(found, ["conv_id"])
        own = found.column("part").to_numpy() == 1
        convs = np.repeat(np.arange(len(at) - 1), np.diff(at))
        before = np.r_[0, np.cumsum(own)]
        stays = ~own | (before[:-1] - before[at[:-1]][convs] >= found.column("skip").to_numpy())
        counts = np.bincount(convs[stays], minlength=len(at) - 1)
        hashed = np.stack([found.column(c).to_numpy()[stays] for c in ("one", "two")], 1).ravel()
        offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(found.column("conv_id").to_numpy()[at[:-1]]),
                pa.ListArray.from_arrays(offsets * 2, pa.array(hashed)),
                pa.ListArray.from_arrays(offsets, pa.array(found.column("words").to_numpy()[stays].astype(np.int32))),
            ],
            ["conv_id", "path", "words"],
        )


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, words) of every conversation, of turns in order: lent, own; turn (null first), hash.

    path holds two numbers a turn, words one: 20 bytes a turn, the only place where a conversation is one row.
    """
    if "part" not in turns.columns:
        turns = turns.withColumns({"part": F.lit(1), "skip": F.lit(0).cast("long")})
    ranged = turns.repartition("conv_id").sortWithinPartitions(*_ORDER)
    return ranged.mapInArrow(_path, "conv_id long, path array<long>, words array<int>")


class DoubleArray:
    """A trie in two arrays: the child of slot s by code c is slot t = BASE[s] + c if CHECK[t] = s.

    Slot 0 is the root.  Codes are dense numbers from 1 on.
    """

    #: Free slots that are tried for a family of children before it goes behind all others.
    TRIES = 64

    def __init__(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Packs nodes 1, 2, ... given by parent (0: the root) and code, in order of parents.

        Families take the first slots at which all of them fit, large ones first; only children then fill
        what is left free.  The closer the codes of a family, the smaller the arrays.
        """
        nodes = len(parents)
        begins = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]]) if nodes else np.empty(0, np.int64)
        sizes = np.diff(np.r_[begins, nodes])
        self._taken = np.zeros(2 * nodes + 2, bool)
        self._taken[0] = True
        self._top, self._lowest = 1, 1
        slots = np.zeros(nodes + 1, np.int64)
        base = np.zeros(nodes + 1, np.int64)
        families = np.flatnonzero(sizes > 1)
        for family in families[np.argsort(-sizes[families], kind="stable")].tolist():
            first, last = int(begins[family]), int(begins[family] + sizes[family])
            shifts = codes[first:last] - codes[first:last].min()
            at = self._place(shifts)
            slots[first + 1 : last + 1] = at + shifts
            self._taken[at + shifts] = True
            self._top = max(self._top, int(at + shifts.max()) + 1)
            base[parents[first]] = at + shifts[0] - codes[first]
        alone = begins[sizes == 1]
        free = np.flatnonzero(~self._taken)[: len(alone)]
        slots[alone + 1] = free
        base[parents[alone]] = free - codes[alone]
        size = max(self._top, int(slots.max()) + 1)
        self.slots = slots
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, -1, np.int64)
        self.base[slots] = base
        self.check[slots[1:]] = slots[parents]

    def _place(self, shifts: np.ndarray) -> int:
        """The least free slot tried at which all members of a family fit."""
        span = int(shifts.max())
        if self._top + span + 1 > len(self._taken):
            self._taken = np.r_[self._taken, np.zeros(max(len(self._taken), span + 1), bool)]
        while self._taken[self._lowest]:
            step = np.flatnonzero(~self._taken[self._lowest : self._lowest + 4096])
            self._lowest += int(step[0]) if len(step) else 4096
        for begin in (self._lowest, max(self._lowest, self._top - span)):
            tried = begin + np.flatnonzero(~self._taken[begin : begin + 4096])[: self.TRIES]
            tried = tried[tried + span < len(self._taken)]
            fits = ~self._taken[tried[:, None] + shifts].any(1)
            if fits.any():
                return int(tried[np.argmax(fits)])
        return self._top

    def step(self, slots: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of slots by codes, -1 where there is none."""
        to = self.base[slots] + codes
        inside = (to > 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == slots), to, -1)


_NODE = {
    "conv_id": pa.int64(),
    "depth": pa.int64(),
    "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(),
    "n_children": pa.int64(),
    "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(),
    "ends_sha256": pa.string(),
}
# Of nodes that other shards may hold too: their place in the shard, that of their parent, a hash of their
# path, the words of their last turn, and the ids that end there.
_SHARED = {
    "shard": pa.int64(),
    "place": pa.int32(),
    "up": pa.int32(),
    "key_one": pa.int64(),
    "key_two": pa.int64(),
    "words": pa.int64(),
    "ends": pa.binary(),
}
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def _ddl(fields: dict) -> str:
    return ", ".join(f"{name} {_DDL[kind]}" for name, kind in fields.items())


def _path_keys(one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    """A 128-bit hash of every prefix of a path, that of no turns first."""
    keys = [(0, 0)]
    with np.errstate(over="ignore"):
        for turn in zip(one.view(np.uint64), two.view(np.uint64)):
            now = np.array(keys[-1], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array(turn)
            keys.append(tuple(mixed(now + np.uint64(len(keys))).view(np.int64).tolist()))
    return keys


def shard_nodes(shard: int, convs: np.ndarray, offsets: np.ndarray, turns: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    """All nodes of one shard: conversations sorted by path and id, whose turns (two numbers) are given flat.

    Other shards hold conversations before and after these, so only nodes on the first and the last path
    can be theirs too.  What is told of such a shared node is this shard's part without that of shared nodes
    below it.
    """
    order = np.lexsort((turns[:, 1], turns[:, 0]))
    new = np.r_[True, (turns[order[1:]] != turns[order[:-1]]).any(1)] if len(order) else np.empty(0, bool)
    codes = np.empty(len(order), np.int64)
    codes[order] = np.cumsum(new)
    lengths = np.diff(offsets)
    deepest = int(lengths.max())

    # Level by level: equal prefixes are neighbours.
    at_node = np.zeros(len(convs), np.int64)
    parents, labels, known = [], [], 0
    for depth in range(deepest):
        active = np.flatnonzero(lengths > depth)
        parent, code = at_node[active], codes[offsets[active] + depth]
        first = np.r_[True, (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])]
        at_node[active] = known + np.cumsum(first)
        known += int(first.sum())
        parents.append(parent[first])
        labels.append(code[first])
    if parents:
        parents, labels = np.concatenate(parents), np.concatenate(labels)
        # Numbered anew as they first appear, so that turns of one family lie side by side.
        distinct, first = np.unique(labels, return_index=True)
        dense = np.empty(len(distinct) + 1, np.int64)
        dense[distinct[np.argsort(first)]] = np.arange(1, len(distinct) + 1)
        codes, labels = dense[codes], dense[labels]
    trie = DoubleArray(np.array(parents, np.int64), np.array(labels, np.int64))

    size = len(trie.check)
    n_convs, least = np.zeros(size, np.int64), np.zeros(size, np.int64)
    depths, own_words = np.zeros(size, np.int64), np.zeros(size, np.int64)
    n_convs[0], least[0] = len(convs), convs.min()
    state = np.zeros(len(convs), np.int64)
    trails = {0: [0], len(convs) - 1: [0]}  # slots on the first and the last path
    levels = [np.zeros(1, np.int64)]
    for depth in range(deepest):
        active = np.flatnonzero(lengths > depth)
        turn = offsets[active] + depth
        state[active] = to = trie.step(state[active], codes[turn])
        begins = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        slots = to[begins]
        n_convs[slots] = np.diff(np.r_[begins, len(to)])
        least[slots] = np.minimum.reduceat(convs[active], begins)
        depths[slots] = depth + 1
        own_words[slots] = words[turn[begins]]
        levels.append(slots)
        for conv, trail in trails.items():
            if lengths[conv] > depth:
                trail.append(int(state[conv]))
    shared: dict[int, tuple[int, int]] = {}
    for conv, trail in trails.items():
        path = turns[offsets[conv] : offsets[conv + 1]]
        for slot, key in zip(trail, _path_keys(path[:, 0], path[:, 1])):
            shared.setdefault(slot, key)
    slots = np.concatenate(levels)
    is_shared = np.zeros(size, bool)
    is_shared[list(shared)] = True

    ours = slots[~is_shared[slots]]
    children = np.bincount(trie.check[ours], minlength=size)
    leaves = ((children == 0) & ~is_shared).astype(np.int64)
    saved = np.where(is_shared, 0, (n_convs - 1) * own_words)
    for level in reversed(levels[1:]):
        level = level[~is_shared[level]]
        np.add.at(leaves, trie.check[level], leaves[level])
        np.add.at(saved, trie.check[level], saved[level])

    ends: dict[int, bytes] = {}
    begins = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(state)]):
        ends[int(state[begin])] = ",".join(map(str, convs[begin:end].tolist())).encode()

    places = {slot: place for place, slot in enumerate(shared)}
    ups = trie.check[slots]
    columns = {
        "conv_id": least[slots],
        "depth": depths[slots],
        "parent_conv_id": pa.array(least[ups], mask=is_shared[ups] | (ups < 0)),
        "n_convs": n_convs[slots],
        "n_children": children[slots],
        "n_leaves": leaves[slots],
        "saved_tokens": saved[slots],
        "ends_sha256": [
            None if s in shared else hashlib.sha256(ends[s]).hexdigest() if s in ends else EMPTY for s in slots.tolist()
        ],
        "shard": np.full(len(slots), shard),
        "place": [places.get(s) for s in slots.tolist()],
        "up": [places.get(s) for s in ups.tolist()],
        "key_one": [shared[s][0] if s in shared else None for s in slots.tolist()],
        "key_two": [shared[s][1] if s in shared else None for s in slots.tolist()],
        "words": own_words[slots],
        "ends": [ends.get(s) if s in shared else None for s in slots.tolist()],
    }
    fields = _NODE | _SHARED
    return pa.RecordBatch.from_arrays([pa.array(columns[n], k) for n, k in fields.items()], list(fields))


def _shards(most_convs: int, most_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        rows = turns = 0

        def built() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            path, words = whole.column("path").combine_chunks(), whole.column("words").combine_chunks()
            offsets = words.offsets.to_numpy().astype(np.int64)
            first, last = int(offsets[0]), int(offsets[-1])
            begin = int(path.offsets.to_numpy()[0])
            flat = path.values.to_numpy()[begin : begin + 2 * (last - first)].reshape(-1, 2)
            counts = words.values.to_numpy()[first:last].astype(np.int64)
            return shard_nodes((part << 32) | number, whole.column("conv_id").to_numpy(), offsets - first, flat, counts)

        for batch in batches:
            begin = 0
            sizes = np.diff(batch.column("words").offsets.to_numpy().astype(np.int64))
            while begin < batch.num_rows:
                full = turns + np.cumsum(sizes[begin:]) >= most_turns
                taken = min(most_convs - rows, int(np.argmax(full)) + 1 if full.any() else batch.num_rows - begin)
                piece = batch.slice(begin, taken)
                held.append(piece)
                rows, turns, begin = rows + piece.num_rows, turns + int(sizes[begin : begin + taken].sum()), begin + taken
                if rows >= most_convs or turns >= most_turns:
                    yield built()
                    number, rows, turns = number + 1, 0, 0
                    held.clear()
        if held:
            yield built()

    return run


class _Open:
    """A shared node whose subtree goes on."""

    def __init__(self, row: dict, up: tuple[int, int] | None) -> None:
        self.key, self.depth, self.up = (row["key_one"], row["key_two"]), row["depth"], up
        self.conv_id, self.words = row["conv_id"], row["words"]
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.at: list[tuple[int, int]] = []

    def add(self, row: dict) -> None:
        self.conv_id = min(self.conv_id, row["conv_id"])
        self.n_convs += row["n_convs"]
        self.n_children += row["n_children"]
        self.n_leaves += row["n_leaves"]
        self.saved += row["saved_tokens"]
        self.at.append((row["shard"], row["place"]))


_MERGED = pa.schema(
    [
        ("key_one", pa.int64()),
        ("key_two", pa.int64()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("shards", pa.list_(pa.int64())),
        ("places", pa.list_(pa.int32())),
        ("up_shard", pa.int64()),
        ("up_place", pa.int32()),
    ]
)
_MERGED_DDL = (
    "key_one long, key_two long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, shards array<long>, places array<int>, up_shard long, up_place int"
)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared nodes over all shards, whose rows come by shard and place: those of one path are open at a time."""
    path: list[_Open] = []
    out: list[tuple] = []

    def close(depth: int) -> None:
        while len(path) > depth:
            node = path.pop()
            if not node.n_children:
                node.n_leaves = 1
            node.saved += (node.n_convs - 1) * node.words
            if path:
                path[-1].n_children += 1
                path[-1].n_leaves += node.n_leaves
                path[-1].saved += node.saved
            shards, places = zip(*node.at)
            numbers = (node.conv_id, node.depth, node.n_convs, node.n_children, node.n_leaves, node.saved)
            out.append((*node.key, *numbers, shards, places, *(node.up or (None, None))))

    def flushed() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out), _MERGED)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=_MERGED)

    for batch in batches:
        for row in batch.to_pylist():
            depth = row["depth"]
            if len(path) <= depth or path[depth].key != (row["key_one"], row["key_two"]):
                close(depth)
                path.append(_Open(row, None if row["up"] is None else (row["shard"], row["up"])))
            path[depth].add(row)
        if out:
            yield flushed()
    close(0)
    if out:
        yield flushed()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids that end in a node, over its pieces by shard; input sorted."""
    key, digest = None, None
    for batch in batches:
        out: list[tuple] = []
        for one, two, piece in zip(*(batch.column(c).to_pylist() for c in ("key_one", "key_two", "ends"))):
            if (one, two) == key:
                digest.update(b"," + piece)
                continue
            if key is not None:
                out.append((*key, digest.hexdigest()))
            key, digest = (one, two), hashlib.sha256(piece)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key_one", "key_two", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key_one": [key[0]], "key_two": [key[1]], "ends_sha256": [digest.hexdigest()]})


def prefix_trie(found: DataFrame, most_convs: int = SHARD, most_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie's nodes of conversations (conv_id, path, words) as `paths` gives them, a row for each node.

    A node is a distinct sequence of first turns; the root has none.  conv_id is the smallest conversation
    that begins with it, parent_conv_id that of its parent (root: null), n_convs their number, n_children
    its children, n_leaves the childless nodes of its subtree, saved_tokens the sum over its subtree of
    (n_convs - 1) times the words of a node's last turn, ends_sha256 the digest of the ids, ascending and
    joined by commas, of the conversations that end there.  Copies are members like others, a conversation
    without turns is one of the root alone, and no conversations give no nodes.

    Conversations are range-partitioned by (path, conv_id), so a hot beginning or a conversation with many
    copies fills several partitions, and cut into shards.  Every shard packs its distinct paths into a
    double array over its dense turn ids and is walked once for its nodes.  Only nodes on a shard's first and
    last path can have members elsewhere: these, some for each shard, are put together in one pass in order,
    which holds one path at a time.
    """
    small_batches(found.sparkSession)
    shards = found.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = kept(shards.mapInArrow(_shards(most_convs, most_turns), _ddl(_NODE | _SHARED)), "trie-nodes")
    shared = nodes.filter("place is not null")
    merged = shared.drop("ends", "ends_sha256", "parent_conv_id").repartition(1).sortWithinPartitions("shard", "place")
    merged = kept(merged.mapInArrow(_merged, _MERGED_DDL), "trie-shared")
    ended = shared.filter("ends is not null").select("key_one", "key_two", "shard", "ends")
    ended = ended.repartition("key_one", "key_two").sortWithinPartitions("key_one", "key_two", "shard")
    ended = ended.mapInArrow(_ends, "key_one long, key_two long, ends_sha256 string")
    ups = merged.select(F.explode(F.arrays_zip("shards", "places")).alias("at"), F.col("conv_id").alias("parent_conv_id"))
    ups = ups.select(F.col("at.shards").alias("shard"), F.col("at.places").alias("up"), "parent_conv_id")

    columns = list(_NODE)
    alone = nodes.filter("place is null")
    inner = alone.filter("up is null").select(*columns)
    upper = alone.filter("up is not null").drop("parent_conv_id").join(ups, ["shard", "up"]).select(*columns)
    tops = (
        merged.join(ended, ["key_one", "key_two"], "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
        .withColumnsRenamed({"up_shard": "shard", "up_place": "up"})
        .join(ups, ["shard", "up"], "left")
    )
    return inner.unionByName(upper).unionByName(tops.select(*columns))
