"""The trie of shared conversation prefixes, by truncation peeling.

Peeling goes down from the greatest depth: at each depth the conversations that end there join the nodes that survive
from below, nodes of one prefix become one, their sums are final, and the last turn is stripped, so that a node becomes
a child, leaves and saved characters of its parent. Nodes are found and summed in the same pass.

At scale the sequences, which are chains of 16-byte digests and lengths and hold no texts, are range-partitioned in
their own order and peeled in blocks of a bounded number of turns. A prefix that is shared with another block lies on
the path of the block's first or of its last sequence; what the block knows of such nodes is kept as two rows, one for
each path, and the next round peels these rows like sequences. Every round leaves at most three quarters of the rows,
and two rounds suffice for billions of turns. So neither a prefix that all conversations share nor copies of one
conversation gather in one task: equal sequences are merged by id buckets before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm.common import checked_broadcast, discard, durable, shuffle_partitions, text_or_empty

#: Turns that are peeled together; a block holds four sequences at least.
BLOCK_TURNS = 1 << 18
#: Ids of one sequence that are sorted together.
ID_BUCKET = 1 << 16

_KEY = np.dtype("V16")
_NEVER = np.iinfo(np.int64).max
_NODES = "conv_id long, depth long, parent_conv_id long, parent_key binary, key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PATHS = "path binary, chars binary, sums binary, ends array<string>"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_sequences(conversations: DataFrame, group: Column | None = None) -> DataFrame:
    """(group, conv_id, turns): each conversation's turns in order of turn (null first), then role, then digest, as
    structs (digest, chars). Null roles and texts are empty ones; repeated rows are turns of their own; rows without a
    conv_id belong to no conversation. group (conv_id unless given) is a function of conv_id; rows are partitioned by it.

    Texts are digested before the shuffle. A conversation's digests, 24 bytes a turn, must fit in a task."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.filter("conv_id IS NOT NULL").select((F.col("conv_id") if group is None else group).alias("group"), "conv_id", F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", role.alias("role"), digest.alias("digest"), F.length(text).alias("chars")).alias("t"))
    ordered = turns.repartition("group").groupBy("group", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return ordered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): conversation c gets the first h turns of conversation c - c % 100 (none if absent) in place of its own first h, h = crc32(c) % 6."""
    known = turn_sequences(conversations, F.col("conv_id") - F.col("conv_id") % 100)
    head = F.max(F.when(F.col("conv_id") == F.col("group"), F.slice("turns", 1, 5))).over(Window.partitionBy("group"))
    taken = known.withColumn("head", head).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int"))
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return taken.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), own)).alias("turns"))


def _chained(sequences: DataFrame) -> DataFrame:
    """(conv_id, path, chars): path holds a 16-byte key for each prefix, chars the length of each turn's text."""

    def chain(batches):
        for b in batches:
            paths = []
            for turns in b.column(1).to_pylist():
                key, path = b"", []
                for digest in turns:
                    key = hashlib.sha256(key + digest).digest()[:16]
                    path.append(key)
                paths.append(b"".join(path))
            chars = [np.array(c, np.int32).tobytes() for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.binary()), pa.array(chars, pa.binary())], ["conv_id", "path", "chars"])

    return sequences.select("conv_id", "turns.digest", "turns.chars").mapInArrow(chain, "conv_id long, path binary, chars binary")


def _pieces(chained: DataFrame) -> DataFrame:
    """Equal sequences merged by bucket of ids: (path, chars, bucket, least, convs, ids)."""
    merged = chained.groupBy("path", "chars", F.floor(F.col("conv_id") / ID_BUCKET).alias("bucket")).agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("convs"), F.array_sort(F.collect_list("conv_id")).alias("ids"))
    return merged.withColumn("ids", F.array_join("ids", ","))


class Item:
    """A sequence with what is known at each depth of its path: rows convs, least, children, leaves, saved of sums."""

    def __init__(self, path: bytes, chars: bytes, sums: np.ndarray | None = None, ends: list[str | None] | None = None) -> None:
        self.path, self.chars = path, chars
        self.depth = len(path) // 16
        self.sums = _nothing(self.depth) if sums is None else sums
        self.ends: list[str | None] = [None] * (self.depth + 1) if ends is None else ends


def _nothing(depth: int) -> np.ndarray:
    sums = np.zeros((5, depth + 1), np.int64)
    sums[1] = _NEVER
    return sums


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[Item]:
    """Items of sorted pieces: the ids of a sequence are digested as they pass."""
    item, digest = None, None
    for b in batches:
        for path, chars, least, convs, ids in zip(*(b.column(c).to_pylist() for c in ("path", "chars", "least", "convs", "ids")), strict=True):
            if item is None or item.path != path:
                if item is not None:
                    item.ends[-1] = digest.hexdigest()
                    yield item
                item, digest = Item(path, chars), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
            item.sums[0, -1] += convs
            item.sums[1, -1] = min(item.sums[1, -1], least)
    if item is not None:
        item.ends[-1] = digest.hexdigest()
        yield item


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[Item]:
    for b in batches:
        for path, chars, sums, ends in zip(*(b.column(c).to_pylist() for c in ("path", "chars", "sums", "ends")), strict=True):
            yield Item(path, chars, np.frombuffer(sums, np.int64).reshape(5, -1), ends)


class _Peeler:
    """Peels one block of items that ascend by path. Nodes on the first and last path stay open unless the block is all there is."""

    def __init__(self, items: list[Item], closing: bool, keyed: bool) -> None:
        self.items, self.closing, self.keyed = items, closing, keyed
        self.offset = np.concatenate(([0], np.cumsum([i.depth for i in items])))
        self.keys = np.frombuffer(b"".join(i.path for i in items), _KEY)
        self.chars = np.frombuffer(b"".join(i.chars for i in items), np.int32)
        self.nodes: list[pa.Table] = []
        self.left, self.right = Item(items[0].path, items[0].chars), Item(items[-1].path, items[-1].chars)

    def _entries(self) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """What the items know, by depth: (item, sums, digests of ends, first entry of each depth)."""
        at, item, sums, ends, names = [], [], [], [], [""]
        for i, it in enumerate(self.items):
            used = np.flatnonzero(it.sums[0] | it.sums[2] | (it.sums[1] != _NEVER))
            at.append(used)
            item.append(np.full(len(used), i))
            sums.append(it.sums[:, used])
            for d in used.tolist():
                ends.append(len(names) if it.ends[d] else 0)
                if it.ends[d]:
                    names.append(it.ends[d])
        depth, item, sums, ends = np.concatenate(at), np.concatenate(item), np.concatenate(sums, axis=1), np.array(ends, np.int64)
        order = np.argsort(depth, kind="stable")
        first = np.searchsorted(depth[order], np.arange(max(i.depth for i in self.items) + 2))
        return item[order], np.vstack([sums[:, order], ends[order]]), names, first

    def _on(self, item: Item, i: int, depth: int, keys: np.ndarray | None, n: int) -> np.ndarray:
        if self.closing or depth > item.depth:
            return np.zeros(n, bool)
        return np.ones(n, bool) if keys is None else keys == self.keys[self.offset[i] + depth - 1]

    def peel(self) -> None:
        item, known, names, first = self._entries()
        alive, alive_sums, waiting = np.zeros(0, np.int64), np.zeros((6, 0), np.int64), None
        for depth in range(len(first) - 2, -1, -1):
            new = slice(first[depth], first[depth + 1])
            rep = np.concatenate([alive, item[new]])
            if not len(rep):
                alive, alive_sums, waiting = rep, np.zeros((6, 0), np.int64), None
                continue
            order = np.argsort(rep, kind="stable")
            rep, sums = rep[order], np.concatenate([alive_sums, known[:, new]], axis=1)[:, order]
            keys = self.keys[self.offset[rep] + depth - 1] if depth else None
            start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if depth else np.zeros(1, np.int64)
            owner = np.zeros(len(rep), np.int64)
            owner[order] = np.cumsum(np.isin(np.arange(len(rep)), start)) - 1
            total = np.add.reduceat(sums, start, axis=1)
            total[1] = np.minimum.reduceat(sums[1], start)
            rep, keys = rep[start], keys[start] if depth else None
            on_left, on_right = self._on(self.left, 0, depth, keys, len(rep)), self._on(self.right, len(self.items) - 1, depth, keys, len(rep))
            opened = on_left | on_right
            for side, on in ((self.left, on_left), (self.right, on_right & ~on_left)):
                for g in np.flatnonzero(on).tolist():
                    side.sums[:, depth] = total[:5, g]
                    side.ends[depth] = names[total[5, g]] or None
            if waiting is not None:
                self._emit(*waiting, owner[: len(alive)], total[1], opened, keys)
            closed = np.flatnonzero(~opened)
            convs, least, children, leaves, saved, ends = total[:, closed]
            leaves = np.where(children == 0, 1, leaves)
            if depth:
                saved = saved + (convs - 1) * self.chars[self.offset[rep[closed]] + depth - 1]
            node_keys = [k.tobytes() for k in keys[closed]] if depth and self.keyed else [b""] * len(closed)
            waiting = (depth, node_keys, convs, least, children, leaves, saved, [names[e] or _NO_ENDS for e in ends.tolist()])
            alive = rep[closed]
            alive_sums = np.vstack([convs, least, np.ones(len(closed), np.int64), leaves, saved, np.zeros(len(closed), np.int64)])
        if waiting is not None and len(alive):  # the root
            self._emit(*waiting, np.zeros(len(alive), np.int64), None, None, None)

    def _emit(self, depth, node_keys, convs, least, children, leaves, saved, ends, owner, parents, opened, keys) -> None:
        n = len(convs)
        if parents is None:
            parent, parent_key = [None] * n, [None] * n
        else:
            wait = opened[owner]
            parent = pa.array(parents[owner], mask=wait)
            parent_key = [(b"" if keys is None else keys[o].tobytes()) if w else None for o, w in zip(owner.tolist(), wait.tolist(), strict=True)]
        columns = [pa.array(least), pa.array(np.full(n, depth)), pa.array(parent, pa.int64()), pa.array(parent_key, pa.binary()), pa.array(node_keys if self.keyed else [None] * n, pa.binary()), *(pa.array(c) for c in (convs, children, leaves, saved)), pa.array(ends, pa.string())]
        self.nodes.append(pa.Table.from_arrays(columns, [c.split()[0] for c in _NODES.split(", ")]))

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in f"{_NODES}, {_PATHS}".split(", ")]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 3 + [pa.list_(pa.string())]
        if self.nodes:
            for b in pa.concat_tables(self.nodes).combine_chunks().to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.nulls(len(b), k) for k in kinds[10:])], names)
        if not self.closing:
            kept = [self.left, self.right][: 1 if len(self.items) == 1 else 2]
            values = [[i.path for i in kept], [i.chars for i in kept], [i.sums.tobytes() for i in kept], [i.ends for i in kept]]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(kept), k) for k in kinds[:10]), *(pa.array(v, k) for v, k in zip(values, kinds[10:], strict=True))], names)


def _peeled(rows: DataFrame, partitions: int, closing: bool, items: Callable, keyed: bool) -> DataFrame:
    def blocks(batches):
        block, turns = [], 0
        for item in items(batches):
            block.append(item)
            turns += item.depth
            if not closing and turns >= BLOCK_TURNS and len(block) >= 4:
                peeler = _Peeler(block, False, keyed)
                peeler.peel()
                yield from peeler.rows()
                block, turns = [], 0
        if block:
            peeler = _Peeler(block, closing, keyed)
            peeler.peel()
            yield from peeler.rows()

    order = ["path", "bucket"] if "bucket" in rows.columns else ["path"]
    return rows.repartitionByRange(partitions, "path").sortWithinPartitions(*order).mapInArrow(blocks, f"{_NODES}, {_PATHS}")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The trie of (conv_id, turns): a row for each distinct prefix, the empty one included, with its members' least
    conv_id, depth, the parent's conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    A conversation without turns is a member of the root alone; without conversations there is no node. conv_id is
    unique in sequences and not null."""
    names = [c.split()[0] for c in _NODES.split(", ")]
    pieces = durable(_pieces(_chained(sequences)))
    rounds = [durable(_peeled(pieces, shuffle_partitions(sequences.sparkSession), False, _sequences, False))]
    discard(pieces)
    while (left := rounds[-1].filter("path IS NOT NULL").select("path", "chars", "sums", "ends").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("path") / 16).alias("turns")).first())["rows"]:
        closing = left["rows"] <= 8 or left["turns"] <= BLOCK_TURNS
        partitions = 1 if closing else max(1, min(left["rows"] // 8, shuffle_partitions(sequences.sparkSession), int(left["turns"] // BLOCK_TURNS) + 1))
        rounds.append(durable(_peeled(rounds[-1].filter("path IS NOT NULL").select("path", "chars", "sums", "ends"), partitions, closing, _paths, True)))
    nodes = [r.filter("path IS NULL").select(*names) for r in rounds]
    every, parents = nodes[0], nodes[0].limit(0)
    for later in nodes[1:]:
        every, parents = every.unionByName(later), parents.unionByName(later)
    parents = checked_broadcast(parents.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found")))
    waiting = every.filter("parent_key IS NOT NULL").join(parents, "parent_key").withColumn("parent_conv_id", F.col("found")).select(*names)
    return every.filter("parent_key IS NULL").unionByName(waiting).drop("key", "parent_key")


#: DuckDB SQL for the trie of rebuilt conversations. It pairs every prefix with its ancestors, which only tests can afford.
ORACLE_SQL = """
WITH turns AS (
    SELECT conv_id, chars, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS place
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(text, '')) AS chars, substr(sha256(concat(length(coalesce(role, '')), ':', role, text)), 1, 32) AS digest
        FROM conversations WHERE conv_id IS NOT NULL)
), ids AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: CAST(ord(s[i]) AS BIGINT))),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, step: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM turns)
), rebuilt AS (
    SELECT i.conv_id, 0 AS part, t.place, t.chars, t.digest FROM ids i JOIN turns t ON t.conv_id = i.base AND t.place <= i.h
    UNION ALL SELECT i.conv_id, 1, t.place, t.chars, t.digest FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.place > i.h
), numbered AS (
    SELECT conv_id, chars, digest, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM rebuilt
), prefixes AS (
    SELECT conv_id, depth, chars, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM numbered
    UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), linked AS (
    SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(k) OVER (PARTITION BY conv_id ORDER BY depth) AS child FROM prefixes
), nodes AS (
    SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, count(DISTINCT child) AS n_children, min(parent) AS parent, min(chars) AS chars,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE child IS NULL), '')) AS ends_sha256
    FROM linked GROUP BY k, depth
), below AS (
    SELECT DISTINCT a.k, b.k AS lower FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), sums AS (
    SELECT b.k, count(*) FILTER (WHERE n.n_children = 0) AS n_leaves, CAST(sum((n.n_convs - 1) * n.chars) AS BIGINT) AS saved_tokens FROM below b JOIN nodes n ON n.k = b.lower GROUP BY b.k
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.k = n.k LEFT JOIN nodes p ON p.k = n.parent
"""
