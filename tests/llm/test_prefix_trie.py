"""The prefix trie against a trie of nested dictionaries, and its SQL on the same rows."""

import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from flowsentry.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def in_order(rows):
    conversations = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            conversations[c].append(((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]), (role, text)))
    return {c: [t for _, t in sorted(v)] for c, v in conversations.items()}


def rebuilt(conversations):
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = conversations.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def trie(conversations):
    """Rows of the trie: every prefix of every conversation with its members, by definition."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    saved = lambda n: (len(members[n]) - 1) * len(n[-1][1]) if n else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], sum(not children[b] for b in below[n]), sum(map(saved, below[n])), digest(ends[n])) for n, m in members.items())


def found(conversations):
    return sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(prefix_trie.rebuilt(conversations)).collect())


def by_sql(conversations):
    con = duckdb.connect()
    con.register("conversations", conversations.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    return sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.ORACLE_SQL})").fetchall())


def made(seed):
    """Hundreds of conversations of few texts, so that prefixes and whole conversations are often shared; one is long."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(1000, 250, replace=False).tolist():
        hot = rng.random() < 0.3
        length = 9 if hot else int(rng.integers(1, 9)) if rng.random() < 0.98 else 60
        rows += [(c, t, "user" if t % 2 else "bot", "same" if hot else ["a", "é🙂", None][int(rng.integers(3))]) for t in range(length)]
    return rows


@pytest.mark.parametrize("turns", [1, 40, 1 << 18])
def test_trie_equals_its_definition(spark, monkeypatch, turns):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "ID_BUCKET", 16)
    rows = made(turns)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = trie(rebuilt(in_order(rows)))
    assert found(frame) == want and max(r[1] for r in want) > 50
    assert by_sql(frame) == want


def test_peeling_in_rounds(monkeypatch):
    """Blocks of one task, peeled round by round, give the trie that one block gives."""
    rng, items = np.random.default_rng(4), {}
    for c in range(300):
        path = b"".join(hashlib.sha256(bytes([d]) + bytes(p)).digest()[:16] for d, p in ((d, rng.integers(0, 2, 1)) for d in range(int(rng.integers(0, 12)))))
        items.setdefault(path, c)
    # keys of a chain must name whole prefixes
    chained = {}
    for path, c in items.items():
        key, out = b"", b""
        for i in range(0, len(path), 16):
            key = hashlib.sha256(key + path[i : i + 16]).digest()[:16]
            out += key
        chained[out] = c

    def fresh():
        out = []
        for path, c in sorted(chained.items()):
            item = prefix_trie.Item(path, np.full(len(path) // 16, 3, np.int32).tobytes())
            item.sums[0, -1], item.sums[1, -1], item.ends[-1] = 1, c, str(c)
            out.append(item)
        return out

    def rows(peeler):
        peeler.peel()
        return [r for t in peeler.nodes for r in t.to_pylist()]

    once = rows(prefix_trie._Peeler(fresh(), True, True))
    level, nodes, rounds = fresh(), [], 0
    while level:
        closing = len(level) <= 4
        blocks = [level[i : i + 4] for i in range(0, len(level), 4)]
        level, rounds = [], rounds + 1
        for block in blocks:
            peeler = prefix_trie._Peeler(block, closing, True)
            nodes += rows(peeler)
            if not closing:
                level += [peeler.left, peeler.right][: 1 if len(block) == 1 else 2]
    name = {r["key"]: r["conv_id"] for r in nodes}
    for r in nodes:
        if r["parent_key"] is not None:
            r["parent_conv_id"] = name[r["parent_key"]]
    plain = lambda rows: sorted(tuple(str(r[k]) for k in ("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in rows)
    assert rounds > 4 and plain(nodes) == plain(once)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, 0, "user", "x"), (7, 0, "user", "x"), (7, 0, "bot", "x"), (107, 1, "user", "y" * 50_000), (-250, 3, "u", ""), (-205, 3, "u", "z"), (300, 0, "u", "a"), (341, 0, "u", "a")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("path", frame_extra()).withColumn("depth", frame_extra())
    want = trie(rebuilt(in_order(rows)))
    assert found(frame) == want == by_sql(frame.select("conv_id", "turn", "role", "text"))
    assert found(frame.limit(0)) == []
    assert found(frame.filter("conv_id IS NULL")) == []


def frame_extra():
    from pyspark.sql import functions as F

    return F.lit(b"extra")


def test_given_conversations(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = trie(rebuilt(in_order([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])))
    assert found(frame) == want
