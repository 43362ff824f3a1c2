"""Periodic runs against a definition in plain loops."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from flowsentry.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_definition(words):
    """(start, length, period) of every run: each lag's stretches that agree with themselves, of the smallest period."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def copies(rng, n, letters):
    words = [int(rng.integers(letters))]
    while len(words) < n:
        a = int(rng.integers(len(words)))
        words += words[a : a + int(rng.integers(1, 200))] * int(rng.integers(1, 4))
    return words[:n]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def neighbours(rng):
    """Two runs of one short period in different phases side by side: the longer periods across them have no anchor inside."""
    unit = rng.integers(0, 2, int(rng.integers(1, 6))).tolist()
    u, v = unit * int(rng.integers(10, 60)), unit * int(rng.integers(10, 60))
    u, v = u[int(rng.integers(len(unit))) :], v[int(rng.integers(len(unit))) :]
    return [1, *u, *v, *u, 2, *u, *v]


def test_runs_equal_their_definition():
    rng = np.random.default_rng(5)
    texts = [[], [0], [0] * 11, [0] * 12, [0] * 400, [0, 1] * 90 + [1, 0] * 90, ([0] * 70 + [1]) * 9, fibonacci(700), list(range(150)) * 4, list(range(33)) * 2, list(range(31)) * 2]
    texts += [copies(rng, int(rng.integers(1, 700)), int(rng.integers(1, 6))) for _ in range(40)] + [neighbours(rng) for _ in range(40)]
    found = periodic.runs([np.array(t, np.int64) for t in texts])
    assert [list(map(tuple, f.tolist())) for f in found] == [by_definition(t) for t in texts]
    assert sum(map(len, found)) > 300
    assert periodic.runs([]) == []


def test_hashes_decide_nothing(monkeypatch):
    """With prefix hashes that call everything alike, the word by word comparison gives the same runs."""
    texts = [np.array(list(range(100)) * 3 + [7] * 50 + list(range(100)) * 2, np.int64), np.array(fibonacci(300), np.int64)]
    want = [f.tolist() for f in periodic.runs(texts)]
    monkeypatch.setattr(periodic._Prefixes, "alike", lambda self, at, lag, size: np.ones(len(at), bool))
    assert [f.tolist() for f in periodic.runs(texts)] == want


def test_a_long_text_is_searched_whole():
    rng = np.random.default_rng(6)
    unit = rng.integers(0, 10_000, 50_000)
    text = np.concatenate([unit, unit, [10_001], [3] * 100_000])
    assert periodic.runs([text])[0].tolist() == [[0, 100_000, 50_000], [100_001, 100_000, 1]]


def report(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_definition(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_report_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = docs.filter("n_chars < 6000")
    want = {report(r["doc_id"], r["text"]) for r in short.collect()}
    got = [tuple(r) for r in periodic.run_report(short).collect()]
    assert set(got) == want and len(got) == len(want) and any(r[1] for r in got)


@pytest.mark.parametrize("ids", [[None, 1, 19, 19, 3, 4], [39, 57, 65, 70, 86, 96]])
def test_odd_rows(spark, ids):
    texts = [None, "", " \t\n", "a b\x0bc d " * 300, "a b\x0bc d " * 300, "one"]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, runs string, searched_text int")
    got = sorted((tuple(r) for r in periodic.run_report(frame).collect()), key=str)
    assert got == sorted((report(i, t) for i, t in zip(ids, texts, strict=True)), key=str)
    kept = periodic.with_runs(frame)
    assert kept.columns == ["doc_id", "text", "runs", "searched_text", "_runs", "collapsed"]
    assert sorted(r["searched_text"] for r in kept.collect()) == [1] * 6
    assert periodic.run_report(frame.limit(0)).collect() == []
