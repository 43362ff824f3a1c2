"""Maximal periodic runs of words, exactly, by multi-scale minimizers.

A run is a stretch of words of smallest period q, at least max(12, 2 q) long, that no neighbouring word extends.

* Periods below SCANNED are found by comparing the words with themselves at each lag.
* Periods of a scale [2k, 4k) are found by seeds. Of every k + 1 consecutive grams of k words the least by hash (the
  leftmost of equals) is a minimizer. The windows at a run's start and one period later hold the same words, so their
  minimizers lie exactly a period apart: every pair of equal minimizers whose distance is in the scale is a candidate.
* A gram that lies in a known run of period k / 2 or less is periodic and never a minimizer: equal grams of the others
  are more than k / 2 apart, so a minimizer has fewer than eight partners. When every window of a run's first period
  is made of periodic grams, that period lies in one known run and the next period in another, of the same period,
  that touches it; such neighbours are tried at every lag of the scale, which is less than their length.
* Candidates are extended by binary search over prefix hashes and then compared word by word; hashes decide nothing.

The work is O(n log n) words a document, without bound on period or length. No row meets another one, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import free_name

LEAST = 12
#: Periods below this are found by direct lag scans; a power of two, 4 * LEAST / 3 at least so that a gram of the first scale has LEAST words.
SCANNED = 32
#: Words that are searched together; a longer text is searched by itself.
GROUP_WORDS = 1 << 19

_NONE = np.uint64(2**64 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Prefixes:
    """Polynomial prefix hashes modulo 2**64 of a sequence of word numbers."""

    def __init__(self, x: np.ndarray) -> None:
        self.power = np.full(len(x) + 1, _BASE)
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_mixed(x.astype(np.uint64) + _BASE) * self.power[:-1], out=self.sums[1:])

    def grams(self, end: int, k: int) -> np.ndarray:
        """A hash of each k words that start in the first end words."""
        shift = self.power[end - k :: -1]
        return _mixed((self.sums[k : end + 1] - self.sums[: end - k + 1]) * shift)

    def alike(self, at: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.power[lag] == self.sums[at + lag + size] - self.sums[at + lag]


def _minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the leftmost least of some window of width grams; grams equal to _NONE never are."""
    least, at, size = grams, np.arange(len(grams)), 1
    while size < width:
        step = min(size, width - size)
        right = least[step:] < least[: len(least) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        least = np.where(right, least[step:], least[: len(least) - step])
        size += step
    at = at[least != _NONE]
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def _scanned(x: np.ndarray, lag: int) -> np.ndarray:
    """(start, end, lag) of the stretches that agree with themselves at lag."""
    differ = np.flatnonzero(x[:-lag] != x[lag:])
    edges = np.concatenate(([-1], differ, [max(len(x) - lag, 0)]))
    found = np.flatnonzero(np.diff(edges) - 1 >= max(LEAST, 2 * lag) - lag)
    start = edges[found] + 1
    return np.column_stack([start, edges[found + 1] + lag, np.full(len(found), lag)])


def _holds(x: np.ndarray, start: int, end: int, lag: int) -> bool:
    """Whether the stretch agrees with itself at lag and no neighbour does."""
    inner = np.array_equal(x[start : end - lag], x[start + lag : end])
    return inner and (start == 0 or x[start - 1] != x[start - 1 + lag]) and (end == len(x) or x[end] != x[end - lag])


def _by_words(x: np.ndarray, at: int, lag: int) -> tuple[int, int, int]:
    """The stretch around at that agrees with itself at lag, found without hashes."""
    agree = x[:-lag] == x[lag:]
    if not agree[at]:
        return at, at, lag
    after, before = np.flatnonzero(~agree[at:]), np.flatnonzero(~agree[:at])
    return int(before[-1]) + 1 if len(before) else 0, (at + int(after[0]) if len(after) else len(agree)) + lag, lag


def _extended(x: np.ndarray, prefixes: _Prefixes, at: np.ndarray, lag: np.ndarray, end: int) -> np.ndarray:
    """(start, end, lag) of the long enough stretches around the candidates."""
    ahead, back = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    step = 1 << max(end.bit_length() - 1, 0)
    while step:
        fits = np.flatnonzero(at + lag + ahead + step <= end)
        good = fits[prefixes.alike(at[fits] + ahead[fits], lag[fits], np.full(len(fits), step))]
        ahead[good] += step
        fits = np.flatnonzero(at - back - step >= 0)
        good = fits[prefixes.alike(at[fits] - back[fits] - step, lag[fits], np.full(len(fits), step))]
        back[good] += step
        step >>= 1
    found = np.column_stack([at - back, at + lag + ahead, lag, at])
    found = found[found[:, 1] - found[:, 0] >= np.maximum(LEAST, 2 * lag)]
    if not len(found):
        return np.zeros((0, 3), np.int64)
    stretches, which = np.unique(found[:, :3], axis=0, return_inverse=True)
    good = np.array([_holds(x, *r) for r in stretches.tolist()])
    held = [r for r, g in zip(stretches.tolist(), good.tolist(), strict=True) if g]
    held += {_by_words(x, at, lag) for _, _, lag, at in found[~good[which.ravel()]].tolist()}  # hashes that met by chance
    return np.array([r for r in held if r[1] - r[0] >= max(LEAST, 2 * r[2])], np.int64).reshape(-1, 3)


def _primitive(found: list[np.ndarray]) -> np.ndarray:
    """Of stretches with the same ends that of the smallest period: the others repeat it."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.any(np.diff(rows[:, :2], axis=0, prepend=-1), axis=1)]


def _candidates(prefixes: _Prefixes, known: np.ndarray, end: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) pairs in which every run with a period in [2k, 4k) within the first end words occurs."""
    grams = prefixes.grams(end, k)
    short = known[(known[:, 2] <= k // 2) & (known[:, 1] - known[:, 0] >= k) & (known[:, 1] <= end)]
    depth = np.zeros(len(grams) + 1, np.int64)
    np.add.at(depth, short[:, 0], 1)
    np.add.at(depth, short[:, 1] - k + 1, -1)
    grams[np.cumsum(depth[:-1]) > 0] = _NONE
    seeds = _minimizers(grams, k + 1)
    seeds = seeds[np.lexsort((seeds, grams[seeds]))]
    values, at, lag, apart = grams[seeds], [], [], 1
    while apart < len(seeds):
        distance = seeds[apart:] - seeds[:-apart]
        near = (values[apart:] == values[:-apart]) & (distance < 4 * k)
        if not near.any():
            break
        near &= distance >= 2 * k
        at.append(seeds[:-apart][near])
        lag.append(distance[near])
        apart += 1
    wide = short[short[:, 1] - short[:, 0] >= 2 * k]
    touch = np.flatnonzero((wide[1:, 0] <= wide[:-1, 1]) & (wide[1:, 2] == wide[:-1, 2]))
    for (a1, b1, _), (a2, b2, _) in zip(wide[touch].tolist(), wide[touch + 1].tolist(), strict=True):
        lags = np.arange(2 * k, min(4 * k, b2 - a1))
        first = np.maximum(a1, a2 - lags)
        good = (first < b1) & (first + lags < b2)
        at.append(first[good])
        lag.append(lags[good])
    return (np.concatenate(at), np.concatenate(lag)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each array of word numbers (0 or more) its runs as rows (start, length, period), by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    parts, starts, at = [], [], 0
    for n, i in enumerate(order):  # longest first, each followed by a number of its own
        starts.append(at)
        parts += [texts[i], np.array([-1 - n], np.int64)]
        at += len(texts[i]) + 1
    x = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    known = _primitive([_scanned(x, lag) for lag in range(1, min(SCANNED, len(x)))] or [np.zeros((0, 3), np.int64)])
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    prefixes = _Prefixes(x) if len(sizes) and sizes[0] >= 2 * SCANNED else None
    k = SCANNED // 2
    while len(sizes) and sizes[0] >= 4 * k:
        end = int((sizes[sizes >= 4 * k] + 1).sum())
        seeds = _candidates(prefixes, known, end, k)
        if len(seeds[0]):
            known = _primitive([known, _extended(x, prefixes, *seeds, end)])
        k *= 2
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    if len(known):
        owner = np.searchsorted(starts, known[:, 0], side="right") - 1
        rows = np.column_stack([known[:, 0] - np.array(starts)[owner], known[:, 1] - known[:, 0], known[:, 2]])
        rows, owner = rows[(by := np.lexsort((rows[:, 2], rows[:, 0], owner)))], owner[by]
        for o, part in zip(np.unique(owner).tolist(), np.split(rows, np.flatnonzero(np.diff(owner)) + 1), strict=True):
            out[order[o]] = part
    return out


def repeated(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words any run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return np.cumsum(depth[:-1]) > 0


def _groups(texts: Iterable[bytes | None]) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for text in texts:
        words = text.split() if text else []  # bytes: at the separators of common.WORD
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _searched(group: list[list[bytes]]) -> Iterator[tuple[list[dict], bytes]]:
    flat = np.array([w for words in group for w in words], object)
    numbers = pd.factorize(flat)[0].astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    cuts = np.cumsum([len(words) for words in group])[:-1]
    for words, found in zip(group, runs(np.split(numbers, cuts)), strict=True):
        if len(found):
            drop = repeated(len(words), found)
            words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
        yield [{"start": a, "length": n, "period": q} for a, n, q in found.tolist()], b" ".join(words)


def with_runs(df: DataFrame, text: str = "text", runs_name: str = "runs", collapsed_name: str = "collapsed") -> DataFrame:
    """df with two columns: runs, an array of (start, length, period) by start, then period, numbered in words from 0; and
    collapsed, the words that no run contains after its first period, joined by one space.

    A null or empty text has no runs and collapses to an empty one. All other columns pass; where df has a column of a
    new name already, the new one gets underscores before it. Equal rows fare alike; a table without rows gives none.
    """
    runs_name = free_name(df, runs_name)
    collapsed_name = free_name(df, collapsed_name)
    words = free_name(df, "searched_text")
    kind = "array<struct<start: bigint, length: bigint, period: bigint>>"

    def search(batches):
        made = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts = (v.as_py() for v in batch.column(batch.schema.get_field_index(words)))
            rows = [row for group in _groups(texts) for row in _searched(group)]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != words]
            new = [pa.array([r for r, _ in rows], made), pa.array([c for _, c in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([*kept, *new], [*(n for n in batch.schema.names if n != words), runs_name, collapsed_name])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"{runs_name} {kind}", f"{collapsed_name} binary"])
    found = df.withColumn(words, F.col(text).cast("binary")).mapInArrow(search, fields)
    return found.withColumn(collapsed_name, F.col(collapsed_name).cast("string"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by crc32 of its decimal id gets its tail replaced by repeats of its own words;
    a null id is not among them."""
    words = r"filter(split(text, '[ \\x09-\\x0D]+'), w -> w <> '')"
    planted = f"""element_at(transform(array({words}), w -> CASE WHEN size(w) = 0 THEN '' ELSE
        element_at(transform(array(named_struct('a', g % size(w), 'p', 1 + (size(w) - g % size(w)) DIV (3 + g % 8))), s ->
            array_join(transform(sequence(0L, size(w) - 1L), i -> w[CAST(CASE WHEN i < s.a THEN i ELSE s.a + (i - s.a) % s.p END AS INT)]), ' ')), 1) END), 1)"""
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn("g", F.expr("h DIV 10"))
    return hashed.select("doc_id", F.expr(f"CASE WHEN h % 10 = 0 AND text IS NOT NULL THEN {planted} ELSE text END").alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """A row for each document of with_planted_runs: its longest run (ties: smallest start, then period) and digests of
    all its runs and of its collapsed text."""
    found = with_runs(with_planted_runs(docs))
    best = F.expr("array_min(transform(runs, r -> named_struct('less', -r.length, 'start', r.start, 'period', r.period)))")
    return found.withColumn("best", best).selectExpr(
        "doc_id",
        "CAST(size(runs) AS BIGINT) AS n_runs",
        "best.start AS start",
        "-best.less AS length",
        "best.period AS period",
        "-1000 * best.less DIV best.period AS exponent_milli",
        "sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), ''), 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256",
    )
