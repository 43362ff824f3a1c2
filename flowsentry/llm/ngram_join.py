"""Near-duplicate documents by an exact Jaccard join on word shingles.

A document's set holds its distinct 4-word shingles (64-bit hashes); two documents link when
100 * |x & y| >= 85 * |x | y|. Documents with the same set are one node, so copies are never paired. The join:

* a global order puts rare shingles first: frequent ones come from counts over all documents, ties by hash;
* prefix filter: sets that link share a shingle among the first n - ceil(0.85 n) + 1 of each;
* length filter (sizes within 0.85), positional filter (what is left after the shared shingle can still reach the
  required overlap), suffix filter (as many elements differ as the parities of SIGNATURE_BITS hash classes of the two
  sets do), all three inside the joins on prefix shingles;
* pairs are made distinct; each meets the suffix filter once more, with parities of twice as many hash classes as the
  sets have elements, and is verified once, on whole sets: one set of a pair goes to the set that is in more pairs.

Only the components are asked for, so pairs inside one component need no second proof. A first round pairs, in each
prefix bucket and size band, every set with the bucket's most central one: the set in which fewest rarer shingles come
before the shared one. DRAW_ROUNDS others pair, in buckets whose sets are not all in one component yet, every set with
the most central set of each of DRAWS hash classes. Either makes a bounded multiple of the postings. A last round
pairs, in buckets still mixed, all sets of different components (all but those of the bucket's most common component
against all). Every link is thus verified or joins two sets already connected, and a group of thousands of near copies
costs pairs in proportion to its size.

A set is named by a 64-bit digest. Names that two sets share show in a second digest; those sets then go by the second
one. Rounds are durable tables; each is deleted when the next one stands.

Edge cases: null and empty texts, and texts without words, have an empty set and link with nothing; with fewer words
than a shingle the whole sequence is the only shingle; repeated rows share a set, whatever their ids; a null doc_id is
a document like others and the component's id only if no other id is in it; texts of any length are used whole; a
table without rows gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.common import discard, durable, free_name, text_or_empty
from flowsentry.llm.components import components

#: Words in a shingle and the similarity in percent.
WORDS, PERCENT = 4, 85
#: Bytes of text that are hashed together, and the most entries of the table of frequent shingles.
BLOCK_BYTES, FREQUENT_ENTRIES = 1 << 18, 500_000
#: Documents whose texts and sets a task has as Python objects at once; shingles whose counts it takes together, the
#: ranges of hashes by which they are sorted, and rows of counts it makes at once.
PIECE_ROWS, HELD_SHINGLES, COUNT_RANGES, COUNT_ROWS = 1_000, 1 << 23, 16, 50_000
#: Ids that are broadcast to pick documents for verification; more are shuffled.
BROADCAST_IDS = 200_000
#: Hash classes of which a mixed bucket draws one set each, and rounds of draws.
DRAWS, DRAW_ROUNDS = 6, 1
#: Hash classes whose parities make a set's signature, as longs of 64.
SIGNATURE_BITS = 256
SIGNATURE = [f"s{i}" for i in range(SIGNATURE_BITS // 64)]
#: A shingle counts as locally frequent when so many documents of one batch (or of HELD_SHINGLES of it) hold it.
LOCAL_COUNT = 2

_RNG = np.random.Generator(np.random.PCG64(20240607))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
# A letter's value; A-Z have those of a-z, separators 0.
_LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]
_LETTER[_SPACE] = 0
_FACTORS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = int(_FACTORS[0])
_tables: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """At least n powers of the base, and of its inverse modulo 2^64; tables of a usual block's size are kept."""
    if _tables and len(_tables[0]) >= n:
        return _tables
    size = max(n, 2 * BLOCK_BYTES)
    found = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        out = np.full(size, base, np.uint64)
        out[0] = 1
        found.append(np.cumprod(out, dtype=np.uint64))
    if size == 2 * BLOCK_BYTES:
        _tables[:] = found
    return found


def word_hashes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of UTF-8 bytes, A-Z lower-cased: a polynomial in the word's bytes, mixed."""
    space = _SPACE[block]
    starts = np.flatnonzero(np.concatenate(([True], space[:-1])) & ~space)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    up, down = _powers(len(block))
    return _mix(np.add.reduceat(_LETTER[block] * up[: len(block)], starts) * down[starts]), starts


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each text."""
    out: list[np.ndarray] = []
    block: list[bytes] = []
    held = 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        if block and held + len(data) > BLOCK_BYTES:
            out += _block_sets(block, words)
            block, held = [], 0
        block.append(data)
        held += len(data) + 1
    return out + _block_sets(block, words) if block else out


def _block_sets(block: list[bytes], words: int) -> list[np.ndarray]:
    joined = np.frombuffer(b" ".join(block), np.uint8)
    lengths = np.array([len(x) + 1 for x in block])
    firsts = np.cumsum(lengths) - lengths
    hashes, starts = word_hashes(joined)
    bounds = np.searchsorted(starts, np.append(firsts, len(joined) + 1))
    n = len(hashes) - words + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(words if n > 0 else 0):
        rolled += hashes[k : k + n] * _FACTORS[k]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            found = np.unique(rolled[a : b - words + 1].view(np.int64))
        elif b > a:
            whole = (hashes[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64, keepdims=True)
            found = _mix(whole + np.full(1, b - a, np.uint64) * _FACTORS[-1]).view(np.int64)
        else:
            found = np.empty(0, np.int64)
        out.append(found)
    return out


def digests(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a whole set."""
    h = _mix(found.view(np.uint64))
    total, other = h.sum(dtype=np.uint64, keepdims=True), np.bitwise_xor.reduce(h, initial=np.uint64(0), keepdims=True)
    both = total * _FACTORS[1:3] + other * _FACTORS[3:5] + np.full(1, len(found), np.uint64) * _FACTORS[5:7]
    first, second = _mix(both).view(np.int64).tolist()
    return first, second


class Names:
    """The name of a set: its first digest (its lowest bits, in tests), or its second where the first one is shared."""

    def __init__(self, shared: frozenset[int] = frozenset(), bits: int = 64):
        self.shared, self.mask = shared, (1 << bits) - 1

    def first(self, found: np.ndarray) -> tuple[int, int]:
        first, second = digests(found)
        return (first if self.mask == (1 << 64) - 1 else first & self.mask), second

    def __call__(self, found: np.ndarray) -> int:
        first, second = self.first(found)
        return second if first in self.shared else first


def signature(found: np.ndarray) -> np.ndarray:
    """The parities of the set's SIGNATURE_BITS hash classes, as int64."""
    odd = np.bincount((found.view(np.uint64) >> np.uint64(32)).astype(np.int64) % SIGNATURE_BITS, minlength=SIGNATURE_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_signature(found: np.ndarray) -> bytes:
    """The parities of at least twice as many hash classes as the set has elements (a power of two), as bytes."""
    classes = max(SIGNATURE_BITS, 1 << (2 * len(found) - 1).bit_length()) if len(found) else SIGNATURE_BITS
    odd = np.bincount(found & (classes - 1), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def parities_that_differ(a: bytes, b: bytes) -> int:
    """Of two wide signatures; the wider one is folded to the other's classes. At least as many elements differ."""
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(s.reshape(-1, n), axis=0) for s in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


@F.pandas_udf(T.LongType())
def _wide_difference(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([parities_that_differ(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n with any set that links."""
    return -(-percent * n // 100)


def rare_first(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set in the global order: by count (0 unless frequent), then hash."""
    if not len(frequent):
        return found
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    return found[np.lexsort((found, np.where(frequent[at] == found, counts[at], 0)))]


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PIECE_ROWS rows of the batches at a time, without copies."""
    for batch in batches:
        for i in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(i, PIECE_ROWS)


def often_held(sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shingles, counts) of what LOCAL_COUNT or more of the sorted sets hold, a range of hashes at a time: beside the
    sets there is a copy of one range."""
    width, more = (1 << 64) // COUNT_RANGES, LOCAL_COUNT - 1
    cuts = np.array([k * width - (1 << 63) for k in range(1, COUNT_RANGES)], np.int64)
    bounds = [[0, *np.searchsorted(s, cuts).tolist(), len(s)] for s in sets]
    for k in range(COUNT_RANGES if sets else 0):
        found = np.concatenate([s[b[k] : b[k + 1]] for s, b in zip(sets, bounds, strict=True)])
        found.sort()
        found = found[more:][found[more:] == found[: max(len(found) - more, 0)]]
        firsts = np.flatnonzero(np.concatenate((np.ones(min(len(found), 1), bool), found[1:] != found[:-1])))
        yield found[firsts], np.diff(np.append(firsts, len(found))) + more


SUMMARY = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_hash", "n", "key", "second", "h", "count")] + [("wide", pa.binary())] + [(c, pa.int64()) for c in SIGNATURE])


def summary_rows(batches: Iterable[pa.RecordBatch], words: int, names: Names) -> Iterator[pa.RecordBatch]:
    """The rows of _summaries from (doc_id, text_hash, text): a worker has a piece's texts and a batch's sets at once
    (those of HELD_SHINGLES at most, or of one piece)."""

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for all_h, all_c in often_held(held):
            for i in range(0, len(all_h), COUNT_ROWS):
                h, c = all_h[i : i + COUNT_ROWS], all_c[i : i + COUNT_ROWS]
                none = pa.array(np.zeros(len(h), np.int64))
                columns = dict.fromkeys(SUMMARY.names, none) | {"n": np.full(len(h), -1), "h": h, "count": c, "wide": pa.nulls(len(h), pa.binary())}
                yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in SUMMARY], schema=SUMMARY)

    for batch in batches:
        held: list[np.ndarray] = []
        for part in pieces([batch]):
            sets = shingle_sets(part.column("text").to_pylist(), words)
            signed = np.array([signature(s) for s in sets], np.int64).reshape(-1, len(SIGNATURE))
            keys = np.array([names.first(s) for s in sets], np.int64).reshape(-1, 2)
            columns = {"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "n": [len(s) for s in sets], "key": keys[:, 0], "second": keys[:, 1], "wide": [wide_signature(s) for s in sets]} | {c: signed[:, i] for i, c in enumerate(SIGNATURE)}
            none = np.zeros(len(sets), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(columns.get(x.name, none), x.type) for x in SUMMARY], schema=SUMMARY)
            if held and sum(map(len, held)) + sum(map(len, sets)) > HELD_SHINGLES:
                yield from counted(held)
                held = []
            held += sets
        yield from counted(held)


def _summaries(docs: DataFrame, words: int, names: Names) -> DataFrame:
    """Two kinds of rows: of each document (doc_id, text_hash, n, key, second, signatures), and of each batch's frequent shingles (h, count)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    return rows.mapInArrow(lambda batches: summary_rows(batches, words, names), "doc_id long, text_hash long, n long, key long, second long, h long, count long, wide binary, " + ", ".join(f"{c} long" for c in SIGNATURE))


def _frequent(summaries: DataFrame, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents hold, by hash: at most entries of them, as their counts add up to at most the total."""
    total = summaries.filter("n < 0").agg(F.sum("count").alias("t")).first()["t"] or 0
    least = max(16, -(-total // entries))
    rows = summaries.filter("n < 0").groupBy("h").agg(F.sum("count").alias("count")).filter(F.col("count") >= least).toPandas()
    rows = rows.sort_values("h")
    return rows["h"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)


def _postings(docs: DataFrame, words: int, percent: int, shared, names: Names) -> DataFrame:
    """(h, pos, key, n) for the prefix of every set; copies in one task give one set's rows."""

    def scan(batches):
        frequent, counts = shared.value
        seen: set[int] = set()
        for part in pieces(batches):
            hs, pos, keys, sizes = [], [], [], []
            for found in shingle_sets(part.column("text").to_pylist(), words):
                n = len(found)
                key = names(found) if n else 0
                if n and key not in seen:
                    seen.add(key)
                    p = n - needed(n, percent) + 1
                    hs.append(rare_first(found, frequent, counts)[:p])
                    pos.append(np.arange(p, dtype=np.int32))
                    keys.append(np.full(p, key, np.int64))
                    sizes.append(np.full(p, n, np.int32))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, pos, keys, sizes)], names=["h", "pos", "key", "n"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(scan, "h long, pos int, key long, n int")


def _picked(frame: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of frame (with doc_id and text_hash) that wanted names, with wanted's other columns."""
    side = wanted.withColumnsRenamed({"doc_id": "wanted_id", "text_hash": "wanted_hash"})
    side = F.broadcast(side) if side.count() <= BROADCAST_IDS else side
    return frame.join(side, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash"))).drop("wanted_id", "wanted_hash")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(key, hubs, shingles) of the wanted documents (doc_id, text_hash, key, hubs)."""

    def scan(batches):
        for part in pieces(batches):
            sets = pa.array(shingle_sets(part.column("text").to_pylist(), words), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("hubs"), sets], names=["key", "hubs", "shingles"])

    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    return _picked(rows, wanted).select("key", "hubs", "text").mapInArrow(scan, "key long, hubs array<long>, shingles array<long>")


def _reaches(overlap: Column, na: Column, nb: Column, percent: int) -> Column:
    """100 * overlap >= percent * union, for this (bound of the) overlap."""
    return (100 + percent) * overlap >= percent * (na + nb)


def _may_link(a: str, b: str, percent: int) -> Column:
    """The length filter; the positional filter at a shared prefix shingle (before it the pair may share nothing, if it
    is the first); the suffix filter on signatures (elements that differ leave at most half of what remains)."""
    na, nb = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    rest = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    differ = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SIGNATURE), F.lit(0)).cast("long")
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & _reaches(rest, na, nb, percent) & ((100 + percent) * (na + nb - differ) >= 2 * percent * (na + nb))


def _pairs(joined: DataFrame, tested: DataFrame | None = None) -> DataFrame:
    """The distinct pairs (a, b, na, nb) of a join of postings x and y that were not tested before."""
    swap = F.col("x.key") > F.col("y.key")
    pick = lambda c: (F.when(swap, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")), F.when(swap, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")))
    (a, b), (na, nb) = pick("key"), pick("n")
    pairs = joined.select(a.alias("a"), b.alias("b"), na.cast("long").alias("na"), nb.cast("long").alias("nb")).distinct()
    return durable(pairs if tested is None else pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"))


class Corpus:
    """What the rounds of the join read: the documents, a row for each of their sets, and how sets are made."""

    def __init__(self, docs: DataFrame, summaries: DataFrame, nodes: DataFrame, repeated: bool, words: int, percent: int):
        self.docs, self.summaries, self.nodes, self.repeated, self.words, self.percent = docs, summaries, nodes, repeated, words, percent

    def once(self, frame: DataFrame) -> DataFrame:
        """One row for each key; only repeated rows of documents give several."""
        return frame.dropDuplicates(["key"]) if self.repeated else frame

    def ids(self, keyed: DataFrame) -> DataFrame:
        """keyed, with the document that stands for its key."""
        return self.nodes.select("key", "doc_id", "text_hash").join(keyed, "key")


def _verified(pairs: DataFrame, corpus: Corpus) -> DataFrame:
    """Those of the distinct pairs (a, b, na, nb) of set names that link: by wide signatures, then by their whole sets."""
    if pairs.isEmpty():
        return durable(pairs.select("a", "b"))
    percent, ends = corpus.percent, lambda frame: frame.select(F.col("a").alias("key")).union(frame.select("b"))
    wanted = durable(corpus.ids(ends(pairs).distinct()))
    wide = durable(corpus.once(_picked(corpus.summaries.filter("n > 0").select("doc_id", "text_hash", "wide"), wanted).select("key", "wide")))
    of = lambda x: wide.select(F.col("key").alias(x), F.col("wide").alias(f"wide_{x}"))
    size = F.col("na") + F.col("nb")
    near = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("differ", _wide_difference("wide_a", "wide_b"))
    left = durable(near.filter((100 + percent) * (size - F.col("differ")) >= 2 * percent * size).select("a", "b", "na", "nb"))
    discard(wanted, wide)
    if left.isEmpty():
        return durable(left.select("a", "b"))
    # The set that is in fewer pairs goes to the other one, its hub.
    often = ends(left).groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    met = left.join(often.select(F.col("key").alias("a"), F.col("m").alias("ma")), "a").join(often.select(F.col("key").alias("b"), F.col("m").alias("mb")), "b")
    swap = F.col("ma") > F.col("mb")
    aimed = durable(met.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("key"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("hub"), size.alias("size")))
    wanted = durable(corpus.ids(aimed.select("key", "hub").union(aimed.select("hub", "hub").distinct()).groupBy("key").agg(F.collect_list("hub").alias("hubs"))))
    sets = durable(corpus.once(_sets(corpus.docs, wanted, corpus.words)))
    sent = sets.select("key", F.explode("hubs").alias("hub"), "shingles")
    hubs = sets.filter(F.array_contains("hubs", F.col("key"))).select(F.col("key").alias("hub"), F.col("shingles").alias("of_hub"))
    overlap = F.size(F.array_intersect("shingles", "of_hub")).cast("long")
    shared = sent.filter("key <> hub").join(hubs, "hub").select("key", "hub", overlap.alias("overlap"))
    links = durable(shared.join(aimed, ["key", "hub"]).filter((100 + percent) * F.col("overlap") >= percent * F.col("size")).select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")))
    discard(left, aimed, wanted, sets)
    return links


def _still_mixed(kept: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings, with their component as label, of the buckets that hold several components; top is the bucket's most common one."""
    named = kept.drop("label", "top").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("root", "key")).drop("root")
    mixed = named.groupBy("h", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("m", "label")).alias("top")).filter("labels > 1").select("h", F.col("top.label").alias("top"))
    return durable(named.join(mixed, "h"))


def _joined(x: DataFrame, y: DataFrame, on: list[str], more: Column, percent: int) -> DataFrame:
    equal = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on]
    for e in equal[1:]:
        equal[0] = equal[0] & e
    return x.alias("x").join(y.alias("y"), equal[0] & more & _may_link("x", "y", percent))


def _links(kept: DataFrame, corpus: Corpus) -> DataFrame:
    """Enough verified links (a, b) of set names for the components of all links, from the postings of shared prefix shingles."""
    carried, percent = ["n", "key", *SIGNATURE], corpus.percent
    spread = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    banded = kept.withColumn("band", spread)
    leaders = banded.groupBy("h", "band").agg(F.min(F.struct("pos", *carried)).alias("lead"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("h", "band", "lead.*")
    tested = _pairs(_joined(banded, leaders, ["h", "band"], F.col("x.key") != F.col("y.key"), percent))
    links = _verified(tested, corpus)
    labels = components(links)
    mixed = _still_mixed(kept, labels)
    discard(kept, labels)
    for r in range(DRAW_ROUNDS):
        dealt = F.pmod(F.xxhash64("key", F.lit(r)), F.lit(DRAWS))
        drawn = mixed.groupBy("h", dealt.alias("draw")).agg(F.min(F.struct("pos", *carried, "label")).alias("lead")).select("h", "lead.*")
        more = _pairs(_joined(mixed, drawn, ["h"], F.col("x.label") != F.col("y.label"), percent), tested)
        found = _verified(more, corpus)
        before = (links, tested, more, found, mixed)
        links, tested = durable(links.unionByName(found)), durable(tested.select("a", "b").unionByName(more.select("a", "b")))
        labels = components(links)
        mixed = _still_mixed(mixed, labels)
        discard(*before, labels)
    across = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.top")) | (F.col("x.key") < F.col("y.key")))
    last = _pairs(_joined(mixed.filter("label <> top"), mixed, ["h"], across, percent), tested)
    found = _verified(last, corpus)
    out = durable(links.unionByName(found))
    discard(links, tested, mixed, last, found)
    return out


def near_duplicate_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, frequent_entries: int = FREQUENT_ENTRIES, name_bits: int = 64) -> DataFrame:
    """(doc_id, text_hash, n, root) of every row of docs: n is the size of its set, root names its component (null if the set is empty)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    summaries = durable(_summaries(docs, words, Names(bits=name_bits)))
    rows = summaries.filter("n >= 0").select("doc_id", "text_hash", "n", "key", "second", *SIGNATURE)
    doubled = rows.filter("n > 0").groupBy("key").agg(F.min("second").alias("a"), F.max("second").alias("b")).filter("a <> b").select("key")
    names = Names(frozenset(r["key"] for r in doubled.collect()), name_bits)  # about 0 rows, as digests have 64 bits
    rows = rows.withColumn("key", F.when(F.col("key").isin(*names.shared), F.col("second")).otherwise(F.col("key"))) if names.shared else rows
    firsts = [F.min(c).alias(c) for c in SIGNATURE]
    nodes = durable(rows.filter("n > 0").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), *firsts).select("key", "first.doc_id", "first.text_hash", *SIGNATURE))
    shared = spark.sparkContext.broadcast(_frequent(summaries, frequent_entries))

    postings = durable(_postings(docs, words, percent, shared, names))
    buckets = postings.groupBy("h").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least <> most").select("h")
    signed = postings.join(buckets, "h").join(nodes.select("key", *SIGNATURE), "key")
    kept = durable(signed.groupBy("key", "h").agg(F.min("pos").alias("pos"), F.min("n").alias("n"), *firsts))
    discard(postings)

    repeated = not rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").isEmpty()
    links = _links(kept, Corpus(docs, summaries, nodes, repeated, words, percent))
    labels = components(links)
    out = durable(rows.select("doc_id", "text_hash", "n", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.coalesce("root", "key")).alias("root")))
    discard(summaries, nodes, links, labels)
    return out


def near_duplicate_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id is the smallest doc_id of its component."""
    rows = near_duplicate_rows(docs, words, percent)
    smallest = rows.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(smallest, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component of near duplicates: that of the smallest doc_id (then of the least text hash;
    of equal rows, one). Rows go by id and text, so one id may stand for several texts; rows without words all stay."""
    rows = near_duplicate_rows(docs, words, percent).filter("n > 0").withColumn("row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    firsts = rows.groupBy("root").agg(F.min("row").alias("first"))
    marked = durable(rows.join(firsts, "root").groupBy("doc_id", "text_hash").agg((F.min("row") == F.min("first")).alias("stays"), F.count(F.lit(1)).alias("times")))
    hashed = free_name(docs, "ngram_text_hash")
    named = docs.withColumn(hashed, F.xxhash64(text_or_empty()))
    drop = lambda frame, less, how: frame.alias("d").join(less.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col(f"d.{hashed}") == F.col("m.text_hash")), how)
    kept = drop(named, marked.filter(~F.col("stays")), "left_anti")
    repeated = marked.filter("stays and times > 1")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = drop(kept, repeated, "left_semi").dropDuplicates(["doc_id", hashed])
    return drop(kept, repeated, "left_anti").unionByName(once).select(*docs.columns)
