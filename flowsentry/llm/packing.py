"""Packing documents into sequences by shortest-pack-first over the length histogram.

Each document's token ids (and an end id) are cut at multiples of the sequence length; the pieces shorter than a
sequence go into a histogram by length. Lengths are placed longest first: each goes into the shortest pack, the one
with the most room, or opens a pack if it doesn't fit there; packing patterns carry counts, so a step places many pieces.
Pieces then meet their places by (length, rank within the length).

The histogram and the patterns are bounded by the sequence length, not by the documents. Ranks are exact but come from
(length, bucket) groups with offsets, so a length that most documents share is still spread over all tasks.

Edge cases: null and empty texts are one piece, the end id; very long texts give many full pieces; repeated rows are
packed each; the same input gives the same sequences; a table without rows gives none.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm.common import durable, text_or_empty

#: Fixed: the pre-token pattern of the byte-level BPE vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE_SCHEMA = "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long"
BUCKETS = 256


class Encoder:
    """Ids of a byte-level BPE .json file, by the faster of two libraries that share the vocabulary.

    The file's special strings become their single ids, as the tokenizers library has it by default.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))  # the vocabulary is a file on each machine, like the libraries
        decode = {c: b for b, c in _byte_letters().items()}
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(decode[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in specials}
        self.specials = specials
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.encoding = tiktoken.Encoding("bpe", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.special is None or not self.special.search(text):
            return np.asarray(self.encoding.encode_ordinary(text), dtype="<u4")
        parts = [[self.specials[x]] if x in self.specials else self.encoding.encode_ordinary(x) for x in self.special.split(text) if x]
        return np.asarray([i for p in parts for i in p], dtype="<u4")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: printable bytes stand for themselves, the others follow from code point 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def pieces(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, copies: bool = False) -> DataFrame:
    """(doc_id, copy, start, length, ids_crc32, doc_tokens): each document's ids and end_id, cut at multiples of size;
    with copies, copy tells apart the rows of a document that is repeated, else it is 0."""
    names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]

    def cut(batches):
        encoder = Encoder(path)
        for batch in batches:
            rows = []
            for doc_id, copy, text in zip(batch["doc_id"], batch["copy"], batch["text"], strict=True):
                ids = np.append(encoder.ids(text), np.uint32(end_id)).astype("<u4")
                rows.extend((doc_id, copy, s, min(size, len(ids) - s), zlib.crc32(ids[s : s + size].tobytes()), len(ids)) for s in range(0, len(ids), size))
            yield pd.DataFrame(rows, columns=names)

    copy = F.monotonically_increasing_id() if copies else F.lit(0).cast("long")
    return docs.select("doc_id", copy.alias("copy"), text_or_empty().alias("text")).mapInPandas(cut, PIECE_SCHEMA)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a sequence, number of such sequences)] for a histogram length -> pieces."""
    open_by_room: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []  # heap of the rooms that have patterns, negated: the shortest pack comes first
    done: dict[tuple[int, ...], int] = {}

    def put(pattern: tuple[int, ...], room: int, n: int) -> None:
        if room == 0:
            done[pattern] = done.get(pattern, 0) + n
            return
        if room not in open_by_room:
            open_by_room[room] = {}
            heapq.heappush(rooms, -room)
        open_by_room[room][pattern] = open_by_room[room].get(pattern, 0) + n

    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        while left:
            room = -rooms[0] if rooms else 0
            if room < length:
                most = size // length
                whole, part = divmod(left, most)
                if whole:
                    put((length,) * most, size - length * most, whole)
                if part:
                    put((length,) * part, size - length * part, 1)
                break
            pattern, n = open_by_room[room].popitem()
            if not open_by_room[room]:
                del open_by_room[room]
                heapq.heappop(rooms)
            used = min(n, left)
            if n > used:
                put(pattern, room, n - used)
            put((*pattern, length), room - length, used)
            left -= used
    for patterns in open_by_room.values():
        for pattern, n in patterns.items():
            done[pattern] = done.get(pattern, 0) + n
    return sorted(done.items(), reverse=True)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """[(length, first rank, last rank, first sequence, offset)]: which ranks of a length go where, one row for each slot of a pattern."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            first = taken.get(length, 0)
            out.append((length, first, first + n - 1, sequence, offset))
            taken[length] = first + n
            offset += length
        sequence += n
    return out


def ranked(cut: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds rank: 0, 1, 2, ... within each length. The offsets are at most size * buckets rows of 3 numbers: 6 MB."""
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "copy", "start", "ids_crc32"), F.lit(buckets)))
    counts = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "copy", "start", "ids_crc32")
    return keyed.withColumn("within", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("within")).drop("bucket", "within", "first")


def pack(cut: DataFrame, size: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces. Give it a durable frame: it is read twice."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most size rows
    table = places(shortest_pack_first(histogram, size))
    by_length: dict[int, list] = {}
    for length, first, last, sequence, offset in table:
        by_length.setdefault(length, []).append((first, sequence, offset))
    shared = spark.sparkContext.broadcast({k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in by_length.items()})
    rows = ranked(cut)
    schema = "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                firsts, sequences, offsets = shared.value[int(length)]
                slot = np.searchsorted(firsts, ranks[at], side="right") - 1
                sequence[at], offset[at] = sequences[slot] + ranks[at] - firsts[slot], offsets[slot]
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    order = ["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens", "rank"]
    return rows.select(*order).mapInPandas(place, schema)


def packed_documents(docs: DataFrame, path: str, size: int = 1024, copies: bool = False) -> DataFrame:
    """The pieces of all documents with their places."""
    return pack(durable(pieces(docs, path, size, copies=copies)), size)
