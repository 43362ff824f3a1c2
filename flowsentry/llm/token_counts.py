"""Token counts by a two-tier lookup of pre-token lengths.

A tokenizer splits a text into pre-tokens and encodes each by itself, so a count is the sum of the pre-tokens' lengths.
Tier one is a compact table of frequent pre-tokens, counted over a bounded sample and broadcast; tier two is each
worker's cache, which encodes what the table lacks. Nothing is shuffled but the sample's counts, and the table changes
only the speed, never a count.

Edge cases: null text counts as empty (0 tokens); the tokenizer's special strings inside a text count as one token each,
as its default has it; lone repeated rows stay; long texts are split like others, never cut.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import text_or_empty

#: Documents whose pre-tokens are counted for the shared table, its entries, and the entries of a worker's cache.
SAMPLE_DOCUMENTS, TABLE_ENTRIES, CACHE_ENTRIES = 4_000, 50_000, 1_000_000
#: Fixed: the pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Lengths(dict):
    """Pre-token -> tokens; encodes what it lacks and remembers it up to a bound."""

    def __init__(self, table: dict[str, int], encode: Callable[[str], int], bound: int = CACHE_ENTRIES):
        super().__init__(table)
        self.encode, self.table, self.bound = encode, table, len(table) + bound

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.bound:
            self.clear()
            self.update(self.table)
        n = self[piece] = self.encode(piece)
        return n


def load(path: str):
    """(special strings, function from a pre-token to its length) of a tokenizers .json file."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return specials, lambda piece: len(tokenizer.encode(piece, add_special_tokens=False).ids)


def pre_tokens(text: str, split=regex.compile(PRE_TOKEN).findall) -> list[str]:
    return split(text)


def count_tokens(text: str, lengths: Lengths, special: regex.Pattern | None, split) -> int:
    if special is None or not special.search(text):
        return sum(map(lengths.__getitem__, split(text)))
    n = len(special.findall(text))
    return n + sum(sum(map(lengths.__getitem__, split(part))) for part in special.split(text) if part)


def frequent_lengths(docs: DataFrame, path: str, sample_documents: int = SAMPLE_DOCUMENTS, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """The most frequent pre-tokens of about sample_documents documents with their lengths, at most entries of them."""
    total = docs.count()
    sample = docs.sample(min(1.0, sample_documents / max(total, 1)), seed=7).select(text_or_empty().alias("text"))

    def tally(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(pre_tokens(text))
        yield pd.DataFrame(list(counts.items()), columns=["piece", "n"])

    top = sample.mapInPandas(tally, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(entries).collect()
    _, encode = load(path)
    return {r["piece"]: encode(r["piece"]) for r in top if len(r["piece"]) <= 64}


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def count(batches):
        specials, encode = load(path)
        special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        lengths, split = Lengths(table.value, encode), regex.compile(PRE_TOKEN).findall
        for batch in batches:
            n = [count_tokens(t, lengths, special, split) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": n, "over_limit": [x > limit for x in n]})

    rows = docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    return rows.mapInPandas(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
