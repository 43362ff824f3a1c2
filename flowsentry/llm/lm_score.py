"""Cross-entropy difference of documents between a target and a background n-gram model.

Both are interpolated bigram models over one vocabulary, one list of bigrams and one smoothing, so they differ only in
their counts: the target's come from the documents labelled good (and not held out), the background's from all
documents. A document's score is the mean over its words of the target loss minus the background loss; lower is closer
to the target.

The vocabulary is every word that all documents hold LEAST times or more, the bigrams are all pairs of words that follow
each other so often; other words are one class, and the mass of other bigrams goes to the unigram model, so each
conditional distribution sums to 1. What the models gather thus grows with the input, and nothing in it has a most.

A text's loss is a sum: each word adds its unigram loss, each context its loss of mass to bigrams, and each bigram of
the models a correction. Scoring finds the most frequent words and bigrams (FREQUENT_WORDS, FREQUENT_BIGRAMS) in
broadcast arrays of bounded size. The others leave each batch once for each document and meet their table in a shuffled
join; words and bigrams that surely have no row there are told by a broadcast bitmap of FILTER_BITS and stay at home.
Which rows are broadcast, and the bitmap's size, move work and change no score.

Words are told apart by 64-bit hashes, of which a sample's most common words (NAMED_WORDS) get short ones, so that most
rows of a shuffle are small; that changes no count. Edge cases: null or empty texts have 0 words and score 0; without target rows
both models are the background, and every score is 0; texts of any length are used whole; rows that repeat a doc_id, or
have none, count and are scored each by itself; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import checked_broadcast, discard, durable, text_or_empty
from flowsentry.llm.ngram_join import _FACTORS, BLOCK_BYTES, _mix, word_hashes

#: The least count of the models' words and bigrams.
LEAST = 3
#: The most words and bigrams that are broadcast (40 and 24 bytes each), and the bits of the bitmap of the others (16 MB).
FREQUENT_WORDS, FREQUENT_BIGRAMS, FILTER_BITS = 250_000, 500_000, 1 << 27
#: The share of documents whose most common words get short names, and how many do.
NAMING_SHARE, NAMED_WORDS = 1 / 16, 60_000
#: Words that are counted together in a task before they leave it: a bound on its memory.
RUN_WORDS = 1 << 18
#: Weight of the bigram model where all its mass is kept, and the added count of the unigram model.
BIGRAM_WEIGHT, ADDED = 0.8, 0.5
#: Names that no word has: before a row of a single word, before a text's first word, before a document's own row.
SINGLE, START, OWN = 0, 1, -1
#: Names below this are short ones.
SHORT = 1 << 16


def _blocks(texts: list[str]):
    """(first text, words' hashes, the text of each word, texts) for runs of texts of about BLOCK_BYTES."""
    block: list[bytes] = []
    held = first = 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        if block and held + len(data) > BLOCK_BYTES:
            yield first, *_block(block)
            block, held, first = [], 0, i
        block.append(data)
        held += len(data) + 1
    if block:
        yield first, *_block(block)


def _block(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    hashes, starts = word_hashes(np.frombuffer(b" ".join(block), np.uint8))
    words = hashes.view(np.int64)
    ends = np.cumsum([len(x) + 1 for x in block])
    return np.where((words >= OWN) & (words < SHORT), SHORT, words), np.searchsorted(ends, starts, side="right"), len(block)


def _named(words: np.ndarray, of: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct words' names, sorted, with START; of each word the place there of the word before it, and its own).

    short holds the sorted hashes of words whose names are START + 1, START + 2, ..."""
    found, at = np.unique(np.append(words, START), return_inverse=True)
    if len(short):
        place = np.minimum(np.searchsorted(short, found), len(short) - 1)
        found = np.where(short[place] == found, place + START + 1, found)
    order = np.argsort(found)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    at = rank[at]
    here, before = at[:-1], np.empty(len(words), np.int64)
    before[1:] = here[:-1]
    before[np.flatnonzero(np.diff(of, prepend=-1))] = at[-1]
    return found[order], before, here


def short_names(docs: DataFrame, share: float = NAMING_SHARE, most: int = NAMED_WORDS) -> np.ndarray:
    """The sorted hashes of the most common words of a sample of docs."""

    def count(batches):
        for batch in batches:
            found = [words for _, words, _, _ in _blocks(batch["text"].tolist())]
            w, n = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
            yield pd.DataFrame({"word": w, "n": n})

    rows = docs.sample(share, seed=1).select(text_or_empty().alias("text")).mapInPandas(count, "word long, n long")
    top = rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(min(most, SHORT - START - 1))
    return np.sort(top.select("word").toArrow()["word"].to_numpy())


def pair_codes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit code (uint64) of each bigram, or of each single word."""
    return _mix(before.view(np.uint64) * _FACTORS[7] + word.view(np.uint64) * _FACTORS[8])


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, target): whether a document trains the target model."""
    good = labels.filter((F.col("quality") == 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).select("doc_id", F.lit(1).alias("target")).distinct()
    return docs.select("doc_id", text_or_empty().alias("text")).join(checked_broadcast(good), "doc_id", "left").select("text", F.coalesce("target", F.lit(0)).alias("target"))


def counts_of(marked: DataFrame, least: int, short) -> DataFrame:
    """(before, word, n, t, c, ct): every word (before is SINGLE) and every bigram seen least times or more, with its count
    in all and in target documents; c and ct count a word as a context (START: the texts with words)."""

    def tables(found: np.ndarray, of: np.ndarray, weight: np.ndarray):
        every, before, here = _named(found, of, short.value)
        size = len(every)
        sums = lambda at, w=None, m=size: np.bincount(at, w, minlength=m).astype(np.int64)
        yield pd.DataFrame({"before": SINGLE, "word": every, "n": sums(here), "t": sums(here, weight), "c": sums(before), "ct": sums(before, weight)})
        code, at, n = np.unique(before * size + here, return_inverse=True, return_counts=True)
        yield pd.DataFrame({"before": every[code // size], "word": every[code % size], "n": n, "t": sums(at, weight, len(code)), "c": 0, "ct": 0})

    def count(batches):
        for batch in batches:
            run, held = [], 0
            targets = batch["target"].to_numpy()
            for first, found, texts, _ in _blocks(batch["text"].tolist()):
                run.append((found, first + texts, targets[first + texts]))
                held += len(found)
                if held >= RUN_WORDS:
                    yield from tables(*map(np.concatenate, zip(*run, strict=True)))
                    run, held = [], 0
            if run:
                yield from tables(*map(np.concatenate, zip(*run, strict=True)))

    rows = marked.mapInPandas(count, "before long, word long, n long, t long, c long, ct long")
    return rows.groupBy("before", "word").agg(*[F.sum(c).alias(c) for c in ("n", "t", "c", "ct")]).filter((F.col("before") == SINGLE) | (F.col("n") >= least))


def _frequent(rows: DataFrame, limit: int) -> Column:
    """Which rows are frequent: the highest quarter octaves of n that hold at most limit rows."""
    octave = F.floor(4 * F.log2(F.col("n").cast("double")))
    least, held = 1 << 30, 0
    for r in sorted(rows.groupBy(octave.alias("octave")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True):
        held += r["rows"]
        if held > limit:
            break
        least = r["octave"]
    return octave >= least


def _bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """The bits at the codes of rows (before, word), made in tasks; at most bits / 64 rows come to the driver."""

    def mark(batches):
        for batch in batches:
            code = pair_codes(batch["before"].to_numpy(np.int64), batch["word"].to_numpy(np.int64)) & np.uint64(bits - 1)
            slot, at = np.unique(code >> np.uint64(6), return_inverse=True)
            held = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(held, at, np.uint64(1) << (code & np.uint64(63)))
            yield pd.DataFrame({"slot": slot.view(np.int64), "bits": held.view(np.int64)})

    found = rows.select("before", "word").mapInPandas(mark, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(max(bits // 64, 1), np.uint64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


class Models:
    """What scoring looks up: the loss of an unknown word in each model (0 background, 1 target), the frequent words' and
    bigrams' changes to it, and the bitmap of the other ones that have any."""

    def __init__(self, short: np.ndarray, other: np.ndarray, words: pd.DataFrame, bigrams: pd.DataFrame, bits: np.ndarray):
        words = words.sort_values("word")
        codes = pair_codes(bigrams["before"].to_numpy(np.int64), bigrams["word"].to_numpy(np.int64))
        order = np.argsort(codes)
        self.short, self.other, self.bits = short, other, bits
        self.words, self.codes = words["word"].to_numpy(np.int64), codes[order]
        self.word_changes = words[["b", "t", "cb", "ct"]].to_numpy(float).T.copy()
        self.corrections = bigrams[["b", "t"]].to_numpy(float)[order].T.copy()

    @staticmethod
    def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the asked keys, 0 where absent; which are there)."""
        if not len(keys):
            return np.zeros((len(values), len(asked))), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        there = keys[at] == asked
        return np.where(there, values[:, at], 0.0), there

    def of_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._looked_up(self.words, self.word_changes, words)

    def of_bigrams(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._looked_up(self.codes, self.corrections, codes)

    def may_hold(self, codes: np.ndarray) -> np.ndarray:
        at = codes & np.uint64(64 * len(self.bits) - 1)
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def train(docs: DataFrame, labels: DataFrame, least: int = LEAST, words: int = FREQUENT_WORDS, bigrams: int = FREQUENT_BIGRAMS, bits: int = FILTER_BITS) -> tuple[Models, DataFrame]:
    """The models' frequent part, and (before, word, b, t, cb, ct) of the rest: what a word (before is SINGLE) or bigram
    changes in the background's and the target's loss, and a word as context."""
    short = short_names(docs)
    counts = durable(counts_of(_marked(docs, labels), least, docs.sparkSession.sparkContext.broadcast(short)))
    known = F.col("n") >= least
    single = counts.filter(F.col("before") == SINGLE)
    sums = single.agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum(F.when(known, F.col("n"))).alias("known_n"), F.sum(F.when(known, F.col("t"))).alias("known_t"), F.count_if(known).alias("words")).first()
    total = {"n": sums["n"] or 0, "t": sums["t"] or 0}
    rest = {"n": total["n"] - (sums["known_n"] or 0), "t": total["t"] - (sums["known_t"] or 0)}
    read = counts
    if not total["t"]:
        total["t"], rest["t"] = total["n"], rest["n"]
        read = counts.withColumns({"t": F.col("n"), "ct": F.col("c")})
    over = {x: max(total[x], 1) + ADDED * (sums["words"] + 1) for x in total}
    other = np.array([-np.log((rest[x] + ADDED) / over[x]) for x in ("n", "t")])

    pairs = read.filter(F.col("before") != SINGLE)
    mass = pairs.groupBy(F.col("before").alias("word")).agg(F.sum("n").alias("mn"), F.sum("t").alias("mt"))
    lost = lambda m, c: -F.log(1 - BIGRAM_WEIGHT * F.coalesce(F.col(m), F.lit(0)) / F.greatest(F.col(c), F.lit(1)))
    gain = lambda x, o: -F.log((F.col(x) + ADDED) / over[x]) - float(o)
    vocabulary = read.filter((F.col("before") == SINGLE) & (known | (F.col("word") == START))).join(mass, "word", "left")
    vocabulary = durable(vocabulary.select("before", "word", F.greatest("n", "c").alias("n"), F.greatest("c", F.lit(1)).alias("contexts"), F.greatest("ct", F.lit(1)).alias("target_contexts"), gain("n", other[0]).alias("b"), gain("t", other[1]).alias("t"), lost("mn", "c").alias("cb"), lost("mt", "ct").alias("ct")))

    context = vocabulary.select(F.col("word").alias("before"), "contexts", "target_contexts", "cb", "ct")
    follower = vocabulary.select("word", F.col("b").alias("wb"), F.col("t").alias("wt"))
    joined = pairs.select("before", "word", "n", F.col("t").alias("nt")).join(context, "before").join(follower, "word")

    def correction(count: str, contexts: str, lost_: str, gained: str, o: float) -> Column:
        without = F.col(lost_) + F.col(gained) + float(o)
        return -F.log(F.exp(-without) + BIGRAM_WEIGHT * F.col(count) / F.col(contexts)) - without

    zero = F.lit(0.0)
    corrected = durable(joined.select("before", "word", "n", correction("n", "contexts", "cb", "wb", other[0]).alias("b"), correction("nt", "target_contexts", "ct", "wt", other[1]).alias("t"), zero.alias("cb"), zero.alias("ct")))
    discard(counts)

    often_words, often_bigrams = _frequent(vocabulary, words), _frequent(corrected, bigrams)
    rare = vocabulary.filter(~often_words).select("before", "word", "b", "t", "cb", "ct").unionByName(corrected.filter(~often_bigrams).drop("n"))
    models = Models(short, other, vocabulary.filter(often_words).select("word", "b", "t", "cb", "ct").toArrow().to_pandas(), corrected.filter(often_bigrams).select("before", "word", "b", "t").toArrow().to_pandas(), _bitmap(rare, bits))
    return models, rare


def _scored(docs: DataFrame, models: Models) -> DataFrame:
    """Two kinds of rows: of each document (before is OWN: its words and losses), and of each of its words and bigrams that
    are in no broadcast array but may be in the models (before, word, times, times as context).

    row numbers the rows of docs: ids may repeat. It follows from the place in the files, so a task that runs again gives the same."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def rate(batches):
        m = shared.value
        for batch in batches:
            ids, numbers = batch["doc_id"], batch["row"].to_numpy(np.int64)
            for first, words, of, size in _blocks(batch["text"].tolist()):
                every, before, here = _named(words, of, m.short)
                changes, there = m.of_words(every)
                codes = pair_codes(every[before], every[here])
                fixed, known = m.of_bigrams(codes)
                losses = m.other[:, None] + changes[:2, here] + changes[2:, before] + fixed
                own = numbers[first : first + size]
                sums = [np.bincount(of, x, minlength=size) for x in losses]
                yield pd.DataFrame({"before": OWN, "word": own, "row": own, "doc_id": ids.iloc[first : first + size].to_numpy(), "n": np.bincount(of, minlength=size), "c": 0, "background": sums[0], "target": sums[1]})
                # Each text's distinct bigrams and words, numbered inside the block.
                left, total = ~known & m.may_hold(codes), len(every)
                pair, n = np.unique((of[left] * total + before[left]) * total + here[left], return_counts=True)
                text, pair = pair // (total * total), pair % (total * total)
                yield pd.DataFrame({"before": every[pair // total], "word": every[pair % total], "row": own[text], "doc_id": None, "n": n, "c": 0, "background": 0.0, "target": 0.0})
                asked = ~there & m.may_hold(pair_codes(np.full(total, SINGLE, np.int64), every))
                as_word, as_context = asked[here], asked[before]
                single, at = np.unique(np.concatenate([of[as_word] * total + here[as_word], of[as_context] * total + before[as_context]]), return_inverse=True)
                k, every_n = int(as_word.sum()), len(single)
                yield pd.DataFrame({"before": SINGLE, "word": every[single % total], "row": own[single // total], "doc_id": None, "n": np.bincount(at[:k], minlength=every_n), "c": np.bincount(at[k:], minlength=every_n), "background": 0.0, "target": 0.0})

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_or_empty().alias("text"))
    return rows.mapInPandas(rate, "before long, word long, row long, doc_id long, n int, c int, background double, target double")


def cross_entropy_difference(docs: DataFrame, models: Models, rare: DataFrame) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, ce_diff) of every document; losses are means over words."""
    own = F.col("before") == OWN
    met = _scored(docs, models).join(rare, ["before", "word"], "left").filter(own | F.col("b").isNotNull())
    loss = lambda base, change, context: F.when(own, F.col(base)).otherwise(F.col("n") * F.col(change) + F.col("c") * F.col(context))
    parts = met.select("row", "doc_id", F.when(own, F.col("n")).otherwise(0).alias("words"), loss("background", "b", "cb").alias("bl"), loss("target", "t", "ct").alias("tl"))
    sums = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("words").alias("n_words"), F.sum("bl").alias("bl"), F.sum("tl").alias("tl"))
    mean = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    return sums.select("doc_id", "n_words", mean("tl").alias("target_loss"), mean("bl").alias("background_loss"), (mean("tl") - mean("bl")).alias("ce_diff"))
