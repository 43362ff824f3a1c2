"""Toxicity by a weighted grammar of finite-state patterns over clauses.

A lexical transducer turns each word of a clause into a class: insult (I), threat (H), target (T), negation (N) or
reported speech (R). Insults come with weights learned from labelled documents, as whole words or as stems; the closed
classes are fixed lists. Three transducers read the classes from left to right and mark insults and threats: negation
(a negation at most NEGATION_REACH words before), reported speech (one anywhere before in the clause) and target (one at
most TARGET_REACH words before); they are composed into one machine. A fourth reads its output from right to left and
marks what has its target after it. Each mark is an arc with a weight in the log semiring, so a match weighs its
insult's weight times the arcs' factors: targets raise it, negation and reported speech lower it. A threat without a
target is no match. A document's score is a logistic function of the logarithm of 1 + the sum of its matches' weights,
so a word counts only through the clause that it stands in.

What is learned: lexicon, arc weights and the logistic function, from a bounded sample of labelled rows
(``SAMPLE_ROWS``, those with the least hash of doc_id). An insult is a unit whose log ratio of rates among the words of
toxic and of other documents is at least LEAST_RATIO even CAUTION standard errors lower, so a language with few labels
needs no other limits than one with many; its weight is what the ratio has above FREE_RATIO. The sample is dealt into folds; the lexicon of the other folds rates each fold, arcs
and function are fitted on all, and the final lexicon takes the whole sample. Arc weights start from fixed beliefs
(``ARCS``) within signed bounds, and move as far as the sample shows it. Nothing else is an input: no labels,
languages, sources or ids.

Texts are scanned with one Aho-Corasick automaton over the insult and threat lexicons; only clauses with a hit are
split into words, each clause once and whole. Edge cases: null and empty texts score like texts without matches; a
table without labelled toxic rows gives every document the base rate; repeated labels of a document count once, toxic
if any says so; repeated rows get equal scores; any length is scanned whole; a column named score stays as it is in
``without_toxic``; a table without rows gives none.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import durable, free_name, text_or_empty

#: Labelled rows that are learned from, lexicon entries, stem lengths, and the score from which a document is rejected.
SAMPLE_ROWS, LEXICON_ENTRIES, STEMS, REJECT = 20_000, 20_000, (4, 5, 6, 7), 0.7
#: Folds of the sample; least toxic documents of an entry, standard errors taken off its log ratio, what must be left, and what weighs nothing.
FOLDS, LEAST_TOXIC, CAUTION, LEAST_RATIO, FREE_RATIO = 5, 4, 3.0, 2.5, 2.0
#: How far the two labels are balanced in the fit: 0 as they come, 1 both weigh the same.
BALANCE = 0.6

# Closed word classes of four languages.
TARGETS = frozenset("you your yours yourself u ur he she they him her them his their du dich dir dein deine ihr euch sie er ihn ihm tu te toi ton ta tes vous votre vos il elle ils elles lui leur usted ustedes tú tu ti te él ella ellos ellas vosotros le les".split())
NEGATIONS = frozenset("not no never nor neither without isn't aren't wasn't don't doesn't nicht kein keine keinen keiner nie niemals ohne ne pas jamais aucun aucune sans nunca jamás ningún ninguna sin tampoco".split())
REPORTS = frozenset("said says say called calls reported according quoted quote wrote writes claimed claims sagte sagt sagten nannte nennt schrieb laut dit disait disent appelle appelait selon écrit dijo dice dicen llamó llama según escribió".split())
THREATS = frozenset("kill hurt destroy murder stab shoot burn beat töten umbringen verletzen vernichten schlagen tuer tuerai détruire frapper matar mataré destruir golpear quemar".split())
NEGATION_REACH, TARGET_REACH = 3, 4
#: Log weights of the arcs: what is believed before the sample, and the bounds within which it may move them.
ARCS = {"targeted": (0.4, 0.0, 1.5), "negated": (-1.5, -4.0, -0.3), "reported": (-1.0, -4.0, -0.3), "threat": (0.0, -1.0, 1.5)}
#: Weight of a threat before arcs; spread of the beliefs.
THREAT_WEIGHT, SPREAD = 4.0, 0.5

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")
#: Symbols: a class, with marks added by transducers.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
TARGETED, NEGATED, REPORTED = 8, 16, 32
SYMBOLS = 64


class Transducer:
    """A deterministic transducer: arcs[state][symbol] is (next state, output symbol)."""

    def __init__(self, arcs: list[list[tuple[int, int]]]):
        self.arcs = arcs

    def __call__(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for x in symbols:
            state, y = self.arcs[state][x]
            out.append(y)
        return out


def marking(trigger: int, mark: int, reach: int | None) -> Transducer:
    """Marks insults and threats that have the trigger among the reach symbols before them (None: anywhere before)."""
    last = 1 if reach is None else reach
    arcs = []
    for state in range(last + 1):  # symbols within which the trigger is still near; 0: it is not
        row = []
        for x in range(SYMBOLS):
            after = last if x & 7 == trigger else state if reach is None else max(state - 1, 0)
            row.append((after, x | mark if state and x & 7 in (INSULT, THREAT) else x))
        arcs.append(row)
    return Transducer(arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that gives second's output on first's output."""
    names, queue, arcs = {(0, 0): 0}, [(0, 0)], []
    for a, b in queue:
        row = []
        for x in range(SYMBOLS):
            na, y = first.arcs[a][x]
            nb, z = second.arcs[b][y]
            if (na, nb) not in names:
                names[na, nb] = len(names)
                queue.append((na, nb))
            row.append((names[na, nb], z))
        arcs.append(row)
    return Transducer(arcs)


FORWARD = compose(compose(marking(NEGATION, NEGATED, NEGATION_REACH), marking(REPORT, REPORTED, None)), marking(TARGET, TARGETED, TARGET_REACH))
BACKWARD = marking(TARGET, TARGETED, TARGET_REACH)


@dataclass(frozen=True)
class Lexicon:
    """Weights of insults: whole words, and stems that start a word."""

    words: dict[str, float]
    stems: dict[str, float]

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                best = max(best, self.stems.get(word[:n], 0.0))
        return best


@dataclass(frozen=True)
class Model:
    """Lexicon, log weights of the arcs by name, and the logistic function's two numbers."""

    lexicon: Lexicon
    arcs: dict[str, float]
    bias: float
    slope: float

    def scores(self, kinds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * strength(kinds, self.arcs), -30, 30)))


def marked(symbol: int) -> list[str]:
    """The arcs that a match has gone through."""
    return [name for name, mark in (("targeted", TARGETED), ("negated", NEGATED), ("reported", REPORTED)) if symbol & mark] + (["threat"] if symbol & 7 == THREAT else [])


#: The kinds of matches, in the order of the features: what the grammar can put out.
KINDS = [base | marks for base in (INSULT, THREAT) for marks in range(0, SYMBOLS, 8) if base == INSULT or marks & TARGETED]


def strength(kinds: np.ndarray, arcs: dict[str, float]) -> np.ndarray:
    """log(1 + the matches' weights), for rows of sums by kind."""
    return np.log1p(kinds @ np.exp([sum(arcs[a] for a in marked(k)) for k in KINDS]))


def units(words: Counter) -> Counter:
    """Occurrences of each word, and of its stems (marked with *)."""
    out = Counter(words)
    for word, n in words.items():
        for k in STEMS:
            if len(word) > k:
                out[word[:k] + "*"] += n
    return out


def clause_symbols(clause: str, lexicon: Lexicon) -> tuple[list[int], list[float]]:
    """The lexical transducer's output: a class and a weight for each word."""
    symbols, weights = [], []
    for word in _WORD.findall(clause):
        w = lexicon.weight(word)
        symbols.append(INSULT if w > 0 else THREAT if word in THREATS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else TARGET if word in TARGETS else OTHER)
        weights.append(w if w > 0 else THREAT_WEIGHT)
    return symbols, weights


def clause_matches(symbols: list[int], weights: list[float]) -> list[tuple[int, float]]:
    """(kind, weight) of each match of a clause."""
    out = BACKWARD(FORWARD(symbols)[::-1])[::-1]
    return [(x, w) for x, w in zip(out, weights, strict=True) if x & 7 == INSULT or (x & 7 == THREAT and x & TARGETED)]


class Scanner:
    """Sums of texts' match weights by kind, under one lexicon."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.at = lexicon, {k: i for i, k in enumerate(KINDS)}
        self.automaton = ahocorasick.Automaton()
        for unit in (*lexicon.words, *lexicon.stems, *THREATS):
            self.automaton.add_word(unit, len(unit))
        self.automaton.make_automaton()

    def features(self, text: str) -> np.ndarray:
        low, out, done = text.lower(), np.zeros(len(KINDS)), 0
        for end, n in self.automaton.iter(low):
            start = end - n + 1
            if start < done or (start and low[start - 1].isalpha()):
                continue
            begin = max(low.rfind(c, done, start) + 1 or done for c in ".!?;:\n")
            stop = _CLAUSE_END.search(low, end + 1)
            done = stop.start() if stop else len(low)
            for kind, weight in clause_matches(*clause_symbols(low[begin:done], self.lexicon)):
                out[self.at[kind]] += weight
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic, fold): at most rows labelled documents whose crc32(doc_id as text) mod 3 is not 1, by least hash."""
    known = labels.filter(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = durable(known.withColumn("order", F.xxhash64(F.lit("sample"), "doc_id")).orderBy("order", "doc_id").limit(rows))
    return durable(docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), F.pmod("order", F.lit(FOLDS)).cast("int").alias("fold")))


def _unit_counts(sample: DataFrame, toxic: int, wanted: set[str] | None) -> DataFrame:
    """(unit, n0, docs0, n1, ...): for each fold, the occurrences of a unit (one of wanted) in documents with this label, and those documents."""

    def count(batches):
        tally: dict[int, Counter] = {}
        held: dict[int, Counter] = {}
        for batch in batches:
            for text, fold in zip(batch["text"], batch["fold"], strict=True):
                found = units(Counter(_WORD.findall(text.lower())))
                found = found if wanted is None else {u: found[u] for u in found.keys() & wanted}
                tally.setdefault(fold, Counter()).update(found)
                held.setdefault(fold, Counter()).update(found.keys())
        yield pd.DataFrame([(f, u, n, held[f][u]) for f, c in tally.items() for u, n in c.items()], columns=["fold", "unit", "n", "docs"])

    found = sample.filter(F.col("toxic") == toxic).select("text", "fold").mapInPandas(count, "fold int, unit string, n long, docs long")
    return found.groupBy("unit").agg(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("n", "docs")])


def learn_lexicons(sample: DataFrame) -> list[Lexicon]:
    """For each fold the lexicon of all others, then that of the whole sample."""
    words = F.regexp_count("text", F.lit(r"[\p{L}]+"))
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.sum(words).alias("n")).collect()}
    docs = sum((F.col(f"docs{f}") for f in range(1, FOLDS)), F.col("docs0"))
    often = _unit_counts(sample, 1, None).filter(docs >= LEAST_TOXIC).orderBy(F.desc(docs), "unit").limit(10 * LEXICON_ENTRIES).toPandas()
    clean = _unit_counts(sample, 0, set(often["unit"])).toPandas()
    both = often.merge(clean, on="unit", how="left", suffixes=("t", "c")).fillna(0)
    out = []
    for folds in (*(tuple(g for g in range(FOLDS) if g != f) for f in range(FOLDS)), tuple(range(FOLDS))):
        t, c, td, cd = (sum(both[f"{x}{f}{k}"] for f in folds).to_numpy(float) for x in ("n", "docs") for k in "tc")
        nt, nc = (max(sum(sizes.get((f, k), 0) for f in folds), 1) for k in (1, 0))
        ratio = np.log((t + 0.5) / nt) - np.log((c + 0.5) / nc)
        keep = (ratio - CAUTION * np.sqrt(1 / (td + 0.5) + 1 / (cd + 0.5)) >= LEAST_RATIO) & (td > 0)
        chosen = sorted(zip(both["unit"][keep], (ratio[keep] - FREE_RATIO).tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:LEXICON_ENTRIES]
        out.append(Lexicon({u: w for u, w in chosen if u[-1] != "*"}, {u[:-1]: w for u, w in chosen if u[-1] == "*"}))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, penalty: float = 0.01, rounds: int = 50) -> tuple[float, float]:
    """(bias, slope) of a weighted ridge logistic regression on one feature, by Newton steps; the slope is not negative."""
    a = np.stack([np.ones(len(x)), x], axis=1)
    ridge = np.diag([1e-3, penalty])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weights * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weights * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def fit(kinds: np.ndarray, toxic: np.ndarray, sweeps: int = 3, steps: int = 17) -> tuple[dict[str, float], float, float]:
    """(arcs, bias, slope): each arc in turn goes to the best of steps values within its bounds, the logistic function follows."""
    arcs = {name: believed for name, (believed, _, _) in ARCS.items()}
    weights = np.where(toxic == 1, ((toxic == 0).sum() / max((toxic == 1).sum(), 1)) ** BALANCE, 1.0)
    bias, slope = fit_logistic(strength(kinds, arcs), toxic, weights)

    def loss(tried: dict[str, float]) -> float:
        z = np.clip(bias + slope * strength(kinds, tried), -30, 30)
        return float(np.sum(weights * (np.logaddexp(0, z) - toxic * z))) + sum(((tried[n] - ARCS[n][0]) / SPREAD) ** 2 / 2 for n in ARCS)

    for _ in range(sweeps):
        for name, (_, low, high) in ARCS.items():
            arcs[name] = min((arcs[name], *np.linspace(low, high, steps).tolist()), key=lambda v, n=name: loss({**arcs, n: v}))
        bias, slope = fit_logistic(strength(kinds, arcs), toxic, weights)
    return arcs, bias, slope


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    sample = labelled_sample(docs, labels, rows)
    *others, whole = learn_lexicons(sample)
    names = [f"k{k}" for k in KINDS]

    def rate(batches):
        scanners = [Scanner(x) for x in others]
        for batch in batches:
            x = np.array([scanners[f].features(t) for t, f in zip(batch["text"], batch["fold"], strict=True)]).reshape(-1, len(names))
            yield pd.DataFrame(x, columns=names).assign(toxic=batch["toxic"].to_numpy())

    rated = sample.mapInPandas(rate, ", ".join(f"{n} double" for n in names) + ", toxic int").toPandas()  # at most rows rows of numbers
    if rated["toxic"].nunique() < 2:
        share = float(rated["toxic"].mean()) if len(rated) else 0.0
        return Model(whole, {n: believed for n, (believed, _, _) in ARCS.items()}, math.log((share + 1e-3) / (1 - share + 1e-3)), 0.0)
    return Model(whole, *fit(rated[names].to_numpy(), rated["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Adds score, under this name, to the rows of docs (all columns stay)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(shared.value.lexicon)
        for texts in parts:
            yield pd.Series(shared.value.scores(np.array([scanner.features(t) for t in texts.fillna("")]).reshape(-1, len(KINDS))))

    return docs.withColumn(name, rate("text"))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels, rows))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the documents that score REJECT or more."""
    name = free_name(docs, "toxicity_score")
    return score(docs, learn(docs, labels, rows), name).filter(F.col(name) < REJECT).drop(name)
