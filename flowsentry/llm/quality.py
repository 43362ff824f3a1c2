"""Quality scores by naive Bayes support vectors.

A document is the set of its word and word pair n-grams, hashed to 2**BITS features, with indicators of how much its
n-grams repeat at short distances; words are runs of letters and digits or runs of marks. Each feature's indicator is scaled by the logarithm of its smoothed share in good over that in
bad documents, and a linear model with squared hinge loss is fitted on the scaled, unit-length vectors by dual
coordinate descent. The score is a logistic function of the margin, fitted on margins of folds that the model
had not seen, with both classes at their shares among all labelled rows. PRIOR and the other constants were chosen
by folds inside the training rows of sf0.1.

Labels come from at most SAMPLE_ROWS rows, half of each class, those of least hash of the doc_id; their ids are
broadcast, so no text is shuffled but theirs. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import text_or_empty

#: Most labelled rows that the model is fitted on; the fit's memory and time are bounded by it.
SAMPLE_ROWS = 12_000
BITS = 20
#: Documents of the sample that a feature must occur in.
LEAST = 3
#: Distances in pieces at which repeats are counted.
LAGS = (1, 2, 3, 4, 6, 8, 12, 16)
#: Added to a vector's squared length before it is brought to unit length, so that a few n-grams are little evidence.
PRIOR = 200.0
FOLDS, ROUNDS, COST, THRESHOLD = 4, 10, 1.0, 0.7

_PIECE = re.compile(r"\w+|[^\w\s]+")


def _repeats(one: np.ndarray) -> np.ndarray:
    """Numbers for how often a text's n-grams repeat at once: for each lag, the power of two of the share of pieces that equal the piece lag before."""
    shares = [(one[lag:] == one[:-lag]).mean() if len(one) > lag else 0.0 for lag in LAGS]
    return np.array([lag * 16 + min(int(-np.log2(x)), 15) for lag, x in zip(LAGS, shares, strict=True) if x > 0], np.uint64)


def ngrams(text: str) -> np.ndarray:
    """Ascending distinct feature numbers of a text; none if it has no words."""
    pieces = _PIECE.findall(text.lower())
    if not pieces:
        return np.zeros(0, np.int32)
    one = np.fromiter((zlib.crc32(p.encode("utf-8", "surrogatepass")) for p in pieces), np.uint64, len(pieces))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] + np.uint64(1)
    every = np.concatenate([one * np.uint64(0xBF58476D1CE4E5B9), two * np.uint64(0x94D049BB133111EB), (_repeats(one) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)])
    return np.unique((every >> np.uint64(64 - BITS)).astype(np.int32))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Per feature the logarithm of its smoothed share in good over that in bad rows; 0 for those in fewer than LEAST rows."""
    counts = np.zeros((2, 1 << BITS))
    for row, label in zip(rows, good.tolist(), strict=True):
        counts[label, row] += 1
    seen = counts.sum(axis=0)
    share = (counts + 1) / (counts.sum(axis=1) + (seen > 0).sum())[:, None]
    return np.where(seen >= LEAST, np.log(share[1] / share[0]), 0.0)


def dual_descent(rows: list[np.ndarray], good: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Weights (the last one the bias) of the squared hinge loss on scaled, unit-length rows; each class has half the cost."""
    weights, rng = np.zeros((1 << BITS) + 1), np.random.default_rng(0)
    scaled = []
    for row in rows:
        row = row[ratios[row] != 0]
        x = ratios[row]
        scaled.append((np.append(row, 1 << BITS), np.append(_unit(x), 1.0)))
    sign = np.where(good == 1, 1.0, -1.0)
    slack = np.array([0.5 / (COST * len(good) / (2 * max((good == g).sum(), 1))) for g in (0, 1)])[good]
    norm, alpha = np.array([x @ x for _, x in scaled]) + slack, np.zeros(len(rows))
    for _ in range(ROUNDS):
        for i in rng.permutation(len(rows)).tolist():
            at, x = scaled[i]
            step = sign[i] * (x @ weights[at]) - 1 + slack[i] * alpha[i]
            new = max(alpha[i] - step / norm[i], 0.0)
            if new != alpha[i]:
                weights[at] += (new - alpha[i]) * sign[i] * x
                alpha[i] = new
    return weights


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(x @ x + PRIOR)


def margin(row: np.ndarray, ratios: np.ndarray, weights: np.ndarray) -> float:
    return float(_unit(ratios[row]) @ weights[row] + weights[-1])


def logistic(margins: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic regression on margins, by Newton's method with a slight pull to 0."""
    x, p = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        slope = x.T @ (weight * (q - good)) + 1e-2 * p
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2), slope)
        p = p - step
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])


def fit(rows: list[np.ndarray], good: np.ndarray, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(ratios, weights, slope, offset); rates are the two classes' rows among all labelled ones."""
    unseen, fold = np.zeros(len(rows)), np.arange(len(rows)) % FOLDS
    for f in range(FOLDS):
        train = [r for r, k in zip(rows, fold.tolist(), strict=True) if k != f]
        ratios = log_count_ratios(train, good[fold != f])
        weights = dual_descent(train, good[fold != f], ratios)
        for i in np.flatnonzero(fold == f).tolist():
            unseen[i] = margin(rows[i], ratios, weights)
    found = np.bincount(good, minlength=2)
    slope, offset = logistic(unseen, good, (rates / np.maximum(found, 1))[good] * len(rows) / rates.sum())
    ratios = log_count_ratios(rows, good)
    return ratios, dual_descent(rows, good, ratios), slope, offset


def sample(labels: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(at most SAMPLE_ROWS label rows (doc_id, quality) outside the held-out share, the two classes' rows among all of them).

    Rows whose doc_id or quality is null, and whose quality is neither 0 nor 1, are not used."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(~held_out("doc_id") & F.col("quality").isin(0, 1))
    rates = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    halves = [known.filter(F.col("quality") == q).orderBy(order, "doc_id").limit(SAMPLE_ROWS // 2) for q in (0, 1)]
    return halves[0].unionByName(halves[1]), np.array([rates.get(0, 0), rates.get(1, 0)], float)


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(two rows: each feature's ratio, and its ratio times its weight; the logistic function's slope and offset, bias included).

    The fit runs in one task over the bounded sample; what reaches the driver is the model, 2**BITS features at most.
    With fewer than two classes among the labels the table is empty and the offset is the score of every text."""
    chosen, rates = sample(labels)
    if not rates.all():
        return np.zeros((2, 0)), np.array([0.0, (rates[1] + 1) / (rates.sum() + 2)])
    rows = docs.join(F.broadcast(chosen.withColumnsRenamed({"doc_id": "chosen_id", "quality": "chosen_quality"})), F.col("doc_id") == F.col("chosen_id")).select("doc_id", F.col("chosen_quality").alias("quality"), text_or_empty().alias("text"))

    def featured(batches):
        for b in batches:
            made = [ngrams(t.as_py()).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["doc_id", "quality", "features"])

    def fitted(batches):
        found = [(i, q, f) for b in batches for i, q, f in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        found.sort()
        rows, good = [np.frombuffer(f, np.int32) for _, _, f in found], np.array([q for _, q, _ in found], int)
        if len(set(good.tolist())) < 2:
            return
        ratios, weights, slope, offset = fit(rows, good, rates)
        at = np.flatnonzero(ratios)
        used = [*at.tolist(), -1, -2]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([*ratios[at], 1.0, slope], pa.float64()), pa.array([*weights[at], weights[-1], offset], pa.float64())], ["feature", "ratio", "weight"])

    model = rows.mapInArrow(featured, "doc_id long, quality int, features binary").repartition(1).mapInArrow(fitted, "feature int, ratio double, weight double").toArrow()
    if not model.num_rows:
        return np.zeros((2, 0)), np.array([0.0, (rates[1] + 1) / (rates.sum() + 2)])
    feature, ratio, weight = (model.column(i).to_numpy() for i in range(3))
    table = np.zeros((2, 1 << BITS), np.float32)
    real = feature >= 0
    table[0, feature[real]], table[1, feature[real]] = ratio[real], ratio[real] * weight[real]
    bias, (slope, offset) = weight[feature == -1][0], (ratio[feature == -2][0], weight[feature == -2][0])
    return table, np.array([slope, offset + slope * bias])


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document. A null text is an empty one, which like any text without
    known n-grams gets the model's score at its bias; equal texts get equal scores; a null doc_id is not held out."""
    (table, line) = model
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def score(batches):
        table = sent.value
        for b in batches:
            out = []
            for text in b.column(1):
                if not table.size:
                    out.append(float(line[1]))
                    continue
                row = ngrams(text.as_py())
                x = table[0, row].astype(float)
                z = line[0] * float(table[1, row].sum(dtype=float)) / np.sqrt(float(x @ x) + PRIOR) + line[1]
                out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    found = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(score, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
