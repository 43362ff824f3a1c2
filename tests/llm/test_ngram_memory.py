"""What a Python worker of the n-gram join holds at once, and that its pieces give the rows of whole batches."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from flowsentry.llm import ngram_join


def _peak(work) -> int:
    tracemalloc.start()
    work()
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return most


def test_counts_of_shingles_are_those_of_brute_force_and_need_no_copy_of_all_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(-(2**63), 2**63 - 1, 5_000)) for _ in range(100)]
    ends = np.array([-(2**63), -1, 0, 2**63 - 1])
    sets += [sets[0], sets[1][::2], ends, ends, np.empty(0, np.int64), sets[0]]
    want = {h: c for h, c in Counter(np.concatenate(sets).tolist()).items() if c >= ngram_join.LOCAL_COUNT}
    found = [x for h, c in ngram_join.often_held(sets) for x in zip(h.tolist(), c.tolist(), strict=True)]
    assert len(found) == len(want) and dict(found) == want
    assert list(ngram_join.often_held([])) == []
    held = sum(s.nbytes for s in sets)
    assert _peak(lambda: np.unique(np.concatenate(sets), return_counts=True)) > 2 * held  # as it was
    assert _peak(lambda: [None for _ in ngram_join.often_held(sets)]) < held / 2


def test_the_first_scan_holds_a_batch_of_sets_about_once(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 250))) for _ in range(6_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text_hash": pa.array(range(len(texts))), "text": pa.array(texts)})
    names, rows = ngram_join.Names(), []
    ngram_join.shingle_sets(texts[:10])  # the tables of powers stay
    sets = sum(s.nbytes for s in ngram_join.shingle_sets(texts))
    del texts
    most = _peak(lambda: rows.extend(x.num_rows for x in ngram_join.summary_rows([batch], 4, names)))
    assert sum(rows[:6]) == 6_000 and max(rows) <= max(ngram_join.PIECE_ROWS, ngram_join.COUNT_ROWS)
    assert most < 2.5 * sets

    monkeypatch.setattr(ngram_join, "HELD_SHINGLES", 2_000)  # shingles are counted in more parts, rows of documents stay
    small = batch.slice(0, 2_500)
    again = pa.Table.from_batches(ngram_join.summary_rows([small], 4, names)).to_pandas()
    assert again[again.n >= 0].doc_id.tolist() == list(range(2_500))


def test_large_ids_stay_exact_next_to_a_null_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(2**53 + 1, text), (2**53 + 3, f"{text} end"), (None, "quite another text of six words"), (2**53 + 5, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicate_components(docs.coalesce(1)).collect()}
    assert found == {2**53 + 1: (37, 2**53 + 1), 2**53 + 3: (38, 2**53 + 1), None: (3, None), 2**53 + 5: (0, 2**53 + 5)}
