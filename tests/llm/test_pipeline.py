"""The pipeline against a brute-force version, stage by stage: each is judged on what its predecessor kept."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.llm import toxicity
from flowsentry.llm.common import durable
from flowsentry.llm.queries import bpe_path
from tests.llm.test_text_operators import SMALL, brute_components, brute_targets, chain, check_packing

words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents with drifting copies, exact copies, null and empty texts; labels as given."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rng = np.random.default_rng(8)
    texts = [t for n, size in ((15, 80), (8, 200)) for t in chain(rng, n, size)] + [None, "", " ", "one", "ONE"]
    texts += [r["text"] for r in docs.orderBy("doc_id").limit(5).collect()]
    rows = [(10_000 + i, t, "en", None if i % 9 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def kept(spark, folder):
    """What goes into the first stage and comes out of each."""
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(durable(stage(spark, out[-1], folder)))
    return out


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_toxic_documents_go(spark, folder, kept):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn(kept[0], labels)

    def rate(text):
        # By definition: every clause, every word, every mark.
        total = 0.0
        for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
            found = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause)
            weights = [max([model.lexicon.words.get(w, 0.0), *(model.lexicon.stems.get(w[:n], 0.0) for n in toxicity.STEMS if len(w) > n)]) for w in found]
            for i, w in enumerate(weights):
                if not w and found[i] not in toxicity.THREATS:
                    continue
                closed = lambda xs, kind: any(not weights[j] and found[j] in kind for j in xs)
                targets, negations, reports = toxicity.TARGETS - toxicity.THREATS - toxicity.NEGATIONS - toxicity.REPORTS, toxicity.NEGATIONS - toxicity.THREATS, toxicity.REPORTS - toxicity.THREATS - toxicity.NEGATIONS
                targeted = closed([j for j in range(max(0, i - 4), min(len(found), i + 5)) if j != i], targets)
                if not w and not targeted:
                    continue
                arcs = model.arcs["targeted"] * targeted + model.arcs["negated"] * closed(range(max(0, i - 3), i), negations) + model.arcs["reported"] * closed(range(i), reports) + model.arcs["threat"] * (not w)
                total += (w or toxicity.THREAT_WEIGHT) * np.exp(arcs)
        return 1 / (1 + np.exp(-np.clip(model.bias + model.slope * np.log1p(total), -30, 30)))

    assert ids(kept[1]) == sorted(r["doc_id"] for r in kept[0].collect() if rate(r["text"]) < 0.7)
    toxic = {r["doc_id"] for r in labels.collect() if r["toxic"] == 1}
    clean = set(ids(kept[0])) - toxic
    assert len(clean - set(ids(kept[1]))) <= 0.02 * len(clean)


def test_one_of_each_near_duplicate_group_stays(kept):
    found = brute_components([(r["doc_id"], r["text"]) for r in kept[1].collect()], 5, 80)
    assert ids(kept[2]) == sorted(d for d, _, first in found if d == first)
    assert len(ids(kept[2])) < len(ids(kept[1]))


def test_mix_meets_its_targets(kept):
    before = {r["doc_id"]: r for r in kept[2].collect()}
    sizes, taken, own, largest = Counter(), Counter(), Counter(), Counter()
    for r in before.values():
        n = len(words(r["text"]))
        sizes[r["source"]] += n
        largest[r["source"]] = max(n, largest[r["source"]])
    for r in kept[3].collect():
        assert r == before[r["doc_id"]]  # no text is cut
        own[r["doc_id"]] += len(words(r["text"]))
        taken[r["source"]] += len(words(r["text"]))
    want = brute_targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in want)
    assert all(n <= 3 * len(words(before[d]["text"])) for d, n in own.items())


def test_every_token_of_the_mix_is_packed_once(kept):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe_path())
    encode = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    # Copies of a document may end at different words, so what is packed is compared as whole documents.
    want = Counter((r["doc_id"], tuple(encode(r["text"]))) for r in kept[3].collect())
    by_copy = {}
    for r in kept[4].collect():
        by_copy.setdefault((r["doc_id"], r["copy"]), []).append(r)
    left = {}
    for (d, tokens), n in want.items():
        left.setdefault(d, []).extend([tokens] * n)
    renamed, named = [], {}
    for (d, copy), pieces in by_copy.items():
        first = min(pieces, key=lambda r: r["start"])
        tokens = next(t for t in left[d] if len(t) == first["doc_tokens"] and zlib.crc32(np.array(t[: first["length"]], "<u4").tobytes()) == first["ids_crc32"])
        left[d].remove(tokens)
        named[d, copy] = list(tokens)
        renamed += [{**r.asDict(), "doc_id": (d, copy)} for r in pieces]
    assert not any(left.values())
    sequences = check_packing(renamed, named)
    assert sum(map(len, named.values())) > 0.95 * 1024 * sequences


def test_run_gives_the_stages_rows(spark, folder, kept):
    rows = lambda frame: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in frame.collect())
    assert rows(corpus_pipeline.run(spark, folder)) == rows(kept[4])


def test_run_of_empty_tables_and_of_clashing_columns(spark, folder, tmp_path):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    names = ["score", "copy", "key", "n", "position", "times", "words", "text_hash", "toxicity_score", "mix_row"]
    odd = docs.limit(30).select("*", *[F.lit("own").alias(c) for c in names])
    twice = odd.limit(3).withColumn("text", F.concat(F.lit("another text of one id, with words of its own "), "text"))
    odd.unionByName(twice).unionByName(odd.limit(2)).write.parquet(f"{tmp_path}/odd/documents.parquet")
    labels.write.parquet(f"{tmp_path}/odd/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = durable(stage(spark, kept, f"{tmp_path}/odd"))
        assert kept.columns == odd.columns and kept.filter(" or ".join(f"{c} <> 'own'" for c in names)).isEmpty()
    assert corpus_pipeline.run(spark, f"{tmp_path}/odd").count() > 0
