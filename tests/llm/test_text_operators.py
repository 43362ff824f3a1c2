"""Text operators against brute force, round trips and held-out accuracy."""

import gzip
import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.llm import fingerprint, html_extract, lm_score, media, mixing, ngram_join, packing, token_counts, toxicity, warc
from flowsentry.llm.components import components
from flowsentry.llm.queries import bpe_path

SMALL = "/root/testdata/sf0.001"
SCHEMA = "extra int, doc_id long, text string, lang string, source string, n_chars long, n int, label string"
TEXTS = [
    None,
    "",
    "   \t\n",
    "one",
    "two words",
    "Ｆｕｌｌ　ＷＩＤＴＨ Straße",
    "full width STRASSE",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z",
    "A b c d e f g h i j k l m n o p q r s t u v w x y z",
    "don't <|endoftext|> stop  <|endoftext|> \x1c x y 123 ½ १२३ 漢字 🙂\r\n\r\n end   ",
    "word " * 5000,
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    rows = [(1, i, t, "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), 7, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[7], rows[7], rows[0]], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# fingerprints


def test_canonical_folds_width_case_and_space():
    assert fingerprint.canonical("Ｆｕｌｌ　ＷＩＤＴＨ\n Straße ") == "full width strasse"
    assert fingerprint.canonical("é") == fingerprint.canonical("É")
    assert fingerprint.digest("a b") != fingerprint.digest("ab")


def test_fingerprints_match_brute_force(spark, docs):
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(rows, reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints_with_edits(docs).collect()}
    assert len(got) == len(rows)
    for i, d in enumerate(order):
        following = rows[order[(i + 1) % len(order)]]
        edited = fingerprint.edited_text(rows[d], following)
        half = len(rows[d]) // 2
        assert edited == rows[d][: len(rows[d]) - half] + following[:half]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d]["n_chars"] == len(rows[d]) and got[d]["fingerprint"] == fingerprint.digest(rows[d])
        assert got[d]["near_next"] == float(fingerprint.digest(following) == fingerprint.digest(rows[d]))


def test_fingerprints_odd_rows(odd, none):
    got = fingerprint.fingerprints_with_edits(odd).collect()
    assert len(got) == odd.count()
    assert fingerprint.fingerprints_with_edits(none).count() == 0
    classes = {r["doc_id"]: r["class_id"] for r in fingerprint.exact_classes(odd).collect()}
    assert classes[0] == classes[1] == classes[2] == 0 and classes[5] == classes[6] == 5 and classes[7] == classes[8] == 7 and classes[3] == 3


def test_equal_digests_of_different_bytes_stay_apart(odd):
    same = odd.select("doc_id", F.lit("0").alias("fingerprint"))
    assert same.count() == odd.count()
    # classes come from bytes inside a bucket, so a bucket that mixes texts is split
    real = fingerprint.exact_classes(odd)
    assert real.select("class_id").distinct().count() == len({fingerprint.canonical(t or "") for t in TEXTS})


# WARC


def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").limit(30)
    archived = [bytes(r["record"]) for r in warc.archive_bytes(warc.responses(pages)).collect()]
    assert sum(1 for data in archived for _ in warc.decode_records(data)) == 30
    assert sum(1 for _ in warc.decode_records(b"".join(gzip.decompress(a) for a in archived))) == 30
    by_page = {}
    for r in warc.derive(warc.responses(pages)).collect():
        (headers, block), = warc.decode_records(bytes(r["record"]))
        assert headers["warc-type"] == r["record_type"] and headers["warc-refers-to"] == r["refers_to"] and headers["warc-block-digest"] == warc.sha1_digest(block) == r["block_digest"]
        assert len(block) == r["content_length"]
        by_page.setdefault(r["page_id"], set()).add(r["record_type"])
    assert all(v == {"metadata", "conversion"} for v in by_page.values()) and len(by_page) == 30


def test_warc_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://a/", "<p>x &amp; y<script>z</script>"), (2, "http://a/", "<p>x &amp; y<script>z</script>")], "page_id long, url string, html string")
    got = warc.derive(warc.responses(pages)).collect()
    assert len(got) == 6
    text = [bytes(r["record"]) for r in got if r["record_type"] == "conversion" and r["page_id"] == 2]
    assert text[0] == text[1] and b"\r\n\r\nx & y\r\n\r\n" in text[0]
    assert all("WARC-Target-URI" not in bytes(r["record"]).decode() for r in got if r["page_id"] == 1)


class Reader(__import__("html.parser", fromlist=["HTMLParser"]).HTMLParser):
    """A plain second reading of a page: its letters without markup, and its links."""

    def __init__(self):
        super().__init__()
        self.letters, self.links, self.title, self.skip = [], [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.RAW:
            self.skip = tag
        self.links += [v for k, v in attrs if tag == "a" and k == "href"]

    def handle_endtag(self, tag):
        self.skip = None if tag == self.skip else self.skip

    def handle_data(self, data):
        (self.letters if self.skip is None else self.title if self.skip == "title" else []).append(data)


def test_warc_records_match_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").withColumn("record", F.lit(1)).withColumn("headers", F.lit("x"))
    got = {(r["page_id"], r["record_type"]): r for r in warc.derive(warc.responses(pages)).collect()}
    rows = pages.collect()
    assert len(got) == 2 * len(rows)
    for r in rows:
        (head, block), = warc.decode_records(warc.response_record(r["url"], r["html"], "2024-01-01T00:00:00Z"))
        read = Reader()
        read.feed(r["html"])
        squeeze = lambda t: "".join(t.split())
        made = {}
        for kind in ("metadata", "conversion"):
            (own, data), = warc.decode_records(bytes(got[r["page_id"], kind]["record"]))
            made[kind] = data.decode()
            assert own["warc-refers-to"] == head["warc-record-id"] and own["warc-refers-to-target-uri"] == own["warc-target-uri"] == r["url"]
            assert own["warc-refers-to-date"] == head["warc-date"] and own["warc-block-digest"] == warc.sha1_digest(data)
            assert got[r["page_id"], kind]["source_digest"] == head["warc-payload-digest"] == warc.sha1_digest(r["html"].encode())
        assert squeeze(made["conversion"]) == squeeze("".join(read.letters))
        fields = [line.split(": ", 1) for line in made["metadata"].split("\r\n") if line]
        assert [v for k, v in fields if k == "outlink"] == read.links
        assert [v for k, v in fields if k == "title"] == [" ".join("".join(read.title).split())]
        assert [v for k, v in fields if k == "source-http-header"] == block.split(b"\r\n\r\n")[0].decode().split("\r\n")
        assert dict(fields)["source-payload-verified"] == "true"


def test_damaged_archives_lose_only_what_is_damaged(spark):
    good = warc.response_record("http://a/", "<p>WARC/1.0 inside</p>", "2024-01-01T00:00:00Z")
    zipped = gzip.compress(good)
    cases = [(1, good + good, 2, None), (2, good + good[:-9], 1, "truncated block"), (3, zipped + zipped[:-12], 1, "truncated gzip member"), (4, good.replace(b"Content-Length: 1", b"Content-Length: x1"), 0, "no length"), (5, b"WARC/1.1\r\nContent-Length: 3", 0, "unfinished headers"), (6, good + b"junk", 1, "no version line"), (7, None, 0, None), (8, b"", 0, None), (9, good.replace(b"Content-Length: 1", b"Content-Length: 0"), 0, "no end of block"), (10, zipped[:10] + b"zzzz" + zipped[14:], 0, "gzip data")]
    frame = spark.createDataFrame([(i, r) for i, r, _, _ in cases], "page_id long, record binary")
    made = Counter(r["page_id"] for r in warc.derive(frame).collect())
    told = {r["page_id"]: (r["sound"], r["reason"]) for r in warc.damaged(frame).collect()}
    for i, _, sound, why in cases:
        assert made[i] == 2 * sound and told.get(i, (sound, None)) == (sound, why) or (i == 10 and i in told), (i, told.get(i))
    assert warc.derive(frame.limit(0)).count() == warc.damaged(frame.limit(0)).count() == 0


def test_unclosed_scripts_and_tags_stay_hidden_in_linear_time():
    assert warc.plain_text("<p>a<script>var x = 1;") == "a" and warc.plain_text("a <b") == "a" and warc.plain_text("1 < 2") == "1 < 2"
    began = __import__("time").time()
    for piece in ("<a ", '<a "', "<script>", "<!", "<p>", "<a b='", '<a "x'):
        html_extract.blocks(piece * 20_000)
    assert __import__("time").time() - began < 30


# HTML

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Site</p></header><nav><ul><li><a href=x>A</a><li><a href=y>B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>One<br>two <b>bold</p><p>three<p>four &copy; <a href=q>link</a><aside>side</aside>
<form><p>name</p></form><script>var t="</p>";</script><ul><li>five<li>six</ul></article><section id="comments"><p>reader says</p></section><footer>foot</footer></body></html>"""


def test_main_text_of_an_article():
    assert html_extract.main_text(PAGE, None) == "Head & line One two bold three four © link five six"
    assert html_extract.main_text("", None) == "" and html_extract.main_text("plain   text &lt;b&gt;", None) == "plain text <b>"


def test_templates_find_slots_without_roles(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = []
    for i in range(12):
        body = " ".join(words[(i * 3 + j) % 10] + str(i) for j in range(40))
        rows.append((i, f"http://h.example/{i}", f"<div class=top><p>Welcome to our site</p></div><div class=x1><p>{body}</p></div><div class=y2><p>All rights kept by us</p></div>"))
    rows.append((99, None, None))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Welcome" not in got[i] and "rights" not in got[i] and f"alpha{i}" in got[i] for i in range(12))
    assert got[99] == ""


def test_extract_of_given_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        inner = re.search(r"(?s)<article>(.*)</article>", source[r["page_id"]])[1]
        plain = " ".join(warc.html_lib.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert r["text"].replace(" ", "") == plain.replace(" ", "") and r["n_chars"] == len(r["text"])


def site(spark, pages):
    rows = [(i, f"http://h.example/{i}", html) for i, html in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extract.extract(frame).collect()}


def prose(i, n=40):
    return " ".join(f"w{i}x{j}" for j in range(n))


def test_templates_decide_on_pages_with_articles(spark):
    got = site(spark, [f"<article><h1>t{i}</h1><p>{prose(i)}</p><div class=z><p>Read on with us</p></div></article>" for i in range(8)])
    assert all(got[i] == f"t{i} {prose(i)}" for i in range(8))
    # Copies keep their text, and a page that departs from the template goes by its own roles.
    assert set(site(spark, [f"<article><p>{prose(1)}</p></article>"] * 6).values()) == {prose(1)}
    assert site(spark, [*[f"<article><p>{prose(i)}</p></article>" for i in range(8)], "<section><p>other form</p></section>"])[8] == "other form"


def test_titles_and_short_slots_stay(spark):
    got = site(spark, [f"<div class=content><h1>t{i}</h1><blockquote>q{i}</blockquote><p>{prose(i)}</p><p>{prose(i + 50)}</p></div><div class=end><p>All rights kept by us</p></div>" for i in range(6)])
    assert all(got[i] == f"t{i} q{i} {prose(i)} {prose(i + 50)}" for i in range(6))


def test_template_decides_and_repeated_pages_do_not(spark):
    page = lambda i: f"<article><h1>t{i}</h1><p>{prose(i)}</p><div class=policy-alert><p>level {i}</p></div><p>Read on with us</p></article>"
    whole = lambda i: f"t{i} {prose(i)} level {i} Read on with us"
    assert [html_extract.main_text(page(i), None) for i in range(8)] == [whole(i) for i in range(8)]
    got = site(spark, [page(i) for i in range(8)])
    assert all(got[i] == whole(i).removesuffix(" Read on with us") for i in range(8))
    rows = [(i, f"http://h.example/{i}", page(i), "x") for i in range(8) for _ in range(2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    twice = html_extract.extract(frame).collect()
    assert len(twice) == 16 and all(r["text"] == got[r["page_id"]] for r in twice)
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_chrome_names_are_whole_names():
    text = lambda attributes, tag="div": html_extract.main_text(f"<p>a</p><{tag} {attributes}>b</{tag}>", None)
    for kept in ('class="overflow-hidden"', 'aria-hidden="false"', 'data-hidden="x"', 'class="social-science"', 'class="post-header"', 'title="not hidden"', 'class="search-theory text"'):
        assert "b" in text(kept), kept
    assert "b" in text('class="social search"', "article") and "b" in text("id=comment-7", "main")
    for gone in ("hidden", 'hidden=""', "aria-hidden=true", 'style="display: none"', 'class="cookie-notice"', "class=ad", 'class="post-comments"', "class=sidebarLeft id=x", "role=navigation", "id=site-header"):
        assert text(gone) == "a", gone


def test_template_classes_pass_an_order_and_a_nesting_test():
    page = lambda *names: html_extract.blocks("".join(f"<div class={n}>{n}</div>" for n in names))
    classes = {f"p/div.{n}": c for n, c in (("a", 1), ("b", 1), ("c", 2), ("d", 2))}
    one, crossing = html_extract.orders(page("a", "c", "d", "b"), classes)
    assert not crossing and one == html_extract.orders(page("a", "b", "c", "d"), classes)[0] == html_extract.orders(page("a", "b", "a", "b", "c", "d"), classes)[0]
    other, crossing = html_extract.orders(page("b", "c", "a", "d"), classes)
    assert crossing == {(1, 2)} and other[1] != one[1] and other[2] == one[2]
    assert html_extract.orders(page("a", "b", "b", "a"), classes)[0][1] not in (one[1], other[1])
    tokens = html_extract.pd.DataFrame({"class": [1, 1, 2, 2, 3], "pages": [9, 9, 5, 5, 9]})
    tests = html_extract.pd.DataFrame([(1, -1, 7, 7), (2, -1, 7, 7), (3, -1, 6, 7), (1, 2, 0, 0)], columns=["class", "other", "low", "high"])
    assert html_extract.valid_classes(tokens, tests) == {1}


# n-gram join


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_components(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return {(d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets)}


def chain(rng, n, size):
    """Near copies that drift, some past the limit."""
    words = [f"w{rng.integers(3000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        for _ in range(int(rng.integers(1, 3))):
            words[int(rng.integers(len(words)))] = f"n{rng.integers(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_matches_brute_force(spark, docs, words, percent):
    rng = np.random.default_rng(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    more = [t for n, size in ((30, 120), (20, 60), (12, 300)) for t in chain(rng, n, size)] + TEXTS + ["one", "ONE", "two  words"]
    rows += [(10_000 + i, t) for i, t in enumerate(more)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in ngram_join.near_duplicate_components(frame, words, percent).collect()}
    assert got == brute_components(rows, words, percent)


def test_shared_names_of_sets_are_told_apart(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(60).collect()] + [(10_000 + i, t) for i, t in enumerate(chain(np.random.default_rng(6), 12, 90))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    named = ngram_join.near_duplicate_rows(frame, name_bits=3)  # 72 sets, 8 names
    least = named.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("first"))
    got = {(r["doc_id"], r["n"], r["first"] if r["n"] else r["doc_id"]) for r in named.join(least, "root", "left").collect()}
    assert got == brute_components(rows, 4, 85)


def test_pairs_of_near_copies_grow_with_the_group_not_its_square(spark, monkeypatch):
    """Copies of one text that reach it but not each other, and copies that are just too far from everything."""
    made, real = [], ngram_join._pairs
    monkeypatch.setattr(ngram_join, "_pairs", lambda *a: made.append(real(*a)) or made[-1].cache())
    rng, counts = np.random.default_rng(7), []
    base = [f"w{i}" for i in range(200)]

    def copy(edits):
        out = list(base)
        for i in rng.choice(200, edits, replace=False):
            out[i] = f"n{rng.integers(10**9)}"
        return " ".join(out)

    for size in (60, 240):
        made.clear()
        rows = [(0, " ".join(base)), *((i, copy(3 if i % 2 else 6)) for i in range(1, size))]
        got = {tuple(r) for r in ngram_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute_components(rows, 4, 85)
        counts.append(sum(x.count() for x in made))
    assert counts[1] < 6 * counts[0]


def test_signatures_never_differ_more_than_their_sets():
    rng = np.random.default_rng(4)
    pool = rng.integers(-(2**63), 2**63, 3000)
    for size in (1, 40, 400, 2000):
        for _ in range(20):
            x, y = (np.unique(rng.choice(pool, size)) for _ in "xy")
            parities = np.bitwise_xor(ngram_join.signature(x), ngram_join.signature(y)).view(np.uint8)
            assert np.unpackbits(parities).sum() <= len(np.setxor1d(x, y))
            y = y[: int(rng.integers(1, len(y) + 1))]
            assert ngram_join.parities_that_differ(ngram_join.wide_signature(x), ngram_join.wide_signature(y)) <= len(np.setxor1d(x, y))
    assert ngram_join.parities_that_differ(ngram_join.wide_signature(x), ngram_join.wide_signature(x + 1)) > 0.3 * len(np.setxor1d(x, x + 1))
    assert not ngram_join.signature(np.empty(0, np.int64)).any()


def test_ngram_join_empty_and_one_of_each(odd, none):
    assert ngram_join.near_duplicate_components(none).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect())[7] == 1 and 8 not in {r["doc_id"] for r in kept.collect()}


def test_one_of_each_goes_by_rows(spark):
    w, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "wz")
    rows = [(1, w, 1), (5, f"{w} tail", 2), (5, z, 3), (None, f"{w} end", 4), (None, "p q r s t u", 5), (5, "", 6), (5, "", 7), (1, w, 8), (7, f"{z} x", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ngram_text_hash int")
    got = ngram_join.one_of_each(frame)
    assert got.columns == frame.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert kept == Counter({(1, w): 1, (5, z): 1, (None, "p q r s t u"): 1, (5, ""): 2})
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicate_components(frame).collect()} == {(1, 1), (5, 1), (None, 1), (5, 5), (7, 5), (None, None)}
    assert ngram_join.one_of_each(frame.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 60
    links = spark.createDataFrame([((i * 37) % 997, ((i + 1) * 37) % 997) for i in range(n)] + [(5000, 5001)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert len({got[(i * 37) % 997] for i in range(n + 1)}) == 1 and got[5000] == got[5001] != got[0]


# tokens and packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_path())


def test_token_counts_match_the_library(spark, docs, odd, none, tokenizer):
    for frame in (docs, odd):
        texts = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
        want = Counter((d, len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for d, t in texts)
        got = token_counts.token_counts(frame, bpe_path()).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert token_counts.token_counts(none, bpe_path()).count() == 0


def test_encoder_gives_the_librarys_ids(tokenizer):
    encoder, rng = packing.Encoder(bpe_path()), np.random.default_rng(1)
    letters = [*"ab E'1 \t\n\r\x0b\x1c\x1d\x85  ​　éß漢ｱ٣½_-.<|🙂́﻿\x00"]
    texts = [*(t or "" for t in TEXTS), *("".join(rng.choice(letters, 40)) for _ in range(3000))]
    special, lengths, split = __import__("regex").compile(r"<\|endoftext\|>"), token_counts.Lengths({}, token_counts.load(bpe_path())[1]), __import__("regex").compile(token_counts.PRE_TOKEN).findall
    for t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert encoder.ids(t).tolist() == ids, repr(t)
        assert token_counts.count_tokens(t, lengths, special, split) == len(ids), repr(t)


def test_encoder_gives_the_librarys_ids_of_every_code_point(tokenizer):
    encoder = packing.Encoder(bpe_path())
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for join in ("", " a", "1\n"):
        for i in range(0, len(points), 4096):
            text = join.join(points[i : i + 4096])
            assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(rows, want, size=1024):
    """rows: packed pieces; want: doc_id -> list of token id lists."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["copy"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for (d, _), own in by_doc.items():
        own.sort(key=lambda r: r["start"])
        ids = want[d]
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_sequence)


def test_packing_round_trip(docs, odd, none, tokenizer):
    want = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = packing.packed_documents(docs, bpe_path()).collect()
    sequences = check_packing(rows, want)
    assert sum(map(len, want.values())) > 0.97 * 1024 * sequences
    odd_rows = packing.packed_documents(odd.withColumn("copy", F.lit("own")), bpe_path(), copies=True).collect()
    check_packing(odd_rows, {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in odd.collect()})
    assert len({(r["doc_id"], r["copy"]) for r in odd_rows}) == odd.count()
    assert packing.packed_documents(none, bpe_path()).count() == 0


def test_shortest_pack_first_places_everything():
    rng = np.random.default_rng(3)
    for _ in range(30):
        histogram = dict(Counter(rng.integers(1, 65, 400).tolist()))
        patterns = packing.shortest_pack_first(histogram, 64)
        placed = Counter()
        for lengths, n in patterns:
            assert sum(lengths) <= 64
            for x in lengths:
                placed[x] += n
        assert placed == Counter(histogram)
    assert packing.shortest_pack_first({32: 4}, 64) == [((32, 32), 2)]
    assert packing.shortest_pack_first({40: 1, 30: 1, 20: 2}, 64) == [((40, 20), 1), ((30, 20), 1)]


# mixing


def brute_targets(sizes):
    sources = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sources)}
    total, target, free = sum(sizes.values()), {}, set(sources)
    left = float(total)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(3.0 * sizes[s] for s in over)
        free -= over
    return target


def test_mixing_targets_and_words(spark, docs, odd, none):
    for frame in (docs, odd):
        rows = mixing.mixed_documents(frame).collect()
        assert len(rows) == frame.count()
        sizes = Counter()
        for r in frame.collect():
            sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        want = brute_targets(dict(sizes))
        taken = Counter()
        for r in rows:
            assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        # The partial pass ends at the document nearest to the target.
        largest = Counter()
        for r in rows:
            largest[r["source"]] = max(largest[r["source"]], r["size"] * (3 if frame is odd else 1))
        assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in want)
        assert all((r["position"] is None) == (r["taken"] == 0) for r in rows)
        positions = [r["position"] for r in rows if r["position"] is not None]
        assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    assert mixing.mixed_documents(none).count() == 0


def test_mixing_is_repeatable_and_inverts_demand(spark, docs):
    key = lambda frame: sorted((r["doc_id"], r["taken"], r["position"] or -1) for r in mixing.mixed_documents(frame).collect())
    assert key(docs) == key(docs.repartition(7))
    t = spark.range(101).select((F.col("id") / 100).alias("t"))
    for slope in (-0.7, 0.0, 0.6):
        back = t.select("t", mixing.due(mixing.demand(F.col("t"), F.lit(50.0), F.lit(slope)), F.lit(50.0), F.lit(slope)).alias("u"))
        assert all(abs(r["t"] - r["u"]) < 1e-9 for r in back.collect())


@pytest.mark.parametrize("which", ["given", "odd", "one source"])
def test_mixing_equals_its_sql(spark, docs, odd, tmp_path, which):
    import duckdb

    frame = {"given": docs, "odd": odd, "one source": docs.limit(9).withColumn("source", F.lit(None).cast("string"))}[which]
    frame.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents")
    frame = spark.read.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    rows = con.execute(mixing.ORACLE_SQL)
    names = [d[0] for d in rows.description]
    got = mixing.mixed_documents(frame)
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(rows.fetchall())


def test_mixed_rows_hold_the_words_taken(docs, odd, none):
    for frame in (docs, odd):
        rows = mixing.mixed_rows(frame)
        assert rows.columns == frame.columns
        words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        got, want = Counter(), Counter()
        for r in rows.collect():
            got[r["doc_id"]] += words(r["text"])
        for r in mixing.mixed_documents(frame).collect():
            want[r["doc_id"]] += r["taken"]
        assert +got == +want
    assert mixing.mixed_rows(none).count() == 0


# LM scores


@pytest.mark.parametrize(("words", "bigrams", "bits"), [(0, 0, 64), (50, 500, 1 << 10), (10**6, 10**6, 1 << 20)])
def test_lm_models_are_distributions_and_match_brute_force(spark, docs, labels, words, bigrams, bits):
    models, rare = lm_score.train(docs, labels, words=words, bigrams=bigrams, bits=bits)
    assert (rare.count() == 0) == (words > 50) and len(models.words) <= words and len(models.codes) <= bigrams
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    texts = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate({x: x + 32 for x in range(65, 91)})) for r in docs.collect()}
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(docs, models, rare).collect()}
    assert len(got) == len(texts)
    followed = {d: list(zip([None, *texts[d]], texts[d], strict=False)) for d in texts}
    known = {w for w, n in Counter(w for d in texts for w in texts[d]).items() if n >= lm_score.LEAST}
    kept = {x for x, n in Counter(x for d in texts for x in followed[d]).items() if n >= lm_score.LEAST}
    assert len(known) > 50 and len(kept) > 50
    for k, chosen in ((0, set(texts)), (1, good & set(texts))):
        pairs = Counter(x for d in chosen for x in followed[d])
        context, single, mass = Counter(), Counter(), Counter()
        for (a, b), n in pairs.items():
            context[a] += n
            single[b if b in known else 0] += n
            mass[a] += n if (a, b) in kept else 0
        n_all = sum(single.values())

        def p(a, b, pairs=pairs, context=context, single=single, mass=mass, n_all=n_all):
            total = max(context[a], 1)
            alone = (single[b if b in known else 0] + lm_score.ADDED) / (n_all + lm_score.ADDED * (len(known) + 1))
            return (1 - lm_score.BIGRAM_WEIGHT * mass[a] / total) * alone + (lm_score.BIGRAM_WEIGHT * pairs[a, b] / total if (a, b) in kept else 0)

        for a in (None, *sorted(known)[:3], "never seen"):
            assert abs(sum(p(a, b) for b in (*known, 0)) - 1) < 1e-9
        for d in texts:
            want = np.mean([-np.log(p(a, b)) for a, b in followed[d]]) if texts[d] else 0.0
            assert abs(got[d]["target_loss" if k else "background_loss"] - want) < 1e-9


def test_lm_odd_rows(odd, none, labels):
    got = lm_score.cross_entropy_difference(odd, *lm_score.train(odd, labels.limit(0))).collect()
    assert len(got) == odd.count() and all(r["ce_diff"] == 0 for r in got)
    assert lm_score.cross_entropy_difference(odd, *lm_score.train(none, labels)).count() == odd.count()


def test_lm_scores_rows_that_share_an_id_apart(spark, docs, labels):
    trained = lm_score.train(docs, labels)
    texts = ["the the the", "zzz qqq www vvv uuu", None]
    alone = [lm_score.cross_entropy_difference(spark.createDataFrame([(1, t)], "doc_id long, text string"), *trained).first() for t in texts]
    for i in (-5, None):
        got = lm_score.cross_entropy_difference(spark.createDataFrame([(i, t) for t in texts], "doc_id long, text string"), *trained).collect()
        assert sorted(tuple(r)[1:] for r in got) == sorted(tuple(r)[1:] for r in alone) and {r["doc_id"] for r in got} == {i}


# media


def test_stored_rows_are_filtered():
    text = "the quick brown fox jumps over the lazy dog, " * 40 + "z" * 300 + "漢字🙂"
    size, data = media.store(text)
    packed = b"".join(c for k, c in media.chunks(data) if k == b"IDAT")
    kinds = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, media.WIDTH + 1)[:, 0]
    assert {1, 2} <= set(kinds.tolist()) <= {0, 1, 2}
    assert media.decode_png(data).tobytes()[:size].decode() == text


def test_png_filters_and_checksums():
    rng = np.random.default_rng(2)
    samples = rng.integers(0, 256, (9, 12), dtype=np.uint8)
    for kind in (0, 1, 2):
        assert (media.decode_png(media.encode_png(samples, kind)) == samples).all()
    rows = np.zeros((9, 13), np.uint8)
    for y in range(9):  # filters 0 to 4 in turn, encoded by definition
        kind = y % 5
        rows[y, 0] = kind
        for x in range(12):
            a = int(samples[y, x - 3]) if x >= 3 else 0
            b = int(samples[y - 1, x]) if y else 0
            c = int(samples[y - 1, x - 3]) if y and x >= 3 else 0
            near = a + b - c
            paeth = a if abs(near - a) <= abs(near - b) and abs(near - a) <= abs(near - c) else b if abs(near - b) <= abs(near - c) else c
            rows[y, x + 1] = (int(samples[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256
    assert (media.unfilter(rows, 3) == samples).all()
    data = bytearray(media.encode_png(samples))
    data[45] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media.decode_png(bytes(data))
    with pytest.raises(ValueError, match="signature"):
        media.decode_png(b"GIF89a")


def test_media_round_trip(docs, odd, none):
    for frame in (docs, odd):
        texts = Counter()
        for r in frame.collect():
            data = (r["text"] or "").encode()
            padded = data + bytes(-len(data) % 64 if data else 64)
            texts[r["doc_id"], len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
        got = media.media_features(media.with_media(frame)).collect()
        assert Counter(tuple(r)[:5] for r in got) == texts
        assert all(len(r["feature"]) == 16 for r in got)
    assert media.media_features(media.with_media(none)).count() == 0


def test_cosine_hash_stands_small_changes():
    rng = np.random.default_rng(4)
    image = np.cumsum(rng.integers(0, 9, (200, 64)), axis=0).astype(np.uint8) // 4
    noisy = image.copy()
    noisy[rng.integers(0, 200, 20), rng.integers(0, 64, 20)] ^= 3
    bits = lambda x: np.unpackbits(np.frombuffer(media.cosine_hash(x), np.uint8))
    assert (bits(image) != bits(noisy)).sum() <= 4


# toxicity


LEXICON = toxicity.Lexicon({"idiot": 3.0}, {"lowei": 2.0})


def test_clause_patterns():
    def kinds(t):
        return ["+".join(toxicity.marked(k)) or "insult" for k, _ in toxicity.clause_matches(*toxicity.clause_symbols(t, LEXICON))]

    assert kinds("you are an idiot") == ["targeted"] and kinds("idiot, you") == ["targeted"]
    assert kinds("the idiot house") == ["insult"] and kinds("a loweixyz thing") == ["insult"]
    assert kinds("that is not an idiot") == ["negated"] and kinds("quoted was idiot") == ["reported"]
    assert kinds("you are not an idiot") == ["targeted+negated"] and kinds("she said idiot") == ["targeted+reported"]
    assert kinds("i will kill you") == ["targeted+threat"] and kinds("i will kill time") == [] and kinds("lowei") == []


def test_composed_machine_equals_its_definition():
    rng = np.random.default_rng(9)
    for _ in range(2000):
        symbols = rng.choice(6, int(rng.integers(0, 14)), p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1]).tolist()
        want = []
        for i, x in enumerate(symbols):
            if x not in (toxicity.INSULT, toxicity.THREAT):
                continue
            near = symbols[max(0, i - 4) : i] + symbols[i + 1 : i + 5]
            marks = toxicity.TARGETED * (toxicity.TARGET in near) | toxicity.NEGATED * (toxicity.NEGATION in symbols[max(0, i - 3) : i]) | toxicity.REPORTED * (toxicity.REPORT in symbols[:i])
            if x == toxicity.INSULT or marks & toxicity.TARGETED:
                want.append((x | marks, float(i)))
        assert toxicity.clause_matches(symbols, [float(i) for i in range(len(symbols))]) == want


def test_scanner_equals_a_scan_of_every_clause():
    rng, words = np.random.default_rng(10), "idiot loweiss lowei you not said kill the house it's ÉTÉ idiots".split()
    scanner = toxicity.Scanner(LEXICON)
    for _ in range(300):
        text = " ".join(str(rng.choice(words)) + str(rng.choice(["", "", "", ".", "!", "\n", ":"])) for _ in range(int(rng.integers(0, 60))))
        want = np.zeros(len(toxicity.KINDS))
        for clause in re.split(r"[.!?;:\n]", text.lower()):
            for kind, weight in toxicity.clause_matches(*toxicity.clause_symbols(clause, LEXICON)):
                want[toxicity.KINDS.index(kind)] += weight
        assert np.allclose(scanner.features(text), want), text
    far = toxicity.Scanner(LEXICON).features("he said " + "word " * 500 + "idiot")
    assert far[toxicity.KINDS.index(toxicity.INSULT | toxicity.REPORTED)] == 3.0 and far.sum() == 3.0


def test_every_kind_moves_the_score():
    model = toxicity.Model(LEXICON, {n: b for n, (b, _, _) in toxicity.ARCS.items()}, -2.0, 2.0)
    rate = lambda t: float(model.scores(toxicity.Scanner(LEXICON).features(t)[None])[0])
    bare = rate("the idiot house")
    assert rate("you idiot") > bare > rate("that is no idiot") and bare > rate("quoted was idiot") > rate("the house")
    assert rate("i kill you") > rate("i kill time") == rate("") and rate("i will not kill you") < rate("i will kill you")


def test_arcs_are_learned_within_their_bounds():
    rng, learned = np.random.default_rng(11), []
    for share in (0.0, 0.8):  # of negated insults that are toxic
        kinds, toxic = np.zeros((600, len(toxicity.KINDS))), np.zeros(600)
        for i in range(600):
            kind = int(rng.choice([toxicity.INSULT, toxicity.INSULT | toxicity.NEGATED, toxicity.INSULT | toxicity.TARGETED, 0]))
            if kind:
                kinds[i, toxicity.KINDS.index(kind)] = 3.0
                toxic[i] = rng.random() < (share if kind & toxicity.NEGATED else 0.9)
        arcs, _, slope = toxicity.fit(kinds, toxic)
        assert arcs["reported"] == toxicity.ARCS["reported"][0] and slope > 0
        assert all(low <= arcs[n] <= high for n, (_, low, high) in toxicity.ARCS.items())
        learned.append(arcs["negated"])
    assert learned[0] < learned[1]


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").select("lang", "score", "predicted", "toxic").toPandas()
    toxic, clean = got[got["toxic"] == 1], got[got["toxic"] == 0]
    print(toxic.groupby("lang")["predicted"].agg(["mean", "size"]), clean.groupby("lang")["predicted"].agg(["mean", "size"]))
    assert toxic["predicted"].mean() >= 0.9 and clean["predicted"].mean() <= 0.02
    assert (toxic.groupby("lang")["predicted"].mean() >= 0.9).all()
    held = {r["doc_id"]: r["held_out"] for r in docs.limit(5).select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out")).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in held.items())


def test_toxicity_odd_rows(odd, none, labels):
    assert toxicity.toxicity(odd, labels.limit(0)).count() == odd.count()
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.without_toxic(odd, labels).columns == odd.columns
    own = odd.withColumn("score", F.lit("own")).withColumn("toxicity_score", F.lit(1))
    assert [tuple(r)[-2:] for r in toxicity.without_toxic(own, labels).collect()] == [("own", 1)] * odd.count()


def test_templates_are_json(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r in html_extract.templates(pages).collect():
        assert set(json.loads(r["template"])) == {"steps", "texts", "slots"}
