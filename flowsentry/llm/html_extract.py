"""Main text of web pages by template deduction from equivalence classes.

Pages of one host come from a few templates. Every page is read into tokens: element paths (tag and class from the root)
and text blocks under their path. Over a host's pages each token has an occurrence vector, its count on each page;
tokens with equal vectors form an equivalence class. A vector is kept as an order-free sum of digests of (page, count),
so classes come from one aggregation that combines in each task, and a host with a third of all pages is no hot spot;
rows that repeat a page add alike to all of its tokens.
Only tokens on at least half of a host's pages can belong to its template, so a host's template is bounded by twice its
mean page. A second pass tests the classes: one is valid if its tokens come in one order on all pages, in equal rounds,
and if no round of it crosses one of a weightier class. The valid classes' elements are the host's skeleton, whose gaps
are the slots; valid classes' texts are chrome. Slots are then told apart over all pages of the host: by the articles'
text in them, else by their share of links. A slot's size is no reason to drop it.

The page's text: blocks in the article's slots, without menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments; references decoded, white space folded, blocks joined by one blank.

Edge cases: null or empty html gives an empty text; pages of hosts with too few pages for a template (and null urls) are
judged by roles and their own text alone, and so are pages without a block in the content slots; repeated rows give repeated results; unclosed, stray and unknown tags are read
as browsers read them; nothing is cut.
"""

from __future__ import annotations

import html as html_lib
import json
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import checked_broadcast, durable

#: Pages a host needs for a template, the share of them a template token is on, and the share of linked text from which a slot is none of content.
LEAST_PAGES, SHARE, LINK_SHARE = 4, 0.5, 0.5

# Element names by what a browser does with them, and words in class, id and role names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math canvas object xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "optgroup": ("select",)}
CHROME = frozenset("nav footer aside form menu dialog select button head".split())
CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer header masthead topbar cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies discussion pagination pager toolbar complementary contentinfo search".split())
ARTICLE_WORDS = frozenset("article post entry story articlebody postbody entrycontent postcontent main maincontent".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
#: The start of a tag or comment that the page's end leaves unfinished.
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
#: Words beside chrome words in the class names of chrome ("cookie-box"), and last words that make any name one of chrome ("post-comments").
PLAIN_WORDS = frozenset("area bar block bottom box button buttons container global inner item items left link links list outer page primary right secondary section site top wrap wrapper".split())
CHROME_ENDS = frozenset("ads adverts advertisement advertising breadcrumb breadcrumbs comments commentlist disqus menu menubar nav navbar navigation newsletter pagination pager sidebar sidebars".split())

_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_INVISIBLE = re.compile(r"(?i)\bdisplay\s*:\s*none")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block:
    __slots__ = ("path", "chrome", "article", "text", "linked")

    def __init__(self, path: str, chrome: bool, article: bool, text: str, linked: int):
        self.path, self.chrome, self.article, self.text, self.linked = path, chrome, article, text, linked


def is_chrome_name(name: str, in_article: bool) -> bool:
    """Whether a whole class, id or role name is one of chrome: a chrome word, chrome words among plain ones, or any name with an unmistakable last word."""
    parts = [w.lower() for w in _PART.findall(name)]
    if in_article and parts == ["header"]:
        return False
    if name.lower() in CHROME_WORDS or (parts and parts[-1] in CHROME_ENDS):
        return True
    return any(w in CHROME_WORDS for w in parts) and all(w in CHROME_WORDS or w in PLAIN_WORDS for w in parts)


def _role(tag: str, attributes: str, in_article: bool) -> tuple[str, bool, bool]:
    """(step of the path, is chrome, is an article) of an element."""
    step, chrome, article = tag, tag in CHROME or (tag == "header" and not in_article), tag in ("article", "main")
    if attributes:
        values = {k.lower(): a or b or c for k, a, b, c in reversed(_ATTRIBUTE.findall(attributes))}
        names = [w for k in ("class", "id", "role") for w in values.get(k, "").split()]
        if names and tag not in ("html", "body"):
            chrome |= not article and any(is_chrome_name(w, in_article) for w in names)
            article |= not chrome and any(w in ARTICLE_WORDS for n in names for w in (n.lower(), *(x.lower() for x in _PART.findall(n))))
        if "class" in values:
            step = f"{tag}.{'.'.join(values['class'].split())}"
        hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or bool(_INVISIBLE.search(values.get("style", "")))
        chrome |= tag not in ("html", "body") and hidden
    return step, chrome, article and not chrome


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order, each with the path and roles of the elements around it."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, chrome, article
    words: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if words:
            text = " ".join(html_lib.unescape("".join(words)).split())
            words.clear()
            if text:
                _, path, chrome, article = stack[-1]
                out.append(Block(path, chrome, article, text, min(linked, len(text))))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            words.append(text)
            if in_link:
                linked += len(text)

    last = html.rfind(">") + 1  # no tag ends behind it; what is unfinished there is dropped, as browsers do
    unfinished = _UNFINISHED.search(html, last)
    html = html[: unfinished.start()] if unfinished else html
    while m := _TOKEN.search(html, at, last):
        add(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = False
            if tag == "br":
                add(" ")
            if tag in INLINE and all(t != tag for t, *_ in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    flush()
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"(?i)</{tag}\s*>").search(html, at)
            add(" ")
            at = end.end() if end else len(html)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            add(" ")
            continue
        _, path, chrome, article = stack[-1]
        step, is_chrome, is_article = _role(tag, m[3], article)
        if tag in INLINE:
            if tag == "a":
                in_link = True
            if not is_chrome or chrome:
                continue
        flush()
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        elif tag in SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SAME[tag]:
                    break
                if stack[i][0] == tag or (tag, stack[i][0]) in (("dt", "dd"), ("dd", "dt"), ("td", "th"), ("th", "td")):
                    del stack[i:]
                    break
        _, path, chrome, article = stack[-1]
        stack.append((tag, f"{path}/{step}", chrome or is_chrome, (article or is_article) and not is_chrome))
    add(html[at:])
    flush()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?i)(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url) if isinstance(url, str) else None
    return m[1].lower() if m else ""


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def text_key(path: str, text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{path}\n{text}"))


TOKEN_SCHEMA = "host string, kind string, token string, pages long, total long, low long, high long, chars long, linked long, article long"
ORDER_SCHEMA = "host string, class long, other long, low long, high long"


def _page_tokens(found: list[Block]) -> list[tuple[str, str]]:
    """The page's (kind, token) in order: each block's element path, then its text under that path."""
    return [t for b in found for t in (("p", b.path), ("x", str(text_key(b.path, b.text))))]


def _tokens(pages: DataFrame) -> DataFrame:
    """Partial sums of each batch for every (host, token); kind p: an element path, x: a text under a path, h: the host itself."""
    names = [x.split()[0] for x in TOKEN_SCHEMA.split(", ")]

    def count(batches):
        for batch in batches:
            sums: dict[tuple, list] = {}
            for page, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                host = host_of(url)
                if not host:
                    continue
                found = blocks(html if isinstance(html, str) else "")
                mine: dict[tuple[str, str], list] = {("h", ""): [1, 0, 0, 0]}
                for i, token in enumerate(_page_tokens(found)):
                    b, x = found[i // 2], mine.setdefault(token, [0, 0, 0, 0])
                    x[0] += 1
                    if token[0] == "p" and not b.chrome:
                        x[1] += len(b.text)
                        x[2] += b.linked
                        x[3] += len(b.text) * b.article
                for (kind, token), (n, *sizes) in mine.items():
                    x = sums.setdefault((host, kind, token), [0, 0, 0, 0, 0, 0, 0])
                    digest = xxhash.xxh64_intdigest(f"{page}:{n}")
                    for i, v in ((0, 1), (1, n), (2, digest & 0x7FFFFFFF), (3, digest >> 33), *enumerate(sizes, 4)):
                        x[i] += v
            yield pd.DataFrame([(*k, *x) for k, x in sums.items()], columns=names)

    return pages.select("page_id", "url", "html").mapInPandas(count, TOKEN_SCHEMA)


def orders(found: list[Block], classes: dict[str, int]) -> tuple[dict[int, tuple[int, ...]], set[tuple[int, int]]]:
    """(order of each class on a page, pairs of classes whose spans cross); classes: class by kind and token.

    The order is that of one round if the tokens come in equal rounds, else all of them, which differs from every round
    of a valid class. A span is a round of a class, from its first token to its last."""
    at: dict[int, list[tuple[int, str]]] = {}
    for i, (kind, token) in enumerate(_page_tokens(found)):
        c = classes.get(kind + token)
        if c is not None:
            at.setdefault(c, []).append((i, token))
    order, spans = {}, []
    for c, places in at.items():
        tokens = [t for _, t in places]
        size = len(set(tokens))
        cyclic = tokens == tokens[:size] * (len(tokens) // size)
        order[c] = _signed(xxhash.xxh64_intdigest("\n".join(tokens[:size] if cyclic else [*tokens, ""])))
        if cyclic and size > 1:
            spans += [(places[i][0], places[i + size - 1][0], c) for i in range(0, len(places), size)]
    crossing, around = set(), []
    for first, last, c in sorted(spans):
        around = [x for x in around if x[0] >= first]
        crossing |= {(min(c, o), max(c, o)) for end, o in around if end < last and o != c}
        around.append((last, c))
    return order, crossing


def _orders(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Partial sums of each batch of the order and nesting tests: (host, class, -1, least and greatest order), and (host, class, other, 0, 0) of crossing classes."""
    names = [x.split()[0] for x in ORDER_SCHEMA.split(", ")]
    rows = pages.select("html", host_column().alias("host")).join(checked_broadcast(candidates, 20_000, "classes"), "host")

    def test(batches):
        known: dict[str, dict] = {}
        for batch in batches:
            seen: dict[tuple, list] = {}
            for host, html, packed in zip(batch["host"], batch["html"], batch["classes"], strict=True):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = dict(x.rsplit("\n", 1) for x in packed)
                    known[host] = {k: int(v) for k, v in known[host].items()}
                order, crossing = orders(blocks(html if isinstance(html, str) else ""), known[host])
                for c, v in order.items():
                    x = seen.setdefault((host, c, -1), [v, v])
                    x[:] = min(x[0], v), max(x[1], v)
                for c, other in crossing:
                    seen[host, c, other] = [0, 0]
            yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=names)

    found = rows.mapInPandas(test, ORDER_SCHEMA)
    return found.groupBy("host", "class", "other").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def valid_classes(tokens: pd.DataFrame, tests: pd.DataFrame) -> set[int]:
    """Classes whose tokens keep one order on all pages and whose spans never cross those of a class on more pages or with more tokens."""
    order = tests[tests["other"] == -1]
    valid = set(order.loc[order["low"] == order["high"], "class"])
    weight = {c: (group["pages"].iloc[0], len(group), c) for c, group in tokens.groupby("class")}
    rivals: dict[int, list[int]] = {}
    for a, b in tests.loc[tests["other"] != -1, ["class", "other"]].itertuples(index=False):
        rivals.setdefault(a, []).append(b)
        rivals.setdefault(b, []).append(a)
    kept: set[int] = set()
    for c in sorted(valid, key=weight.get, reverse=True):
        if not any(o in kept for o in rivals.get(c, ())):
            kept.add(c)
    return kept


def deduce(tokens: pd.DataFrame, tests: pd.DataFrame) -> dict:
    """The template of one host from its frequent tokens: {steps: the skeleton's paths, texts: keys, slots: content slots}.

    A slot is content if articles' text is in it; on hosts without any, if most of its text is not linked. Skeleton
    elements without frequent text of their own are listed with a question mark: their blocks go by their pages' roles."""
    tokens = tokens[tokens["class"].isin(valid_classes(tokens, tests))]
    paths = tokens[tokens["kind"] == "p"]
    steps = {p for path in paths["token"] for p in _prefixes(path)}
    rows = list(paths.itertuples())
    if any(r.article for r in rows):
        slots = {r.token for r in rows if r.article}
    else:
        slots = {r.token for r in rows if r.linked < LINK_SHARE * r.chars}
    open_ = {"?" + p for p in (steps | {""}) - set(paths["token"])}
    return {"steps": sorted(steps), "texts": sorted(set(tokens.loc[tokens["kind"] == "x", "token"])), "slots": sorted(slots | open_)}


def _prefixes(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(2, len(parts) + 1)]


def slot_of(path: str, steps: set[str]) -> str:
    """The deepest element of the skeleton around a path."""
    while path and path not in steps:
        path = path.rpartition("/")[0]
    return path


def host_column():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) for every host with enough pages; template is JSON."""
    sums = _tokens(pages).groupBy("host", "kind", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "low", "high", "chars", "linked", "article")])
    sums = durable(sums.filter(F.col("pages") >= 2))
    hosts = sums.filter((F.col("kind") == "h") & (F.col("pages") >= LEAST_PAGES)).select("host", F.col("pages").alias("n_pages"))
    frequent = sums.filter("kind <> 'h'").join(hosts, "host").filter(F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), F.col("n_pages") * SHARE))
    frequent = durable(frequent.withColumn("class", F.xxhash64("pages", "total", "low", "high")))
    candidates = durable(frequent.groupBy("host").agg(F.collect_list(F.concat("kind", "token", F.lit("\n"), F.col("class").cast("string"))).alias("classes")))

    def build(key: tuple, group: pd.DataFrame, tests: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "template": [json.dumps(deduce(group.sort_values(["kind", "token"]), tests))]})

    return frequent.groupBy("host").cogroup(_orders(pages, candidates).groupBy("host")).applyInPandas(build, "host string, template string")


def main_text(html: str, template: dict | None) -> str:
    """The page's main text; template as read from ``templates`` with sets for lists, or None."""
    found = [b for b in blocks(html) if not b.chrome]
    inside = [b for b in found if b.article]
    if template:
        slotted = [b for b in found if _in_slot(b, template, bool(inside))]
        fresh = [b for b in slotted if str(text_key(b.path, b.text)) not in template["texts"]]
        # A page that is mostly template text is a copy of others, not a form.
        copied = 2 * sum(len(b.text) for b in fresh) < sum(len(b.text) for b in slotted)
        if slotted:
            return " ".join(b.text for b in (slotted if copied else fresh))
    return " ".join(b.text for b in inside or [b for b in found if 2 * b.linked < len(b.text)])


def _in_slot(block: Block, template: dict, has_article: bool) -> bool:
    slot = slot_of(block.path, template["steps"])
    return slot in template["slots"] or ("?" + slot in template["slots"] and (block.article or not has_article))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    found = durable(templates(pages))
    rows = pages.select("page_id", "url", "html", host_column().alias("host")).join(checked_broadcast(found, 20_000, "template"), "host", "left").drop("host")

    def fill(batches):
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for html, packed in zip(batch["html"], batch["template"], strict=True):
                template = None
                if isinstance(packed, str):
                    if packed not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[packed] = {k: set(v) for k, v in json.loads(packed).items()}
                    template = known[packed]
                texts.append(main_text(html, template) if isinstance(html, str) else "")
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return rows.mapInPandas(fill, "page_id long, url string, text string, n_chars long")
