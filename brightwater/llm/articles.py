"""Main text of web pages by equivalence classes of template tokens.

1. Every page is a sequence of tokens: structural tags by their path, and text blocks by path and
   content. Per host, a token's occurrence vector (how often it stands in each page) is kept as a
   fingerprint that adds up over pages. Tokens with equal vectors form an equivalence class.
   Equal pages of a host count once.
2. A class is valid if enough pages have it. Valid classes nest by path and make up the host's template: tags that
   all pages share span the slots, and text in every page belongs to the template, not to the content.
3. The dense slot is the deepest template element, standing once in each page, that holds nearly all
   text outside menus, adverts and the like. The main slot is the article or main element around it; without one, the
   smallest template element with all such text, where text that other pages have at the same place is none of it. What
   a page has outside the main slot still counts where the slot is no article, or holds less than half of the page.

Hosts with too few pages use the template of all pages together.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.llm.frames import ready, registered, table
from brightwater.llm.markup import events
from brightwater.plans.scratch import written
from brightwater.plans.skew import small

#: A host's own template needs this many pages; its classes this share of them.
LEAST_PAGES = 4
SUPPORT = 0.5
#: Text counts as template if it stands once in this share of at least so many pages, beside different other text.
TEXT_SUPPORT = 0.95
TEXT_PAGES = 20
#: The dense slot holds this share of the text outside menus and the like.
MAIN_SHARE = 0.9

#: Elements that never hold the article, and words in classes and ids that say the same.
ASIDE_TAGS = frozenset(
    "aside button canvas dialog fieldset footer form head iframe menu nav noscript object select svg template title video "
    "audio".split()
)
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "discussion disqus footer login menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted "
    "related replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Last words that leave an aside one, and first words that deny it.
PARTS_OF_ASIDES = frozenset(
    "area articles bar block box button buttons container form icons inner item items left link links list outer panel posts right "
    "section slot stories text title unit widgets wrap wrapper".split()
)
NEGATIONS = frozenset("has hide hidden no non not with without".split())
_PARTS = re.compile(r"[.#]")
_WORDS = re.compile(r"[-_]+")
_DIGITS = re.compile(r"\d+")


@lru_cache(maxsize=100_000)
def _marked(element: str) -> bool:
    """Whether a class, id or role names an aside: as a whole, or by its last word that says more than `box` or `list`."""
    name, *marks = _PARTS.split(element)
    if name in ("html", "body", "main", "article"):
        return False
    for mark in marks:
        words = [w for w in _WORDS.split(mark) if w]
        if words and words[0] in NEGATIONS:
            continue
        while len(words) > 1 and words[-1] in PARTS_OF_ASIDES:
            words.pop()
        if words and words[-1] in ASIDE_WORDS:
            return True
    return False


def is_aside(path: str, opened: frozenset[str] = frozenset()) -> bool:
    """Whether any element of a path is a menu, header, footer, sidebar, notice, advert, form or comment.

    Names of ``opened`` elements tell nothing.
    """
    inside = False
    at = 0
    for element in path.split("/")[1:]:
        at += len(element) + 1
        name = _PARTS.split(element)[0]
        if name in ASIDE_TAGS or name == "header" and not inside:
            return True
        if _marked(element) and path[:at] not in opened:
            return True
        inside |= name in ("article", "main")
    return False


def wrappers(chars: dict[str, int], places) -> frozenset[str]:
    """Elements named like asides that hold the content: a main element, or most text with no headline or article outside."""
    named = [p for p in places if _marked(p.rpartition("/")[2])]
    if not named:
        return frozenset()
    everywhere = frozenset(named)
    shown = {p: n for p, n in chars.items() if not is_aside(p, everywhere)}
    total = sum(shown.values())
    heads = [p for p in places if _PARTS.split(p.rpartition("/")[2])[0] in ("main", "article", "h1", "h2") and not is_aside(p, everywhere)]
    opened: set[str] = set()
    for p in sorted(named, key=lambda p: p.count("/")):
        own = sum(n for q, n in shown.items() if _within(q, p))
        mains = any(_within(q, p) and _PARTS.split(q.rpartition("/")[2])[0] == "main" for q in heads)
        outside = any(not _within(q, p) and not is_aside(q, frozenset(opened)) for q in heads)
        if mains or 2 * own > total and not outside:
            opened.add(p)
    return frozenset(opened)


def _shown(page: str):
    """The events of a page and its wrappers."""
    found = list(events(page))
    chars: dict[str, int] = defaultdict(int)
    for kind, path, value in found:
        if kind == "text":
            chars[path] += len(block_text(value))
    return found, wrappers(chars, {path for kind, path, _ in found if kind == "open"})


def block_text(value: str) -> str:
    return " ".join(value.split())


def text_token(path: str, value: str) -> str:
    return f"{path} {xxhash.xxh3_64_hexdigest(block_text(value))}"


def place_token(path: str, value: str) -> str:
    """Like ``text_token``, for text that differs in digits only, as dates and counters do."""
    return f"{path} ~{xxhash.xxh3_64_hexdigest(_DIGITS.sub('', block_text(value)))}"


def _article(path: str) -> str | None:
    """The outermost article or main element of a path."""
    at = 0
    for element in path.split("/")[1:]:
        at += len(element) + 1
        if _PARTS.split(element)[0] in ("article", "main"):
            return path[:at]
    return None


def _page_tokens(page: str) -> dict[str, list[int]]:
    """Token to [occurrences, characters of text directly in it, hash of the page's other text for text tokens]."""
    found: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    blocks, places = [], []
    found_events, opened = _shown(page)
    for kind, path, value in found_events:
        if kind == "open":
            found[path][0] += 1
        elif kind == "close":
            found[path + " /"][0] += 1
        else:
            found[path][1] += len(block_text(value))
            token = text_token(path, value)
            own = found[token]
            own[0] += 1
            own[1] += len(block_text(value))
            aside = is_aside(path, opened)
            blocks.append((token, 0 if aside else int(token[-8:], 16)))
            if not aside and _article(path) is None:
                place = place_token(path, value)
                own = found[place]
                own[0] += 1
                own[1] += len(block_text(value))
                places.append((place, blocks[-1][1]))
    total = sum(h for _, h in blocks)
    for token, own in blocks:
        found[token][2] = (total - own * found[token][0]) & 0x7FFFFFFF
    for token, own in places:  # only those that stand once are looked at
        found[token][2] = (total - own) & 0x7FFFFFFF
    return found


def _tokens(batches):
    """Per batch and host: fingerprint, pages, occurrences, characters, most occurrences and other text per token."""
    for batch in batches:
        held: dict[tuple[str, str], list[int]] = {}
        pages: dict[str, int] = defaultdict(int)
        for host, row, page in zip(*(c.to_pylist() for c in batch.columns)):
            pages[host] += 1
            for token, (count, chars, beside) in _page_tokens(page).items():
                own = held.setdefault((host, token), [0, 0, 0, 0, 0, beside, beside])
                if count:
                    own[0] ^= xxhash.xxh3_64_intdigest(f"{row} {count}".encode())
                    own[1] += 1
                own[2] += count
                own[3] += chars
                own[4] = max(own[4], count)
                own[5] = min(own[5], beside)
                own[6] = max(own[6], beside)
        for host, count in pages.items():
            held[host, "*"] = [0, count, count, 0, 1, 0, 0]
        values = list(held.values())
        yield pa.record_batch(
            {
                "host": pa.array([h for h, _ in held], pa.string()),
                "token": pa.array([t for _, t in held], pa.string()),
                "vector": pa.array([v[0] - (1 << 63) for v in values], pa.int64()),
                **{
                    name: pa.array([v[k] for v in values], pa.int64())
                    for k, name in ((1, "pages"), (2, "count"), (3, "chars"), (4, "most"))
                },
                **{name: pa.array([v[k] for v in values], pa.int32()) for k, name in ((5, "low"), (6, "high"))},
            }
        )


class Template:
    """The template of a host from its tokens, and the main slot."""

    def __init__(self, tokens: list[tuple[str, int, int, int, int, int]], pages: int, lone: frozenset[str] = frozenset()):
        """tokens: (token, vector, pages, count, chars, most); ``lone`` texts always stand beside the same other text."""
        classes = defaultdict(list)
        for token, vector, support, count, _, most in tokens:
            if support >= SUPPORT * pages:
                classes[vector, support, count].append((token, most))
        #: valid classes, widest support first: the outer ones come before those nested in their slots
        self.classes = [sorted(members) for _, members in sorted(classes.items(), key=lambda c: (-c[0][1], c[0][0]))]
        once = {t for members in self.classes for t, most in members if most == 1}
        enough = {t for t, _, support, *_ in tokens if support >= TEXT_SUPPORT * pages and pages >= TEXT_PAGES}
        #: text blocks that belong to the template
        self.texts = sorted(t for t in (once & enough) - lone if " " in t and " ~" not in t and not t.endswith(" /"))
        elements = {t for t in once if " " not in t}
        chars = {t: c for t, _, _, _, c, _ in tokens if c and " " not in t}
        self.opened = wrappers(chars, {t for t, *_ in tokens if " " not in t and t.startswith("/")})
        self.dense = self._slot(tokens, elements, set(self.texts), MAIN_SHARE)
        article = _article(self.dense or "")
        #: the main slot, and the element to look for in pages of other hosts
        self.main, self.likely = article or self.dense, article or self.dense
        if self.dense and not article:
            often = {t for t, _, support, *_ in tokens if support >= TEXT_SUPPORT * pages and pages >= LEAST_PAGES}
            places = {t for t in (once & often) - lone if " ~" in t and not _within(t.partition(" ")[0], self.dense)}
            self.main = self._slot(tokens, elements, {t for t in self.texts if _within(t.partition(" ")[0], self.dense)} | places, 1) or self.dense
            self.texts = sorted({*self.texts, *places})

    def _slot(self, tokens, elements: set[str], known: set[str], share: float) -> str | None:
        """The deepest element with a share of the text that is neither aside nor known."""
        inside: dict[str, int] = defaultdict(int)
        total = 0
        for token, _, _, _, chars, _ in tokens:
            path, _, text = token.partition(" ")
            if not chars or text and token not in known or is_aside(path, self.opened):
                continue
            own = -chars if text else chars  # template text is not content
            total += own
            parts = path.split("/")
            for k in range(1, len(parts) + 1):
                inside["/".join(parts[:k])] += own
        fits = [t for t in elements if not is_aside(t, self.opened) and inside[t] >= share * total and not _is_leaf(t)]
        return max(fits, key=lambda t: (t.count("/"), inside[t], t)) if total and fits else None


def _within(path: str, slot: str) -> bool:
    return path == slot or path.startswith(slot + "/")


def _is_leaf(path: str) -> bool:
    name = _PARTS.split(path.rpartition("/")[2])[0]
    return name in ("p", "li", "pre", "td", "th", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "head", "html")


def extract(
    page: str, main: str | None, template_texts: frozenset[str] | set[str] = frozenset(), own: bool = False
) -> str:
    """The blocks of a page without asides and template text, one per line.

    They stand in the main slot. With a template of the page's ``own`` host, which knows its texts, those outside
    stay too, unless the slot is an article that holds at least half of the page's text.
    """
    blocks = []
    found_events, opened = _shown(page)
    places = {path for kind, path, _ in found_events if kind == "open"}
    if main in places:
        opened |= {main[: m.start()] for m in re.finditer("/", main)} | {main}
    for kind, path, value in found_events:
        if kind == "text" and not is_aside(path, opened):
            text = block_text(value)
            if text and text_token(path, text) not in template_texts and place_token(path, text) not in template_texts:
                blocks.append((path, text))
    found = main in places
    if not found:
        main = _likely(places, opened)
    inside = [text for path, text in blocks if main is None or _within(path, main)]
    if own and found and len(inside) < len(blocks):
        whole = [text for _, text in blocks]
        if _article(main) is None or 2 * sum(map(len, inside)) < sum(map(len, whole)):
            inside = whole
    return "\n".join(inside)


def _likely(places: set[str], opened: frozenset[str] = frozenset()) -> str | None:
    """Where the article is in a page that lacks the template's main slot."""
    for name in ("article", "main", "body"):
        found = [p for p in places if _PARTS.split(p.rpartition("/")[2])[0] == name and not is_aside(p, opened)]
        if found:
            return min(found, key=lambda p: (p.count("/"), p))
    return None


def _templates(batches):
    for batch in batches:
        found = []
        hosts = batch.column(0).to_pylist()
        for tokens in batch.column(1).to_pylist():
            pages = next((t["pages"] for t in tokens if t["token"] == "*"), 0)
            rows = [
                (t["token"], t["vector"], t["pages"], t["count"], t["chars"], t["most"]) for t in tokens if t["token"] != "*"
            ]
            lone = frozenset(t["token"] for t in tokens if t["low"] == t["high"])
            found.append(Template(rows, pages, lone))
        yield pa.record_batch(
            {
                "host": batch.column(0),
                "main": pa.array([t.likely if h is None else t.main for h, t in zip(hosts, found)], pa.string()),
                "texts": pa.array([t.texts for t in found], pa.list_(pa.string())),
            }
        )


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, row, page) with every page content of a host once, under its hash.

    Only contents that a host has twice or more are shuffled, after each task has reduced its own.
    """
    seen = pages.select("host", F.xxhash64("host", "page").alias("row"), "page")
    copied = seen.groupBy("host", "row").count().where("count > 1").select("host", "row")
    copied = small(written(copied, "copied"))
    firsts = seen.join(copied, ["host", "row"], "left_semi").groupBy("host", "row").agg(F.first("page").alias("page"))
    return seen.join(copied, ["host", "row"], "left_anti").unionByName(firsts)


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, texts) for every host with enough different pages, and for host null over all pages.

    ``pages`` has (host, page). Only tokens in at least SUPPORT of a host's pages, and elements with
    text in so many, meet in one row; they are as many as a page or two have.
    """
    counted = distinct_pages(pages).select("host", "row", "page").mapInArrow(
        _tokens, "host string, token string, vector long, pages long, count long, chars long, most long, low int, high int"
    )
    sums = [
        F.bit_xor("vector").alias("vector"),
        *[F.sum(c).alias(c) for c in ("pages", "count", "chars")],
        *[F.max(c).alias(c) for c in ("most", "high")],
        F.min("low").alias("low"),
    ]
    by_host = written(counted.groupBy("host", "token").agg(*sums), "tokens")
    overall = by_host.groupBy("token").agg(*sums).withColumn("host", F.lit(None).cast("string"))
    every = by_host.unionByName(overall)
    sizes = every.where("token = '*'").select(F.col("host").alias("h"), F.col("pages").alias("size"))
    wide = (
        every.join(sizes, F.col("host").eqNullSafe(F.col("h")))
        .where((F.col("pages") >= F.col("size") * SUPPORT) & ((F.col("size") >= LEAST_PAGES) | F.col("host").isNull()))
        .groupBy("host")
        .agg(F.collect_list(F.struct("token", "vector", "pages", "count", "chars", "most", "low", "high")).alias("tokens"))
    )
    return written(wide.mapInArrow(_templates, "host string, main string, texts array<string>"), "templates")


def _extracted(fallback):
    def run(batches):
        for batch in batches:
            texts = []
            for page, main, known in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                used = (main, known) if main is not None else fallback
                texts.append(extract(page, used[0], set(used[1] or ()), main is not None))
            yield pa.record_batch(
                {
                    "__key": batch.column(0),
                    "url": batch.column(1),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                }
            )

    return run


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars): the article of every page.

    The whole html is read. Character references are decoded, white space in a block becomes one space,
    blocks are joined by newlines; a page without article text has an empty one. Pages are grouped by the
    host of their url; a null url, or one without host, counts as a host of its own name. A null html is empty.
    Rows are pages of their own whatever their keys; repeated rows give repeated results. Other columns
    are not read; an empty table gives an empty result.
    """
    ready(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^/?#]*://([^/?#]*)", 1))
    rows = pages.select(
        F.col(key).alias("__key"),
        F.col(url).alias("url"),
        host.alias("host"),
        F.coalesce(F.col(html), F.lit("")).alias("page"),
    )
    found = templates(rows.select("host", "page"))
    overall = found.where("host is null").first()
    fallback = (overall.main, list(overall.texts)) if overall else (None, [])
    own = small(found.where("host is not null and main is not null"))
    kind = pages.schema[key].dataType.simpleString()
    text = pages.schema[url].dataType.simpleString()
    result = (
        rows.join(own, "host", "left")
        .select("__key", "url", "page", "main", "texts")
        .mapInArrow(
            _extracted(fallback), f"__key {kind}, url {text}, text string, n_chars long"
        )
    )
    return result.select(F.col("__key").alias(key), "url", "text", "n_chars")


@registered("op2_template_extraction")
def template_extraction(spark, folder):
    """The main text of every page."""
    return main_texts(table(spark, folder, "pages"))
