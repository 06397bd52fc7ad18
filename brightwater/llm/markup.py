"""A small tolerant HTML scanner: text blocks under paths of structural elements."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Elements that shape a page; all others (links, emphasis and the like) only mark text up.
STRUCTURAL = frozenset(
    "address article aside blockquote body button canvas dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header html iframe legend li main menu nav noscript object ol p pre section select "
    "summary svg table tbody td template tfoot th thead title tr ul video audio".split()
)
#: Elements whose content is not markup.
RAW = frozenset("script style textarea xmp".split())
#: Elements that an opening tag of the same kind closes, up to the element that may hold them.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Structural elements that may stand inside a paragraph.
IN_PARAGRAPH = frozenset("button canvas iframe noscript object select svg template video audio".split())

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.DOTALL,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")


def label(name: str, rest: str) -> str:
    """An element with its classes and id, digits left out; equal for the same place of a template."""
    if "=" not in rest:
        return name
    marks = []
    for kind, *values in _NAMED.findall(rest):
        value = next((v for v in values if v), "")
        marks += [("#" if kind.lower() == "id" else ".") + _DIGITS.sub("", v.lower()) for v in value.split()]
    return name + "".join(m.replace("/", "") for m in marks)


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open" | "close" | "text", path, value) in page order.

    A path is the labels of the open structural elements, joined by "/". Text is decoded and stands between
    structural tags; white space is as in the page, a line break is a space.
    """
    names: list[str] = []
    paths: list[str] = [""]
    held: list[str] = []
    at = 0

    def flush():
        if held:
            text = "".join(held)
            held.clear()
            if text.strip():
                yield "text", paths[-1], text

    def pop():
        names.pop()
        return "close", paths.pop(), ""

    while at < len(page):
        found = _TOKEN.search(page, at)
        end = found.start() if found else len(page)
        if end > at:
            held.append(html.unescape(page[at:end]))
        if not found:
            break
        at = found.end()
        if found["name"] is None:
            continue
        name = found["name"].lower()
        if name in RAW and not found["close"]:
            stop = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(page, at)
            at = stop.start() if stop else len(page)
            if name == "textarea":
                held.append(" ")
            continue
        if name not in STRUCTURAL:
            if name in ("br", "hr", "wbr", "img", "input"):
                held.append(" ")
            continue
        yield from flush()
        if found["close"]:
            if name in names:
                while names[-1] != name:
                    yield pop()
                yield pop()
            continue
        if "p" in names and name not in IN_PARAGRAPH and not set(names[names.index("p") + 1 :]) & {"button", "object"}:
            while "p" in names:
                yield pop()
        if name in SIBLINGS:
            same, holders = SIBLINGS[name]
            inner = max((k for k, n in enumerate(names) if n in holders), default=-1)
            if set(names[inner + 1 :]) & same:
                while len(names) > inner + 1:
                    yield pop()
        names.append(name)
        paths.append(f"{paths[-1]}/{label(name, found['rest'])}")
        yield "open", paths[-1], ""
        if found["rest"].endswith("/") and name in ("iframe", "svg", "canvas"):
            yield pop()
    yield from flush()
