"""Column functions that cut a text into an array of chunks.

The splitting and the greedy packing are array expressions, so documents are cut where they lie
and in full. Packing walks the pieces with ``aggregate``; its state is the finished chunks and the
open one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightwater.functions.text import let, trimmed, words

# The places where a run of terminators ends and other text begins.
_SENTENCE_END = r"(?<=[.!?])(?=[^.!?])"
_NO_CHUNKS = "cast(array() as array<string>)"


def chunk_fixed(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Windows of ``size`` characters every ``size - overlap``; the first to reach the end is last.

    The text is cut into steps once and windows are joined from them; a substring walks from the start of its text.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than the chunk size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(float(step))).cast("int"))
    starts = F.sequence(F.lit(0), last)

    def windows(steps: Column) -> Column:
        met = F.lit(-(-size // step))
        return F.transform(starts, lambda i: F.left(F.array_join(F.slice(steps, i + 1, met), ""), F.lit(size)))

    pieces = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), windows)
    return F.when(F.length(text) > 0, pieces).otherwise(F.expr(_NO_CHUNKS))


def _sentences(text: Column) -> Column:
    """Terminated sentences; text after the last terminator is dropped unless there is none.

    Splitting at the sentence ends is linear in the text; searching for whole sentences would
    rescan a long unterminated tail from each of its characters.
    """
    pieces = F.split(text, _SENTENCE_END)
    whole = F.filter(pieces, lambda p: p.rlike(r"^[^.!?]") & p.rlike(r"[.!?]$"))
    return let(whole, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(text)))


def _start() -> Column:
    return F.struct(F.expr(_NO_CHUNKS).alias("done"), F.lit("").alias("open"))


def _push(done: Column, chunk: Column) -> Column:
    return F.when(chunk == "", done).otherwise(F.concat(done, F.array(chunk)))


def _with_overlap(chunks: Column, overlap: int) -> Column:
    """Prefix every chunk but the first with the end of the previous, already prefixed chunk."""
    if overlap <= 0:
        return chunks

    def add(state: Column, chunk: Column) -> Column:
        tail = F.right(state["open"], F.lit(overlap))
        whole = F.when(F.size(state["done"]) == 0, chunk).otherwise(
            F.concat(tail, F.lit(" "), chunk)
        )
        return F.struct(
            F.concat(state["done"], F.array(whole)).alias("done"), whole.alias("open")
        )

    return F.aggregate(chunks, _start(), add, lambda state: state["done"])


def chunk_sentence(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Sentences packed greedily up to ``size`` characters, then overlapped."""

    def add(state: Column, sentence: Column) -> Column:
        fits = F.length(state["open"]) + F.length(sentence) <= size
        closed = F.when(
            state["open"] == "", state["done"]
        ).otherwise(F.concat(state["done"], F.array(trimmed(state["open"]))))
        return F.struct(
            F.when(fits, state["done"]).otherwise(closed).alias("done"),
            F.when(fits, F.concat(state["open"], sentence)).otherwise(sentence).alias("open"),
        )

    packed = F.aggregate(
        _sentences(text),
        _start(),
        add,
        lambda state: F.when(state["open"] == "", state["done"]).otherwise(
            F.concat(state["done"], F.array(trimmed(state["open"])))
        ),
    )
    chunks = F.filter(_with_overlap(packed, overlap), lambda c: c != "")
    return F.when(F.length(text) > 0, chunks).otherwise(F.expr(_NO_CHUNKS))


def chunk_sentence_simple(text: Column, size: int = 512) -> Column:
    """Sentences joined by an extra space and closed once the next would pass ``size``."""

    def add(state: Column, sentence: Column) -> Column:
        close = (F.length(state["open"]) + F.length(sentence) > size) & (state["open"] != "")
        return F.struct(
            F.when(close, F.concat(state["done"], F.array(trimmed(state["open"]))))
            .otherwise(state["done"])
            .alias("done"),
            F.when(close, sentence)
            .otherwise(F.concat(state["open"], F.lit(" "), sentence))
            .alias("open"),
        )

    packed = F.aggregate(
        _sentences(text),
        _start(),
        add,
        lambda state: _push(state["done"], trimmed(state["open"])),
    )
    return F.when(trimmed(text) != "", packed).otherwise(F.expr(_NO_CHUNKS))


def chunk_paragraph(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Paragraphs packed greedily; an oversize one is cut by ``chunk_fixed``; then overlapped.

    The blank line put between packed paragraphs is not counted when the next one is tried.
    """
    paragraphs = F.filter(F.split(text, r"\n\n+|\r\n\r\n+"), lambda p: trimmed(p) != "")

    def add(state: Column, paragraph: Column) -> Column:
        opened = state["open"]
        fits = F.length(opened) + F.length(paragraph) <= size
        closed = _push(state["done"], trimmed(opened))
        oversize = F.length(paragraph) > size
        return F.struct(
            F.when(fits, state["done"])
            .when(oversize, F.concat(closed, chunk_fixed(paragraph, size, overlap)))
            .otherwise(closed)
            .alias("done"),
            F.when(
                fits,
                F.concat(opened, F.when(opened == "", "").otherwise("\n\n"), paragraph),
            )
            .when(oversize, "")
            .otherwise(paragraph)
            .alias("open"),
        )

    packed = F.aggregate(
        paragraphs, _start(), add, lambda state: _push(state["done"], trimmed(state["open"]))
    )
    chunks = F.filter(_with_overlap(packed, overlap), lambda c: c != "")
    return F.when(F.length(text) > 0, chunks).otherwise(F.expr(_NO_CHUNKS))


def chunk_paragraph_simple(text: Column, longer_than: int = 50) -> Column:
    """Trimmed paragraphs of more than ``longer_than`` characters, without a size limit."""
    paragraphs = F.transform(F.split(text, r"\n{2,}"), trimmed)
    return F.filter(paragraphs, lambda p: F.length(p) > longer_than)


def chunk_words(text: Column, n_words: int = 500) -> Column:
    """Groups of ``n_words`` white-space separated words."""

    def group(found: Column) -> Column:
        last = F.ceil(F.size(found) / F.lit(float(n_words))).cast("int") - 1
        groups = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.array_join(F.slice(found, i * n_words + 1, F.lit(n_words)), " "),
        )
        return F.when(F.size(found) > 0, groups).otherwise(F.expr(_NO_CHUNKS))

    return let(words(text), group)


STRATEGIES = {
    "fixed": chunk_fixed,
    "sentence": chunk_sentence,
    "sentence_simple": chunk_sentence_simple,
    "paragraph": chunk_paragraph,
    "paragraph_simple": chunk_paragraph_simple,
    "words": chunk_words,
}
