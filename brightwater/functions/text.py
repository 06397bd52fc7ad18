"""Text splitting with the same notion of white space everywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that the matched systems treat as white space, besides the blank.
_OTHER_SPACES = "\t\n\x0b\f\r" + "".join(
    map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)

# English stop words that a keyword match ignores.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now"
).split()


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def plain_spaces(text: Column) -> Column:
    """The text with every white-space character replaced by a blank."""
    return F.translate(text, _OTHER_SPACES, " " * len(_OTHER_SPACES))


def space_split(text: Column) -> Column:
    """Split at every single white-space character; runs give empty strings."""
    return F.split(plain_spaces(text), " ")


def words(text: Column) -> Column:
    """Array of the non-empty white-space separated words."""
    return F.array_remove(space_split(text), "")


#: White space in UTF-8: single bytes, first bytes of longer characters, and those characters as numbers.
_SPACE, _LEAD = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
for _code in map(str.encode, " " + _OTHER_SPACES):
    (_SPACE if len(_code) == 1 else _LEAD)[_code[0]] = True
_WIDE = {n: [int.from_bytes(c) for c in map(str.encode, _OTHER_SPACES) if len(c) == n] for n in (2, 3)}


def word_lists(texts: pa.Array) -> pa.ListArray:
    """``words`` of an Arrow array inside a task; a null text has none."""
    texts = texts.cast(pa.string()).fill_null("")
    _, ends, held = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(held or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    blank = _SPACE[data]
    at = np.flatnonzero(_LEAD[data])
    for size, codes in _WIDE.items():
        at = at[at <= len(data) - size]
        code = sum(data[at + i].astype(np.int64) << 8 * (size - 1 - i) for i in range(size))
        wide = at[np.isin(code, codes)]
        for i in range(size):
            blank[wide + i] = True
    word = ~blank
    first, last = word.copy(), word.copy()
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    inner = ends[(ends > 0) & (ends < len(data))]  # words end with their text
    first[inner], last[inner - 1] = word[inner], word[inner - 1]
    starts = np.flatnonzero(first)
    sizes = np.append(0, np.flatnonzero(last) + 1 - starts)
    buffers = [pa.py_buffer(np.cumsum(sizes).astype(np.int32)), pa.py_buffer(data[word])]
    found = pa.StringArray.from_buffers(len(starts), *buffers)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends).astype(np.int32)), found)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" " + _OTHER_SPACES))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(trimmed(text), F.lit("")) == ""


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Captured group of the first match, null where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))
