"""Importing this module registers every query of this folder."""

from brightwater.llm import (  # noqa: F401
    articles,
    bytepairs,
    collocations,
    contamination,
    languages,
    packing,
    periodic,
    quality,
    repeats,
    shards,
    similar,
    urls,
    warc,
)
from brightwater.llm.frames import QUERIES, SQL  # noqa: F401
