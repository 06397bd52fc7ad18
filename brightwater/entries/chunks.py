"""Chunking queries over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightwater.entries import entry
from brightwater.entries.views_sql import with_views
from brightwater.operators.chunks import chunk_documents
from brightwater.plans import tables
from brightwater.plans.skew import spread

_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"


def _rows(spark, folder, strategy, blank_lines=False, **options):
    docs = spread(tables.table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    if blank_lines:
        docs = docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunk_documents(docs, strategy, **options).select("doc_id", "chunk_index", "chunk_text")


@entry(
    "chunk_fixed",
    with_views("chunks", "SELECT doc_id, chunk_index, chunk_text FROM chunks"),
)
def chunk_fixed(spark, folder):
    return _rows(spark, folder, "fixed")


_INDEXED = """SELECT doc_id, cast(i - 1 AS int) AS chunk_index, chunks[i] AS chunk_text
FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM ({}))"""

_SENTENCES = """CASE WHEN regexp_matches(text, '[^.!?]+[.!?]+') THEN regexp_extract_all(text, '[^.!?]+[.!?]+') ELSE [text] END"""


def _overlapped(chunks: str) -> str:
    return f"""list_reduce({chunks}, lambda a, c: {{'done': a.done || [CASE WHEN len(a.done) = 0 THEN c ELSE concat(right(a.open, 64), ' ', c) END],
 'open': CASE WHEN len(a.done) = 0 THEN c ELSE concat(right(a.open, 64), ' ', c) END}}, {{'done': []::varchar[], 'open': ''}}).done"""


@entry(
    "chunk_sentence",
    _INDEXED.format(
        f"""SELECT doc_id, list_filter({_overlapped("packed")}, lambda c: c <> '') AS chunks FROM (SELECT doc_id,
 CASE WHEN s.open = '' THEN s.done ELSE s.done || [{_TRIM.format("s.open")}] END AS packed FROM (SELECT doc_id,
 list_reduce({_SENTENCES}, lambda a, x: CASE WHEN length(a.open) + length(x) <= 512 THEN {{'done': a.done, 'open': concat(a.open, x)}}
  ELSE {{'done': CASE WHEN a.open = '' THEN a.done ELSE a.done || [{_TRIM.format("a.open")}] END, 'open': x}} END,
  {{'done': []::varchar[], 'open': ''}}) AS s FROM documents WHERE length(text) > 0))"""
    ),
)
def chunk_sentence(spark, folder):
    return _rows(spark, folder, "sentence")


@entry(
    "chunk_sentence_simple",
    _INDEXED.format(
        f"""SELECT doc_id, CASE WHEN {_TRIM.format("s.open")} = '' THEN s.done ELSE s.done || [{_TRIM.format("s.open")}] END AS chunks FROM (SELECT doc_id,
 list_reduce({_SENTENCES}, lambda a, x: CASE WHEN length(a.open) + length(x) > 512 AND a.open <> '' THEN {{'done': a.done || [{_TRIM.format("a.open")}], 'open': x}}
  ELSE {{'done': a.done, 'open': concat(a.open, ' ', x)}} END, {{'done': []::varchar[], 'open': ''}}) AS s FROM documents WHERE {_TRIM.format("text")} <> '')"""
    ),
)
def chunk_sentence_simple(spark, folder):
    return _rows(spark, folder, "sentence_simple")


_SPACED = "replace(text, chr(10), chr(10) || chr(10))"
_FIXED_CUT = "list_transform(range(0, greatest(0, cast(ceil((length(x)-512)/448.0) AS bigint))+1), lambda i: substr(x, cast(i*448+1 AS bigint), 512))"


@entry(
    "chunk_paragraph",
    _INDEXED.format(
        f"""SELECT doc_id, list_filter({_overlapped("packed")}, lambda c: c <> '') AS chunks FROM (SELECT doc_id,
 CASE WHEN {_TRIM.format("s.open")} = '' THEN s.done ELSE s.done || [{_TRIM.format("s.open")}] END AS packed FROM (SELECT doc_id,
 list_reduce(list_filter(string_split_regex({_SPACED}, '\\n\\n+|\\r\\n\\r\\n+'), lambda p: {_TRIM.format("p")} <> ''),
  lambda a, x: CASE WHEN length(a.open) + length(x) <= 512 THEN {{'done': a.done, 'open': concat(a.open, CASE WHEN a.open = '' THEN '' ELSE chr(10) || chr(10) END, x)}}
  WHEN length(x) > 512 THEN {{'done': (CASE WHEN a.open = '' THEN a.done ELSE a.done || [{_TRIM.format("a.open")}] END) || {_FIXED_CUT}, 'open': ''}}
  ELSE {{'done': CASE WHEN a.open = '' THEN a.done ELSE a.done || [{_TRIM.format("a.open")}] END, 'open': x}} END,
  {{'done': []::varchar[], 'open': ''}}) AS s FROM documents WHERE length(text) > 0))"""
    ),
)
def chunk_paragraph(spark, folder):
    return _rows(spark, folder, "paragraph", blank_lines=True)


@entry(
    "chunk_paragraph_simple",
    _INDEXED.format(
        f"""SELECT doc_id, list_filter(list_transform(string_split_regex({_SPACED}, '\\n\\n+'), lambda p: {_TRIM.format("p")}), lambda p: length(p) > 50) AS chunks FROM documents"""
    ),
)
def chunk_paragraph_simple(spark, folder):
    return _rows(spark, folder, "paragraph_simple", blank_lines=True)


@entry(
    "chunk_words",
    _INDEXED.format(
        """SELECT doc_id, list_transform(range(0, cast(ceil(len(w)/500.0) AS bigint)), lambda g: array_to_string(w[cast(g*500+1 AS bigint):cast(g*500+500 AS bigint)], ' ')) AS chunks
FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') AS w FROM documents)"""
    ),
)
def chunk_words(spark, folder):
    return _rows(spark, folder, "words")
