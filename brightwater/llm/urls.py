"""Allow and block rules for urls, by a trie over reversed host labels and path segments.

A rule (host, path) fits its host and all subdomains, if the url's path starts with the rule's path. The
longest rule that fits decides; of two equally long ones the longer host, then block. A rule's path
need not end with a segment: its last piece is a prefix of a segment.

The trie is held by every task only if the rules are few enough; more rules are joined on (host suffix, whole
segments), which every url offers in as many ways as it has labels times segments.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.llm.frames import ready, registered, table

ALLOW, BLOCK = "allow", "block"
#: Rules that a trie may hold; a rule takes well under a kilobyte.
TRIE_RULES = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no `://`."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def strength(host: str, path: str, verdict: str) -> tuple[int, int, bool]:
    return len(host) + len(path), len(host), verdict == BLOCK


class Trie:
    """Rules by reversed host labels, then by path segments; the last piece of a path is a prefix."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            tails = node.setdefault("tails", {})
            found = (strength(host, path, verdict), host + path, verdict)
            tails[tail] = max(tails.get(tail, found), found)
            node.setdefault("sizes", set()).add(len(tail))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits, or nulls."""
        best = None
        segments = path.split("/")
        node = self.root
        for label in [None, *reversed(host.split("."))] if host else [None]:
            if label is not None:
                node = node.get("labels", {}).get(label)
                if node is None:
                    break
            at = node.get("paths")
            for segment in segments:
                if at is None:
                    break
                tails = at.get("tails", {})
                for size in at.get("sizes", ()):
                    found = tails.get(segment[:size]) if size <= len(segment) else None
                    if found and (best is None or found > best):
                        best = found
                at = at.get("segments", {}).get(segment)
        return (None, None) if best is None else (best[1], best[2])


def _judged(shared):
    def run(batches):
        trie: Trie = shared.value
        for batch in batches:
            found = [trie.find(h, p) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([rule for rule, _ in found], pa.string()),
                    pa.array([verdict for _, verdict in found], pa.string()),
                ],
                names=[*batch.schema.names, "rule", "ruled"],
            )

    return run


def judge(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = ALLOW,
    trie_rules: int = TRIE_RULES,
) -> DataFrame:
    """(key, host, path, rule, verdict) for every row.

    ``rules`` has (host, path, verdict), host lower case. ``rule`` is the deciding one as host + path, null if
    none fits; the verdict is then ``default``. Rules with nulls are ignored; of equal rules block
    wins. A null url, or one without `://`, has an empty host and path and fits no rule with a host. Rows
    are judged one by one: repeated rows give repeated results, null keys stay, other columns are not
    read, and an empty table gives an empty result.
    """
    ready(pages.sparkSession)
    host, path = host_and_path(F.col(url))
    split = pages.select(host.alias("host"), path.alias("path"), F.col(key).alias("__key"))
    known = rules.select("host", "path", "verdict").dropna().distinct()
    if known.count() <= trie_rules:
        trie = Trie([tuple(r) for r in known.collect()])
        kind = pages.schema[key].dataType.simpleString()
        found = split.mapInArrow(
            _judged(pages.sparkSession.sparkContext.broadcast(trie)),
            f"host string, path string, __key {kind}, rule string, ruled string",
        )
    else:
        found = _joined(split, known)
    verdict = F.coalesce("ruled", F.lit(default))
    return found.select(F.col("__key").alias(key), "host", "path", "rule", verdict.alias("verdict"))


def _joined(split: DataFrame, rules: DataFrame) -> DataFrame:
    """The same without a trie: urls meet rules on a host suffix and the rule's whole segments."""
    whole = F.regexp_extract("path", "(?s)^(.*/)?", 0)
    sided = rules.select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict", whole.alias("rule_whole")
    )
    labels = F.split("host", r"\.")
    suffixes = F.concat(
        F.array(F.lit("")),
        F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)),
                lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
            )
        ),
    )
    segments = F.split("path", "/")
    begins = F.transform(
        F.sequence(F.lit(0), F.size(segments) - 1),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(segments, 1, k), "/"), F.lit("/"))),
    )
    distinct = split.select("host", "path").distinct()
    offered = distinct.select("host", "path", F.explode(suffixes).alias("rule_host"), begins.alias("begins"))
    offered = offered.select("host", "path", "rule_host", F.explode("begins").alias("rule_whole"))
    best = (
        offered.join(sided, ["rule_host", "rule_whole"])
        .where(F.expr("startswith(path, rule_path)"))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    (F.length("rule_host") + F.length("rule_path")).alias("size"),
                    F.length("rule_host").alias("hosts"),
                    (F.col("verdict") == BLOCK).alias("blocks"),
                    F.concat("rule_host", "rule_path").alias("rule"),
                    F.col("verdict").alias("ruled"),
                )
            ).alias("best")
        )
        .select("host", "path", "best.rule", "best.ruled")
    )
    return split.join(best, ["host", "path"], "left")


RULES = [
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
]

URLS_SQL = r"""
WITH rules(rule_host, rule_path, ruled) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), split AS (
    SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
), fits AS (
    SELECT page_id, rule_host || rule_path AS rule, ruled,
           row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS nth
    FROM split JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(ruled, 'allow') AS verdict
FROM split LEFT JOIN (SELECT * FROM fits WHERE nth = 1) USING (page_id)
"""


@registered("op6_url_filter", URLS_SQL)
def url_filter(spark, folder):
    """The rule and verdict for the url of every page."""
    pages = table(spark, folder, "pages")
    return judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
