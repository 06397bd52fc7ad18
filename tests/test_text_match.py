"""Stems against published examples; lexeme match and ranks against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from brightwater.functions.stemming import stem
from brightwater.functions.text import STOP_WORDS
from brightwater.operators import text_match

# Published examples of the stemmer: word and stem.
EXAMPLES = (
    "consign consign consigned consign consigning consign consignment consign consist consist consisted consist "
    "consistency consist consistent consist consistently consist consisting consist consists consist consolation consol "
    "consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid "
    "consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson "
    "consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci "
    "conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl "
    "constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri "
    "knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel "
    "kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif "
    "knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive "
    "knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp "
    "knot knot knots knot"
).split()
MORE = {
    "skies": "sky", "dying": "die", "news": "news", "generously": "generous", "communication": "communic", "herring": "herring",
    "hoping": "hope", "hopping": "hop", "cries": "cri", "ties": "tie", "say": "say", "by": "by", "relational": "relat",
    "rational": "ration", "happily": "happili", "feed": "feed", "agreed": "agre", "controlling": "control", "gas": "gas",
    "kiwis": "kiwi", "youth": "youth", "ill": "ill", "roll": "roll", "adjustment": "adjust", "decisiveness": "decis",
}


def test_published_stems():
    pairs = dict(zip(EXAMPLES[::2], EXAMPLES[1::2])) | MORE
    assert {w: stem(w) for w in pairs} == pairs


WORDS = "connect connected connecting connection running runs run happy happily the of straße naïve 7b cities city".split()


def frames(spark):
    random.seed(4)
    chunks = [
        (f"c{i}", None if i % 23 == 0 else " ".join(random.choice(WORDS) + random.choice(["", ".", ", "]) for _ in range(random.randint(0, 25))), random.choice([["a"], ["b", "a"], None]))
        for i in range(90)
    ]
    questions = [(i, " ".join(random.choice(WORDS) for _ in range(random.randint(0, 4))), "ab"[i % 2]) for i in range(30)]
    questions += [(90, None, "a"), (91, "of the", "a"), (92, "unknown run", "a")]
    c = spark.createDataFrame(chunks, "id string, chunk_text string, permissions array<string>").repartition(3)
    return spark.createDataFrame(questions, "query_id int, text string, user_id string"), c, questions, chunks


def plain(questions, chunks, stemmed, most):
    name = stem if stemmed else str
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = []
    for query, text, user in questions:
        wanted = sorted({name(w) for w in split(text) if w not in STOP_WORDS})
        scored = []
        for key, body, readers in chunks:
            places = [[i for i, w in enumerate(split(body), 1) if name(w) == x] for x in wanted]
            if not wanted or not all(places) or user not in (readers or []):
                continue
            if len(places) == 1:
                rank = 0.1 * sum(1 / j**2 for j in range(1, len(places[0]) + 1)) / 1.64493406685
            else:
                rest = 1.0
                for i in range(len(places)):
                    for k in range(i):
                        for p in places[i]:
                            for q in places[k]:
                                if p != q:
                                    d = abs(p - q)
                                    near = 1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))
                                    rest *= 1 - math.sqrt(0.01 * near)
                rank = 1 - rest
            scored.append((-round(rank, 7), key))
        out += [(query, n, key, -score) for n, (score, key) in enumerate(sorted(scored)[:most], 1)]
    return out


@pytest.mark.parametrize("stemmed", [True, False])
def test_ranks(spark, stemmed):
    q, c, questions, chunks = frames(spark)
    got = text_match.rank_by_lexemes(q, c, None, stemmed).collect()
    want = plain(questions, chunks, stemmed, None)
    assert len(want) > 40
    assert sorted((r.query_id, r.id, round(r.score, 7)) for r in got) == sorted((w[0], w[2], w[3]) for w in want)
    few = text_match.rank_by_lexemes(q, c, 3, stemmed)
    assert few.groupBy("query_id").agg(F.max("rank").alias("m")).agg(F.max("m")).first()[0] == 3
    assert text_match.rank_by_lexemes(q.limit(0), c).collect() == []
    assert text_match.rank_by_lexemes(q, c.limit(0)).collect() == []


def test_positions(spark):
    c = spark.createDataFrame([("x", "Connecting, the connections! of cities", ["a"])], "id string, chunk_text string, permissions array<string>")
    q = spark.createDataFrame([(1, "a", "city connected")], "query_id int, user_id string, text string")
    row = text_match.match_lexemes(q, c).first()
    assert [(f.lexeme, f.positions) for f in row.found] == [("citi", [5]), ("connect", [1, 3])]
    assert text_match.match_lexemes(q, c, stemmed=False).collect() == []
