"""The stemmer on published pairs, and indexed search against scoring every document by a two-pointer scan."""

import os
import random
import re

import pytest

from quarry.functions import stemming
from quarry.operators import textindex

pytestmark = pytest.mark.usefixtures("few_partitions")

PAIRS = (
    "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall "
    "hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit conformabli:conform radicalli:radic "
    "differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal "
    "sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer "
    "airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ "
    "angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll ab:ab élan:élan"
)


def test_stemmer():
    assert {w: stemming.stem(w) for w in (p.split(":")[0] for p in PAIRS.split())} == dict(p.split(":") for p in PAIRS.split())


def plain_score(text, terms):
    places, _ = stemming.analyze(text)
    if not terms or any(t not in places for t in terms):
        return None
    marks = sorted((p, t) for t in terms for p in places[t])
    score, start = 0.0, 0
    while True:
        need, end = set(terms), start
        while end < len(marks) and need:
            need.discard(marks[end][1])
            end += 1
        if need:
            return score
        need, begin = set(terms), end
        while need:
            begin -= 1
            need.discard(marks[begin][1])
        score += 0.1 / (1 + marks[end - 1][0] - marks[begin][0] - (end - 1 - begin))
        start = begin + 1


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["walk", "walked", "running", "run", "house", "houses", "the", "of", "tree", "blue", "Élan", "x9"]
    docs = [(i, " ".join(rng.choices(words, [9, 3, 2, 2, 3, 1, 9, 9, 4, 1, 1, 1], k=rng.randrange(60)))) for i in range(400)] + [(900, None), (901, ""), (902, "walk " * 500 + "tree"), (None, "walk tree")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    path = str(tmp_path_factory.mktemp("index") / "i")
    textindex.build(frame, path, buckets=8)
    return docs, path


@pytest.mark.parametrize("query,k", [("walking trees", 10), ("walk", 5), ("house of the run", 20), ("x9 blue élan", 50), ("tree tree walks", 1), ("the of", 5), ("missing walk", 5), ("", 3), ("walk house tree run", 500)])
def test_search_equals_scoring_everything(spark, index, query, k):
    docs, path = index
    terms = sorted(stemming.analyze(query)[0])
    want = sorted(((-s, i) for i, t in docs if i is not None and (s := plain_score(t, terms)) is not None))[:k]
    got = [(r["rank"], r["id"], r["score"]) for r in textindex.search(spark, path, query, k, buckets=8).orderBy("rank").collect()]
    assert [(n, i) for n, i, _ in got] == [(n + 1, i) for n, (_, i) in enumerate(want)]
    assert [s for _, _, s in got] == pytest.approx([-s for s, _ in want])


def test_search_within_allowed_documents(spark, index):
    docs, path = index
    allowed = spark.range(0, 400, 3)
    got = {r["id"] for r in textindex.search(spark, path, "walk tree", 1000, allowed, buckets=8).collect()}
    assert got == {i for i, t in docs if i is not None and i % 3 == 0 and i < 400 and plain_score(t, ["tree", "walk"]) is not None}


def test_a_query_reads_only_its_buckets(spark, index):
    _, path = index
    assert len([x for x in os.listdir(path) if x.startswith("bucket=")]) > 3
    plan = textindex.read(spark, path, ["walk"], 8)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "EqualTo(term,walk)" in plan


def test_texts_of_one_partition_are_indexed_by_several_tasks(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"walk tree{i}") for i in range(50)], "doc_id long, text string").coalesce(1)
    textindex.build(docs, str(tmp_path / "i"), buckets=4)
    assert len({f[:10] for _, _, files in os.walk(tmp_path) for f in files if f.startswith("part-")}) > 1
    assert spark.read.parquet(str(tmp_path / "i")).count() == 100
