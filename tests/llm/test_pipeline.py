"""The pipeline's stages, each held against its own input."""

import collections
import re

import numpy as np
import pytest

import corpus_pipeline
from tabframe.llm import mixing, toxicity
from tabframe.llm.common import table, written
from tests.llm import helpers

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    found = [table(spark, FOLDER, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        found.append(written(stage(spark, found[-1], FOLDER), "test-stage"))
    return found


def test_columns(steps):
    assert all(df.columns == steps[0].columns for df in steps[1:-1])


def test_toxic_documents_go(spark, steps):
    scores = {r.doc_id: r.predicted for r in toxicity.score(steps[0], table(spark, FOLDER, "labels")).collect()}
    assert sorted(r.doc_id for r in steps[1].collect()) == sorted(i for i, p in scores.items() if not p)


def test_copies_go(steps):
    bodies = collections.defaultdict(list)
    for r in steps[1].collect():
        bodies[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(min(g)[1] for g in bodies.values())


def test_near_copies_go(steps):
    found = helpers.similar([(r.doc_id, r.text) for r in steps[2].collect()])
    assert sorted(r.doc_id for r in steps[3].collect()) == [i for i, _, c in found if i == c]


def test_sources_are_mixed(steps):
    words = lambda df: collections.Counter()
    taken = words(steps[4])
    for r in steps[4].collect():
        taken[r.source] += len(re.findall(helpers.WORD, r.text))
    target = {r.source: r.target for r in mixing.mix(steps[3]).join(steps[3].select("doc_id", "source"), "doc_id").collect()}
    assert all(abs(taken[s] - t) <= 0.1 * t + 64 for s, t in target.items())


def test_tokens(steps):
    assert steps[5].count() == steps[4].count() and steps[5].where("n_tokens > 0").count() == steps[4].count()


def test_run(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, steps[-1].collect()))


def hard(spark):
    """Nulls in any column, blank, repeated and very long texts, odd names, rows without id."""
    rng = np.random.default_rng(1)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    long, plain = words(40_000), words(80)
    data = [(1, plain, "en", "a", 1), (1, plain, "en", "a", 1), (2, plain.replace(" ", "\n"), None, None, None), (3, None, None, None, None),
            (4, "", "en", "b", 0), (5, " \t\n", "de", "b", 3), (None, plain + " end", "en", "a", 2), (None, None, None, None, None), (6, long, "en", "c", 9),
            (7, long + " more", "en", "c", 9), (8, "x", "en", None, 1), (9, "é", "fr", "a", 1), *[(i, words(50), "en", "a", 1) for i in range(20, 40)]]
    names = [c for c in helpers.CLASHES]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    return spark.createDataFrame([(*r, *["y"] * len(names)) for r in data], schema).repartition(3)


def test_stages_take_hard_rows_and_none(spark):
    docs = hard(spark)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, rows, FOLDER), "test-stage")
            assert out.columns == docs.columns
            rows = out
        last = corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER)
        assert last.count() == rows.count()
    assert rows.count() == 0


def test_copies_of_hard_rows(spark):
    docs = hard(spark)
    kept = [r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, FOLDER).collect()]
    assert sorted(i for i in kept if i is not None and i < 20) == [1, 1, 5, 6, 7, 8, 9] and kept.count(None) == 1
    near = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()]
    assert sorted(i for i in near if i is not None and i < 20) == [1, 3, 4, 5, 6, 8, 9] and near.count(None) == 2
