"""The pipeline against plain Python, stage by stage."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from tests.conftest import SF001
from tests.llm import test_mixing, test_ngram_join, test_packing
from tickframe.llm import secrets, toxicity
from tickframe.llm.common import staged, table


@pytest.fixture(scope="module")
def steps(spark):
    docs = [table(spark, SF001, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(staged(stage(spark, docs[-1], SF001), name))
    return docs


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "secrets", "mixing", "packing"]
    assert all(d.columns == steps[0].columns for d in steps[1:-1])


def test_toxic_documents_go(spark, steps):
    model = toxicity.fit(steps[0], table(spark, SF001, "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(steps[0], model).select("row.doc_id", "score").collect()}
    assert sorted(d for d, _ in rows(steps[1])) == sorted(d for d, s in scores.items() if s < 0.3)


def test_one_of_each_group_stays(steps):
    want = sorted(d for d, _, c in test_ngram_join.brute(rows(steps[1])) if d == c)
    assert sorted(d for d, _ in rows(steps[2])) == want


def test_secrets_are_marked(steps):
    before, after = dict(rows(steps[2])), dict(rows(steps[3]))
    assert before.keys() == after.keys()
    for d, text in before.items():
        want, at = "", 0
        for _, s, e, *_ in secrets.find(text)[1]:
            if e > at:
                want += text[at:s] + "[SECRET]" if s >= at else ""
                at = e
        assert after[d] == want + text[at:]
    assert all(r.n_chars == len(r.text) for r in steps[3].collect() if "[SECRET]" in r.text)


def test_small_sources_repeat(steps):
    size, source = {}, {}
    for r in steps[3].collect():
        size[r.doc_id], source[r.doc_id] = len(r.text.split()), r.source
    tokens = defaultdict(int)
    for d, n in size.items():
        tokens[source[d]] += n
    want = test_mixing.solve(tokens, 2.0, True)
    given = defaultdict(int)
    times = Counter(d for d, _ in rows(steps[4]))
    assert times.keys() == size.keys() and max(times.values()) <= 2
    for d, n in times.items():
        given[source[d]] += n * size[d]
    for s, e in want.items():
        most = max(n for d, n in size.items() if source[d] == s)
        assert round(e * tokens[s]) - most - 1 <= given[s] <= round(e * tokens[s]) + 1


def test_packed(spark, steps):
    out = steps[5].collect()
    bins, total = test_packing.check(rows(steps[4]), out)
    assert bins <= -(-total // 2048) + 1
    assert corpus_pipeline.run(spark, SF001).count() == len(out)


def test_empty_documents(spark):
    docs = table(spark, SF001, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF001), "empty")
    assert docs.count() == 0
