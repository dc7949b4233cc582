"""The pipeline's stages on odd rows, clashing columns and empty tables."""

from collections import Counter

import pytest

import corpus_pipeline
from hyperloom.llm import cluster


@pytest.fixture(scope="module")
def steps(spark, tables):
    docs = cluster.table(spark, tables, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = cluster.materialise(stage(spark, docs, tables))
        out.append(docs)
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_language_stage_drops_texts_without_letters(steps):
    gone = ids(steps[0]) - ids(steps[1])
    assert {163, 164, 165, 166} <= set(gone) and not any(i is not None and i < 160 for i in gone)


def test_quality_stage_keeps_clean_documents(steps):
    before, after = ids(steps[1]), ids(steps[2])
    clean = [i for i in before if i is not None and i < 160 and i % 5]
    assert sum(i in after for i in clean) >= 0.97 * len(clean)
    assert sum(i in after for i in before if i is not None and i < 160 and i % 5 == 0) <= 2


def test_one_document_of_each_group_stays(steps, documents):
    from test_operators import near_duplicates

    rows = [(r.doc_id, r.text) for r in steps[2].select("doc_id", "text").collect()]
    group = {i: g for i, (_, _, g) in near_duplicates(rows).items()}
    after = ids(steps[3])
    assert {i for i in after if i is not None} == set(group.values())
    assert all(n == 1 for i, n in after.items() if i is not None)
    # the row without an id is a copy of one that has one
    assert ids(steps[2])[None] == 1 and after[None] == 0


def test_mixing_only_repeats_or_drops(steps):
    before, after = ids(steps[3]), ids(steps[4])
    assert set(after) <= set(before)


def test_packing_holds_all(steps):
    first = Counter(r["doc_id"] for r in steps[5].where("piece = 0").select("doc_id").collect())
    assert first == ids(steps[4])


def test_run_on_empty_tables(spark, empty_tables):
    assert corpus_pipeline.run(spark, empty_tables).collect() == []


def test_run(spark, tables, steps):
    assert ids(corpus_pipeline.run(spark, tables)) == ids(steps[5])
