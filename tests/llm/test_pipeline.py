"""The pipeline's stages one by one, each against brute force on its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_similarity import brute_components
from tests.llm.test_text import brute_lines
from tidemetric.llm import decontaminate, mixing, quality_crf
from tidemetric.llm.common import table


@pytest.fixture(scope="module")
def passed(spark, tiny):
    docs, out = table(spark, tiny, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, tiny).persist()
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns_of_documents(spark, tiny, passed):
    for _, before, after in passed[:-1]:
        assert after.schema.names == before.schema.names == table(spark, tiny, "documents").schema.names
    assert [name for name, _, _ in passed] == [name for name, _ in corpus_pipeline.STAGES]


def test_quality_stage_drops_what_the_classifier_rejects(spark, tiny, passed):
    _, before, after = passed[0]
    kept = {r["doc_id"] for r in quality_crf.op5_quality_classifier(spark, tiny).filter("predicted = 1").collect()}
    assert set(texts(after)) == kept and len(kept) < before.count()


def test_line_stage_equals_brute_force(passed):
    _, before, after = passed[1]
    assert texts(after) == {i: t for i, _, _, t in brute_lines(list(texts(before).items()))}
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_copy_stage_keeps_one_of_each_group(passed):
    _, before, after = passed[2]
    want = {i for i, _, c in brute_components(list(texts(before).items()), 5, 80) if i == c}
    assert set(texts(after)) == want and after.count() == len(want)


def test_decontamination_stage_drops_leaks(spark, tiny, passed):
    _, before, after = passed[3]
    items = [" ".join(r["text"].lower().split()) for r in table(spark, tiny, "benchmark").collect()]
    whole = {i: " ".join(t.lower().split()) for i, t in texts(before).items()}
    leaks = {i for i, t in whole.items() if any(x in t for x in items)}
    found = {r["doc_id"] for r in decontaminate.find_leaks(before, table(spark, tiny, "benchmark")).collect()}
    assert leaks <= found and set(texts(after)) == set(whole) - found


def test_mixing_stage_takes_words_of_what_is_left(passed):
    _, before, after = passed[4]
    rows = after.collect()
    assert {r["doc_id"] for r in rows} <= set(texts(before))
    assert all(0 < r["taken"] <= 3 * r["n_words"] for r in rows)
    words = sum(len(t.split()) for t in texts(before).values())
    assert abs(sum(r["taken"] for r in rows) - words) <= after.select("source").distinct().count()


def test_mixing_stage_takes_null_and_repeated_ids_row_by_row(spark):
    rows = [(None, "a b c", "s"), (None, "d e", "t"), (7, "f g h i", "s"), (7, "j", "t"), (7, "k l", None), (8, "m n o p q", "t"), (8, "m n o p q", "t"), (9, "r " * 30, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.stage(spark, docs, "").collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "source", "n_words", "taken"}
    assert all(r["n_words"] == len(r["text"].split()) and 0 < r["taken"] <= 3 * r["n_words"] for r in got)
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) <= Counter(rows)
    want, taken = {}, Counter()
    for r in mixing.mix_sources(docs).collect():
        want[r["source"]] = r["target"]
    for r in got:
        taken[r["source"]] += r["taken"]
    assert {s: taken[s] for s in want} == {s: int(t + 0.5) for s, t in want.items()}
    assert (None, "d e", "t") in {(r["doc_id"], r["text"], r["source"]) for r in got}


def test_empty_documents_pass_all_stages(spark, tiny):
    docs = table(spark, tiny, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny)
        assert docs.count() == 0
