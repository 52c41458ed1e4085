"""The pipeline against its stages applied by hand and checked by brute force."""

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from corpus_tables import edges, no_labels, nothing  # noqa: F401
from tillsight.llm import quality, toxicity
from tillsight.llm.common import table
from test_near_dedup import brute

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, results = table(spark, ROOT, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, ROOT).persist()
        results.append(docs)
    yield results
    for frame in results:
        frame.unpersist()


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_keep_the_columns(spark, stages):
    names = table(spark, ROOT, "documents").columns
    assert [s.columns for s in stages[:-1]] == [names] * 4


def test_classifiers_decide(spark, stages):
    docs, labels = table(spark, ROOT, "documents"), table(spark, ROOT, "labels")
    good = quality.classify(docs, labels).where("predicted = 1")
    assert ids(stages[0]) == ids(good)
    civil = toxicity.classify(stages[0], labels).where("predicted = 0")
    assert ids(stages[1]) == ids(civil)


def test_one_of_each_group_stays(stages):
    data = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = sorted(i for i, (_, label) in brute(data, 5).items() if i == label)
    assert ids(stages[2]) == want


def test_mix_and_packing_have_every_row(stages):
    assert set(ids(stages[3])) <= set(ids(stages[2]))
    first = [r.doc_id for r in stages[4].where("piece = 0").collect()]
    assert sorted(first) == ids(stages[3])


def test_run_gives_the_last_stage(spark, stages):
    def sizes(frame):
        return sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in frame.collect())

    assert sizes(entry_points.queries()["pipeline"](spark, ROOT)) == sizes(stages[4])


def test_stages_take_edges_and_nothing(spark, edges, nothing, no_labels, tmp_path):  # noqa: F811
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    for source in (edges, nothing):
        docs, seen = source, []
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).persist()
            seen.append(docs)
        given = {r.doc_id for r in source.collect()}
        kept = [ids_of(frame) for frame in seen]
        # Without labels nothing is toxic, and 9 is a copy of 7; no stage makes up an id.
        assert kept[0] <= given and kept[1] == kept[0] and kept[2] == kept[1] - {9}
        assert kept[3] <= kept[2] and kept[4] == kept[3]
        texts = {r.doc_id: r.text for r in source.collect()}
        assert {i for i in kept[2] if not (texts[i] or "").strip()} <= kept[3]
        for frame in seen:
            frame.unpersist()


def ids_of(frame):
    return {r.doc_id for r in frame.select("doc_id").collect()}


def test_near_dedup_keeps_a_determined_row_of_repeated_ids(spark):
    from tillsight.llm import near_dedup

    rows = [(1, "some words of a first text here", 5), (1, "another text of the same id here", 7), (1, None, 1),
            (2, "words that are nowhere else at all", 3), (2, "words that are nowhere else at all", 2)]
    frames = [spark.createDataFrame(r, "doc_id long, text string, k int").repartition(3) for r in (rows, rows[::-1])]
    found = [sorted(map(tuple, near_dedup.keep_one(f, words=5).collect())) for f in frames]
    assert found[0] == found[1] == [(1, None, 1), (2, "words that are nowhere else at all", 2)]
