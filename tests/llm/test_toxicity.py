import numpy as np
import pytest

from conftest import rows
from corpus_tables import edges, no_labels, nothing, prose  # noqa: F401
from tillsight.llm import toxicity

BAD = ("idiot", "zorvex", "blatig", "quorl")


def written(i):
    words = prose(i, 50, 3000).split()
    if i % 4 == 0:
        words[10 + i % 30] = BAD[i // 4 % 4]
    return " ".join(words)


@pytest.fixture(scope="module")
def marked(spark):
    return spark.createDataFrame(
        [(i, written(i), int(i % 4 == 0)) for i in range(800)], "doc_id long, text string, toxic int"
    )


def test_held_out_documents_are_told_apart(marked):
    found = toxicity.classify(marked.select("doc_id", "text"), marked.select("doc_id", "toxic")).collect()
    held = [r for r in found if r.held_out]
    assert 100 < len(held) < 220 and len(found) == 800
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_held_out_labels_are_not_used(marked):
    docs, labels = marked.select("doc_id", "text"), marked.select("doc_id", "toxic")
    flipped = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic"
    )
    texts = [r.text for r in docs.collect()]
    one, two = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert np.array_equal(one.scores(texts), two.scores(texts))


def test_copies_prove_no_words(spark):
    data = [(prose(1), 1, 0, 11)] * 50 + [(prose(i + 5), 0, i % 4, i) for i in range(60)]
    sample = spark.createDataFrame(data, "text string, y int, fold int, head long")
    words, others = toxicity.word_lists(sample)
    assert set(words) == set(toxicity.INSULTS) and len(others) == toxicity.FOLDS


def test_features():
    words = {"idiot": 3.0, "moron": 2.0}
    names = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT! id10t m.o.r.o.n idiot", words)))
    assert names["list_distinct"] == 1 and names["masked_hits"] == 2 and names["weight_best"] == 3.0
    assert names["shout_rate"] > 0 and names["you_rate"] > 0 and names["exclaim_rate"] > 0
    assert toxicity.features(None, words) == toxicity.features("", words)
    assert len(toxicity.features("x", words)) == len(toxicity.FEATURES)


def test_trees_fit_what_one_feature_decides():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    y = (x[:, 1] > 0.3).astype(float)
    margin = toxicity.boost(x, y, np.ones(500)).margin(x)
    assert ((margin > 0) == (y > 0)).mean() > 0.97


def test_isotonic_steps_rise_and_keep_the_mean():
    rng = np.random.default_rng(5)
    score = rng.normal(size=300)
    y = (rng.random(300) < toxicity.sigmoid(2 * score)).astype(float)
    knots, values = toxicity.isotonic(score, y, np.ones(300))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    assert np.interp(score, knots, values).mean() == pytest.approx(y.mean(), abs=0.02)


def test_edges(edges, nothing, no_labels):  # noqa: F811
    found = rows(toxicity.classify(edges, no_labels))
    assert len(found) == edges.count() and all(0 <= r[2] <= 1 for r in found)
    assert toxicity.classify(nothing, no_labels).count() == 0
    kept = toxicity.drop_toxic(edges, no_labels, 1.1)
    assert kept.columns == edges.columns and kept.count() == edges.count()


def test_words_masked_at_their_ends_and_by_stars():
    words = {"idiot": 3.0, "stupid": 2.0, "moron": 2.0}

    def hits(text):
        return dict(zip(toxicity.FEATURES, toxicity.features(text, words)))["masked_hits"]

    for text in ("1d10t", "1diot", "$tupid", "st*pid", "*diot", "(m0r0n)", "!diot", "id10t!", "s****d m.o.r.o.n"):
        assert hits(f"So, {text}. Then") == len(text.split()), text
    named = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT! 1d10t m.o.r.o.n idiot", words)))
    assert named["masked_hits"] == 2
    assert hits("*idiot* **moron** idiot! stupid. 10 3rd a-b * ** 5*5 ***** !") == 0


def test_distance_to_words_that_address_the_reader():
    words, far = {"idiot": 3.0}, "one two three four five six seven eight nine ten "

    def named(text):
        return dict(zip(toxicity.FEATURES, toxicity.features(text, words)))

    close, apart = named("you are an idiot " + far), named("you " + far + "an idiot are")
    assert close["you_near"] == 1 and close["you_distance"] == pytest.approx(np.log1p(3))
    assert apart["you_near"] == 0 and apart["you_distance"] == pytest.approx(np.log1p(12))
    assert named("you 1d10t")["you_near"] == 1 and named("idiot " + far + "your idiot")["you_near"] == 0.5
    assert named("idiot")["you_distance"] == named("you")["you_distance"] == pytest.approx(np.log1p(toxicity.FAR))
    assert named("you " * 200 + far)["you_rate"] == pytest.approx(100 * 200 / 210)


def test_texts_that_open_alike_are_no_copies(spark):
    opening = "This passage opens every document of the collection and is long enough to fill a head. "
    data = [(i, opening + written(i), int(i % 4 == 0)) for i in range(240)]
    data += [(1000 + i, opening + prose(7, 60) + " gnarf" + "!" * (i % 5), 1) for i in range(40)]
    marked = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    sample = marked.withColumnRenamed("toxic", "y")
    groups = toxicity.grouped(sample).collect()
    assert {r.fold for r in groups if r.y} == set(range(toxicity.FOLDS))
    assert len({r["head"] for r in groups if r.doc_id >= 1000}) == 1
    assert len({r["head"] for r in groups}) == 241
    model = toxicity.train(marked.select("doc_id", "text"), marked.select("doc_id", "toxic"))
    assert {"zorvex", "blatig", "quorl"} <= set(model.words) and "gnarf" not in model.words
