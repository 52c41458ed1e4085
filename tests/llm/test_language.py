import numpy as np

from conftest import rows
from corpus_tables import edges, nothing  # noqa: F401
from tillsight.llm import language

SYLLABLES = {"aa": ("ka", "to", "ri", "mu"), "bb": ("sch", "ein", "ung", "der"), "cc": ("que", "ción", "los", "ñe")}


def written(lang, seed, words=30):
    rng, parts = np.random.default_rng(seed), SYLLABLES[lang]
    return " ".join("".join(parts[k] for k in rng.integers(0, 4, 3)) for _ in range(words))


def test_languages_of_held_out_documents(spark):
    data = [(i, written(lang, i), lang) for i, lang in enumerate(["aa", "bb", "cc", "aa"] * 60)]
    data += [(1000 + i, written("bb", i), None) for i in range(5)]
    found = language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    truth = {i: lang for i, _, lang in data}
    held = [r for r in found if r.held_out and truth[r.doc_id]]
    assert len(held) > 20 and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert all(r.lang_pred == "bb" for r in found if r.doc_id >= 1000)
    assert all(0 < r.score <= 1 for r in found)


def test_profiles_are_the_same_on_every_run(spark):
    data = [(i, written(lang, i), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    one, two = language.train(frame), language.train(frame.repartition(3))
    assert one.names == two.names == ["aa", "bb"] and np.allclose(one.vectors, two.vectors, atol=1e-6)


def test_first_ids_of_each_language(spark):
    ids = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 < 2 THEN 'hot' ELSE concat('l', id % 9) END AS lang")
    order = {r.doc_id: r.hash for r in ids.selectExpr("doc_id", "xxhash64(doc_id) AS hash").collect()}
    groups = {}
    for r in ids.collect():
        groups.setdefault(r.lang, []).append(r.doc_id)
    for most in (1, 40, 500):
        found = {(r.lang, r.doc_id) for r in language.first_ids(ids, most).collect()}
        assert found == {(k, i) for k, v in groups.items() for i in sorted(v, key=order.get)[:most]}


def test_a_text_is_the_sum_of_its_grams():
    text = "Äb c-ab"
    padded = " äb c ab "
    want = np.zeros(language.DIM)
    for i in range(len(padded) - 2):
        a, b, c = (language.letter_vector(ord(x)) for x in padded[i : i + 3])
        want += np.roll(a, 2) * np.roll(b, 1) * c
    assert np.allclose(language.Vectors().total(*language.grams(text)), want)
    numbers, counts = language.grams("aaaa")
    assert counts.sum() == 4 and len(numbers) == 3


def test_forgetting_vectors_changes_nothing(monkeypatch):
    whole = language.Vectors().total(*language.grams("some words of a text"))
    monkeypatch.setattr(language, "GRAMS_KEPT", 3)
    assert np.allclose(language.Vectors().total(*language.grams("some words of a text")), whole)


def test_edges(edges, nothing):  # noqa: F811
    found = rows(language.identify(edges))
    assert len(found) == edges.count()
    for doc_id, _, lang, score in found:
        assert (lang == "und" and score == 0) == (doc_id in (1, 2, 5)) and 0 <= score <= 1
    assert language.identify(nothing).count() == 0
