import pytest

from corpus_tables import edges, nothing, prose  # noqa: F401
from tillsight.llm import mixing


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing again and again what lies above the caps."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, share * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, prose(i, 5 + i % 50), ["a", "b", "C", "é", None, "a", "a"][i % 7]) for i in range(1400)]
    return spark.createDataFrame(data, "doc_id long, text string, source string").repartition(7)


def test_targets_and_taken_words(docs):
    found = docs.select("doc_id", "source").join(mixing.mix(docs), "doc_id").collect()
    sizes, taken, target = {}, {}, {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    want = water(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 55 / 2
    assert {r.source_size for r in found} == set(sizes.values())


def test_reruns_agree_however_the_rows_lie(docs):
    one = sorted(map(tuple, mixing.mix(docs).collect()))
    assert one == sorted(map(tuple, mixing.mix(docs.repartition(3, "text")).collect()))


def test_few_hash_levels_find_the_same_threshold(docs, monkeypatch):
    one = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "LEVELS", (4, 20, 28))
    assert one == sorted(map(tuple, mixing.mix(docs).collect()))


def test_rows_of_the_mix(docs):
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect()}
    counts = dict.fromkeys(taken, 0)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        counts[r.doc_id] += 1
    assert counts == taken


def test_edges(edges, nothing):  # noqa: F811
    found = mixing.mix(edges).collect()
    assert len(found) == edges.count()
    assert all(r.taken <= 2 * r.size for r in found)
    by = {r.doc_id: r for r in found}
    assert [by[i].size for i in (5, 1, 2, 3)] == [0, 0, 0, 1]
    sevens = [r.taken for r in found if r.doc_id == 7]
    assert len(sevens) == 2 and sevens[0] == sevens[1]
    mixed = mixing.mixed(edges)
    assert mixed.columns == edges.columns
    assert {r.doc_id for r in mixed.collect()} >= {5, 1, 2}
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
