import numpy as np
import pytest

from tillsight.llm import neighbours


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    values = centres[rng.integers(0, 20, 1500)] + 0.7 * rng.normal(size=(1500, 24))
    return spark.createDataFrame(
        [(i, [float(x) for x in v], "clash") for i, v in enumerate(values)],
        "vec_id long, embedding array<float>, dim string",
    )


def exact(rows, queries, k):
    ids = np.array([r.vec_id for r in rows])
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found = {}
    for q in queries:
        score = unit @ unit[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        found[q] = [(int(ids[i]), float(score[i])) for i in order]
    return found


def test_recall_and_scores(vectors):
    queries = vectors.where("vec_id % 50 = 0")
    found = neighbours.nearest(vectors, queries).collect()
    want = exact(vectors.collect(), range(0, 1500, 50), 5)
    true = {q: dict(v) for q, v in want.items()}
    hits = [(r.query_id, r.vec_id) for r in found if r.vec_id in true[r.query_id]]
    assert len(found) == 150 and len(hits) >= 0.9 * 150
    for r in found:
        if r.vec_id in true[r.query_id]:
            assert r.score == pytest.approx(true[r.query_id][r.vec_id], abs=1e-12)
    for q in true:
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)


def test_several_blocks_give_one_answer(vectors, monkeypatch):
    queries = vectors.where("vec_id % 100 = 0")
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    found = neighbours.nearest(vectors, queries).collect()
    want = exact(vectors.collect(), range(0, 1500, 100), 5)
    assert len({(r.query_id, r["rank"]) for r in found}) == 75
    assert sum(r.vec_id in dict(want[r.query_id]) for r in found) >= 0.9 * 75


def test_unsound_vectors_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    data = [
        (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]),
        (6, [2.0, 0.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]),
        (10, []), (7, [1.0, 1.0]),
    ]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = neighbours.nearest(frame, frame).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in found} == {0, 6, 7, 8}
    assert [(r.vec_id, round(r.score, 6)) for r in found if r.query_id == 0] == [
        (6, 1.0), (7, 0.707107), (8, 0.707107),
    ]


def test_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(none, none).count() == 0


def test_windows_grow_until_enough_collide():
    rng = np.random.default_rng(1)
    search = neighbours.Search(directions=16)
    index = rng.normal(size=(300, 16)).astype(np.float32)
    found = list(neighbours.candidates(index, index[:5], search, 1e-3, 40))
    assert all(len(f) >= 40 and i in f for i, f in enumerate(found))
    every = list(neighbours.candidates(index, index[:2], search, 1e-3, 10**6))
    assert all(len(f) == 300 for f in every)
