import random
import re

import numpy as np
import pytest

from conftest import rows
from corpus_tables import corpus, edges, nothing, prose  # noqa: F401
from tillsight.llm import near_dedup as nd
from tillsight.llm.graph import components


def shingles(text, width=2):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(docs, width=2):
    """``{doc_id: (n, component)}`` by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in docs}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    label[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def found(frame, **settings):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(frame, **settings).collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_equals_all_pairs(corpus, width):  # noqa: F811
    want = brute([(r.doc_id, r.text) for r in corpus.collect()], width)
    assert found(corpus, words=width) == want
    assert len({c for _, c in want.values()}) < len(want)


def test_a_large_group_of_near_copies_with_outsiders(spark, monkeypatch):
    """Copies far from the pivot and from each other meet in tiles."""
    pick = random.Random(7)
    base = prose(1, 80).split()
    data = []
    for i in range(120):
        words = list(base)
        for _ in range(pick.choice((1, 2, 4, 6, 8))):
            words[pick.randrange(80)] = f"n{pick.randrange(50)}"
        data.append((i, " ".join(words)))
    monkeypatch.setattr(nd, "TILE", 16)
    frame = spark.createDataFrame(data, "doc_id long, text string")
    assert found(frame) == brute(data)


def test_edges(edges, nothing):  # noqa: F811
    got = nd.near_duplicates(edges).collect()
    assert len(got) == edges.count()
    by = {r.doc_id: r for r in got}
    assert [by[i].n_shingles for i in (5, 1, 2, 3)] == [0, 0, 0, 1]
    assert all(by[i].component_id == i and by[i].kept for i in (5, 1, 2, 3, 4, 8, 6))
    assert (by[9].component_id, by[9].kept) == (7, False) and by[7].kept
    assert by[None].component_id is None and by[None].kept
    assert nd.near_duplicates(nothing).count() == 0
    kept = nd.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, 8, None]))


def test_hashes_follow_words():
    assert np.array_equal(nd.shingle_hashes("A b  C"), nd.shingle_hashes("\ta B\nc "))
    assert len(nd.shingle_hashes("a b a b a")) == 2 and len(nd.shingle_hashes("x")) == 1
    assert not len(nd.shingle_hashes(" \n")) and not len(nd.shingle_hashes(None))
    assert not np.array_equal(nd.shingle_hashes("É b"), nd.shingle_hashes("é b"))
    assert len(nd.shingle_hashes("y" * 3000 + " z")) == 1
    texts = [prose(i, 40, 10**6) for i in range(300)]
    assert sum(len(nd.shingle_hashes(t)) for t in texts) == sum(len(shingles(t)) for t in texts)


def test_signatures_estimate_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    a, b = nd._mix(a), nd._mix(b)
    same = (nd.signature(a) == nd.signature(b)).mean()
    assert same == pytest.approx(800 / 1200, abs=0.12)


def test_the_sequential_test_keeps_what_may_be_a_link():
    needed = nd.least_matches()
    assert len(needed) == nd.HASHES // nd.BATCH and needed == sorted(needed)
    rng = np.random.default_rng(6)
    for k, least in enumerate(needed, start=1):
        assert (rng.binomial(k * nd.BATCH, 0.8, 20_000) < least).mean() < 1e-3
        assert (rng.binomial(k * nd.BATCH, 0.3, 2_000) >= least).mean() < (0.5 if k == 1 else 0.1)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(7, 7)]
    got = dict(rows(components(spark.createDataFrame(links, "a long, b long"))))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(51)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
