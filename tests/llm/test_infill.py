import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_tables import edges, nothing  # noqa: F401
from tillsight.llm import infill

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plainly(doc_id, text):
    """The contract, by lists of units."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab Z.\n<PSM>é東\U0001f600\x00", max_size=300))
def test_every_rank_is_reached_exactly(text):
    units = UNIT.findall(text)
    found = infill.SkipList(text)
    assert found.n == len(units)
    at = np.cumsum([0, *map(len, units)])
    assert [found.place(i) for i in range(found.n + 1)] == at.tolist()


def test_lanes_of_long_texts_and_slices(monkeypatch):
    pick = random.Random(3)
    text = "".join(pick.choice(["word", "x", " ", "é", "\U0001f600", "Long" * 30]) for _ in range(60_000))
    at = np.cumsum([0, *map(len, UNIT.findall(text))])
    for size in (1 << 20, 1000):
        monkeypatch.setattr(infill, "SLICE", size)
        found = infill.SkipList(text)
        assert 3 <= len(found.lanes) <= 9 and len(found.lanes[-1][0]) <= 16
        for units, points, _ in found.lanes:
            assert units.sum() == found.n and points.sum() == len(text)
        for rank in [0, found.n, *(pick.randrange(found.n) for _ in range(500))]:
            assert found.place(rank) == at[rank]
    with pytest.raises(IndexError):
        found.place(found.n + 1)


def test_texts_by_the_contract(spark, edges, nothing):  # noqa: F811
    tricky = ["<P>", "a<", "<<S", "<P x <S y <M", "x<S", "M>a<M", "P>S>M>", "ab " * 50, None, "\n\r\x00"]
    rows = [(i, tricky[i % len(tricky)]) for i in range(400)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    for frame in (more, edges):
        want = sorted(
            ((r.doc_id, *plainly(r.doc_id, r.text)) for r in frame.select("doc_id", "text").collect()), key=repr
        )
        found = infill.transform(frame)
        assert sorted(map(tuple, found.collect()), key=repr) == want
        texts = {r.doc_id: r.text or "" for r in frame.collect()}
        for r in infill.digests(found).collect():
            assert r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert {w[2] for w in want} >= {"plain", "psm"}
    assert infill.digests(infill.transform(nothing)).count() == 0
