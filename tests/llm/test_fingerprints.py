import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from corpus_tables import edges, nothing, prose  # noqa: F401
from tillsight.llm import fingerprints as fp


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def numbers(text):
    found = set()
    for shingle in shingles(text):
        h = 42
        for word in shingle:
            h = xxhash.xxh64(word.encode(), seed=h).intdigest()
        found.add((h >> 32) - (2**32 if h >> 63 else 0))
    return sorted(found)


def printed(text, kept=fp.KEPT):
    return "".join(f"{x + 2**31:08x}" for x in numbers(text)[:kept])


def edited(text, following):
    part = len(text) // 4
    return text[: len(text) - part] + following[:part]


@pytest.fixture(scope="module")
def texts(spark):
    data = [(7 * i % 101, prose(i, 10 + 9 * i) + " é😀 ſ" * (i % 4)) for i in range(40)]
    return spark.createDataFrame(data, "doc_id long, text string").repartition(6)


def test_fingerprints_equal_brute_force(texts):
    data = sorted(map(tuple, texts.collect()))
    found = {r.doc_id: r for r in fp.fingerprint(texts).collect()}
    assert len(found) == len(data)
    for i, (doc_id, text) in enumerate(data):
        following = data[(i + 1) % len(data)][1]
        other, r = edited(text, following), found[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (printed(text), printed(other))
        a, b = shingles(text), shingles(other)
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b), abs=0.15)
        assert r.near_next == pytest.approx(len(a & shingles(following)) / len(a | shingles(following)), abs=0.15)


def test_sketches_of_parts_merge_into_that_of_the_whole(spark):
    parts = [(k % 2, prose(k, 200)) for k in range(10)]
    frame = spark.createDataFrame(parts, "key int, text string").select("key", fp.sketch(F.col("text"), 16).alias("sketch"))
    found = {r.key: r.sketch for r in fp.merge_all(frame, "key", 16).collect()}
    for key in (0, 1):
        union = sorted(set().union(*(numbers(t) for k, t in parts if k == key)))
        assert found[key] == union[:16]


def test_estimates(spark):
    big, half = prose(1, 3000, 10**6), " ".join(prose(1, 3000, 10**6).split()[:1500])
    row = spark.createDataFrame([(big, half)], "a string, b string").select(
        fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b")
    ).select(
        fp.distinct_count(F.col("a")), fp.resemblance(F.col("a"), F.col("b")),
        fp.containment(F.col("b"), F.col("a")), fp.containment(F.col("a"), F.col("b")),
    ).first()
    assert row[0] == pytest.approx(2996, rel=0.3)
    assert row[1] == pytest.approx(0.5, abs=0.15)
    assert row[2] > 0.7 and row[3] == pytest.approx(0.5, abs=0.2)


def test_edges(edges, nothing):  # noqa: F811
    found = fp.fingerprint(edges).collect()
    assert len(found) == edges.count()
    by = {r.doc_id: r for r in found}
    assert (by[5].n_chars, by[5].fingerprint) == (0, "") == (by[1].n_chars, by[1].fingerprint)
    assert by[7].fingerprint == by[9].fingerprint == printed("The same old text of some words, again and again.")
    assert by[5].edited_sha256 == hashlib.sha256(b"").hexdigest()
    # the next of 9, the last, is 1, the first; the next of the null id is 1 too
    text = "The same old text of some words, again and again."
    assert by[9].edited_sha256 == hashlib.sha256(text[: len(text) - len(text) // 4].encode()).hexdigest()
    assert by[None].n_chars == 69 and by[2].near_next == 0.0
    assert fp.fingerprint(nothing).count() == 0
