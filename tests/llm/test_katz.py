import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpus_tables import edges, nothing  # noqa: F401
from tillsight.llm import katz


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    for gap in "\t\n\v\f\r":
        text = text.replace(gap, " ")
    return [w for w in text.split(" ") if w]


class Plain:
    """A Katz model by dictionaries and recursion."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [None] + [Counter() for _ in range(order)]
        for text in texts:
            tokens = ["<s>"] * (order - 1) + words(lowered(text)) + ["</s>"]
            for i in range(order - 1, len(tokens)):
                for k in range(1, order + 1):
                    self.counts[k][tuple(tokens[i - k + 1 : i + 1])] += 1
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.d = [None] + [self.discounts(Counter(c.values())) for c in self.counts[1:]]
        self.after = defaultdict(list)
        for k in range(1, order + 1):
            for gram in self.counts[k]:
                self.after[gram[:-1]].append(gram[-1])

    @staticmethod
    def discounts(n):
        def d(r):
            if r > 5 or not n[1] or 6 * n[6] == n[1]:
                return 1.0
            common = 6 * n[6] / n[1]
            x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            return x if 0 < x <= 1 else 1.0

        return d

    def parts(self, h):
        k = len(h) + 1
        counts = [self.counts[k][(*h, w)] for w in self.after[h]]
        total, kept = sum(counts), sum(self.d[k](c) * c for c in counts)
        lost = sum(c * (1 - self.d[k](c)) for c in counts)
        return (total, lost / total) if lost > 0 else (total + 1, 1 / (total + 1))

    def p(self, h, w):
        k = len(h) + 1
        c = self.counts[k][(*h, w)]
        if c:
            return self.d[k](c) * c / self.parts(h)[0]
        if not h:
            return self.parts(h)[1]
        if not self.after[h]:
            return self.p(h[1:], w)
        free = 1 - sum(self.p(h[1:], x) for x in self.after[h])
        return self.parts(h)[1] / free * self.p(h[1:], w)

    def score(self, text):
        body = [*words(lowered(text)), "</s>"]
        tokens = ["<s>"] * (self.order - 1) + body
        found = [self.p(tuple(tokens[i - self.order + 1 : i]), tokens[i]) for i in range(self.order - 1, len(tokens))]
        known = [self.counts[1][(w,)] for w in body]
        base = sum(math.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1))) for c in known)
        return len(body), sum(c > 0 for c in known), self.n, base, sum(map(math.log10, found))


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def compare(frame, order, learn=None):
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    plain = Plain([t for i, t in rows if not held(i)], order)
    want = sorted(((i, held(i), *plain.score(t)) for i, t in rows), key=repr)
    found = sorted(map(tuple, katz.language_scores(frame, order).collect()), key=repr)
    key = lambda r: (repr(r[0]), r[2], round(r[5], 3))
    for a, b in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return plain


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(f"W{int(pick.paretovariate(0.7)) % 60}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i // 2 if i % 7 == 0 else i, 5 + i % 60)) for i in range(150)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_by_recursion(docs, order):
    compare(docs, order)


def test_small_batches_and_many_buckets(docs, monkeypatch):
    monkeypatch.setattr(katz, "BATCH_TOKENS", 40)
    monkeypatch.setattr(katz, "SLICE", 64)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 300)
    compare(docs, 2)
    compare(docs, 3)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_after_any_context_sum_to_one(spark, docs, order):
    texts = [r.text for r in docs.collect()]
    plain = Plain(texts, order)
    for h in list(plain.after)[:80]:
        everything = [g[0] for g in plain.counts[1]] + ["unheard"]
        assert sum(plain.p(h, w) for w in everything) == pytest.approx(1)
    # Documents that differ in their last word only tell the model's own probabilities.
    for h in ("w1", "w2 w3"):
        body = [w for (w,) in plain.counts[1] if w != "</s>"]
        ask = [(1000, h), *[(1001 + i, f"{h} {w}") for i, w in enumerate([*body, "unheard"])]]
        frame = docs.unionByName(spark.createDataFrame(ask, "doc_id long, text string"))
        scores, _, _ = katz.scored(frame, katz.F.col("doc_id") < 1000, order)
        logs = {r.doc_id: r.score for r in scores.where("doc_id >= 1000").collect()}
        context = ["<s>"] * (order - 1) + h.split()
        start = logs[1000] - math.log10(plain.p(tuple(context[len(context) - order + 1 :]), "</s>"))
        total = 10 ** (logs[1000] - start)
        for i, w in enumerate([*body, "unheard"]):
            after = [*context, w]
            end = plain.p(tuple(after[len(after) - order + 1 :]), "</s>")
            total += 10 ** (logs[1001 + i] - math.log10(end) - start)
        assert total == pytest.approx(1)


def test_tables(docs):
    _, tables, model = katz.scored(docs, katz.F.lit(True), 2)
    plain = Plain([r.text for r in docs.collect()], 2)
    ones = katz.rows_of(tables["grams1"], 1).where("count > 0").collect()
    twos = katz.rows_of(tables["grams2"], 2).where("count > 0").collect()
    assert sorted(r["count"] for r in ones) == sorted(plain.counts[1].values())
    assert sorted(r["count"] for r in twos) == sorted(plain.counts[2].values())
    assert len({r.number for r in ones}) == len(ones) and (model.tokens, model.types) == (plain.n, plain.v)


def test_pack_round_trip():
    arrays = [np.arange(5), np.zeros(0), np.full(9, 0.25), np.random.default_rng(1).random(7), np.array([1, 255], np.uint8)]
    for a, b in zip(arrays, katz.unpack(katz.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64])
def test_tokens_by_slices(monkeypatch, size):
    monkeypatch.setattr(katz, "SLICE", size)
    for text in ("", " ", "a", "Ab cd\n\n efg  ", " x", "long" * 9 + "\t" + "É é  ", "a\x1cb"):
        found = [w for part in katz.tokens_of(text) for w in part]
        assert found == [*[w.encode() for w in words(lowered(text))], katz.END]


def test_distinct_without_room_for_one_number():
    big = np.array([2**61, 5, 2**61, 5, 7])
    word = np.array([2**60, 1, 2**60, 1, 1])
    first, number = katz.distinct(big, word)
    assert (big[first][number] == big).all() and (word[first][number] == word).all() and len(first) == 3


def test_edges(spark, edges, nothing):  # noqa: F811
    compare(edges, 2)
    assert katz.language_scores(nothing).count() == 0
    alone = spark.createDataFrame([(1, "not learned"), (2, None)], "doc_id long, text string")
    scores, _, _ = katz.scored(alone, katz.F.lit(False))
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in scores.collect()} == {
        (1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0),
    }
