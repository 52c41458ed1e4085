import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpus_tables import EDGES, edges, nothing, prose  # noqa: F401
from tillsight.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


ODD = [
    "Don't they've I'll  'S ''s x'tra", "a1b22c333", "½ ² ٣ Ⅷ", "é É ﬁ ΣΑΣ Σας İI ıK", "日本語 テスト",
    "<|endoftext|> a<|startoftext|>b", "a b c\x85d\x1ce​f", "\U0001f468‍\U0001f469 ok!!..,,",
    "_under__score_ #tag @x a_b", "ÄÖÜ straße STRASSE ẞ", "́start ́", "", "   ",
    "don’t l'été d'où aujourd'hui", "x\x00y \x07", "ﬀ ŉ ǰ", "Œuvre œil", "can't.Won't,it's;we're",
]


def test_ids_of_words_are_those_of_the_whole_text(tokenizer):
    encoder = packing.WordIds(packing.vocabulary())
    pick = random.Random(3)
    letters = "abcXYZäÖßéÉñ0189'.,;!?-_#&€ſK \n\t ́日"
    texts = ODD + ["".join(pick.choice(letters) for _ in range(60)) for _ in range(400)]
    for text in texts + texts[::-1]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.get(text), "<u4").tolist() == want, text


def test_forgetting_words_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "BYTES_KEPT", 800)
    encoder = packing.WordIds(packing.vocabulary())
    for text in ("one two three four five", "Five, four three", "one two"):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.get(text), "<u4").tolist() == want


def test_ids_of_many_texts_at_once(tokenizer):
    encoder = packing.WordIds(packing.vocabulary())
    texts = [None, *ODD, None, "one two", "one  two", *ODD[::-1]]
    want = [tokenizer.encode(text or "", add_special_tokens=False).ids for text in texts]
    for kind in (pa.string(), pa.large_string()):
        found = encoder.many(pa.array(texts, kind))
        assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == want
        cut = encoder.many(pa.array(texts, kind).slice(3, 9))
        assert [np.frombuffer(ids, "<u4").tolist() for ids in cut] == want[3:12]
    assert encoder.many(pa.array([], pa.string())) == []


def test_words_of_many_texts_are_cut_and_encoded_once():
    # Occurrences are numbered by Arrow; Python cuts and encodes what differs.
    class Line:
        def __init__(self, line):
            self.line, self.letters = line, 0

        def findall(self, text):
            self.letters += len(text)
            return self.line.findall(text)

    encoder = packing.WordIds(packing.vocabulary())
    encoder.line, asked = Line(encoder.line), []
    encode = encoder.parts.encode
    encoder.parts.encode = lambda part: asked.append(part) or encode(part)
    words = [f"{a}{b}re" for a in "bcdfgh" for b in "aeiou"]
    texts = pa.array([" ".join(words[i % 7 :: 3]) for i in range(500)])
    first, again = encoder.many(texts), encoder.many(texts)
    assert first == again
    assert sorted(asked) == sorted(words)
    assert encoder.line.letters <= 2 * len(" ".join(words))


def test_texts_are_taken_together_up_to_a_size():
    sizes = [3, 4, 50, 0, 9, 1, 1]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(8), "text": [*("x" * n for n in sizes), None]})
    parts = [part["doc_id"].to_pylist() for part in packing.together(batch, 10)]
    assert parts == [[0, 1], [2], [3, 4, 5], [6, 7]]
    assert [p.num_rows for p in packing.together(batch.slice(0, 0), 10)] == [0]


def test_pieces_do_not_depend_on_what_is_taken_together(tokenizer, monkeypatch, spark):
    data = [(i, prose(i, 40)) for i in range(60)] + [(61, None), (62, ""), (None, "x y")]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    want = sorted(map(str, packing.tokenized(frame, capacity=30).collect()))
    monkeypatch.setattr(packing, "BYTES_TOGETHER", 300)
    assert sorted(map(str, packing.tokenized(frame, capacity=30).collect())) == want
    assert check(tokenizer, data, packing.pack(frame, capacity=30).collect(), 30)


def check(tokenizer, data, found, capacity=packing.CAPACITY):
    """Every document comes back whole, and the sequences have neither gaps nor overlaps."""
    want = []
    for doc_id, text in data:
        ids = ids_of(tokenizer, text)
        for piece, at in enumerate(range(0, len(ids), capacity)):
            cut = np.array(ids[at : at + capacity], "<u4").tobytes()
            want.append((doc_id, piece, at, len(cut) // 4, zlib.crc32(cut)))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, want))
    end = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
        assert end[r.sequence_id] <= capacity
    return len(end)


def test_round_trip_and_number_of_sequences(spark, tokenizer):
    data = [(i, prose(i, 3 + 17 * i % 900)) for i in range(300)] + [(1000, prose(5, 9000))]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    found = packing.pack(frame).collect()
    total = sum(r.length for r in found)
    assert check(tokenizer, data, found) == -(-total // packing.CAPACITY)


def test_best_fit_takes_the_tightest_room():
    bins, offsets = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8]


def test_bounds_never_exceed_a_packing():
    rng = np.random.default_rng(8)
    for _ in range(60):
        capacity = int(rng.integers(5, 60))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 80)))
        bins, _ = packing.best_fit(lengths, capacity)
        filled = np.bincount(bins, weights=lengths)
        bound = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        assert filled.max() <= capacity and -(-lengths.sum() // capacity) <= bound <= len(filled)
    halves = np.bincount([51] * 7, minlength=101)
    assert packing.lower_bound(halves, 100) == 7
    assert packing.lower_bound(np.bincount([34] * 9, minlength=101), 100) == 5


def test_edges(edges, nothing, tokenizer):  # noqa: F811
    found = packing.pack(edges).collect()
    check(tokenizer, [(r[0], r[1]) for r in EDGES], found)
    assert {(r.length, r.piece) for r in found if r.doc_id in (5, 1, 2)} == {(1, 0)}
    assert packing.pack(nothing).count() == 0


def test_exchange_comes_within_a_hundredth_of_the_bound(spark, tokenizer, monkeypatch, caplog):
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    monkeypatch.setattr(packing, "MERGE", 4)
    data = [(i, prose(i, 3 + 17 * i % 300)) for i in range(400)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    with caplog.at_level("INFO", "tillsight.llm.packing"):
        found = packing.pack(frame, capacity=1000).collect()
    lengths = np.array([r.length for r in found if r.length < 1000])
    bound = packing.lower_bound(np.bincount(lengths, minlength=1001), 1000) + sum(r.length == 1000 for r in found)
    number = check(tokenizer, data, found, 1000)
    assert bound <= number <= bound * 1.01 + 1
    assert f"no packing has fewer than {bound}" in caplog.messages[-1] or len(lengths) < len(found)


def test_kept_bins_are_full_but_for_the_slack():
    kept = packing._kept(np.array([1.0, 0.5, 0.999, 1.0, 0.9]), 0.01)
    assert kept.tolist() == [True, False, True, True, False]
    assert packing._kept(np.array([0.3]), 0.01).tolist() == [False]
    # Two thirds of the room are empty, but no packing has fewer bins.
    bound, measure = packing.best_dual(np.bincount([51] * 7, minlength=101), 100)
    assert bound == 7 and packing._kept(np.full(7, measure[51])).all()
