import numpy as np
import pytest

from conftest import rows
from corpus_tables import edges, no_labels, nothing  # noqa: F401
from tillsight.llm import quality

SCHEMA = "doc_id long, text string, quality int"


def text_of(i):
    words = [f"word{(i * 7 + k * k) % 90}" for k in range(60)]
    return " ".join(w + "###" if i % 3 == 0 else w for w in words)


@pytest.fixture(scope="module")
def marked(spark):
    return spark.createDataFrame([(i, text_of(i), int(i % 3 > 0)) for i in range(400)], SCHEMA)


def test_held_out_documents_are_told_apart(marked):
    found = quality.classify(marked.select("doc_id", "text"), marked.select("doc_id", "quality")).collect()
    held = [r for r in found if r.held_out]
    assert 60 < len(held) < 140 and len(found) == 400
    right = sum(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)


def test_training_is_the_same_on_every_run_and_blind_to_held_out_labels(marked):
    docs, labels = marked.select("doc_id", "text"), marked.select("doc_id", "quality")
    flipped = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality"
    )
    one, two, three = quality.train(docs, labels), quality.train(docs, labels), quality.train(docs, flipped)
    for name in ("embed", "filters", "bias", "out"):
        assert np.array_equal(getattr(one, name), getattr(two, name))
        assert np.array_equal(getattr(one, name), getattr(three, name))


def test_every_byte_counts():
    net = quality.Network.start()
    long = b"abc " * 60_000
    for at in (0, 70_000, 239_000):
        marked = long[:at] + b"\xff\xfe\xfd#####" + long[at + 8 :]
        assert not np.array_equal(net.pooled(long).max(axis=0), net.pooled(marked).max(axis=0)) or (
            net.margin(long) != net.margin(marked)
        )


def test_segments_do_not_show(monkeypatch):
    net, data = quality.Network.start(), bytes(range(256)) * 40
    whole = net.pooled(data)
    monkeypatch.setattr(quality, "SEGMENT", 512)
    assert np.allclose(net.pooled(data), whole, atol=1e-5)


def plain_margin(net, data):
    """The network byte pair by byte pair: responses, halves, overlapping chunks, pools."""
    half, reach = quality.HALF, 2 * quality.TAPS
    size = max(half, -(-len(data) // half) * half)
    codes = np.frombuffer(data.ljust(size + reach - 2, b"\0"), np.uint8)
    kernel = net.filters.reshape(2 * quality.DIM, quality.TAPS, quality.FILTERS)
    found = np.zeros((size // 2, quality.FILTERS))
    for i in range(size // 2):
        total = net.bias.astype("f8").copy()
        for k in range(quality.TAPS):
            pair = net.embed[codes[2 * (i + k) : 2 * (i + k) + 2]].ravel()
            total += pair.astype("f8") @ kernel[:, k]
        found[i] = total
    halves = [found[i : i + half // 2].max(axis=0) for i in range(0, size // 2, half // 2)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
    chunks = np.maximum(chunks, 0)
    return float(np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ net.out + net.shift)


def test_scores_equal_the_network_written_out(spark):
    texts = [None, "", "a", "é" * 100, "some words " * 30, "x#" * 700, "long text, many chunks. " * 120]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    net = quality.train(docs, labels)
    for r in quality.classify(docs, labels).collect():
        want = plain_margin(net, (texts[r.doc_id] or "").encode())
        assert r.score == pytest.approx(quality.sigmoid(want), abs=1e-4)


def test_gradients_are_those_of_the_loss():
    rng, net = np.random.default_rng(2), quality.Network.start(3)
    docs = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (700, 1500, 90)]
    y, w = np.array([1.0, 0.0, 1.0], "f4"), np.array([1.0, 2.0, 0.5], "f4")
    gradient = quality._gradients(net, docs, y, w)

    def loss():
        p = quality.sigmoid(np.array([net.margin(d) for d in docs], "f8"))
        return -float((w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum())

    for name, at in (
        ("filters", (3, 7)), ("out", (4,)), ("out", (25,)), ("bias", (2,)), ("filters", (9, 41)), ("embed", (65, 2)),
    ):
        value, step = getattr(net, name), 2e-2
        value[at] += step
        up = loss()
        value[at] -= 2 * step
        down = loss()
        value[at] += step
        assert gradient[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_gradients_do_not_depend_on_slices(monkeypatch):
    net, data = quality.Network.start(), [bytes(range(256)) * 9, b"short"]
    y, w = np.array([1.0, 0.0], "f4"), np.ones(2, "f4")
    whole = quality._gradients(net, data, y, w)
    monkeypatch.setattr(quality, "SLICE", 2)
    monkeypatch.setattr(quality, "SEGMENT", 512)
    for name, value in quality._gradients(net, data, y, w).items():
        assert np.allclose(value, whole[name], atol=1e-5)


def test_long_documents_are_learned_whole(spark):
    """What tells good from bad stands anywhere in texts of up to 25,000 letters."""

    def text(i):
        words = [f"word{(i * 7 + k * k) % 90}" for k in range(60 if i % 4 else 3500)]
        if i % 3 == 0:
            at = (i * 37) % (len(words) - 20)
            words[at : at + 20] = ["###" + w for w in words[at : at + 20]]
        return " ".join(words)

    data = [(i, text(i), int(i % 3 > 0)) for i in range(500)]
    marked = spark.createDataFrame(data, SCHEMA)
    found = quality.classify(marked.select("doc_id", "text"), marked.select("doc_id", "quality")).collect()
    for long in (False, True):
        held = [r for r in found if r.held_out and (r.doc_id % 4 == 0) == long]
        right = sum(r.predicted == int(r.doc_id % 3 > 0) for r in held)
        assert len(held) > 15 and right >= 0.9 * len(held), (long, right, len(held))


def test_one_text_of_each_id(spark):
    rows_ = [(i, text_of(i)) for i in range(60)] + [(4, None)] + [(4, f"zz {k}") for k in range(300)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    sample = spark.createDataFrame([(i, i % 2, 1.0) for i in range(10)], "doc_id long, y int, weight double")
    found = {r.doc_id: r.text for r in quality.sampled_texts(docs, sample).collect()}
    assert found == {i: text_of(i) for i in range(10)}


def test_edges(edges, nothing, no_labels):
    found = quality.classify(edges, no_labels)
    assert found.count() == edges.count() and all(0 <= r[2] <= 1 for r in rows(found))
    assert quality.classify(nothing, no_labels).count() == 0
    assert quality.keep_good(edges, no_labels, 0.0).columns == edges.columns
    assert quality.keep_good(edges, no_labels, 0.0).count() == edges.count()
