"""Quality of documents by a convolutional network over bytes, written in numpy.

Bytes become short learned vectors; filters of six bytes, moved by two, run over the whole
document. Their largest responses are taken per chunk of 512 bytes, chunks overlapping by
half; the mean and the maximum over all chunks go into one logistic unit. Documents are
fitted on as they are scored: whole, by all their chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import label_sample, remainder, sampled_texts, working

DIM, FILTERS, TAPS = 5, 20, 3
HALF = 256
#: Bytes looked at in one go; bounds the memory for long documents.
SEGMENT = 1 << 16
#: Documents of each class that the network is fitted on.
SAMPLE_DOCS = 1000
#: Chunks whose gradients are summed together.
SLICE = 4096
THRESHOLD = 0.7


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # 2 DIM x TAPS FILTERS: byte pairs of each tap
    bias: np.ndarray
    out: np.ndarray  # 2 FILTERS: means, maxima
    shift: float

    @classmethod
    def start(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.5, (256, DIM)).astype("f4"),
            rng.normal(0, 0.3, (2 * DIM, TAPS * FILTERS)).astype("f4"),
            np.zeros(FILTERS, "f4"),
            rng.normal(0, 0.1, 2 * FILTERS).astype("f4"),
            0.0,
        )

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """Filter responses along the last axis of byte codes (even length)."""
        pairs = self.embed[codes].reshape(*codes.shape[:-1], codes.shape[-1] // 2, 2 * DIM)
        taps = pairs @ self.filters
        n = taps.shape[-2] - TAPS + 1
        total = taps[..., :n, :FILTERS] + self.bias
        for k in range(1, TAPS):
            total += taps[..., k : k + n, k * FILTERS : (k + 1) * FILTERS]
        return total

    def peaks(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest responses in each overlapping chunk of a whole document.

        Returns them, the first byte of the window that gave each, and the padded bytes.
        """
        reach = 2 * TAPS
        codes = np.frombuffer(data, np.uint8)
        size = max(HALF, -(-len(codes) // HALF) * HALF) + reach - 2
        codes = np.concatenate([codes, np.zeros(size - len(codes), np.uint8)])
        tops, places = [], []
        for at in range(0, size - reach + 2, SEGMENT):
            part = codes[at : min(at + SEGMENT, size - reach + 2) + reach - 2]
            found = self.responses(part).reshape(-1, HALF // 2, FILTERS)
            best = found.argmax(axis=1)
            tops.append(np.take_along_axis(found, best[:, None], 1)[:, 0])
            places.append(at + HALF * np.arange(len(best))[:, None] + 2 * best)
        top, place = np.concatenate(tops), np.concatenate(places)
        if len(top) > 1:
            later = top[1:] > top[:-1]
            top = np.where(later, top[1:], top[:-1])
            place = np.where(later, place[1:], place[:-1])
        return top, place, codes

    def pooled(self, data: bytes) -> np.ndarray:
        """Largest responses, at least 0, in each overlapping chunk of a whole document."""
        return np.maximum(self.peaks(data)[0], 0)

    def margin(self, data: bytes) -> float:
        chunks = self.pooled(data)
        both = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])
        return float(both @ self.out + self.shift)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gradients(net: Network, docs: list[bytes], y, weight) -> dict[str, np.ndarray]:
    """Loss gradients of a batch of whole documents."""
    raw, seen, both, shares = [], [], [], []
    for data in docs:
        top, place, codes = net.peaks(data)
        tops = np.maximum(top, 0)
        most = tops.max(axis=0)
        winner = tops == most
        raw.append(top)
        seen.append(codes[place[..., None] + np.arange(2 * TAPS)])
        both.append(np.concatenate([tops.mean(axis=0), most]))
        shares.append(winner / winner.sum(axis=0))
    number = np.array([len(top) for top in raw])
    owner = np.repeat(np.arange(len(docs)), number)
    both = np.stack(both)
    error = ((sigmoid(both @ net.out + net.shift) - y) * weight / weight.sum()).astype("f4")
    back = error[:, None] * net.out
    pool = back[owner, :FILTERS] / number[owner, None] + back[owner, FILTERS:] * np.concatenate(shares)
    pool = (pool * (np.concatenate(raw) > 0)).astype("f4")
    seen = np.concatenate(seen)
    filters = np.zeros((2 * DIM, TAPS, FILTERS), "f4")
    embed = np.zeros_like(net.embed)
    kernels = net.filters.reshape(2 * DIM, TAPS, FILTERS)
    for at in range(0, len(seen), SLICE):
        part, of = seen[at : at + SLICE], pool[at : at + SLICE]
        vectors = net.embed[part].reshape(len(part), FILTERS, TAPS, 2 * DIM)
        filters += np.einsum("bf,bfkd->dkf", of, vectors)
        toward = np.einsum("bf,dkf->bfkd", of, kernels).reshape(-1, DIM)
        for d in range(DIM):
            embed[:, d] += np.bincount(part.ravel(), toward[:, d], 256).astype("f4")
    return {
        "embed": embed, "filters": filters.reshape(2 * DIM, TAPS * FILTERS), "bias": pool.sum(axis=0),
        "out": both.T @ error, "shift": error.sum(),
    }


def fit(docs: list[bytes], y, weight, epochs: int = 10, batch: int = 32, seed: int = 7) -> Network:
    """A network fitted by Adam to whole documents."""
    net, rng = Network.start(seed), np.random.default_rng(seed)
    names = ("embed", "filters", "bias", "out", "shift")
    slow = {k: np.zeros_like(np.asarray(getattr(net, k), "f4")) for k in names}
    spread = {k: np.zeros_like(np.asarray(getattr(net, k), "f4")) for k in names}
    y, weight, step = np.asarray(y, "f4"), np.asarray(weight, "f4"), 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            pick, step = order[at : at + batch], step + 1
            for k, g in _gradients(net, [docs[i] for i in pick], y[pick], weight[pick]).items():
                slow[k] = 0.9 * slow[k] + 0.1 * g
                spread[k] = 0.999 * spread[k] + 0.001 * g * g
                move = slow[k] / (1 - 0.9**step)
                move = move / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - rate * move).astype("f4"))
    net.shift = float(net.shift)
    return net


def train(
    docs: DataFrame,
    labels: DataFrame,
    most: int = SAMPLE_DOCS,
    divisor: int = 4,
    held_out: int = 2,
) -> Network:
    """Fit on a bounded sample: ``most`` whole documents of each class.

    Only rows outside the held-out fold are used; of rows with one id, the smallest text. The
    driver gets the sampled texts. Without any label the network gives the score of its start.
    """
    sample = label_sample(labels, "quality", divisor, held_out, most)
    rows = sampled_texts(docs, sample).collect()
    rows.sort(key=lambda r: r.doc_id)
    texts = [(r.text or "").encode("utf-8", "replace") for r in rows]
    return fit(texts, [r.y for r in rows], [r.weight for r in rows])


def score(text: Column, net: Network) -> Column:
    """Probability that a text is good; null counts as empty. Every byte is looked at."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        working("quality")
        for batch in batches:
            margins = [net.margin((t or "").encode("utf-8", "replace")) for t in batch]
            yield pd.Series(sigmoid(np.array(margins, "f8")))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts are scored like any other; a null id is not held out. Repeated rows
    are scored each; an empty table gives no rows; further columns are ignored.
    """
    net = train(docs, labels)
    return docs.select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        score(F.col("text"), net).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the network accepts, with all their columns.

    Null and empty texts are scored as empty ones and stay or go by that score; repeated rows
    stay or go together.
    """
    net = train(docs, labels)
    return docs.where(score(docs["text"], net) >= threshold)
