"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The word list is learned: words far more frequent in the toxic documents of a labelled
sample, besides a few fixed ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import label_sample, remainder, sampled_texts, stored, working
from tillsight.llm.near_dedup import BANDS, HASHES, shingle_hashes, signature

#: Documents of each class in the labelled sample, and its folds.
SAMPLE_DOCS, FOLDS = 3000, 4
#: A learned word stands in so many toxic texts, and its log odds are above this.
LEAST_TEXTS, LEAST_ODDS = 3, 2.3
THRESHOLD = 0.5
#: Share of MinHash values in which near copies agree.
ALIKE = 0.8
#: Words between a listed word and one that addresses the reader: close by, and without either.
NEAR, FAR = 5, 1000

# Common English insults and words that address the reader.
INSULTS = (
    "clown", "disgusting", "dumb", "fool", "garbage", "hate", "idiot", "idiots", "jerk",
    "liar", "loser", "losers", "moron", "morons", "pathetic", "scum", "shut", "stupid",
    "trash", "ugly", "vermin", "worthless",
)
YOU = frozenset(
    "you your yours yourself du dich dir dein deine tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes".split()
)
# Signs that stand for letters.
LOOKS = str.maketrans("013457@$!|", "oieastasil")

LETTERS = re.compile(r"[^\W\d_]+")
#: A run of letters with signs or digits among them or at its ends.
MASKED = re.compile(r"(?<![\w@$!|*.\-+])[^\W\d_]*+[\d@$!|*.\-_+][\w@$!|*.\-+]*")
#: Words with signs in place of letters have so many letters to tell them by.
TELLING = 2
STRETCHED = re.compile(r"(.)\1{2,}")
CAPITALS = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{3,}\b")

FEATURES = (
    "list_density", "list_hits", "list_distinct", "weight_density", "weight_best",
    "masked_hits", "masked_rate", "you_rate", "you_near", "you_distance", "capital_rate", "shout_rate", "exclaim_rate",
    "question_rate", "mark_rate", "stretch_rate", "word_length", "words",
)


def by_length(words: Iterable[str]) -> dict[int, str]:
    """The words of each length, a line for each."""
    lines: dict[int, list[str]] = {}
    for word in words:
        lines.setdefault(len(word), []).append(word)
    return {n: "\n".join(sorted(of)) for n, of in lines.items()}


def masked_spots(low: str) -> list[tuple[int, str]]:
    """Place and text of the runs that mix letters with signs or digits.

    Marks at the ends of a run are punctuation, besides a ``!`` before letters; ``*`` around
    letters alone is emphasis.
    """
    spots = []
    for found in MASKED.finditer(low):
        spot = found.group().strip(".-_+").rstrip("!.-_+")
        core = spot.strip("*")
        if spot and not (core.isalpha() and spot[0] == spot[-1]) and any(map(str.isalpha, spot)):
            spots.append((found.start(), spot))
    return spots


def unmasked(spot: str, words: dict[str, float], lengths: dict[int, str]) -> bool:
    """Whether a run with signs stands for a listed word; ``*`` is any letter."""
    if spot in words:
        return False
    plain = spot.translate(LOOKS)
    forms = {plain, re.sub(r"[^\w*]|_", "", plain), re.sub(r"[\W\d_]", "", spot)}
    if spot[0] == "!":
        forms |= {spot[1:].translate(LOOKS)} - {spot[1:]}
    for form in forms:
        if form in words:
            return True
        if "*" in form and sum(map(str.isalpha, form)) >= TELLING and len(form) in lengths:
            pattern = re.escape(form).replace(r"\*", r"[^\W\d_]")
            if re.search(f"^{pattern}$", lengths[len(form)], re.M):
                return True
    return False


def features(text: str | None, words: dict[str, float], lengths: dict[int, str] | None = None) -> list[float]:
    """The dense features of one whole text; ``words`` is the list with its weights.

    ``lengths`` is ``by_length(words)``, for callers with many texts.
    """
    text = text or ""
    low = text.lower()
    found = LETTERS.findall(low)
    n, size = max(1, len(found)), max(1, len(text))
    hits = [w for w in found if w in words]
    spots = masked_spots(low) if any(c in low for c in "0123456789@$!|*.-_+") else []
    if spots and lengths is None:
        lengths = by_length(words)
    masked = [at for at, spot in spots if unmasked(spot, words, lengths)]
    you = [i for i, w in enumerate(found) if w in YOU]
    near, nearest = 0.0, FAR
    if you and (hits or masked):
        places = [i for i, w in enumerate(found) if w in words]
        if masked:
            starts = [m.start() for m in LETTERS.finditer(low)]
            places += np.searchsorted(starts, masked).tolist()
        spread = np.array([-FAR, *you, 10**9 + FAR])
        after = np.searchsorted(spread, places)
        gaps = np.minimum(spread[after] - places, places - spread[after - 1])
        near, nearest = float((gaps <= NEAR).mean()), min(FAR, int(gaps.min()))
    weights = [words[w] for w in hits]
    marks = sum(map(text.count, "!?#$%&*@"))
    letters = sum(map(len, found))
    upper = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    return [
        100 * len(hits) / n, np.log1p(len(hits)), float(len(set(hits))),
        100 * sum(weights) / n, max(weights, default=0.0),
        float(len(masked)), 100 * len(spots) / n, 100 * len(you) / n, near, np.log1p(nearest),
        upper / max(1, letters), 100 * len(CAPITALS.findall(text)) / n,
        100 * text.count("!") / n, 100 * text.count("?") / n, marks / size,
        100 * len(STRETCHED.findall(low)) / n, letters / n, np.log1p(len(found)),
    ]


@dataclass
class Trees:
    """Boosted trees of equal depth, kept as arrays: one split for each level and node."""

    depth: int = 3
    start: float = 0.0
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for which, cut, leaf in self.splits:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, which[node]] > cut[node])
            total += leaf[node - (2**self.depth - 1)]
        return total


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def boost(
    x, y, weight, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48
) -> Trees:
    """Trees boosted on the weighted logistic loss, with splits from feature histograms."""
    base = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    model = Trees(depth, float(np.log(base / (1 - base))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    coded = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), model.start)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = sigmoid(margin)
        slope, bend = (y - p) * weight, p * (1 - p) * weight
        which, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == at)
                best = 1e-6
                s, b = slope[rows].sum(), bend[rows].sum()
                for j, e in enumerate(edges):
                    if not len(e) or not len(rows):
                        continue
                    left_s = np.bincount(coded[rows, j], slope[rows], len(e) + 1).cumsum()[:-1]
                    left_b = np.bincount(coded[rows, j], bend[rows], len(e) + 1).cumsum()[:-1]
                    gain = left_s**2 / (left_b + 1) + (s - left_s) ** 2 / (b - left_b + 1) - s * s / (b + 1)
                    gain[(left_b < 0.2) | (b - left_b < 0.2)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, which[at], cut[at] = gain[k], j, e[k]
            node = 2 * node + 1 + (x[np.arange(len(y)), which[node]] > cut[node])
        place = node - inner
        leaf = rate * np.bincount(place, slope, inner + 1) / (np.bincount(place, bend, inner + 1) + 1)
        model.splits.append((which, cut, leaf))
        margin += leaf[place]
    return model


def isotonic(score, y, weight) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps that fit ``y`` best, by pooling neighbours: knots and values."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # knot, value, weight
    for i in order:
        pools.append([float(score[i]), float(y[i]), float(weight[i]), float(score[i])])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            _, v, w, hi = pools.pop()
            last = pools[-1]
            last[1] = (last[1] * last[2] + v * w) / (last[2] + w)
            last[2] += w
            last[3] = hi
    knots = np.array([k for p in pools for k in (p[0], p[3])])
    # A pool of few rows is no proof of 0 or 1.
    values = np.array([(p[1] * p[2] + 0.02) / (p[2] + 0.04) for p in pools for _ in range(2)])
    return knots, np.maximum.accumulate(values)


@dataclass
class Model:
    words: dict[str, float]
    trees: Trees
    knots: np.ndarray
    values: np.ndarray

    def scores(self, texts) -> np.ndarray:
        lengths = by_length(self.words)
        x = np.array([features(t, self.words, lengths) for t in texts], "f8").reshape(-1, len(FEATURES))
        return np.interp(self.trees.margin(x), self.knots, self.values)


def fit(words: dict[str, float], x, y, weight, fold) -> Model:
    """Trees on all rows, calibrated on margins of trees that did not see the row."""
    x, y, weight = (np.asarray(v, "f8") for v in (x, y, weight))
    if not len(y) or y.min() == y.max():
        rate = float(np.average(y, weights=weight)) if len(y) else 0.0
        return Model(words, Trees(), np.array([0.0]), np.array([rate]))
    margin, fold = np.empty(len(y)), np.asarray(fold)
    for k in np.unique(fold):
        seen = fold != k
        if not seen.any():
            seen = fold == k
        margin[fold == k] = boost(x[seen], y[seen], weight[seen]).margin(x[fold == k])
    return Model(words, boost(x, y, weight), *isotonic(margin, y, weight))


def word_lists(
    sample: DataFrame, folds: int = FOLDS
) -> tuple[dict[str, float], list[dict[str, float]]]:
    """Words of toxic documents by log odds: from all folds, and without each fold.

    ``sample`` has ``text``, ``y``, ``fold`` and ``head``, which is equal for copies: of these,
    the one of the smallest ``doc_id``, where there are ids, counts, so copies prove nothing. A
    word must stand in at least three toxic texts and ten times as often as in others. The
    driver gets all words of which that holds with or without one of the folds, and no more.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    order = [F.col(name) for name in ("doc_id", "text") if name in sample.columns]
    once = sample.groupBy("fold", "head", "y").agg(F.min_by("text", F.struct(*order)).alias("text"))
    each = [(y, k) for y in (1, 0) for k in range(folds)]

    def counted(y: int, k: int) -> Column:
        return F.sum(((F.col("y") == y) & (F.col("fold") == k)).cast("int")).alias(f"n{y}_{k}")

    total = once.agg(*[F.coalesce(counted(y, k), F.lit(0)).alias(f"n{y}_{k}") for y, k in each]).first()
    choices: list[int | None] = [None, *range(folds)]

    def seen(n, y: int, left_out: int | None):
        return sum(n(f"n{y}_{k}") for k in range(folds) if k != left_out)

    def odds(n, left_out: int | None, log):
        of = [max(1, seen(total.__getitem__, y, left_out)) for y in (0, 1)]
        share = [(seen(n, y, left_out) + 0.5) / (of[y] + 1) for y in (0, 1)]
        return log(share[1] / share[0])

    telling = [
        (seen(F.col, 1, k) >= LEAST_TEXTS) & (odds(F.col, k, F.log) > LEAST_ODDS) for k in choices
    ]
    rows = (
        once.select("y", "fold", F.explode(words).alias("word"))
        .groupBy("word")
        .agg(*[counted(y, k) for y, k in each])
        .where(reduce(Column.__or__, telling))
        .orderBy("word")
        .collect()
    )

    def listed(left_out: int | None) -> dict[str, float]:
        found = dict.fromkeys(INSULTS, 3.0)
        for r in rows:
            weight = float(odds(r.__getitem__, left_out, np.log))
            if seen(r.__getitem__, 1, left_out) >= LEAST_TEXTS and weight > LEAST_ODDS:
                found[r["word"]] = weight
        return found

    return listed(None), [listed(k) for k in range(folds)]


def copy_groups(heads: list[int], signatures: np.ndarray, alike: float = ALIKE) -> dict[int, int]:
    """Numbers of texts whose near copies have a smaller one, to the smallest of their group.

    Texts that share a band of their signatures are compared with the first text that has it;
    near copies agree in the share ``alike`` of all hashes.
    """
    order = np.argsort(heads, kind="stable")
    above = list(range(len(heads)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    first: dict[tuple[int, bytes], list[int]] = {}
    for at, i in enumerate(order):
        for band, key in enumerate(signatures[i].reshape(BANDS, -1)):
            pivots = first.setdefault((band, key.tobytes()), [])
            for other in pivots:
                if (signatures[i] == signatures[order[other]]).mean() >= alike:
                    one, two = sorted((top(at), top(other)))
                    above[two] = one
                    break
            else:
                pivots.append(at)
    return {heads[i]: heads[order[top(at)]] for at, i in enumerate(order) if top(at) != at}


def grouped(sample: DataFrame) -> DataFrame:
    """``sample`` with ``head``, a number equal for copies and near copies, and ``fold``.

    The driver gets one signature for each text of the bounded sample.
    """

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [signature(shingle_hashes(text)).tobytes() for text in batch["text"]]
            yield pd.DataFrame({"head": batch["head"], "signature": found})

    whole = stored(sample.withColumn("head", F.xxhash64(F.lower(F.coalesce("text", F.lit(""))))), "labelled")
    rows = whole.groupBy("head").agg(F.min("text").alias("text"))
    rows = rows.mapInPandas(signed, "head long, signature binary").collect()
    signatures = np.frombuffer(b"".join(bytes(r.signature) for r in rows), np.uint32).reshape(-1, HASHES)
    moved = list(copy_groups([r["head"] for r in rows], signatures).items())
    groups = sample.sparkSession.createDataFrame(moved, "head long, group long")
    head = F.coalesce("group", "head")
    return (
        whole.join(F.broadcast(groups), "head", "left")
        .withColumn("head", head).drop("group")
        .withColumn("fold", F.pmod("head", F.lit(FOLDS)).cast("int"))
    )


def train(
    docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, divisor: int = 5, held_out: int = 0
) -> Model:
    """Fit on at most ``most`` labelled documents of each class outside the held-out fold.

    Of rows with one id the smallest text counts.

    Each training document is measured with the word list of the other folds, so the list does
    not look better to the trees than it is on new documents.
    """
    sample = label_sample(labels, "toxic", divisor, held_out, most)
    joined = grouped(sampled_texts(docs, sample))
    words, others = word_lists(joined)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series, fold: pd.Series) -> pd.Series:
        lengths = [by_length(of) for of in others]
        return pd.Series([features(t, others[k], lengths[k]) for t, k in zip(texts, fold)])

    rows = joined.select(
        "doc_id", "y", "weight", "fold", measured("text", "fold").alias("x")
    ).collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    return fit(
        words, [r.x for r in rows], [r.y for r in rows], [r.weight for r in rows], [r.fold for r in rows]
    )


def score(text: Column, model: Model) -> Column:
    """Probability that a whole text is toxic; null counts as empty."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        working("toxicity")
        for batch in batches:
            yield pd.Series(model.scores(batch), dtype="f8")

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts are scored like any other; a null id counts as empty text in the fold.
    Repeated rows are scored each; an empty table gives no rows; further columns are ignored.
    """
    model = train(docs, labels)
    return docs.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        score(F.col("text"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns.

    Null and empty texts are scored as empty ones; repeated rows stay or go together.
    """
    model = train(docs, labels)
    return docs.where(score(docs["text"], model) < threshold)
