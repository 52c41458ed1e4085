"""Language identification by hyperdimensional profiles.

A letter is a random vector of +1 and -1. An n-gram is the product of its letters' vectors,
each rotated by its place; a text is the sum of its n-grams; a language is the sum of its
texts, each of length one. A text gets the language whose profile has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import remainder, small, working

DIM, ORDER = 512, 3
#: Documents of each language that its profile is made of.
SAMPLE_DOCS = 400
#: N-gram vectors a worker remembers, 20 MB; others are made when needed.
GRAMS_KEPT = 10_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=20_000)
def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng(code).choice(np.array([-1, 1], np.float32), DIM)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text and how often each stands there.

    Letters in lower case; all else is one space between words. An n-gram is a number: its
    code points, 21 bits each.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    kept = letter | np.concatenate([[False], letter[:-1]])
    codes = np.concatenate([[np.uint64(32)], codes[kept], [np.uint64(32)]])
    if not letter[-1]:
        codes = codes[:-1]
    number = np.zeros(max(0, len(codes) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        number = number << np.uint64(21) | codes[k : k + len(number)]
    return np.unique(number, return_counts=True)


def gram_vector(number: int) -> np.ndarray:
    found = np.ones(DIM, np.float32)
    for place in range(ORDER):
        found = found * np.roll(letter_vector(number >> 21 * place & 0x1FFFFF), place)
    return found


class Vectors:
    """N-gram vectors, remembered up to a number of them."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.rows = np.empty((0, DIM), np.float32)

    def total(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The vector of a text: the sum over its n-grams."""
        if not len(numbers):
            return np.zeros(DIM, np.float32)
        at = np.searchsorted(self.known, numbers)
        seen = at < len(self.known)
        seen[seen] = self.known[at[seen]] == numbers[seen]
        result = counts[seen].astype(np.float32) @ self.rows[at[seen]]
        if not seen.all():
            new = np.stack([gram_vector(int(n)) for n in numbers[~seen]])
            result = result + counts[~seen].astype(np.float32) @ new
            if len(self.known) + len(new) <= GRAMS_KEPT:
                order = np.argsort(np.concatenate([self.known, numbers[~seen]]), kind="stable")
                self.known = np.concatenate([self.known, numbers[~seen]])[order]
                self.rows = np.concatenate([self.rows, new])[order]
        return result


_VECTORS = Vectors()


def forget() -> None:
    """Drop the vectors of this worker."""
    _VECTORS.forget()


def text_vector(text: str | None) -> np.ndarray:
    """The vector of a text, of length one; zero without letters."""
    total = _VECTORS.total(*grams(text))
    size = float(np.linalg.norm(total))
    return total / size if size else total


@dataclass
class Profiles:
    names: list[str]
    vectors: np.ndarray  # a row of length one for each language

    def predict(self, text: str | None) -> tuple[str, float]:
        vector = text_vector(text)
        if not len(self.names) or not vector.any():
            return UNKNOWN, 0.0
        near = self.vectors @ vector
        best = int(near.argmax())
        return self.names[best], float(min(1.0, max(0.0, near[best])))


def first_ids(ids: DataFrame, most: int) -> DataFrame:
    """For each ``lang`` the first ``most`` of its ids by hash: ``doc_id, lang``.

    The ids of a language are counted by the first sixteen bits of the hash; only those up to
    the bits that reach ``most`` are put in order.
    """
    bits = F.shiftright(F.xxhash64("doc_id"), 48)
    upto = Window.partitionBy("of").orderBy("bits")
    reached = (
        ids.groupBy(F.col("lang").alias("of"), bits.alias("bits"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
        .groupBy("of")
        .agg(
            F.coalesce(F.min(F.when(F.col("upto") >= most, F.col("bits"))), F.max("bits")).alias("edge")
        )
    )
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    return (
        ids.join(small(reached, "reached"), F.col("lang") == F.col("of"))
        .where(bits <= F.col("edge"))
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= most)
        .select("doc_id", "lang")
    )


def train(docs: DataFrame, most: int = SAMPLE_DOCS, divisor: int = 5, held_out: int = 0) -> Profiles:
    """Profiles from at most ``most`` documents of each language outside the held-out fold.

    The pick is by hash of the id. Partial sums are made by the tasks; the driver gets one
    vector for each language.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).where(
        remainder(F.col("doc_id"), divisor) != held_out
    )
    picked = small(first_ids(usable.select("doc_id", "lang").distinct(), most), "picked")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working("language", forget)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                total[lang] = total.get(lang, 0) + text_vector(text)
        yield pd.DataFrame(
            [(lang, i, float(v)) for lang, t in total.items() for i, v in enumerate(t)],
            columns=["lang", "i", "v"],
        )

    rows = (
        usable.select("doc_id", "lang", "text")
        .join(picked, ["doc_id", "lang"])
        .select("lang", "text")
        .mapInPandas(sums, "lang string, i int, v double")
        .groupBy("lang", "i")
        .agg(F.sum(F.col("v").cast("decimal(20,9)")).cast("double").alias("v"))
        .collect()
    )
    names = sorted({r.lang for r in rows})
    place = {lang: k for k, lang in enumerate(names)}
    vectors = np.zeros((len(names), DIM), np.float32)
    for r in rows:
        vectors[place[r.lang], r.i] = r.v
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles(names, vectors / np.where(size > 0, size, 1))


def predicted(text: Column, profiles: Profiles) -> Column:
    """Language and cosine of a whole text, as a struct."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        working("language", forget)
        for batch in texts:
            rows = [profiles.predict(t) for t in batch]
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0. Ties go to the first
    language by name. A null id counts as empty text in the fold and is never learned from.
    Repeated rows are predicted each; an empty table gives no rows; further columns are ignored.
    """
    profiles = train(docs)
    return docs.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        predicted(F.col("text"), profiles).alias("found"),
    ).select("doc_id", "held_out", "found.lang_pred", "found.score")
