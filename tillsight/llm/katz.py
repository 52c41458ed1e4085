"""Katz backoff language model over whole corpora: learned from some documents, scoring all.

Documents are coded in batches of a bounded number of tokens. Level by level, a batch sends each
of its distinct n-grams once to the bucket that the n-gram's hash names, with its count in the
batch's documents to learn from. The bucket sums the counts, gives every n-gram a number and
answers the batch. A frequent n-gram so is one entry of each batch, however often it occurs.

An n-gram of level k is its context's number at level k - 1 and its last word's number at level
1. Counts up to five are discounted by Good and Turing's estimate. What a context loses goes to
the words not seen after it, by their probability at the level below; the weight is exact: the
probabilities after any context, with one event for unknown words, sum to one. A token's
probability is found recursively: its discounted count, or its context's weight times the
probability one level down.

Everything that moves or is stored is a row ``level, bucket, batch, data`` of packed arrays. The
rows of ``batch`` -1 are the model's tables, partitioned by bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import remainder, returned, stored

ORDER = 2
#: Counts above this are not discounted.
TRUSTED = 5
#: Tokens of a batch, at most; longer documents go on in the next one.
BATCH_TOKENS = 1 << 20
#: Tokens of the corpus for each bucket.
BUCKET_TOKENS = 1 << 21
#: Bytes of a text that are split into words together.
SLICE = 1 << 22

# Neither mark can be a word, for both hold white space.
START, END = b"\n<s>", b"\n</s>"

ROWS = "level int, bucket int, batch long, data binary, sums array<long>"
#: Level numbers of the batches' words, of the batches themselves and, added to a level, of its
#: contexts.
WORDS, CODED, CONTEXTS = -1, 0, 1000


# Packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; numbers that are few but repeated are coded."""
    import zstandard

    parts = []

    def put(kind: str, array: np.ndarray) -> None:
        array = np.ascontiguousarray(array)
        parts.append(f"{kind}{array.dtype.str[1:]}{len(array):x} ".encode())
        parts.append(array.view(np.uint8).reshape(len(array), array.itemsize).T.tobytes())

    for array in arrays:
        if array.dtype == np.float64 and len(array):
            values, codes = np.unique(array, return_inverse=True)
            if 2 * len(values) <= len(array):
                put("a", values)
                put("c", codes.astype(np.uint32))
                continue
        put("a", array)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    data, at, arrays = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        stop = data.index(b" ", at)
        kind, dtype = data[at : at + 1], np.dtype("<" + data[at + 1 : at + 3].decode())
        n = int(data[at + 3 : stop], 16)
        planes = np.frombuffer(data, np.uint8, n * dtype.itemsize, stop + 1)
        array = np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).reshape(n)
        at = stop + 1 + n * dtype.itemsize
        if kind == b"c":
            arrays[-1] = arrays[-1][array]
        else:
            arrays.append(array)
    return arrays


def rises(sorted_numbers: np.ndarray) -> np.ndarray:
    return np.diff(sorted_numbers, prepend=sorted_numbers.dtype.type(0))


# Coding documents


def tokens_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text, runs without white space with A-Z in lower case, then the end.

    Long texts are split slice by slice; a word may go on through several slices.
    """
    data, begun = text.encode("utf-8", "surrogatepass").lower(), []
    for at in range(0, len(data) - SLICE + 1, SLICE):
        part = data[at : at + SLICE]
        words = part.split()
        open_end = not part[-1:].isspace()
        if begun and len(words) == 1 and open_end and not part[:1].isspace():
            begun += words
            continue
        if begun:
            if words and not part[:1].isspace():
                begun.append(words.pop(0))
            words.insert(0, b"".join(begun))
            begun = []
        if open_end:
            begun = [words.pop()]
        yield words
    rest = data[len(data) // SLICE * SLICE :]
    yield [*(b"".join([*begun, rest]) if not rest[:1].isspace() else b"".join([*begun, b" ", rest])).split(), END]


class Numbers(dict):
    """Numbers of words in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Batch:
    """Pieces of documents, coded by words of the batch; at most ``BATCH_TOKENS`` tokens.

    A piece starts with the ``order - 1`` tokens before it, START for the first piece.
    """

    def __init__(self, order: int):
        self.order, self.numbers, self.tokens, self.pieces, self.size = order, Numbers(), [], [], 0

    def add(self, doc: tuple, before: np.ndarray, tokens: np.ndarray) -> None:
        """``doc`` is ``(uid, doc_id, whether that is null, learn)``."""
        self.tokens += [before, tokens]
        self.size += len(before) + len(tokens)
        self.pieces.append((*doc, len(before) + len(tokens)))

    def rows(self, number: int) -> pd.DataFrame:
        """The batch's words, as sorted hashes with counts to learn, and its documents: ids and
        lengths of the pieces, tokens by frequency of the words, and places of these words among
        the hashes."""
        import xxhash

        uid, doc_id, no_id, learn, length = (np.array(x) for x in zip(*self.pieces))
        tokens = np.concatenate(self.tokens)
        counted = np.repeat(learn, length) & (places(length) >= self.order - 1)
        words = len(self.numbers)
        by_use = np.argsort(-np.bincount(tokens, minlength=words), kind="stable")
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), np.uint64, words)
        by_hash = np.argsort(hashes)
        counts = np.bincount(tokens[counted], minlength=words)[by_hash]
        documents = pack(
            uid, doc_id, no_id.astype(np.uint8), learn.astype(np.uint8), length,
            inverse(by_use)[tokens].astype(np.uint32), inverse(by_hash)[by_use].astype(np.uint32),
        )
        listed = pack(rises(hashes[by_hash]), counts.astype(np.uint32))
        return frame_of([(WORDS, None, number, listed, None), (CODED, None, number, documents, None)])


def inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def places(length: np.ndarray) -> np.ndarray:
    """Place of each token within its piece."""
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)


def coded(docs: DataFrame, learn: Column, order: int) -> DataFrame:
    """Rows of the levels WORDS and CODED, one of each for a batch."""

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        uid, batch = number, Batch(order)

        for frame in frames:
            for doc_id, text, learns in zip(frame["doc_id"].astype("Int64"), frame["text"], frame["learn"]):
                doc = (uid, 0, True, learns) if doc_id is pd.NA else (uid, doc_id, False, learns)
                uid, last = uid + 1, [START] * (order - 1)
                for words in tokens_of(text or ""):
                    for at in range(0, len(words), BATCH_TOKENS):
                        part = words[at : at + BATCH_TOKENS]
                        if batch.size and batch.size + len(part) + order > BATCH_TOKENS:
                            yield batch.rows(number)
                            number, batch = number + 1, Batch(order)
                            returned()
                        before, tokens = (
                            np.fromiter(map(batch.numbers.__getitem__, of), np.int64, len(of)) for of in (last, part)
                        )
                        batch.add(doc, before, tokens)
                        last = [*last, *part][len(last) + len(part) - order + 1 :]
        if batch.size:
            yield batch.rows(number)

    return docs.select("doc_id", "text", learn.alias("learn")).mapInPandas(code, ROWS)


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["level", "bucket", "batch", "data", "sums"])
    return out.astype({"level": "Int32", "bucket": "Int32", "batch": "Int64"})


# Questions of a batch, by bucket


def spread(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(bucket, places)`` for the buckets that occur."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def word_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of words; larger hashes are in later buckets, so sorted words stay in order."""
    return (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def word_questions(frames: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for batch, data in zip(frame["batch"], frame["data"]):
            hashes, counts = unpack(data)
            hashes = np.cumsum(hashes, dtype=np.uint64)
            parts = spread(word_bucket(hashes, buckets))
            yield frame_of([(1, b, batch, pack(rises(hashes[at]), counts[at]), None) for b, at in parts])


def bucket_of(context: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(33)) % np.uint64(buckets)


def distinct(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct pair, in order of the pairs, and each pair's number."""
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = int(word.max()) + 1
    if (int(context.max()) + 1) * span < 1 << 63:
        _, first, number = np.unique(context * span + word, return_index=True, return_inverse=True)
        return first, number
    order = np.lexsort((word, context))
    new = np.r_[True, (np.diff(context[order]) != 0) | (np.diff(word[order]) != 0)]
    number = np.empty(len(word), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class Model:
    """What all tasks know of a model: discounts by level, and sizes of level 1."""

    def __init__(self, order: int, buckets: int):
        self.order, self.buckets = order, buckets
        self.discounts: dict[int, np.ndarray] = {}
        self.tokens = self.types = 0
        self.lost = 0.0

    def learn(self, level: int, sums: list[int]) -> None:
        """``sums``: tokens, types, and how many n-grams occur once, twice and so on."""
        self.discounts[level] = discounts(sums[2:])
        if level == 1:
            self.tokens, self.types = sums[:2]
            rest = 1 - self.discounts[1][1 : TRUSTED + 1]
            self.lost = float((rest * np.arange(1, TRUSTED + 1) * sums[2 : TRUSTED + 2]).sum())

    def kept(self, level: int, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return self.discounts[level][np.minimum(counts, TRUSTED + 1)] * counts

    def single(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words by their counts; what the seen ones lose is one unknown word's."""
        total = self.tokens if self.lost > 0 else self.tokens + 1
        return np.where(counts > 0, self.kept(1, counts), self.lost or 1.0) / total


def discounts(occur: list[int]) -> np.ndarray:
    """Good-Turing discounts by count, up to one that stands for all trusted counts.

    ``occur[r - 1]`` n-grams occur ``r`` times. A discount that the counts can't support, which
    is one outside of 0 to 1, is left out.
    """
    found = np.ones(TRUSTED + 2)
    if occur[0]:
        common = (TRUSTED + 1) * occur[TRUSTED] / occur[0]
        for r in range(1, TRUSTED + 1):
            if occur[r - 1] and common != 1:
                d = ((r + 1) * occur[r] / (r * occur[r - 1]) - common) / (1 - common)
                found[r] = d if 0 < d <= 1 else 1.0
    return found


class View:
    """A batch with the answers it got so far.

    Over the tokens, for the highest level answered: ``number`` of the n-gram that ends there
    and the token's probability ``p``. For the level to ask next: the distinct n-grams with
    their ``bucket``, and ``key``, the n-gram of each token among them. Tokens before which a
    piece is too short for the level have no n-gram.
    """

    def __init__(self, rows: pd.DataFrame, model: Model):
        self.model = model
        data = {
            (level, -1 if pd.isna(bucket) else int(bucket)): d
            for level, bucket, d in zip(rows["level"], rows["bucket"], rows["data"])
        }
        self.uid, self.doc_id, no_id, learn, self.length, tokens, word = unpack(data[CODED, -1])
        self.no_id, self.learn = no_id.astype(bool), learn.astype(bool)
        self.place = places(self.length)
        self.piece = np.repeat(np.arange(len(self.length)), self.length)
        self.predicted = self.place >= model.order - 1
        self.key, self.bucket = word.astype(np.int64)[tokens], None
        levels = {level for level, _ in data}
        ids, counts = self._answers(data, 1, None)
        self.word, self.known = ids[self.key] if len(ids) else self.key, counts[self.key]
        self.number, self.p = self.word, model.single(self.known)
        for level in range(2, model.order + 1):
            contexts, context_bucket = self.key, self.bucket
            at = self._ask(level)
            if level not in levels:
                return
            ids, counts = self._answers(data, level, self.bucket)
            totals, weights = self._answers(data, CONTEXTS + level, context_bucket)
            key, context = self.key[at], contexts[at - 1]
            count = counts[key]
            self.p[at] = np.where(
                count > 0, model.kept(level, count) / totals[context], weights[context] * self.p[at]
            )
            if level < model.order:
                self.number = np.full(len(self.word), -1)
                self.number[at] = ids[key]

    def _ask(self, level: int) -> np.ndarray:
        """Find the distinct n-grams of a level; returns the places of the tokens that have one."""
        at = np.flatnonzero(self.place >= level - 1)
        context, word = self.number[at - 1], self.word[at]
        first, pair = distinct(context, word)
        self.key = np.zeros(len(self.word), np.int64)
        self.key[at] = pair
        self.context, self.last, self.low = context[first], word[first], self.p[at[first]]
        learned = self.learn[self.piece[at]] & self.predicted[at]
        self.often = np.bincount(pair, learned, len(first)).astype(np.uint32)
        self.bucket = bucket_of(self.context, self.last, self.model.buckets)
        return at

    @staticmethod
    def _answers(data: dict, level: int, bucket: np.ndarray | None) -> list[np.ndarray]:
        """Two arrays over the n-grams, put together from the buckets' answers.

        Words, whose ``bucket`` is None, lie in the order of the buckets.
        """
        if bucket is None:
            return [np.concatenate(x) for x in zip(*[unpack(data[at]) for at in sorted(data) if at[0] == level])]
        out = None
        for b, at in spread(bucket):
            parts = unpack(data[level, b])
            out = out or [np.zeros(len(bucket) if len(part) else 0, part.dtype) for part in parts]
            for whole, part in zip(out, parts):
                whole[at if len(part) else slice(0)] = part
        return out

    def questions(self, level: int) -> list[tuple]:
        """Rows of a level's questions, one for each bucket."""
        return [
            (level, b, pack(rises(self.context[at]), self.last[at], self.often[at], self.low[at]))
            for b, at in spread(self.bucket)
        ]


# Buckets


def _answered(level: int, model: Model):
    """The function of a bucket: sums of counts, numbers of n-grams, answers to the batches."""

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        returned()
        bucket, rows = int(key[0]), rows.sort_values("batch")
        asked = [unpack(d) for d in rows["data"]]
        sizes = [len(a[-1]) for a in asked]
        if level == 1:
            words, counts = (np.concatenate(x) for x in zip(*[(np.cumsum(a[0], dtype=np.uint64), a[1]) for a in asked]))
            table, number = np.unique(words, return_inverse=True)
            kept = [rises(table)]
        else:
            context, last, counts, low = (np.concatenate(x) for x in zip(*[(np.cumsum(a[0]), *a[1:]) for a in asked]))
            first, number = distinct(context, last)
            kept = [rises(context[first]), last[first], low[first]]
        total = np.bincount(number, counts).astype(np.int64)
        ids = np.zeros(0, np.int64)
        if level < model.order:
            # Frequent n-grams get small numbers; the bucket can be told from the number.
            ids = np.empty(len(total), np.int64)
            ids[np.argsort(-total, kind="stable")] = np.arange(len(total)) * model.buckets + bucket
        occur = np.bincount(np.minimum(total, TRUSTED + 2), minlength=TRUSTED + 3)[1 : TRUSTED + 2]
        sums = [int(total.sum()), int((total > 0).sum()), *map(int, occur)]
        out = [(level, bucket, -1, pack(*kept, total, ids), sums)]
        at = 0
        for batch, size in zip(rows["batch"], sizes):
            part = number[at : at + size]
            at += size
            out.append((level, bucket, batch, pack(ids[part] if len(ids) else ids, total[part]), None))
        return frame_of(out)

    return answer


def _context_sums(level: int, model: Model):
    """Rows for the buckets of contexts: totals, losses and lower probabilities of what follows."""

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, data in zip(frame["bucket"], frame["data"]):
                context, _, low, counts, _ = unpack(data)
                context, seen = np.cumsum(context), counts > 0
                context, low, counts = context[seen], low[seen], counts[seen]
                if not len(context):
                    continue
                new = np.flatnonzero(np.r_[True, np.diff(context) != 0])
                lost = counts - model.kept(level, counts)
                sums = [np.add.reduceat(x, new) for x in (counts, lost, low)]
                context = context[new]
                yield frame_of(
                    [
                        (CONTEXTS + level, b, -1 - source, pack(context[at], *[s[at] for s in sums]), None)
                        for b, at in spread(context % model.buckets)
                    ]
                )

    return total


def _weighted(level: int, model: Model):
    """The function of a bucket of contexts: totals and backoff weights, answers to the batches."""

    def weigh(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        returned()
        bucket, rows = int(key[0]), rows.sort_values("batch")
        sums = [unpack(d) for d in rows.loc[rows["batch"] < 0, "data"]]
        empty = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        context, counts, lost, low = (np.concatenate(x) for x in zip(empty, *sums))
        contexts, number = np.unique(context, return_inverse=True)
        total, lost, low = (np.bincount(number, x, len(contexts)) for x in (counts, lost, low))
        # A context that loses nothing is given one unseen event.
        whole = np.where(lost > 0, total, total + 1)
        weight = np.where(lost > 0, lost, 1.0) / whole / np.maximum(1 - low, 1e-300)
        out = [(CONTEXTS + level, bucket, -1, pack(contexts, whole, weight), None)]
        for batch, data in zip(rows["batch"], rows["data"]):
            if batch >= 0:
                ids = unpack(data)[0].astype(np.int64)
                at = np.minimum(np.searchsorted(contexts, ids), max(len(contexts) - 1, 0))
                found = contexts[at] == ids if len(contexts) else np.zeros(len(ids), bool)
                totals, weights = np.ones(len(ids)), np.ones(len(ids))
                totals[found], weights[found] = whole[at[found]], weight[at[found]]
                out.append((CONTEXTS + level, bucket, batch, pack(totals, weights), None))
        return frame_of(out)

    return weigh


SCORED = "uid long, doc_id long, learned boolean, tokens long, known long, base double, score double"


def _scored(model: Model):
    def score(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        returned()
        view = View(rows, model)
        use = view.predicted
        piece, known = view.piece[use], view.known[use]
        n = len(view.length)
        base = np.log10((known + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
        return pd.DataFrame(
            {
                "uid": view.uid,
                "doc_id": pd.Series(view.doc_id).astype("Int64").mask(view.no_id),
                "learned": view.learn,
                "tokens": np.bincount(piece, minlength=n),
                "known": np.bincount(piece, known > 0, n).astype(np.int64),
                "base": np.bincount(piece, base, n),
                "score": np.bincount(piece, np.log10(view.p[use]), n),
            }
        )

    return score


def _asked(level: int, model: Model):
    def ask(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        returned()
        batch = int(key[0])
        return frame_of([(lv, b, batch, data, None) for lv, b, data in View(rows, model).questions(level)])

    return ask


def scored(docs: DataFrame, learn: Column, order: int = ORDER) -> tuple[DataFrame, dict[str, DataFrame], Model]:
    """Learn a model from the documents where ``learn`` holds and score all.

    Returns the scores (``doc_id``, ``learned``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score``, a row for each row of ``docs``), the stored tables by level, and
    the model's constants. Tokens are the words of the text and one end; a null text counts as
    empty. ``n_known`` tokens are among those learned. Repeated rows are documents of their own,
    learned from as often as they stand. With nothing to learn from, every word is unknown and
    has probability 1. An empty table gives no rows; further columns are ignored.
    """
    if order < 1:
        raise ValueError("order must be positive")
    spark = docs.sparkSession
    named = stored(coded(docs, learn, order), "coded")
    # Packed tokens take about two bytes.
    size = named.agg(F.sum(F.length("data"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-size // (2 * BUCKET_TOKENS)), min(tasks, -(-size // (1 << 17))))
    model, tables, answers = Model(order, buckets), {}, {}

    known = named.where(F.col("level") == CODED)
    for level in range(1, order + 1):
        if level == 1:
            words = named.where(F.col("level") == WORDS)
            asked = words.mapInPandas(lambda frames: word_questions(frames, buckets), ROWS)
        else:
            asked = known.groupBy("batch").applyInPandas(_asked(level, model), ROWS)
        found = stored(asked.groupBy("bucket").applyInPandas(_answered(level, model), ROWS), f"grams{level}")
        tables[f"grams{level}"] = found.where("batch < 0")
        answers[level] = found.where("batch >= 0")
        sums = tables[f"grams{level}"].agg(
            *[F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0)) for i in range(TRUSTED + 3)]
        )
        model.learn(level, list(sums.first()))
        known = known.unionByName(answers[level])
        if level > 1:
            partial = tables[f"grams{level}"].mapInPandas(_context_sums(level, model), ROWS)
            # Contexts are the n-grams of the level below, in the buckets that numbered them.
            waiting = answers[level - 1].unionByName(partial)
            weighed = stored(waiting.groupBy("bucket").applyInPandas(_weighted(level, model), ROWS), f"contexts{level}")
            tables[f"contexts{level}"] = weighed.where("batch < 0")
            known = known.unionByName(weighed.where("batch >= 0"))
    pieces = known.groupBy("batch").applyInPandas(_scored(model), SCORED)
    sums = pieces.groupBy("uid", "doc_id", "learned").agg(
        *[F.sum(c).alias(c) for c in ("tokens", "known", "base", "score")]
    )
    scores = sums.select(
        "doc_id",
        "learned",
        F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
    return scores, tables, model


def language_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of all documents by a model of those whose id leaves a remainder other than 1."""
    scores, _, _ = scored(docs, remainder(F.col("doc_id"), 5) != 1, order)
    return scores.select("doc_id", (~F.col("learned")).alias("held_out"), *scores.columns[2:])


def rows_of(table: DataFrame, level: int) -> DataFrame:
    """A stored table as rows: ``context``, ``word``, ``number`` and ``count`` of n-grams.

    At level 1 the context is 0 and the word a hash; above, both are numbers of level
    ``level - 1`` and of level 1.
    """

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["data"]:
                parts = unpack(data)
                if level == 1:
                    word, total, ids = parts
                    context, word = np.zeros(len(word), np.int64), np.cumsum(word, dtype=np.uint64).view(np.int64)
                else:
                    context, word, _, total, ids = parts
                    context = np.cumsum(context)
                yield pd.DataFrame(
                    {"context": context, "word": word, "number": ids if len(ids) else -1, "count": total}
                )

    return table.mapInPandas(expand, "context long, word long, number long, count long")
