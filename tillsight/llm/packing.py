"""Best-fit packing of tokenized documents into sequences, with certified bin counts.

Documents are tokenized once and cut into pieces; only the lengths and checksums go on. Pieces
are dealt to groups of bounded size, each packed by best-fit decreasing. The best of a family
of dual-feasible functions gives a lower bound for the number of sequences of all pieces. By
the same function every group measures its sequences and keeps as many as are full but for a
small share; their sum is certified against the bound. The pieces of all others meet in fewer
groups and are packed again, until they fit in one group; where their number hardly falls,
the share grows.
"""

from __future__ import annotations

import codecs
import itertools
import logging
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import stored, working

CAPACITY = 4096
END_ID = 1
#: Pieces of one group; a group is packed by one task.
GROUP_PIECES = 40_000
#: Groups that meet in one for the next round, at most.
MERGE = 16
#: Share of the kept sequences that may be empty by the measure of the bound.
SLACK = 0.002
#: The share is doubled when a round leaves more than this share of its pieces to the next.
FALLS = 0.7
#: Bytes of what a worker remembers of parts of words while documents are packed; beyond, it
#: starts anew.
BYTES_KEPT = 64 << 20
#: Bytes of an entry besides its letters and ids: a number, places in a dictionary and an array.
ENTRY_BYTES = 120
#: Bytes of texts whose words are numbered together; a longer text is taken alone.
BYTES_TOGETHER = 4 << 20
#: The letters that the vocabulary has for the 256 bytes of UTF-8 texts.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = sorted(set(range(256)) - set(_SHOWN))
BYTE_LETTERS = "".join(chr(256 + _HIDDEN.index(b) if b in _HIDDEN else b) for b in range(256))

LOG = logging.getLogger(__name__)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Token ids of whole texts, by way of their distinct words.

    The vocabulary ends words at white space and drops it, so the ids of a text are those of
    its white-space-separated words. Arrow splits many texts at once and numbers their distinct
    words; words of known letters are cut into parts as the tokenizer cuts them, in lower case,
    and its model encodes each part once. Other words are encoded by the tokenizer itself.
    """

    #: What the tokenizer takes as one part, for texts of these letters only.
    simple = re.compile(r"[a-zäöüßéèêëàâçîïôûùñíóúáœ]+|[^\sa-zäöüßéèêëàâçîïôûùñíóúáœ0-9]+|[0-9]")
    plain = re.compile(r"[ -&(-~äöüßÄÖÜéèêëàâçîïôûùñíóúáœÉÈÊËÀÂÇÎÏÔÛÙÑÍÓÚÁŒ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Spark runs a task on each core; more threads would only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.line = re.compile(f"{self.simple.pattern}| ")
        # Texts with these are encoded whole: special tokens, and characters that Python and
        # Arrow take for white space and the tokenizer does not.
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.special = "|".join([*added, r"[\x1c-\x1f]"])
        self.parts = _Parts(self.whole.model)

    def get(self, text: str) -> bytes:
        """The ids of one text, as little-endian bytes."""
        return self.many(pa.array([text], pa.string()))[0]

    def many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian bytes; a null one counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        special = pc.match_substring_regex(texts, self.special)
        words = pc.utf8_split_whitespace(pc.if_else(special, "", texts))
        ends = words.offsets.to_numpy()
        coded = words.values.dictionary_encode()
        ids, starts, lengths = self._words(coded.dictionary)
        index = coded.indices.to_numpy()
        sizes = lengths[index]
        data = ids[_runs(starts[index], sizes)].tobytes()
        ends = 4 * np.concatenate([[0], np.cumsum(sizes)])[ends]
        found = [data[a:b] for a, b in itertools.pairwise(ends.tolist())]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            coded = self.whole.encode(texts[i].as_py(), add_special_tokens=False)
            found[i] = np.array(coded.ids, "<u4").tobytes()
        if self.parts.size > BYTES_KEPT:
            self.parts = _Parts(self.whole.model)
        return found

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, and where those of each word start and how many they are."""
        line, odd = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py(), {}
        if not self.plain.fullmatch(line):
            listed = words.to_pylist()
            odd = {i: w for i, w in enumerate(listed) if w and not self.plain.fullmatch(w)}
            line = " ".join("" if i in odd else w for i, w in enumerate(listed))
        # The parts of all words at once; blanks stand between words.
        split = self.line.findall(line.lower())
        codes = np.fromiter(map(self.parts.__getitem__, split), np.int64, len(split))
        breaks = np.flatnonzero(codes == _Parts.BREAK)
        if odd:
            # A word that is encoded whole is one part, in the place that the line leaves empty.
            self.parts.learn(self.whole, odd.values())
            ends = np.append(breaks, len(codes))
            places = list(odd)
            codes = np.insert(codes, ends[places], [self.parts[w] for w in odd.values()])
            breaks = np.flatnonzero(codes == _Parts.BREAK)
        ids, starts, lengths = self.parts.of(codes)
        at = np.concatenate([[0], np.cumsum(lengths)])
        first = at[np.concatenate([[0], breaks + 1])]
        last = at[np.append(breaks, len(codes))]
        return ids[_runs(starts, lengths)], first, last - first


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, …`` of all runs, one run after the other."""
    ends = np.cumsum(lengths)
    places = np.repeat(starts - (ends - lengths), lengths)
    places += np.arange(len(places))
    return places


class _Parts(dict):
    """Numbers of parts by their text, and the ids of each; a part is encoded when first asked for."""

    #: The number of the blank between words, which has no ids.
    BREAK = 0

    def __init__(self, model):
        super().__init__({" ": self.BREAK})
        self.encode = model.tokenize
        self.ids, self.ends, self.size = array("I"), array("q", [0]), 0

    def __missing__(self, part: str) -> int:
        shown = part if part.isascii() else codecs.charmap_decode(part.encode(), "strict", BYTE_LETTERS)[0]
        return self._add(part, [token.id for token in self.encode(shown)])

    def _add(self, part: str, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        self.size += ENTRY_BYTES + sys.getsizeof(part) + 4 * len(ids)
        number = self[part] = len(self.ends) - 1
        return number

    def learn(self, tokenizer, words: Iterable[str]) -> None:
        """Encode whole words by ``tokenizer``, those that are not yet known."""
        new = [w for w in words if w not in self]
        for word, coded in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self._add(word, coded.ids)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and of the parts with these numbers where theirs start and how many they are."""
        ends = np.array(self.ends)
        starts = np.concatenate([[0], ends[:-1]])[numbers]
        return np.array(self.ids, "<u4"), starts, ends[numbers] - starts


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The encoder of this worker process; it keeps some of what it learned between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop the encoders of this worker. Tasks refer to it by name, as they do to the encoders."""
    _ENCODERS.clear()


def vocabulary() -> str:
    """Default tokenizer file, looked up where the task runs."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(data: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int]]:
    """``(piece, start, length, crc32)`` of a document's ids, given as little-endian bytes."""
    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
        cut = data[at : at + 4 * capacity]
        yield piece, at // 4, len(cut) // 4, zlib.crc32(cut)


def tokenized(
    docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY
) -> DataFrame:
    """The pieces of every document: ids of the text, then ``end_id``, cut at ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("packing", forget)
        ids = encoder(path or vocabulary())
        for batch in batches:
            for part in together(batch, BYTES_TOGETHER):
                doc_ids = part["doc_id"].cast(pa.int64()).to_pylist()
                rows = [
                    (doc_id, *row)
                    for doc_id, data in zip(doc_ids, ids.many(part["text"]))
                    for row in pieces_of(data + end, capacity)
                ]
                yield pa.RecordBatch.from_pylist([dict(zip(_PIECES.names, row)) for row in rows], _PIECES)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


_LONG = pa.int64()
_PIECES = pa.schema(
    {"doc_id": _LONG, "piece": pa.int32(), "start": _LONG, "length": _LONG, "ids_crc32": _LONG}
)


def together(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut where their texts come to ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
    at = total = 0
    for row, size in enumerate(sizes.tolist()):
        if row > at and total + size > most:
            yield batch.slice(at, row - at)
            at, total = row, 0
        total += size
    yield batch.slice(at)


def best_dual(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[int, np.ndarray]:
    """A number of bins that no packing can undercut, and the measure of each size behind it.

    ``counts[s]`` items have size ``s``; no bin measures more than 1. The best of two families
    of dual-feasible functions: items over ``capacity - p`` count whole and those under ``p``
    not at all; and sizes rounded down to multiples of a ``k``-th, exact multiples of a
    ``k + 1``-th excepted.
    """
    every = np.arange(capacity + 1)
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return 0, every / capacity
    n = counts[sizes].astype(np.int64)
    best, measure = -(-int((sizes * n).sum()) // capacity), every / capacity

    def rounded(of: np.ndarray, k: int) -> np.ndarray:
        # In units of 1 / (k * capacity), to stay in whole numbers.
        parts = of * (k + 1)
        return np.where(parts % capacity == 0, of * k, parts // capacity * capacity)

    def cut(of: np.ndarray, p: int) -> np.ndarray:
        return np.where(of > capacity - p, capacity, np.where(of < p, 0, of))

    for p in sizes[sizes * 2 <= capacity]:
        bound = -(-int((cut(sizes, p) * n).sum()) // capacity)
        if bound > best:
            best, measure = bound, cut(every, p) / capacity
    for k in range(1, 31):
        bound = -(-int((rounded(sizes, k) * n).sum()) // (k * capacity))
        if bound > best:
            best, measure = bound, rounded(every, k) / (k * capacity)
    return best, measure


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """A number of bins that no packing can undercut; ``counts[s]`` items have size ``s``."""
    return best_dual(counts, capacity)[0]


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, by best-fit decreasing.

    The open rooms are bits of one number, so the tightest room that fits is found by a shift.
    """
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            place = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, place = capacity, used
            used += 1
        bins[i], offsets[i] = place, capacity - room
        left = room - size
        if left:
            if not rooms[left]:
                open_rooms |= 1 << left
            rooms[left].append(place)
    return bins, offsets


PACKED = "uid long, length long, final boolean, bin long, offset long"


def _kept(measured: np.ndarray, slack: float = SLACK) -> np.ndarray:
    """Which bins to keep: as many as are full by their measure but for ``slack`` of their number."""
    order = np.argsort(-measured, kind="stable")
    empty = np.cumsum(1 - measured[order])
    few = np.flatnonzero(empty <= slack * np.arange(1, len(order) + 1) + 1e-9)
    kept = np.zeros(len(order), bool)
    kept[order[: few[-1] + 1 if len(few) else 0]] = True
    return kept


def _round(
    pieces: DataFrame, groups: int, stage: int, slack: float, measure: np.ndarray, capacity: int
) -> DataFrame:
    """Pack ``uid, length`` in ``groups`` groups; pieces given up are not ``final``."""

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        order = np.lexsort((group["uid"].to_numpy(), -lengths))
        group, lengths = group.iloc[order], lengths[order]
        bins, offsets = best_fit(lengths, capacity)
        kept = _kept(np.bincount(bins, measure[lengths]), slack)
        return pd.DataFrame(
            {
                "uid": group["uid"].to_numpy(),
                "length": lengths,
                "final": kept[bins],
                "bin": int(key[0]) << 32 | bins,
                "offset": offsets,
            }
        )

    # Pieces that met in one round are dealt anew in the next.
    group = F.pmod(F.xxhash64("uid", F.lit(stage)), F.lit(groups)).alias("group")
    return pieces.select("uid", "length", group).groupBy("group").applyInPandas(pack, PACKED)


def pack(
    docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY
) -> DataFrame:
    """Every piece of every document and its place in a sequence.

    Columns ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and
    ``offset``. Null and empty texts are one piece, the end id. Repeated rows and null ids are
    packed like others; an empty table gives no rows; further columns are ignored. ``path`` is
    the tokenizer file on the executors.
    """
    cut = stored(
        tokenized(docs, path, end_id, capacity).withColumn("uid", F.monotonically_increasing_id()),
        "pieces",
    )
    full = F.col("length") == capacity
    todo = cut.where(~full).select("uid", "length")
    counts = np.zeros(capacity + 1, np.int64)
    for row in todo.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    bound, measure = best_dual(counts, capacity)
    left, sequences, places, stage = int(counts.sum()), 0, None, 0
    groups, slack = max(1, -(-left // GROUP_PIECES)), SLACK
    while True:
        packed = stored(_round(todo, groups, stage, 1.0 if groups == 1 else slack, measure, capacity), f"packed{stage}")
        numbered = packed.where("final").select(
            "uid", (F.col("bin") + F.lit((stage + 1) << 56)).alias("sequence_id"), "offset"
        )
        places = numbered if places is None else places.unionByName(numbered)
        whole, rest = packed.agg(
            F.count(F.when(F.col("final") & (F.col("offset") == 0), 1)), F.count(F.when(~F.col("final"), 1))
        ).first()
        sequences += whole
        LOG.info("round %d: %d groups keep %d sequences, %d of %d pieces left", stage, groups, whole, rest, left)
        if not rest:
            break
        todo, stage = packed.where("NOT final").select("uid", "length"), stage + 1
        needed = -(-rest // GROUP_PIECES)
        slack = 2 * slack if rest > FALLS * left else slack
        groups, left = needed if needed == 1 else max(needed, -(-groups // MERGE)), rest
    LOG.info("%d sequences of pieces under the capacity; no packing has fewer than %d", sequences, bound)
    alone = cut.where(full).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return cut.where(~full).join(places, "uid").select(*alone.columns).unionByName(alone)
