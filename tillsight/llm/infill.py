"""Fill-in-middle: documents cut at two unit ranks and put together for infilling.

A unit is a run of the letters A-Z and a-z or any other single code point. The cuts are given
as unit ranks; an indexable skip list over the units turns a rank into a place in the text. Its
lowest lane has a link for each unit, each express lane above skips about fifteen of sixteen
nodes, and every link carries the number of units and of code points it passes. A descent
adds up the widths of the links it takes until it stands exactly at the rank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: A node of a lane is in the next lane with a chance of one in ``2 ** SKIP_BITS``.
SKIP_BITS = 4
#: Code points looked at together while the lanes are built.
SLICE = 1 << 20

FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _towers(n: int) -> np.ndarray:
    """Pseudo-random 64-bit numbers of the units; low zero bits make a node tall."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


def _unit_widths(text: str) -> np.ndarray:
    """Code points of each unit of a text, slice by slice."""
    starts, before = [], False
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = ((codes | 32) - 97).astype(np.uint32) < 26
        inside = letter.copy()
        inside[1:] &= letter[:-1]
        inside[0] &= before
        before = bool(letter[-1])
        starts.append(np.flatnonzero(~inside) + at)
    if not starts:
        return np.zeros(0, np.int64)
    return np.diff(np.concatenate(starts), append=len(text))


class SkipList:
    """The units of a text by rank. ``lanes`` runs from the lowest to the highest.

    A lane is ``(units, points, down)``: the widths of the link that leaves each node, and the
    node's number in the lane below. The first node of every lane is the head.
    """

    def __init__(self, text: str):
        points = _unit_widths(text)
        self.n, self.length = len(points), len(text)
        units = np.ones(self.n, np.int64)
        self.lanes = [(units, points, np.arange(self.n))]
        tower, mask = _towers(self.n), np.uint64((1 << SKIP_BITS) - 1)
        while len(points) > 1 << SKIP_BITS:
            up = tower & mask == 0
            up[0] = True
            nodes = np.flatnonzero(up)
            units, points = np.add.reduceat(units, nodes), np.add.reduceat(points, nodes)
            self.lanes.append((units, points, nodes))
            tower = tower[nodes] >> np.uint64(SKIP_BITS)

    def place(self, rank: int) -> int:
        """The code point at which unit ``rank`` begins; the length of the text for rank ``n``."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        if rank == self.n:
            return self.length
        node = passed = place = 0
        for units, points, down in reversed(self.lanes):
            while passed + units[node] <= rank:
                passed += int(units[node])
                place += int(points[node])
                node += 1
            node = int(down[node])
        return place


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four numbers of a document, from the SHA-256 of seed and id; a null id counts as empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform_text(
    text: str, numbers: list[int], plain_from: int = 90, spm_below: int = 20
) -> tuple[int, str, int | None, int | None, str]:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    units = SkipList(text)
    h1, h2, h3, h4 = numbers
    if not text or h3 % 100 >= plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return units.n, "plain", None, None, text
    first, second = (units.place(rank) for rank in sorted((h1 % (units.n + 1), h2 % (units.n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm_below:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return units.n, form, first, second - first, output


def transform(
    docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20
) -> DataFrame:
    """Every document in its form for infilling; one row per row of ``docs``.

    Columns ``doc_id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (code
    points; null if plain) and ``output``. Texts that are null, empty or hold a mark stay
    plain; a null text counts as empty. Repeated rows get the same cuts, since these come from
    the id; a null id counts as empty text there. An empty table gives no rows; further
    columns are ignored. Texts are not shuffled.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            rows = [
                transform_text(text or "", draws(None if doc_id is pd.NA else doc_id, seed), plain_from, spm_below)
                for doc_id, text in zip(ids, batch["text"])
            ]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            out.insert(0, "doc_id", ids.to_numpy(object))
            yield out.astype({"doc_id": "Int64", "n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(cut, FORMS)


def restored(output: Column, form: Column) -> Column:
    """The text behind an output. No mark is in a text that was cut, so each stands once."""

    def part(of: Column, mark: str, number: int) -> Column:
        return F.split_part(of, F.lit(mark), F.lit(number))

    middle = part(output, MIDDLE, 2)
    psm = F.concat(F.substr(part(output, SUFFIX, 1), F.lit(len(PREFIX) + 1)), middle, part(part(output, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(part(part(output, PREFIX, 2), MIDDLE, 1), middle, F.substr(part(output, PREFIX, 1), F.lit(len(SUFFIX) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(forms: DataFrame) -> DataFrame:
    """The result of :func:`transform` with hashes of output and restored text for the texts."""
    return forms.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


INFILL_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash
  FROM documents),
drawn AS (
  SELECT *, len(unit) AS n,
         CAST('0x' || substr(hash, 1, 8) AS BIGINT) % (len(unit) + 1) AS one,
         CAST('0x' || substr(hash, 9, 8) AS BIGINT) % (len(unit) + 1) AS two,
         CAST('0x' || substr(hash, 17, 8) AS BIGINT) % 100 AS h3,
         CAST('0x' || substr(hash, 25, 8) AS BIGINT) % 100 AS h4
  FROM units),
parts AS (
  SELECT *, array_to_string(unit[1:least(one, two)], '') AS prefix,
         array_to_string(unit[least(one, two) + 1:greatest(one, two)], '') AS middle,
         array_to_string(unit[greatest(one, two) + 1:], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM parts
"""
