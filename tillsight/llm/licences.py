"""Licence scan by a positional index of rare words.

Templates are notices with mandatory key phrases. All documents are counted once for the words
of these phrases. The index lists for a word the templates of which it is one of the rarest
words, and its place there. A document's words of the highest IDF are looked up first: a
document without the rarest word of any template is not read on. Every word found points to
places where its templates would start; those that the rarest words of a template agree on are
candidates. There all key phrases are verified word by word, and the whole notice gives the
score. One plan serves any number of templates: they are data of the index, not columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII but digits and letters.
CUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Anchors of a template whose postings are intersected.
ANCHORS = 2


@dataclass(frozen=True)
class Template:
    """A licence notice; the words in brackets are its mandatory key phrases.

    It starts at its first key phrase; places in it are counted from there.
    """

    label: str
    notice: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.replace("[", "").replace("]", "").split()

    @property
    def offset(self) -> int:
        return len(self.notice.split("[")[0].split())

    @property
    def phrases(self) -> list[tuple[int, list[str]]]:
        """Place and words of each key phrase."""
        found, at = [], -self.offset
        for number, part in enumerate(re.split(r"[\[\]]", self.notice)):
            if number % 2:
                found.append((at, part.split()))
            at += len(part.split())
        return found

    @property
    def phrase(self) -> list[str]:
        return self.phrases[0][1]


# The base phrases, then notices of the method's own.
TEMPLATES = (
    Template("gpl", "[gnu general public license]", True),
    Template("apache", "[apache license]", True),
    Template("cc-by", "[cc by]", True),
    Template("mit", "[mit license]", True),
    Template("gpl-2.0", "licensed under the [gnu general public license version 2]"),
    Template("gpl-3.0", "licensed under the [gnu general public license version 3]"),
    Template("lgpl", "licensed under the [gnu lesser general public license]"),
    Template("agpl", "licensed under the [gnu affero general public license]"),
    Template("apache-2.0", "licensed under the [apache license version 2 0]"),
    Template("cc-by-nc", "licensed under [cc by nc] 4 0"),
    Template("cc-by-sa", "licensed under [cc by sa] 4 0"),
    Template("cc-by-nd", "licensed under [cc by nd] 4 0"),
    Template("mpl", "subject to the terms of the [mozilla public license]"),
    Template("bsd", "[redistribution and use in source and binary forms] with or without modification"),
    Template("mit", "[permission is hereby granted free of charge] to any person obtaining a copy"),
    Template("all-rights-reserved", "[all rights reserved]"),
    Template(
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the "
        "[gnu general public license as published by the free software foundation either version 2 of the "
        "license] or at your option any later version this program is distributed in the hope that it will "
        "be useful but [without any warranty] without even the implied warranty of merchantability or "
        "fitness for a particular purpose see the gnu general public license for more details",
    ),
    Template(
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the "
        "[gnu general public license as published by the free software foundation either version 3 of the "
        "license] or at your option any later version this program is distributed in the hope that it will "
        "be useful but [without any warranty] without even the implied warranty of merchantability or "
        "fitness for a particular purpose see the gnu general public license for more details",
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license [you may not use this file except in "
        "compliance with the license] you may obtain a copy of the license at http www apache org licenses "
        "license 2 0 unless required by applicable law or agreed to in writing software [distributed under "
        "the license is distributed on an as is basis] without warranties or conditions of any kind either "
        "express or implied see the license for the specific language governing permissions and "
        "limitations under the license",
    ),
    Template(
        "mit",
        "[permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files] the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the software [the software is provided as is without "
        "warranty of any kind] express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
        "or copyright holders be liable for any claim damages or other liability whether in an action of "
        "contract tort or otherwise arising from out of or in connection with the software or the use or "
        "other dealings in the software",
    ),
    Template(
        "bsd-2-clause",
        "[redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met] 1 redistributions of source code must retain the "
        "above copyright notice this list of conditions and the following disclaimer 2 [redistributions in "
        "binary form must reproduce the above copyright notice] this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution",
    ),
    Template(
        "bsd-3-clause",
        "3 [neither the name of the copyright holder nor the names of its contributors] may be used to "
        "endorse or promote products derived from this software without specific prior written permission",
    ),
    Template(
        "isc",
        "[permission to use copy modify and or distribute this software for any purpose with or without fee "
        "is hereby granted] provided that the above copyright notice and this permission notice appear in "
        "all copies",
    ),
    Template(
        "mpl-2.0",
        "this source code form is [subject to the terms of the mozilla public license v 2 0] if a copy of "
        "the mpl was not distributed with this file you can obtain one at",
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty [in no event will the "
        "authors be held liable for any damages arising from the use of this software] permission is "
        "granted to anyone to use this software for any purpose including commercial applications and to "
        "alter it and redistribute it freely",
    ),
    Template(
        "unlicense",
        "[this is free and unencumbered software released into the public domain] anyone is free to copy "
        "modify publish use compile sell or distribute this software",
    ),
    Template("bsl-1.0", "[boost software license version 1 0]"),
    Template("epl", "[eclipse public license]"),
    Template("cc0", "[cc0 1 0 universal]"),
    Template("creative-commons-by", "licensed under a [creative commons attribution] license"),
)


def document_counts(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """In how many documents each word of a key phrase stands; all documents are counted.

    As many rows as the key phrases have words come to the driver.
    """
    vocabulary = sorted({w for t in templates for w in t.phrase})
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), CUT)
    rows = (
        docs.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("word"))
        .groupBy("word")
        .count()
        .collect()
    )
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in rows}


def anchors_of(template: Template, counts: dict[str, int]) -> list[tuple[str, int]]:
    """The rarest words of the first key phrase and their places in it, rarest first."""
    placed = {}
    for place, word in enumerate(template.phrase):
        placed.setdefault(word, place)
    return sorted(placed.items(), key=lambda x: (counts[x[0]], x[1]))[:ANCHORS]


def index_of(templates, counts: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """For each anchor its entries: template, place in it, and rank among its anchors."""
    index: dict[str, list[tuple[int, int, int]]] = {}
    for number, template in enumerate(templates):
        anchors = anchors_of(template, counts)
        for rank in range(ANCHORS):
            # A phrase of one word agrees with itself.
            word, place = anchors[min(rank, len(anchors) - 1)]
            index.setdefault(word, []).append((number, place, rank))
    return index


def _literal(value) -> Column:
    """Nested lists, tuples and numbers as a constant column."""
    if isinstance(value, dict):
        return F.create_map(*[c for k, v in value.items() for c in (F.lit(k), _literal(v))])
    if isinstance(value, list):
        return F.array(*map(_literal, value))
    if isinstance(value, tuple):
        return F.struct(*[_literal(v).alias(f"_{i}") for i, v in enumerate(value)])
    return F.lit(value)


def _candidates(index: Column) -> Column:
    """``(_0, _1)``: templates and the starts on which all their anchors agree, from ``hits``."""

    def pointed(hit: Column) -> Column:
        return F.transform(
            index[hit["word"]],
            lambda e: F.struct(e["_0"].alias("_0"), (hit["at"] - e["_1"]).alias("_1"), e["_2"].alias("rank")),
        )

    found = F.flatten(F.transform("hits", pointed))

    def ranked(rank: int) -> Column:
        return F.transform(
            F.filter(found, lambda c: c["rank"] == rank), lambda c: F.struct(c["_0"], c["_1"])
        )

    return reduce(F.array_intersect, map(ranked, range(ANCHORS)))


def _verified(phrases: Column) -> Column:
    """The candidates at which all key phrases of the template stand."""

    def stands(c: Column) -> Column:
        return (c["_1"] >= 0) & F.forall(
            F.get(phrases, c["_0"]),
            lambda p: F.slice("words", c["_1"] + p["_0"] + 1, F.size(p["_1"])) == p["_1"],
        )

    return F.filter("candidates", stands)


def _likeness(notices: Column) -> Column:
    """The largest share of a notice's words that stand around a place of its key phrases."""

    def share(c: Column) -> Column:
        notice = F.get(notices, c["_0"])
        places = F.sequence(F.lit(0), F.size(notice["_1"]) - 1)
        same = F.filter(
            places,
            lambda k: F.coalesce(
                F.get("words", c["_1"] - notice["_0"] + k) == F.get(notice["_1"], k), F.lit(False)
            ),
        )
        return F.size(same) / F.size(notice["_1"]).cast("double")

    return F.array_max(F.transform("found", share))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Licences of every row of ``docs``.

    Columns ``doc_id``, ``n_words``, ``n_base`` (places of base phrases), ``first_word`` and
    ``last_word`` (their smallest and largest start, else null), ``base_labels``, ``labels``
    and ``score``, the likeness of the best template, 0 without one. Labels are distinct,
    sorted and joined by commas. Null and empty texts have no words. Rows are scanned one by
    one, so repeated rows and null ids do not matter; an empty table gives no rows; further
    columns are ignored.
    """
    counts = document_counts(docs, templates)
    index = index_of(templates, counts)
    rarest = sorted({word for word, entries in index.items() if any(rank == 0 for *_, rank in entries)})
    text = F.coalesce("text", F.lit(""))
    # Whether a rarest word may occur; the postings decide.
    promising = text.rlike("(?i)" + "|".join(rarest))
    lowered = F.translate("text", UPPER, LOWER)
    placed = lambda w, i: F.struct(w.alias("word"), i.alias("at"))
    read = (
        docs.select(
            "doc_id",
            F.size(F.array_remove(F.split(text, CUT), "")).cast("long").alias("n_words"),
            F.when(promising, F.col("text")).alias("text"),
        )
        .withColumn("words", F.array_remove(F.split(lowered, CUT), ""))
        .withColumn("hits", F.filter(F.transform("words", placed), lambda h: h["word"].isin(*index)))
        .withColumn("candidates", _candidates(_literal(index)))
        .withColumn("found", _verified(_literal([t.phrases for t in templates])))
        .select("doc_id", "n_words", "words", F.when(F.size("found") > 0, F.col("found")).alias("found"))
    )
    labels = _literal([t.label for t in templates])
    base = [i for i, t in enumerate(templates) if t.base]

    def joined(found: Column) -> Column:
        named = F.transform(found, lambda c: F.get(labels, c["_0"]))
        return F.coalesce(F.array_join(F.sort_array(F.array_distinct(named)), ","), F.lit(""))

    of_base = F.filter("found", lambda c: c["_0"].isin(*base))
    places = F.transform(of_base, lambda c: c["_1"].cast("long"))
    return read.withColumn("places", places).select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        joined(of_base).alias("base_labels"),
        joined(F.col("found")).alias("labels"),
        F.coalesce(
            _likeness(_literal([(t.offset, t.words) for t in templates])), F.lit(0.0)
        ).alias("score"),
    )


def _sql(templates=TEMPLATES) -> str:
    """The same answer by looking for every phrase at every place."""

    def listed(words):
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    places = ",\n         ".join(
        f"CASE WHEN list_has_all(w, {listed(t.phrase)}) THEN "
        f"[i FOR i IN range(0, len(w) - {len(t.phrase) - 1}) IF w[i + 1] = '{t.phrase[0]}' AND "
        + " AND ".join(f"w[i + {at + 1}:i + {at + len(of)}] = {listed(of)}" for at, of in t.phrases)
        + f"] ELSE [] END AS p{i}"
        for i, t in enumerate(templates)
    )

    def labels(which):
        named = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{t.label}' END" for i, t in which)
        return f"array_to_string(list_sort(list_distinct([{named}])), ',')"

    def share(i, t):
        n, o = len(t.words), t.offset
        return (
            f"coalesce(list_max([len([j FOR j IN range(0, {n}) IF p + j - {o} >= 0 AND "
            f"w[p + j - {o} + 1] = ({listed(t.words)})[j + 1]]) / {float(n)} FOR p IN p{i}]), 0)"
        )

    numbered = list(enumerate(templates))
    base = [(i, t) for i, t in numbered if t.base]
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
places AS (
  SELECT doc_id, w, {places}
  FROM words)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST({" + ".join(f"len(p{i})" for i, _ in base)} AS BIGINT) AS n_base,
       list_min(list_concat({", ".join(f"p{i}" for i, _ in base)})) AS first_word,
       list_max(list_concat({", ".join(f"p{i}" for i, _ in base)})) AS last_word,
       {labels(base)} AS base_labels,
       {labels(numbered)} AS labels,
       greatest({", ".join(share(i, t) for i, t in numbered)}) AS score
FROM places
"""


SCAN_SQL = _sql()
