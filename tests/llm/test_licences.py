import re

from conftest import rows
from corpus_tables import edges, nothing  # noqa: F401
from tillsight.llm import licences


def places(words, phrase):
    return [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base, labels, best, starts = set(), set(), 0.0, []
    for t in licences.TEMPLATES:
        for p in places(words, t.phrase):
            if not all(words[p + at : p + at + len(of)] == of for at, of in t.phrases):
                continue
            labels.add(t.label)
            if t.base:
                base.add(t.label)
                starts.append(p)
            first = p - t.offset
            same = sum(
                0 <= first + k < len(words) and words[first + k] == w for k, w in enumerate(t.words)
            )
            best = max(best, same / len(t.words))
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), best,
    )


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "the apache license version 2 0 gnu general public license version 3 gnu general public license",
    "All rights reserved. CC BY-NC 4.0, cc by",
    "mit der License; mit\x00license MIT-LICENSE éMIT License",
    "license mit gnu general public",
    "Apache LicenseK apache licenseſ apache license\x7f",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
]


def test_scan_equals_brute_force(spark, edges):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for docs in (frame, edges):
        want = sorted(str((r.doc_id, *brute(r.text))) for r in docs.collect())
        assert sorted(map(str, rows(licences.scan(docs)))) == want


WHOLE = {i: t for i, t in enumerate(licences.TEMPLATES) if len(t.words) > 15}


def test_whole_notices_are_found_and_broken_ones_are_not(spark):
    data = []
    for i, t in WHOLE.items():
        body = "Copyright 2020 Someone. " + ", ".join(w.capitalize() for w in t.words) + "."
        data.append((i, body))
        # The last word of the last key phrase is another one.
        at, phrase = t.phrases[-1]
        words = t.words
        words[t.offset + at + len(phrase) - 1] = "other"
        data.append((100 + i, " ".join(words)))
    found = {r.doc_id: r for r in licences.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    texts = dict(data)
    for i, t in WHOLE.items():
        assert t.label in found[i].labels.split(",") and found[i].score == 1.0
        for k in (i, 100 + i):
            assert tuple(found[k])[1:] == brute(texts[k])
        if t.label in ("isc", "zlib", "unlicense", "bsd-2-clause", "mpl-2.0", "gpl-2.0", "gpl-3.0"):
            assert t.label not in found[100 + i].labels.split(",")
    assert {t.label for t in WHOLE.values()} >= {"gpl-2.0", "gpl-3.0", "mit", "isc", "apache-2.0", "bsd-2-clause", "zlib"}


def test_the_index_points_from_words_to_templates():
    counts = {"mit": 50, "license": 3, "x": 1}
    templates = (licences.Template("a", "[mit license]"), licences.Template("b", "y [x]"))
    assert licences.index_of(templates, counts) == {
        "license": [(0, 1, 0)], "mit": [(0, 0, 1)], "x": [(1, 0, 0), (1, 0, 1)],
    }
    two = licences.Template("c", "a b [c d] e f [g] h")
    assert two.phrases == [(0, ["c", "d"]), (4, ["g"])] and two.offset == 2 and len(two.words) == 8


def test_an_anchor_is_the_rarest_word():
    counts = {"mit": 50, "license": 3}
    template = licences.Template("mit", "[mit license]")
    assert licences.anchors_of(template, counts) == [("license", 1), ("mit", 0)]


def test_empty_table(nothing):
    found = licences.scan(nothing)
    assert found.count() == 0 and found.columns[0] == "doc_id"
