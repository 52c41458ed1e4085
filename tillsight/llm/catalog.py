"""The registered queries of the operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.llm import (
    conversations,
    fingerprints,
    infill,
    katz,
    language,
    licences,
    mixing,
    near_dedup,
    neighbours,
    packing,
    pages,
    quality,
    toxicity,
)
from tillsight.llm.common import table


def op1_licences(spark, root):
    return licences.scan(table(spark, root, "documents"))


def op2_neighbours(spark, root):
    vectors = table(spark, root, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op3_quality(spark, root):
    return quality.classify(table(spark, root, "documents"), table(spark, root, "labels"))


def op4_pages(spark, root):
    return pages.extract(table(spark, root, "pages"))


def op5_language(spark, root):
    return language.identify(table(spark, root, "documents"))


def op6_fingerprints(spark, root):
    return fingerprints.fingerprint(table(spark, root, "documents"))


def op7_toxicity(spark, root):
    return toxicity.classify(table(spark, root, "documents"), table(spark, root, "labels"))


def op8_near_dedup(spark, root):
    return near_dedup.near_duplicates(table(spark, root, "documents"))


def op9_mixing(spark, root):
    return mixing.mix(table(spark, root, "documents"))


def op10_packing(spark, root):
    return packing.pack(table(spark, root, "documents"))


def op11_infill(spark, root):
    return infill.digests(infill.transform(table(spark, root, "documents")))


def op12_scores(spark, root):
    return katz.language_scores(table(spark, root, "documents"))


def op13_conversations(spark, root):
    return conversations.report(conversations.damaged(table(spark, root, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_licences, op2_neighbours, op3_quality, op4_pages, op5_language, op6_fingerprints,
        op7_toxicity, op8_near_dedup, op9_mixing, op10_packing, op11_infill, op12_scores, op13_conversations,
    )
}
ORACLES = {
    "op1_licences": licences.SCAN_SQL,
    "op8_near_dedup": near_dedup.NEAR_SQL,
    "op9_mixing": mixing.MIX_SQL,
    "op11_infill": infill.INFILL_SQL,
    "op13_conversations": conversations.REPAIR_SQL,
}
