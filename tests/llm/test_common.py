from tillsight.llm import common, packing


def test_what_an_operator_remembers_goes_when_another_works(monkeypatch):
    monkeypatch.setattr(common, "_WORKING", [])
    monkeypatch.setattr(common, "_FORGET", [])
    gone = []
    common.working("a", lambda: gone.append("a"))
    common.working("a", lambda: gone.append("a again"))
    assert gone == []
    common.working("b")
    common.working("b")
    assert gone == ["a"]
    common.working("c", lambda: gone.append("c"))
    common.working("a")
    assert gone == ["a", "c"]


def test_the_encoder_goes_with_its_words(spark):
    """Also in a worker process, which gets the functions of a task by name."""
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(8)], "doc_id long, text string").coalesce(1)

    def look(batches):
        for batch in batches:
            before = len(packing._ENCODERS)
            common.working("quality")
            batch["before"], batch["after"] = before, len(packing._ENCODERS)
            yield batch

    packing.tokenized(docs).count()
    seen = set()
    for _ in range(20):
        packing.tokenized(docs).collect()
        rows = docs.select("doc_id").mapInPandas(look, "doc_id long, before int, after int").collect()
        seen |= {(r.before, r.after) for r in rows}
    assert seen <= {(1, 0), (0, 0)} and (1, 0) in seen
