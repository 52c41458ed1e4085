import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest

from tillsight.llm import conversations as talk

SCHEMA = "conv_id long, turn long, role string, text string"
VALID = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Cost and audit of ``(initial, deleted, truncated)`` rows by search in order of both."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        if i == len(rows) and VALID.fullmatch(made):
            return cost, audit
        if (audit, made) in done or len(made) > len(rows) + 3:
            continue
        done.add((audit, made))
        if not any(VALID.fullmatch(made + end) for end in ("", "a", "ua")):
            continue
        for role in "ua":
            heapq.heappush(heap, (cost + 2, audit + "I", i, made + role))
        if i < len(rows):
            initial, deleted, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, made))
            if not deleted:
                for role in "ua":
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, made + role))
                if initial:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, made + initial))


def rows_of(pick, n):
    return [(pick.choice("suuaax") if pick.random() > 0.03 else "", pick.random() < 0.15, pick.random() < 0.2) for _ in range(n)]


def test_integers_decide_like_a_search():
    pick = random.Random(1)
    for _ in range(400):
        rows = rows_of(pick, pick.randrange(7))
        width = 3 * (len(rows) + 1)
        assert talk.decoded(talk.steps(rows, talk.endings(width), width)[0], width) == cheapest(rows), rows


@pytest.mark.parametrize("block, window", [(1, 2), (2, 3), (5, 2), (7, 100)])
def test_blocks_joined_are_the_whole(monkeypatch, block, window):
    monkeypatch.setattr(talk, "WINDOW", window)
    pick = random.Random(block)
    for _ in range(60):
        rows = rows_of(pick, pick.randrange(1, 60))
        width = 3 * (len(rows) + 1)
        want = talk.decoded(talk.steps(rows, talk.endings(width), width)[0], width)
        made = [talk.block_of(rows[i : i + block]) for i in range(0, len(rows), block)]
        cost, entries = talk.chosen([(costs, talk.ranks(audits)) for costs, audits in made])
        audit = "".join(audits[e] for (_, audits), e in zip(made, entries))
        ends = [talk.decoded(e, 2)[1] for e in talk.endings(2)]
        assert (cost, audit + ends[entries[-1] % 4]) == want


def plainly(table):
    """The contract for a small table, one conversation after the other."""
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, faults, counts = set(), [], [0, 0, 0]
        for _, role, text in rows:
            bare = text.strip(" \t\n\v\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            faults.append((role[:1], fault in (0, 1), fault == 2))
        cost, audit = cheapest(faults)
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(faults))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in talk.apply_audit(audit, iter([r[1:] for r in rows]))).encode())
        out.append((conv, gaps, *counts, illegal, cost, audit, sha.hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def table():
    pick = random.Random(7)
    rows = []
    for conv in [*range(60), None]:
        for turn in [*range(pick.randrange(1, 8)), *([None] if pick.random() < 0.2 else [])]:
            role = pick.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"])
            text = pick.choice(["Yes.", "No!", "", None, " \n", "cut", "And? ", "Yes.", "é…", "a.b"])
            rows.append((conv, turn * 2 if turn and conv == 5 else turn, role, text))
    rows += rows[10:14]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"Line {t // 3}{'.' * (t % 5)}") for t in range(40)]
    return rows


@pytest.mark.parametrize("block", [512, 4])
def test_report_by_the_contract(spark, table, monkeypatch, block):
    short = [r for r in table if r[0] != 1000]
    frame = spark.createDataFrame(short, SCHEMA).selectExpr("*", "'clash' AS kind", "1 AS cost", "2 AS part").repartition(3)
    monkeypatch.setattr(talk, "BLOCK", block)
    assert sorted(map(tuple, talk.report(talk.damaged(frame)).collect()), key=repr) == plainly(short)


def test_sql_and_blocks_agree(spark, table, monkeypatch, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(table, SCHEMA).write.parquet(path)
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(base.execute(talk.REPAIR_SQL).fetchall(), key=repr)
    frame = spark.read.parquet(path)
    for block in (512, 3):
        monkeypatch.setattr(talk, "BLOCK", block)
        assert sorted(map(tuple, talk.report(talk.damaged(frame)).collect()), key=repr) == want


def test_repaired_rows(spark, table):
    frame = talk.as_given(spark.createDataFrame(table, SCHEMA))
    made = talk.repaired(frame).orderBy("conv_id", "place").collect()
    texts = {r.conv_id: r.repaired_sha256 for r in talk.report(frame).collect()}
    for conv, group in itertools.groupby(made, key=lambda r: r.conv_id):
        group = list(group)
        assert VALID.fullmatch("".join(r.role[:1] for r in group))
        assert [r.place for r in group] == list(range(len(group)))
        joined = "\n".join(f"{r.role}:{r.text}" for r in group)
        assert hashlib.sha256(joined.encode()).hexdigest() == texts[conv]


def test_many_copies_and_nothing(spark):
    rows = [(1, 0, "user", "Same.")] * 700 + [(1, 1, "assistant", "Yes.")] + [(2, t, "user", "Hi.") for t in range(900)]
    found = {r.conv_id: r for r in talk.report(talk.as_given(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert (found[1].duplicate, found[1].cost, found[1].audit) == (699, 3 * 699, "K" + "D" * 699 + "K")
    assert (found[2].duplicate, found[2].cost, found[2].audit) == (899, 3 * 899 + 2, "K" + "D" * 899 + "I")
    assert talk.report(talk.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
