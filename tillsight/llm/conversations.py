"""Repair of conversations: the cheapest edits that give a valid order of roles.

Rows are kept, given another role, deleted, or empty turns are inserted, until the role initials
read ``(s?(ua)+)?``. Every path of edits through the rows has one integer for its weight: the
high digits carry the cost, the low digits the audit letters, one digit for each place from the
front and zeros behind the last. The smallest integer is the cheapest path, and among those the
one whose audit comes first. A backward pass over the graph of (row, inserts, state) finds it.

Rows are looked at without their texts and by ranges of conversation and turn, so a long
conversation lies in many tasks. A block of its rows gives the best weight for each pair of a
state before and after it. Every block ends with the edit of a row, and so no audit of a block
begins another for the same pair: ranks can stand for the audits when blocks are put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import stored

# Fixed values of the audit: letters in ASCII order, as digits; and what the edits cost.
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

DIGIT = 3
#: Rows of a block, copies counted.
BLOCK = 512
#: Blocks that are put together at once.
WINDOW = 256

# States: nothing yet, after s, after u, after a. An empty turn or a new role leads on to NEXT.
STATES = range(4)
NEXT = (2, 2, 3, 2)
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
INSERTS = 2

ROLES = {2: "user", 3: "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the damage that their conversation and turn draw.

    Columns ``conv_id``, ``turn``, ``role``, ``text`` and ``times``: 0 for a dropped row, 2 for
    a repeated one. Nulls in role and text are one space.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *name).cast("binary")) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "")
        .when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def as_given(conversations: DataFrame) -> DataFrame:
    """Rows as they are, in the form of :func:`damaged`."""
    return conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.lit(1).cast("long").alias("times"),
    )


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")


def faulty(rows: DataFrame) -> DataFrame:
    """One row for each distinct row of a conversation, without text and with its faults.

    ``copies`` equal rows stand together; ``seen`` tells that role and text are in an earlier
    turn, so all copies are duplicates, else all but one. Copies and repeated texts are counted
    before they are shuffled; the join meets at most one row for each text of a conversation.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    thin = (
        rows.where("times > 0")
        .select("conv_id", "turn", "role", _digest(), blank.alias("blank"), (~blank & ~ended).alias("cut"), "times")
        .groupBy("conv_id", "turn", "role", "digest", "blank", "cut")
        .agg(F.sum("times").alias("copies"))
    )
    # A null turn comes first.
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = thin.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first")).select(
        F.col("conv_id").alias("of"), F.col("role").alias("by"), F.col("digest").alias("text_of"), "first"
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("of"))
        & (F.col("role") == F.col("by"))
        & (F.col("digest") == F.col("text_of"))
    )
    return thin.join(first, same).select(
        "conv_id", "turn", "role", "digest", "blank", "cut", "copies", (order > F.col("first")).alias("seen")
    )


def steps(
    rows: list[tuple[str, bool, bool]], ends: list[int | None], width: int
) -> list[int | None]:
    """Smallest weight from each state before the rows to the end.

    ``rows`` are ``(initial, deleted, truncated)``; ``ends`` are weights of ``width`` digits
    behind the last row, None where no end is reached. Inserts come before a row or at the end.
    """
    low = DIGIT * width
    mask, top = (1 << low) - 1, low - DIGIT

    def put(cost: int, letter: str, then: int | None) -> int | None:
        # The letter takes the first place, those behind it move on by one.
        if then is None:
            return None
        return (then >> low) + cost << low | LETTERS[letter] << top | (then & mask) >> DIGIT

    def least(*options: int | None) -> int | None:
        return min((x for x in options if x is not None), default=None)

    best = ends
    for initial, deleted, truncated in reversed(rows):
        more = TRUNCATED * truncated
        after = [put(DELETE, "D", best[q]) for q in STATES]
        if not deleted:
            keeps = KEPT.get(initial, {})
            for q in STATES:
                kept = put(more, "K", best[keeps[q]]) if q in keeps else None
                after[q] = least(after[q], kept, put(REROLE + more, "R", best[NEXT[q]]))
        best = after
        for _ in range(INSERTS):
            best = [least(after[q], put(INSERT, "I", best[NEXT[q]])) for q in STATES]
    return best


def endings(width: int) -> list[int]:
    """Weights of what must still be inserted behind the last row: valid are nothing and an a."""
    low, found = DIGIT * width, []
    for q in STATES:
        weight, place, state = 0, 0, q
        while state not in (0, 3):
            place += 1
            weight += (INSERT << low) + (LETTERS["I"] << low - DIGIT * place)
            state = NEXT[state]
        found.append(weight)
    return found


def decoded(weight: int, width: int) -> tuple[int, str]:
    """Cost and audit letters of a weight."""
    low = DIGIT * width
    digits = f"{weight & (1 << low) - 1:0{width}o}".rstrip("0")
    return weight >> low, digits.translate(_FROM_DIGITS)


_FROM_DIGITS = str.maketrans({str(d): letter for letter, d in LETTERS.items()})


def block_of(rows: list[tuple[str, bool, bool]]) -> tuple[list[int | None], list[str | None]]:
    """Costs and audits of a block by ``4 * before + after``; None where no edits lead there."""
    width = (INSERTS + 1) * len(rows) + 1
    costs: list[int | None] = [None] * 16
    audits: list[str | None] = [None] * 16
    for after in STATES:
        found = steps(rows, [0 if q == after else None for q in STATES], width)
        for before in STATES:
            if found[before] is not None:
                costs[4 * before + after], audits[4 * before + after] = decoded(found[before], width)
    return costs, audits


def ranks(audits: list[str | None]) -> list[int]:
    """Numbers that order the audits of a block like the audits themselves, from 1."""
    order = {a: i for i, a in enumerate(sorted({a for a in audits if a is not None}), 1)}
    return [order.get(a, 0) for a in audits]


def chosen(blocks: list[tuple[list[int | None], list[int]]]) -> tuple[int, list[int]]:
    """Cost of the best way through all blocks of a conversation, and the entry of each block.

    A block is ``(costs, ranks)``. Blocks are joined window by window, by the same integers: a
    digit is the rank of an entry. What comes out of the windows are blocks again.
    """
    if len(blocks) > WINDOW:
        windows = [blocks[i : i + WINDOW] for i in range(0, len(blocks), WINDOW)]
        found = [[_through(w, [0 if q == after else None for q in STATES]) for after in STATES] for w in windows]
        joined = []
        for ways in found:
            costs = [ways[e % 4][e // 4] and ways[e % 4][e // 4][0] for e in range(16)]
            tails = [ways[e % 4][e // 4] and ways[e % 4][e // 4][1] for e in range(16)]
            order = {t: i for i, t in enumerate(sorted({t for t in tails if t is not None}), 1)}
            joined.append((costs, [order.get(t, 0) for t in tails]))
        cost, entries = chosen(joined)
        return cost, [e for ways, entry in zip(found, entries) for e in ways[entry % 4][entry // 4][2]]
    ends = [decoded(e, INSERTS) for e in endings(INSERTS)]
    cost, _, entries = _through(blocks, [c for c, _ in ends], ranks([a for _, a in ends]))[0]
    return cost, entries


def _through(
    blocks: list[tuple[list[int | None], list[int]]],
    ends: list[int | None],
    last: tuple[int, ...] | list[int] = (0, 0, 0, 0),
) -> list[tuple[int, int, list[int]] | None]:
    """For each state before the blocks: cost, digits of ranks and entries of the best way.

    ``ends`` are the costs of the states behind the blocks, ``last`` the ranks of what follows.
    """
    low = 5 * (len(blocks) + 1)
    mask = (1 << low) - 1
    best = [None if cost is None else cost << low | rank << low - 5 for cost, rank in zip(ends, last)]
    taken = []
    for costs, places in reversed(blocks):
        now, entry_of = [], []
        for before in STATES:
            options = [
                ((best[after] >> low) + costs[e] << low | places[e] << low - 5 | (best[after] & mask) >> 5, e)
                for after in STATES
                if costs[e := 4 * before + after] is not None and best[after] is not None
            ]
            weight, entry = min(options, default=(None, None))
            now.append(weight)
            entry_of.append(entry)
        best = now
        taken.append(entry_of)
    taken.reverse()
    out = []
    for before in STATES:
        if best[before] is None:
            out.append(None)
            continue
        entries, state = [], before
        for entry_of in taken:
            entries.append(entry_of[state])
            state = entry_of[state] % 4
        out.append((best[before] >> low, best[before] & mask, entries))
    return out


BLOCKS = (
    "conv_id long, part int, number int, whole boolean, cost long, audit string, "
    "costs array<long>, ranks array<int>, audits array<string>, blank long, duplicate long, truncated long"
)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of a task's rows, which come in order. The first and last conversation may go on
    in other tasks, and one of more rows than a block has is cut; the others are whole."""
    from pyspark import TaskContext

    part, number, made = TaskContext.get().partitionId(), 0, []
    nothing = object()
    conv, held, counts, pieces, first = nothing, [], [0, 0, 0], 0, True

    def close(whole: bool) -> None:
        nonlocal number, held, counts, pieces
        if whole:
            width = (INSERTS + 1) * (len(held) + 1)
            cost, audit = decoded(steps(held, endings(width), width)[0], width)
            costs, audits = None, None
        else:
            cost, audit = None, None
            costs, audits = block_of(held)
        made.append((conv, part, number, whole, cost, audit, costs, audits and ranks(audits), audits, *counts))
        number, held, counts, pieces = number + 1, [], [0, 0, 0], pieces + 1

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(made, columns=[c.split()[0] for c in BLOCKS.split(", ")])
        made.clear()
        return out.astype({"conv_id": "Int64", "cost": "Int64"})

    for batch in batches:
        ids = [None if i is pd.NA else i for i in batch["conv_id"].astype("Int64")]
        columns = [batch[c].tolist() for c in ("initial", "blank", "cut", "copies", "seen")]
        for of, initial, blank, cut, copies, seen in zip(ids, *columns):
            if conv is not nothing and of != conv:
                if held:
                    close(whole=not first and not pieces)
                first, pieces = False, 0
            conv = of
            for copy in range(copies):
                again = seen or copy > 0
                held.append((initial, blank or again, cut))
                counts[0 if blank else 1 if again else 2] += blank or again or cut
                if len(held) == BLOCK:
                    close(whole=False)
            if len(made) >= 1000:
                yield frame()
    if held:
        close(whole=False)
    yield frame()


def _picked(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
    """The entry of every block of one conversation."""
    blocks = blocks.sort_values(["part", "number"])
    rows = [
        ([None if pd.isna(c) else int(c) for c in costs], [int(r) for r in places])
        for costs, places in zip(blocks["costs"], blocks["ranks"])
    ]
    cost, entries = chosen(rows)
    return pd.DataFrame(
        {
            "at_part": blocks["part"].to_numpy(),
            "at_number": blocks["number"].to_numpy(),
            "entry": entries,
            "all_cost": cost,
        }
    )


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation that has rows: cost, audit and counts of faults.

    Columns ``conv_id``, ``cost``, ``audit``, ``blank``, ``duplicate`` and ``truncated``.
    """
    in_order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    thin = faulty(rows).repartitionByRange(*in_order).sortWithinPartitions(*in_order)
    blocks = stored(
        thin.select(
            "conv_id", F.substring("role", 1, 1).alias("initial"), "blank", "cut", "copies", "seen"
        ).mapInPandas(_blocks, BLOCKS),
        "blocks",
    )
    whole = blocks.where("whole").select("conv_id", "cost", "audit", "blank", "duplicate", "truncated")
    some = blocks.where("NOT whole")
    ways = some.select("conv_id", "part", "number", "costs", "ranks").groupBy("conv_id").applyInPandas(
        _picked, "at_part int, at_number int, entry int, all_cost long"
    )
    joined = (
        some.drop("cost", "audit")
        .join(ways, (F.col("part") == F.col("at_part")) & (F.col("number") == F.col("at_number")))
        .withColumn("audit", F.get("audits", F.col("entry")))
        .groupBy("conv_id")
        .agg(
            F.max("all_cost").alias("cost"),
            F.sort_array(F.collect_list(F.struct("part", "number", "audit", "entry"))).alias("pieces"),
            *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        )
    )
    # What is inserted behind the last row follows from the state there.
    tails = F.array(*[F.lit(decoded(e, INSERTS)[1]) for e in endings(INSERTS)])
    last = F.get(tails, F.element_at("pieces", -1)["entry"] % 4)
    audit = F.concat(F.array_join(F.transform("pieces", lambda p: p["audit"]), ""), last)
    return whole.unionByName(
        joined.select("conv_id", "cost", audit.alias("audit"), "blank", "duplicate", "truncated")
    )


def apply_audit(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired rows. Their number tells whether they begin with a kept s."""
    place = sum(letter != "D" for letter in audit) % 2
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = ROLES[2 + place % 2]
        yield role, text
        place += 1


def _in_order(rows: DataFrame) -> DataFrame:
    """Every row behind its conversation's edits, in order, a conversation in one task.

    Only sorted runs of rows are in memory. A hash of a whole conversation can't be had
    without one task that reads it from front to back.
    """
    found = edits(rows).select(
        "conv_id", F.lit(0).alias("kind"), "audit", "cost", "blank", "duplicate", "truncated"
    )
    text = F.when(F.col("times") > 0, F.col("text")).alias("text")
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", text, "times", _digest())
    return (
        found.unionByName(texts, allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
        .select("conv_id", "kind", "audit", "cost", "blank", "duplicate", "truncated", "turn", "role", "text", "times")
    )


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int | None, tuple, Iterator]]:
    """``(conv_id, edits, rows)`` one after the other; rows are ``(turn, role, text)``."""
    from itertools import groupby

    def records():
        for batch in batches:
            for c in ("conv_id", "turn", "cost", "blank", "duplicate", "truncated", "times"):
                batch[c] = batch[c].astype("Int64")
            yield from batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None)

    for conv, group in groupby(records(), key=lambda r: r[0]):
        head = next(group)
        found, rest = (head[2:7], group) if head[1] == 0 else (("", 0, 0, 0, 0), _again(head, group))
        yield conv, found, (row[7:10] for row in rest for _ in range(row[10]))


def _again(head, rest):
    yield head
    yield from rest


REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
REPAIRED = "conv_id long, place long, role string, text string"
LEGAL = {"su", "ua", "au"}


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: ``conv_id``, ``place`` from 0, ``role``, ``text``."""

    def write(batches):
        out = []
        for conv, (audit, *_), lines in _conversations(batches):
            fixed = apply_audit(audit, ((role, text) for _, role, text in lines))
            for place, (role, text) in enumerate(fixed):
                out.append((conv, place, role, text))
                if len(out) >= 1000:
                    yield _typed(out, REPAIRED)
                    out = []
        yield _typed(out, REPAIRED)

    return _in_order(rows).mapInPandas(write, REPAIRED)


def _typed(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    return out.astype({c.split()[0]: "Int64" for c in schema.split(", ") if c.endswith(" long")})


def report(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and the hash of the repaired text of every conversation.

    ``rows`` come from :func:`damaged` or :func:`as_given`; rows with ``times`` 0 only tell that
    the conversation exists. Rows of one turn are taken by role and then by a hash of the text.
    A null ``conv_id`` is a conversation of its own; a role without an initial fits no place.
    Conversations without rows give zeros, an empty audit and the hash of nothing; an empty
    table gives no rows.
    """

    def write(batches):
        out = []
        for conv, (audit, cost, blank, duplicate, truncated), lines in _conversations(batches):
            illegal, before, turns, least, most, last = 0, None, 0, None, None, None

            def seen():
                nonlocal illegal, before, turns, least, most, last
                for turn, role, text in lines:
                    illegal += before is not None and before + role[:1] not in LEGAL
                    before = role[:1]
                    if turn is not None and turn != last:
                        turns, least, most, last = turns + 1, turn if least is None else least, turn, turn
                    yield role, text

            sha, source = hashlib.sha256(), seen()
            for place, (role, text) in enumerate(apply_audit(audit, source)):
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            gaps = most - least + 1 - turns if turns else 0
            out.append((conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha.hexdigest()))
            if len(out) >= 1000:
                yield _typed(out, REPORT)
                out = []
        yield _typed(out, REPORT)

    return _in_order(rows).mapInPandas(write, REPORT)


def _put(cost: str, letter: str, then: str) -> str:
    """SQL that puts an edit in front of a weight: six digits of cost, then letters."""
    return f"printf('%06d', CAST(substr({then}, 1, 6) AS INTEGER) + {cost}) || '{letter}' || substr({then}, 7)"


def _edited(state: int) -> str:
    """SQL of the best weight from a state whose next edit is that of the row."""
    kept = "".join(
        f", CASE WHEN keeps AND initial = '{initial}' THEN {_put('cost', 'K', f'q{to[state]}')} END"
        for initial, to in KEPT.items()
        if state in to
    )
    new = _put(f"{REROLE} + cost", "R", f"q{NEXT[state]}")
    return f"least({_put(str(DELETE), 'D', f'q{state}')}{kept}, CASE WHEN keeps THEN {new} END)"


def _inserted(state: int, then: str) -> str:
    return f"least(e{state}, {_put(str(INSERT), 'I', f'{then}{NEXT[state]}')})"


REPAIR_SQL = rf"""
WITH RECURSIVE
crcs AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(
             string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
             lambda c: CAST(ord(c) AS BIGINT))),
           lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % 20 AS kind
  FROM conversations, crcs),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i
  FROM rows),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair
  FROM placed),
totals AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
-- The best cost (six digits) and audit from each state behind row i - 1.
best AS (
  SELECT conv_id, n + 1 AS i, '000000' AS q0, '000004II' AS q1, '000002I' AS q2, '000000' AS q3 FROM totals
  UNION ALL
  SELECT conv_id, i, {", ".join(f"{_inserted(q, 'f')} AS q{q}" for q in STATES)} FROM (
    SELECT *, {", ".join(f"{_inserted(q, 'e')} AS f{q}" for q in STATES)} FROM (
      SELECT b.conv_id, j.i, {", ".join(f"{_edited(q)} AS e{q}" for q in STATES)}
      FROM best b JOIN (SELECT conv_id, i, initial, NOT (blank OR again) AS keeps, CAST(cut AS INTEGER) AS cost
                        FROM judged) j
        ON b.conv_id IS NOT DISTINCT FROM j.conv_id AND b.i = j.i + 1))),
audits AS (
  SELECT t.*, CAST(substr(q0, 1, 6) AS BIGINT) AS cost, substr(q0, 7) AS audit
  FROM totals t JOIN best b ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = 1),
letters AS (
  SELECT conv_id, p, letter, len(replace(audit, 'D', '')) % 2 AS shift,
         count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i,
         count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS place
  FROM (SELECT conv_id, audit, unnest(string_split(audit, '')) AS letter, unnest(range(len(audit))) AS p
        FROM audits)),
texts AS (
  SELECT l.conv_id, sha256(string_agg(
           CASE WHEN letter = 'K' THEN r.role WHEN (place + shift) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || CASE WHEN letter = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY p)) AS hash
  FROM letters l LEFT JOIN judged r
    ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.i = r.i AND letter <> 'I'
  WHERE letter <> 'D' GROUP BY l.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN audits a ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN texts t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
"""
