"""Conversation structure repair: the cheapest edits that give a conversation a well-formed sequence of roles.

Well-formed is nothing at all, or an optional system turn and then user and assistant in turns. A conversation's rows and
the four states of such a sequence span a graph: rows are kept, given another role or deleted, and empty turns are
inserted. Forward and backward minimum costs tell which arcs are tight, that is, lie on some cheapest way; from the start a
set of nodes then takes the least edit letter that any tight arc out of it has, step by step, which gives the least of all
cheapest edit texts.

Rows are sorted and dealt by ranges, so a long conversation lies in several parts and a part is all that a task holds. A part's
piece of a conversation acts on the costs as a 4 x 4 matrix of (min, +). Products of the matrices give the costs at the
pieces' ends, and a table of the four states where a walk through a piece ends gives where the next one begins.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import PART, in_batches, list_runs, map_arrow, ordered, written

FAR = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)  # what stands before: nothing, or a turn of this role
NEXT = (USER, USER, ASSISTANT, USER)  # the role that an inserted or changed turn gets in each state
NAMES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1  # costs; a cut off row that stays costs its own on top
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACE = " \t\n\x0b\f\r"
WHOLE = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}


def _row_arcs(initial: str, fault: int) -> tuple[tuple[int, int, str, int], ...]:
    arcs = [(s, s, "D", DELETE) for s in range(4)]
    if fault not in (BLANK, DUPLICATE):
        more = CUT_OFF * (fault == TRUNCATED)
        arcs += [(s, t, "K", KEEP + more) for s, t in WHOLE.get(initial, {}).items()]
        arcs += [(s, NEXT[s], "R", REROLE + more) for s in range(4)]
    return tuple(sorted(arcs, key=lambda x: x[2]))


ARCS = {(c, k): _row_arcs(c, k) for c in ("s", "u", "a", "") for k in range(4)}  # "" stands for any other role
ARCS_FROM = {row: [[x[1:] for x in arcs if x[0] == s] for s in range(4)] for row, arcs in ARCS.items()}


def opened(f: list[int]) -> list[int]:
    """Costs from the start to the states of one place, with the turns that are inserted there."""
    user = min(f[USER], f[START] + INSERT, f[SYSTEM] + INSERT, f[ASSISTANT] + INSERT)
    return [f[START], f[SYSTEM], user, min(f[ASSISTANT], user + INSERT)]


def closed(b: list[int]) -> list[int]:
    """Costs from the states of one place to the end, with the turns that are inserted there."""
    user, assistant = min(b[USER], b[ASSISTANT] + INSERT), min(b[ASSISTANT], b[USER] + INSERT)
    return [min(b[START], user + INSERT), min(b[SYSTEM], user + INSERT), user, assistant]


def forward(first: list[int], rows: list[tuple[str, int]]) -> list[list[int]]:
    """Costs before each row and behind the last, from those before the inserts of the first place."""
    out = [opened(first)]
    for row in rows:
        f, here = [FAR] * 4, out[-1]
        for s, t, _, cost in ARCS[row]:
            f[t] = min(f[t], here[s] + cost)
        out.append(opened(f))
    return out


def backward(last: list[int], rows: list[tuple[str, int]]) -> list[list[int]]:
    out = [last]
    for row in reversed(rows):
        b, there = [FAR] * 4, out[-1]
        for s, t, _, cost in ARCS[row]:
            b[s] = min(b[s], there[t] + cost)
        out.append(closed(b))
    return out[::-1]


BEGIN, END = [0, FAR, FAR, FAR], closed([0 if s in ENDS else FAR for s in range(4)])


def matrix(rows: list[tuple[str, int]]) -> list[list[int]]:
    """``m[s][t]``: the cost of the rows from state s to state t, with inserts before each row and none behind the last."""
    columns = [backward([0 if s == t else FAR for s in range(4)], rows)[0] for t in range(4)]
    return [[columns[t][s] for t in range(4)] for s in range(4)]


def walk(rows: list[tuple[str, int]], f: list[list[int]], b: list[list[int]], total: int, state: int, last: bool) -> tuple[list[tuple[str, int, int]], int]:
    """The edits through the tight arcs, each the least letter: (letter, row, state behind it); and the state at the end.

    Nodes are (place, state). ``last`` says that the conversation ends behind these rows.
    """
    out: list[tuple[str, int, int]] = []
    frontier = {(0, state)}
    while True:
        steps: dict[str, set[tuple[int, int]]] = {}
        for i, s in frontier:
            if i == len(rows) and (not last or s in ENDS and f[i][s] == total):
                return out, s
            if f[i][s] + INSERT + b[i][NEXT[s]] == total:
                steps.setdefault("I", set()).add((i, NEXT[s]))
            if i < len(rows):
                for t, letter, cost in ARCS_FROM[rows[i]][s]:
                    if f[i][s] + cost + b[i + 1][t] == total:
                        steps.setdefault(letter, set()).add((i + 1, t))
        letter = min(steps)
        at = min(frontier)[0]
        frontier = steps[letter]
        # Letters and the rows they take decide the state, so all ways of one edit text are at one node.
        out.append((letter, at, min(frontier)[1]))


def _row_faults(run: dict[str, list]) -> tuple[list[int], list[tuple[str, int]]]:
    """Which rows of a piece are neither its header nor marks, and the initial and the fault of each."""
    again = {p for k, p in zip(run["kind"], run["place"], strict=True) if k == 1}
    rows = [i for i, k in enumerate(run["kind"]) if k == 0]
    states = []
    for i in rows:
        c = run["initial"][i]
        fault = BLANK if run["blank"][i] else DUPLICATE if run["place"][i] in again else TRUNCATED if run["cut_off"][i] else 0
        states.append((c if c in ("s", "u", "a") else "", fault))
    return rows, states


def _head(run: dict[str, list]) -> dict | None:
    """The header of a piece of a conversation that has several."""
    return {n: c[0] for n, c in run.items()} if run["kind"][0] < 0 else None


_PIECE = [("conv", pa.int64()), ("part", pa.int64()), ("place", pa.int64())]
_ENDS = [("f", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("total", pa.int64()), ("last", pa.bool_())]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for run in list_runs(batches, 2):
            at, states = _row_faults(run)
            yield {"conv": run["conv"][0], "part": run["part"][0], "place": run["place"][at[0]], "m": sum(matrix(states), [])}

    return in_batches(rows(), pa.schema([*_PIECE, ("m", pa.list_(pa.int64()))]))


def _costs(pieces: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one conversation, a row for each part: costs before each piece and behind it."""
    pieces = pieces.sort_values("part")
    ms = [[list(m[i : i + 4]) for i in range(0, 16, 4)] for m in pieces["m"]]
    before, behind = [BEGIN], [END]
    for m in ms:
        before.append([min(before[-1][s] + m[s][t] for s in range(4)) for t in range(4)])
    for m in reversed(ms):
        behind.append([min(m[s][t] + behind[-1][t] for t in range(4)) for s in range(4)])
    total = behind[-1][START]
    cap = lambda v: [min(x, FAR) for x in v]
    return pieces[["conv", "part", "place"]].assign(f=[cap(x) for x in before[:-1]], b=[cap(x) for x in behind[::-1][1:]], total=total, last=[i == len(ms) - 1 for i in range(len(ms))])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece, where a walk from each of the four states ends; -1 where no cheapest way passes."""

    def rows() -> Iterator[dict]:
        for run in list_runs(batches, 2):
            head, (_, states) = _head(run), _row_faults(run)
            f, b = forward(head["f"], states), backward(head["b"], states)
            ends = [walk(states, f, b, head["total"], s, head["last"])[1] if f[0][s] + b[0][s] == head["total"] else -1 for s in range(4)]
            yield {k: head[k] for k in ("conv", "part", "place", "f", "b", "total", "last")} | {"ends": ends}

    return in_batches(rows(), pa.schema([*_PIECE, *_ENDS, ("ends", pa.list_(pa.int64()))]))


def _entries(pieces: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values("part")
    state, entry = START, []
    for ends in pieces["ends"]:
        entry.append(state)
        state = ends[state]
    return pieces.drop(columns="ends").assign(entry=entry)


_EDIT_COST = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    counts = [(c, pa.int64()) for c in ("piece", "pieces", "blank", "duplicate", "truncated", "illegal")]
    schema = pa.schema([("id", first.schema.field("id").type), *counts, ("first", pa.string()), ("final", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", _TURNS)])

    def rows() -> Iterator[dict]:
        for run in list_runs(itertools.chain([first], batches), 2):
            head, (at, states) = _head(run), _row_faults(run)
            f = forward(head["f"] if head else BEGIN, states)
            b = backward(head["b"] if head else END, states)
            edits, _ = walk(states, f, b, head["total"] if head else b[0][START], head["entry"] if head else START, not head or head["last"])
            repaired = []
            for e, i, s in edits:
                if e != "D":
                    repaired.append({"role": run["role"][at[i]] if e == "K" else NAMES[s], "text": "" if e == "I" else run["text"][at[i]]})
            faults, initials = [k for _, k in states], [run["initial"][i] for i in at]
            yield {
                "id": run["id"][at[0]], "piece": run["part"][0], "pieces": 2 if head else 1, "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
                "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False)), "first": initials[0], "final": initials[-1],
                "cost": sum(_EDIT_COST[e] + CUT_OFF * (e in "KR" and faults[i] == TRUNCATED) for e, i, _ in edits), "audit": "".join(e for e, _, _ in edits), "repaired": repaired,
            }

    yield from in_batches(rows(), schema, 200)


def repair(messages: DataFrame, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """The repaired conversations: ``id, piece, pieces, blank, duplicate, truncated, illegal, first, final, cost, audit, repaired``.

    A conversation's rows are taken by turn, nulls first, equal turns by role and a hash of the text. A row's first fault
    counts: blank (white space only), duplicate (role and text were there before), truncated (its last character that isn't
    white space is no ``.``, ``!`` or ``?``). ``illegal`` counts neighbours whose roles' first characters aren't su, ua or
    au. ``audit`` has the edits' initials in order (Keep, Rerole, Delete, Insert), the least text of the cheapest ones,
    ``cost`` their cost, ``repaired`` the roles and texts that are left.

    One row for each conversation; one that lies in several range parts (``pieces`` is then 2) has a row for each part, in
    the order of ``piece``: counts and costs add up, texts follow one another, and ``first`` and ``final``, the initials
    at its ends, tell about the neighbours between pieces. Null roles and texts count as one blank, an empty role fits
    nowhere; a null conversation is one of its own. Texts of any length are read whole. Repeated rows are duplicates. An
    empty table gives an empty result. Only the given expressions are read, so other columns and their names don't matter.
    """
    words = F.expr("trim(TRAILING ' \\t\\n\\u000b\\f\\r' FROM text)")
    named = messages.select(conv.alias("id"), turn.alias("turn"), F.coalesce(role.cast("string"), F.lit(" ")).alias("role"), F.coalesce(text.cast("string"), F.lit(" ")).alias("text"))
    sized = [F.concat(F.octet_length(c).cast("string"), F.lit(":"), c) for c in (F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("role"), F.col("text"))]
    signed = named.withColumn("sig", F.unhex(F.sha2(F.concat(F.col("id").isNull().cast("string"), *sized), 256)))
    table = ordered(signed, ["id", "turn", "role", "sig"])
    rows = table.df.withColumn("conv", F.xxhash64("id", F.col("id").isNull())).withColumn("part", F.shiftright("place", PART)).withColumn("kind", F.lit(0))
    rows = rows.withColumn("initial", F.substring("role", 1, 1)).withColumn("blank", words == "").withColumn("cut_off", ~F.right(words, F.lit(1)).isin(".", "!", "?"))
    # The first place of each text is counted before the join: what meets rows is one row for each text that is there repeatedly.
    seen = rows.groupBy("sig").agg(F.min("place").alias("at"), F.count("*").alias("n")).where("n > 1").select("sig", "at")
    marks = written(rows.select("sig", "place", "conv", "part").join(seen.hint("merge"), "sig").where("place > at").select("part", "conv", "place", F.lit(1).alias("kind")))
    columns = ["part", "conv", "place", "kind", "id", "role", "text", "initial", "blank", "cut_off"]
    work = rows.select(*columns).unionByName(marks, allowMissingColumns=True)
    dealt = lambda df: df.repartition("part").sortWithinPartitions("part", "place", "kind")
    kind = rows.schema["id"].dataType.simpleString()
    # Only the first and the last conversation of a part can lie in others as well: at most two for each part.
    ends = rows.groupBy("part").agg(F.array(F.min_by("conv", "place"), F.max_by("conv", "place")).alias("c")).select("part", F.explode("c").alias("conv")).distinct()
    wide = written(ends.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv"))
    if not wide.isEmpty():
        slim = work.drop("id", "role", "text").join(F.broadcast(wide), "conv").select("part", "conv", "place", "kind", "initial", "blank", "cut_off")
        costs = written(map_arrow(dealt(slim), _matrices, "conv long, part long, place long, m array<long>").groupBy("conv").applyInPandas(_costs, "conv long, part long, place long, f array<long>, b array<long>, total long, last boolean"))
        heads = costs.withColumn("kind", F.lit(-1))
        exits = map_arrow(dealt(slim.unionByName(heads, allowMissingColumns=True)), _exits, "conv long, part long, place long, f array<long>, b array<long>, total long, last boolean, ends array<long>")
        heads = written(exits.groupBy("conv").applyInPandas(_entries, "conv long, part long, place long, f array<long>, b array<long>, total long, last boolean, entry long"))
        work = work.unionByName(heads.withColumn("kind", F.lit(-1)), allowMissingColumns=True)
    return map_arrow(dealt(work), _edited, f"id {kind}, piece long, pieces long, blank long, duplicate long, truncated long, illegal long, first string, final string, cost long, audit string, repaired array<struct<role: string, text: string>>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest over the pieces of each conversation, which follow one another; a piece is held at a time."""
    now, state, some, ident = None, None, False, None

    def done(schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([ident], schema.field("id").type), pa.array([state.hexdigest()])], names=["id", "digest"])

    schema = None
    for batch in batches:
        schema = batch.schema
        for row in batch.to_pylist():
            if row["conv"] != now:
                if state:
                    yield done(schema)
                now, state, some, ident = row["conv"], sha256(), False, row["id"]
            for turn in row["repaired"]:
                state.update(("\n" * some + f"{turn['role']}:{turn['text']}").encode())
                some = True
    if state:
        yield done(schema)


def summary(pieces: DataFrame) -> DataFrame:
    """``id`` and the counts, ``cost``, ``audit`` and ``digest`` of whole conversations from their pieces.

    ``digest`` is the SHA-256 of the repaired ``role:text`` lines. That of a conversation of several pieces is sequential
    by nature: its pieces pass through one task, one after another.
    """
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    whole = pieces.where("pieces = 1").select("id", *counts, "audit", F.sha2(lines, 256).alias("digest"))
    split = pieces.where("pieces > 1")
    conv = F.xxhash64("id", F.col("id").isNull()).alias("conv")
    digests = map_arrow(split.select(conv, "id", "piece", "repaired").repartition("conv").sortWithinPartitions("conv", "piece"), _digests, f"id {pieces.schema['id'].dataType.simpleString()}, digest string")
    ends = F.array_sort(F.collect_list(F.struct("piece", "first", "final", "audit"))).alias("ps")
    sums = split.groupBy("id").agg(*[F.sum(c).alias(c) for c in counts], ends)
    between = F.aggregate(F.sequence(F.lit(1), F.size("ps") - 1), F.lit(0).cast("long"), lambda a, i: a + F.when(F.concat(F.get("ps", i - 1)["final"], F.get("ps", i)["first"]).isin("su", "ua", "au"), 0).otherwise(1))
    joined = sums.withColumn("illegal", F.col("illegal") + between).withColumn("audit", F.array_join(F.col("ps.audit"), ""))
    named = digests.withColumnRenamed("id", "i")
    return whole.unionByName(joined.join(named, F.col("id").eqNullSafe(F.col("i"))).select("id", *counts, "audit", "digest"))


def damaged(messages: DataFrame) -> DataFrame:
    """The rows of ``conversations``, some damaged by the hash of their place: gone, emptied, without marks, doubled, renamed."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    how = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    one = F.struct(F.when(how == 4, "user").otherwise(role).alias("role"), F.when(how == 1, "").when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    copies = F.when(how == 0, F.array().cast("array<struct<role:string,text:string>>")).when(how == 3, F.array(one, one)).otherwise(F.array(one))
    return messages.select("conv_id", "turn", F.explode(copies).alias("m")).select("conv_id", "turn", "m.role", "m.text")


def op12(spark, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damaged(messages)
    pieces = written(repair(rows, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")))
    wide = F.col("turn").cast("decimal(38,0)")
    gaps = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("id")).agg((F.max(wide) - F.min(wide) + 1 - F.count("turn")).cast("long").alias("gaps"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = messages.select(F.col("conv_id").alias("id")).distinct().unionByName(gaps, allowMissingColumns=True).unionByName(summary(pieces), allowMissingColumns=True)
    found = every.groupBy("id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("digest"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
    return found.select(F.col("id").alias("conv_id"), *counts, "audit", "repaired_sha256")


_CRC = """xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)),
        lambda a, b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(a, b)), 4294967295), 4294967295) % 20"""

#: From the last row to the first: for each state, the cheapest and then least edits to the end.
ORACLE = f"""
    WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} AS how FROM conversations),
    d AS (
        SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM m
    ),
    f AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n, role[1] AS c,
            CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM d
    ),
    pre(s, t, letters, turns) AS (VALUES (0, 0, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])),
    arc(s, t, letter, c, cost) AS (
        VALUES (0, 0, 'D', '', 3), (1, 1, 'D', '', 3), (2, 2, 'D', '', 3), (3, 3, 'D', '', 3), (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0),
            (0, 2, 'R', '', 2), (1, 2, 'R', '', 2), (3, 2, 'R', '', 2), (2, 3, 'R', '', 2)
    ),
    way AS (
        SELECT conv_id, n + 1 AS i, s, {{'cost': 2 * len(letters), 'audit': letters, 'turns': turns}} AS w FROM (SELECT DISTINCT conv_id, n FROM f) CROSS JOIN (SELECT s, min(letters) AS letters, min(turns) AS turns FROM pre WHERE t IN (0, 3) GROUP BY s)
        UNION ALL
        SELECT f.conv_id, f.i, p.s, min({{'cost': 2 * len(p.letters) + a.cost + CAST(a.letter <> 'D' AND f.fault = 'truncated' AS INTEGER) + y.w.cost, 'audit': p.letters || a.letter || y.w.audit,
            'turns': p.turns || CASE a.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE a.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END || y.w.turns}})
        FROM way y JOIN f ON f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.i = y.i - 1 JOIN arc a ON a.t = y.s AND (a.letter = 'D' OR f.fault IN ('', 'truncated') AND (a.letter = 'R' OR a.c = f.c)) JOIN pre p ON p.t = a.s
        GROUP BY f.conv_id, f.i, p.s
    ),
    counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM f) GROUP BY conv_id
    )
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        CAST(coalesce(w.cost, 0) AS BIGINT) AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(list_aggregate(w.turns, 'string_agg', chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN way y ON y.conv_id IS NOT DISTINCT FROM o.conv_id AND y.i = 1 AND y.s = 0
"""
