import functools
import itertools
import random
import re
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same
from pyspark.sql import functions as F

from corpusmill.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile("(s?(ua)+)?")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(rows):
    """(cost, audit, repaired) of the cheapest and then least edits, by recursion over what is left."""
    faults = faults_of(rows)
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @functools.cache
    def rest(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        put = "user" if state != "u" else "assistant"
        steps = []
        if inserts < 3:
            steps.append((2, "I", rest(i, put[0], inserts + 1), ((put, ""),)))
        if i < len(rows):
            role, text = rows[i]
            steps.append((3, "D", rest(i + 1, state, 0), ()))
            if faults[i] not in ("blank", "duplicate"):
                more = int(faults[i] == "truncated")
                if role[:1] in after[state]:
                    steps.append((more, "K", rest(i + 1, role[:1], 0), ((role, text),)))
                steps.append((2 + more, "R", rest(i + 1, put[0], 0), ((put, text),)))
        found += [(c + r[0], letter + r[1], turns + r[2]) for c, letter, r, turns in steps if r]
        return min(found) if found else None

    return rest(0, "", 0)


def tried(initials, faults, most=7):
    """The same for short conversations by trying all edit texts."""
    for n in range(most + 1):
        found = []
        for audit in itertools.product("DIKR", repeat=n):
            if sum(x != "I" for x in audit) != len(initials):
                continue
            cost, state, i, roles = 0, "", 0, ""
            for e in audit:
                put = "a" if roles[-1:] == "u" else "u"
                if e == "I":
                    cost, roles = cost + 2, roles + put
                    continue
                fault, own = faults[i], initials[i]
                i += 1
                if e == "D":
                    cost += 3
                elif fault in ("blank", "duplicate"):
                    break
                else:
                    cost, roles = cost + 2 * (e == "R") + (fault == "truncated"), roles + (put if e == "R" else own)
            else:
                if GOOD.fullmatch(roles):
                    found.append((cost, "".join(audit)))
        yield from found


def solved(rows):
    states = [(r[:1] if r[:1] in ("s", "u", "a") else "", {"blank": 1, "duplicate": 2, "truncated": 3, "": 0}[f]) for (r, _), f in zip(rows, faults_of(rows), strict=True)]
    f, b = C.forward(C.BEGIN, states), C.backward(C.END, states)
    edits, _ = C.walk(states, f, b, b[0][C.START], C.START, True)
    return b[0][C.START], "".join(e for e, _, _ in edits)


TURN = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", " "]), st.sampled_from(["one.", "two!", "cut", " ", "x. "]))


@settings(max_examples=300, deadline=None)
@given(st.lists(TURN, max_size=9))
def test_edits_against_recursion(rows):
    assert solved(rows) == best(rows)[:2]


@settings(max_examples=40, deadline=None)
@given(st.lists(TURN, max_size=3))
def test_recursion_against_all_edit_texts(rows):
    assert best(rows)[:2] == min(tried([r[:1] for r, _ in rows], faults_of(rows)))


@settings(max_examples=100, deadline=None)
@given(st.lists(TURN, max_size=12), st.integers(0, 12))
def test_matrices_give_the_costs_of_parts(rows, at):
    states = [(r[:1] if r[:1] in ("s", "u", "a") else "", 0) for r, _ in rows]
    at = min(at, len(rows))
    m, behind = C.matrix(states[:at]), C.backward(C.END, states[at:])[0]
    assert min(m[0][t] + behind[t] for t in range(4)) == C.backward(C.END, states)[0][C.START]


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    turns = [(r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in rows]
    faults = faults_of(turns)
    cost, audit, repaired = best(turns)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:], strict=False)]
    digest = sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return (*[faults.count(x) for x in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def found(df):
    pieces = C.repair(df, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    return {r[0]: tuple(r[1:]) for r in C.summary(pieces).select("id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest").collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Yes.", "No", "Why?", f"{c} {t}.", "", " \n"])) for c in range(60) for t in range(rng.randint(1, 9))]
    # Nulls: a conversation, a turn, a role, a text; a very long text; a row that is there twice.
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (100, None, "system", "s."), (100, 1, None, "x."), (100, 2, "user", None), (101, 0, "user", "word " * 200_000 + "."), (102, 0, "user", "a."), (102, 0, "user", "a.")]
    want = {}
    for k in {r[0] for r in rows}:
        want[k] = expected([r for r in rows if r[0] == k])
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == want
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("id", "conv", "part", "place", "kind", "sig", "initial", "piece")]).repartition(7)
    assert found(clash) == want


def test_a_conversation_over_many_parts(spark):
    rng = random.Random(2)
    rows = [(5, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "No", f"{t}.", f"{t}", ""])) for t in range(800)]
    rows += [(4, 1, "user", "a."), (4, 2, "assistant", "b."), (6, 1, "user", "c.")]
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = C.repair(df, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    assert pieces.where("id = 5").count() > 1
    import sys

    sys.setrecursionlimit(20_000)
    assert found(df) == {k: expected([r for r in rows if r[0] == k]) for k in (4, 5, 6)}


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}


def test_op12_against_sql(spark, tiny):
    assert_same(C.op12(spark, tiny), C.ORACLE, tiny)


def test_op12_of_odd_rows_against_sql(spark, tmp_path):
    rows = [(c, t, r, x) for c in (None, 1, 2, 3) for t, r, x in ((None, "system", "s."), (0, "user", "u."), (1, None, "a."), (2, "assistant", None), (3, "user", ""), (7, "assistant", "Fine! "))]
    rows += [(i, 0, "user", "x.") for i in range(50, 90)]  # some of these lose their only row
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations")
    (tmp_path / "conversations").rename(tmp_path / "conversations.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    done = con.execute(C.ORACLE)
    names = [d[0] for d in done.description]
    got = C.op12(spark, str(tmp_path)).select(*names).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(done.fetchall(), key=repr)
    assert any(r.repaired_sha256 == sha256(b"").hexdigest() for r in got)
