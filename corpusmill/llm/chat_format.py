"""Chat formatting: tool calls linked to their results, in topological order, validated, as canonical JSON.

Calls and results meet in a hash join on conversation and identifier. A call may name calls whose results it needs; its
level is its depth among these needs, so the order of levels is topological. Arguments are checked against the schema of
the called tool by expressions made from that schema. DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Table, ordered, written
from corpusmill.llm.line_dedup import once

CALLS = "conv_id long, turn long, place int, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"

IN_ROW = 256  # calls that are ordered in one row; a conversation of more takes several

#: JSON types by the names that a variant's schema has for them.
_TYPES = {"string": "STRING", "integer": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
_TOKEN = r'("(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[^"0-9-]+)'


def read_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from transcripts ``conv_id, turn, role, text``.

    An assistant's text may be an object with ``tool_calls``, each with ``id``, ``name``, ``arguments`` (an object) and,
    if it needs other calls' results, their identifiers in ``after``. A tool's text is an object with ``tool_call_id``
    and ``content``. Other texts hold neither, nor do null, empty and broken ones. Texts of any length are read whole;
    repeated rows give repeated calls. Other columns are not read.
    """
    shape = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>,tool_call_id:string,content:string>"
    parsed = messages.select("conv_id", "turn", "role", F.from_json("text", shape).alias("x"))
    calls = parsed.where("role = 'assistant'").select("conv_id", "turn", F.posexplode("x.tool_calls").alias("place", "c"))
    results = parsed.where("role = 'tool'").select("conv_id", "turn", F.col("x.tool_call_id").alias("call_id"), F.col("x.content").alias("content"))
    return calls.select("conv_id", "turn", "place", F.col("c.id").alias("call_id"), "c.name", "c.arguments", "c.after"), results


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def canonical(value: Column) -> Column:
    """A variant as JSON text that is the same for equal values: sorted keys, no blanks, one form for each number.

    A whole number, however written, is its digits, and any other number the shortest text of its double. Beyond 38
    digits whole numbers are doubles too.
    """
    double = lambda t: t.cast("double")
    whole = lambda t: (F.rint(double(t)) == double(t)) & (F.abs(double(t)) < 1e38)
    number = lambda t: F.when(F.rlike(t, F.lit("[.eE]")), F.when(whole(t), double(t).cast("decimal(38,0)").cast("string")).otherwise(double(t).cast("string"))).otherwise(t)
    tokens = F.regexp_extract_all(F.to_json(value), F.lit(_TOKEN), 1)
    return F.array_join(F.transform(tokens, lambda t: F.when(F.rlike(t, F.lit("^-?[0-9]")), number(t)).otherwise(t)), "")


def schema_errors(parsed: Column, arguments: Column, schema: dict) -> Column:
    """The faults of an argument object under a JSON schema, as an array of texts in a fixed order.

    Understood: ``required``, ``properties`` with ``type``, ``enum`` (members are compared as JSON values), ``minimum``,
    ``maximum`` (of numbers), ``minLength`` and ``maxLength`` (of strings), and ``additionalProperties`` (only false
    restricts). Whole numbers of any size and form are integers.
    """
    faults = []
    known = schema.get("properties", {})
    for name in schema.get("required", []):
        faults.append(F.when(F.variant_get(parsed, _path(name), "variant").isNull(), F.lit(f"{name}: missing")))
    for name, rule in sorted(known.items()):
        value = F.variant_get(parsed, _path(name), "variant")
        text, number = F.try_variant_get(parsed, _path(name), "string"), F.try_variant_get(parsed, _path(name), "double")
        here, kind = value.isNotNull(), rule.get("type")
        is_a = lambda k, value=value: F.rlike(_kind(value), F.lit(f"^({_TYPES[k]})$"))
        right = F.lit(True) if kind is None else is_a(kind)
        if kind == "integer":
            right = F.when(right, F.rint(number) == number).otherwise(False)
        faults.append(F.when(here & ~right, F.lit(f"{name}: not of type {kind}")))
        members = [canonical(F.parse_json(F.lit(json.dumps(m)))) for m in rule.get("enum", [])]
        for word, of, good in (
            ("enum", None, lambda _, members=members, value=value: F.array_contains(F.array(*members), canonical(value))),
            ("minimum", "number", lambda r, number=number: number >= r),
            ("maximum", "number", lambda r, number=number: number <= r),
            ("minLength", "string", lambda r, text=text: F.length(text) >= r),
            ("maxLength", "string", lambda r, text=text: F.length(text) <= r),
        ):
            if word in rule:
                faults.append(F.when(here & right & (F.lit(True) if of is None else is_a(of)) & ~good(rule[word]), F.lit(f"{name}: {word}")))
    if schema.get("additionalProperties") is False:
        extra = F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, sorted(known)))))
        faults.append(F.when(F.size(extra) > 0, F.concat(F.lit("not allowed: "), F.array_join(extra, ","))))
    return F.filter(F.array(*faults) if faults else F.array().cast("array<string>"), lambda x: x.isNotNull())


def quoted(text: Column) -> Column:
    """A text as a JSON string, or ``null``: only quotes, backslashes and control characters are escaped."""
    return F.coalesce(F.substring(F.to_json(F.array(text)), 2, 2**31 - 1).substr(F.lit(1), F.length(F.to_json(F.array(text))) - 2), F.lit("null"))


def link_calls(calls: DataFrame, results: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """Every call with its result, and every result that has no call.

    Returns ``conv_id, turn, call_id, status, level, valid, json``. Status: ``linked``; ``unanswered`` (no result has its
    identifier); ``repeated`` (an earlier call has its identifier: it gets no result); ``orphan`` (a result whose
    identifier no call has). If several results have one identifier, the first by turn and content counts and the
    others come out as ``repeated`` results. A null conversation or identifier matches nothing. Sorted by level, a
    conversation's first calls stand in a topological order (``call_levels``); needs of unknown identifiers don't count.
    Calls in a cycle or behind one, and all other rows, have level -1. Calls of unknown tools, or whose arguments are no
    JSON object, are not valid, nor is a result without a call. Texts of any length are read whole. Repeated rows and hot
    identifiers are aggregated before the joins. Empty inputs give no rows. Other columns are not read.
    """
    key = ["conv_id", "call_id"]
    calls = calls.select("conv_id", "turn", "place", "call_id", "name", "arguments", "after")
    results = results.select("conv_id", "turn", "call_id", "content")
    named = calls.select(*key, F.struct("turn", "place", "name", "arguments").alias("c"), F.lit(None).cast("struct<turn:bigint,content:string>").alias("r"))
    named = named.unionByName(results.select(*key, F.lit(None).cast(named.schema["c"].dataType).alias("c"), F.struct("turn", "content").alias("r")))
    ends = Table(named.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*key).agg(F.min("c").alias("c"), F.min("r").alias("r")))
    levels = call_levels(calls, ends.df.where("c IS NOT NULL").select(*key, F.col("c.turn").alias("turn"), F.col("c.place").alias("place")))
    first = written(ends.df.join(levels, key, "left").select(*key, F.struct("c.turn", "c.place").alias("at"), "r", "level"))
    linked = calls.join(first, key, "left").withColumn("own", F.coalesce(F.struct("turn", "place") == F.col("at"), F.lit(True)))
    status = F.when(~F.col("own"), "repeated").when(F.col("r").isNotNull(), "linked").otherwise("unanswered")
    calls_out = linked.select("conv_id", "turn", "call_id", status.alias("status"), F.when(F.col("own"), F.coalesce("level", F.lit(-1))).otherwise(-1).alias("level"), "name", "arguments", F.when(F.col("own"), F.col("r.content")).alias("content"))
    answers = results.join(first.select(*key, "at", F.col("r").alias("one")), key, "left").where("at.turn IS NULL OR NOT (one.turn <=> turn AND one.content <=> content)")
    orphans = answers.select("conv_id", "turn", "call_id", F.when(F.col("at.turn").isNull(), "orphan").otherwise("repeated").alias("status"), F.lit(-1).cast("long").alias("level"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), "content")
    every = calls_out.withColumn("is_call", F.lit(True)).unionByName(orphans.withColumn("is_call", F.lit(False)))
    parsed = every.withColumn("v", F.try_parse_json("arguments"))
    errors = F.when(F.col("v").isNull() | ~_kind(F.col("v")).startswith("OBJECT"), F.array(F.lit("arguments: not an object")))
    for tool, schema in sorted(tools.items()):
        errors = errors.when(F.col("name") == tool, schema_errors(F.col("v"), F.col("arguments"), schema))
    errors = F.when(F.col("is_call"), errors.otherwise(F.array(F.lit("name: unknown tool"))))
    checked = parsed.withColumn("errors", errors)
    texts = F.concat(F.lit("["), F.array_join(F.transform("errors", quoted), ","), F.lit("]"))
    call = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("v")), F.lit("null")), F.lit(',"errors":'), texts, F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"result":'), quoted(F.col("content")), F.lit("}"))
    answer = F.concat(F.lit('{"id":'), quoted(F.col("call_id")), F.lit(',"result":'), quoted(F.col("content")), F.lit("}"))
    return checked.select("conv_id", "turn", "call_id", "status", "level", F.coalesce(F.size("errors") == 0, F.lit(False)).alias("valid"), F.when(F.col("is_call"), call).otherwise(answer).alias("json"))


def settled(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by, call_id, needs, base, level``: the calls of each row's array ``c``, ordered in one pass.

    ``c`` has ``call_id, needs, base``: ``base`` is the least level a call can have. A call is taken when no need is open;
    its level is then final, and it closes one need of each call that needs it, so calls and needs are visited once. Calls
    that are never taken have no level; their ``base`` is that of the needs which were.
    """
    named = rows.select(*by, "c", once(F.transform("c", lambda x: x["call_id"])).alias("ids"))
    deps = F.transform("c", lambda x: F.filter(F.transform(x["needs"], lambda y: F.array_position("ids", y).cast("int") - 1), lambda p: p >= 0))
    placed = named.select(*by, "c", once(deps).alias("deps"), F.sequence(F.lit(0), F.size("c") - 1).alias("all"))
    users = F.transform("all", lambda k: F.transform("deps", lambda d: F.array_contains(d, k)))
    ready = placed.select(*by, "c", "all", once(users).alias("users"))
    start = F.struct(
        F.filter("all", lambda i: F.size(F.get("c", i)["needs"]) == 0).alias("queue"), F.transform("c", lambda x: F.size(x["needs"])).alias("open"), F.transform("c", lambda x: x["base"]).alias("level")
    )

    def step(s: Column, t: Column) -> Column:
        k = F.get(s["queue"], t)
        uses, level = F.get("users", k), F.get(s["level"], k)
        more = F.filter("all", lambda i: F.get(uses, i) & (F.get(s["open"], i) == 1))
        closed = F.zip_with(s["open"], uses, lambda o, u: F.when(u, o - 1).otherwise(o))
        raised = F.zip_with(s["level"], uses, lambda x, u: F.when(u, F.greatest(x, level + 1)).otherwise(x))
        return F.when(k.isNull(), s).otherwise(F.struct(F.concat(s["queue"], more).alias("queue"), closed.alias("open"), raised.alias("level")))

    done = ready.select(*by, "c", "all", once(F.aggregate("all", start, step)).alias("s"))
    out = F.transform("all", lambda i: F.struct(F.get("c", i).alias("x"), F.get("s.level", i).alias("base"), (F.get("s.open", i) == 0).alias("taken")))
    spread = done.select(*by, F.explode(out).alias("o"))
    return spread.select(*by, "o.x.call_id", "o.x.needs", "o.base", F.when(F.col("o.taken"), F.col("o.base")).alias("level"))


def call_levels(calls: DataFrame, known: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of all first calls (``known``): 0 without needs, else one more than the deepest need.

    -1 marks calls in a cycle or behind one. A conversation of up to ``IN_ROW`` calls is ordered in a row of its own,
    without further shuffles; for the calls of a longer one see ``long_levels``. Needs of calls that aren't there don't count.
    """
    key = ["conv_id", "call_id"]
    first = calls.select("conv_id", "turn", "place", "call_id", F.explode_outer("after").alias("need")).join(known, [*key, "turn", "place"], "left_semi")
    own = Table(first.groupBy("conv_id", "turn", "place", "call_id").agg(F.collect_set("need").alias("needs"))).df
    big = written(own.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > IN_ROW))
    call = F.struct("turn", "place", "call_id", "needs", F.lit(0).cast("long").alias("base"))
    one = own.join(big, "conv_id", "left_anti").groupBy("conv_id").agg(F.array_sort(F.collect_list(call)).alias("c"))
    ids = F.transform("c", lambda x: x["call_id"])
    there = one.select("conv_id", "c", once(ids).alias("ids")).select("conv_id", F.transform("c", lambda x: F.struct(x["call_id"].alias("call_id"), F.array_intersect(x["needs"], "ids").alias("needs"), x["base"].alias("base"))).alias("c"))
    short = settled(there, ["conv_id"]).select("conv_id", "call_id", F.coalesce("level", F.lit(-1)).alias("level"))
    if big.isEmpty():
        return short
    return short.unionByName(long_levels(own.join(big, "conv_id").select("conv_id", "turn", "place", "call_id", "needs")))


def long_levels(own: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` from ``conv_id, turn, place, call_id, needs``, for conversations of any length.

    Calls are dealt by ranges of their places, and ``IN_ROW`` that follow one another are a row. In each round every row
    settles what it can by itself, and what it settled closes needs in the other rows. A conversation of n calls that need
    earlier ones takes n / ``IN_ROW`` rounds at most; needs that go back and forth between rows take one for each turn-about.
    A round that settles nothing shows that the rest is in cycles or behind them.
    """
    key = ["conv_id", "call_id"]
    table = ordered(own.select("conv_id", F.col("turn"), F.col("place").alias("at"), "call_id", "needs"), ["conv_id", "turn", "at", "call_id"])
    there = table.df.select("conv_id", F.col("call_id").alias("need"))
    needs = written(table.df.select(*key, F.explode("needs").alias("need")).join(there, ["conv_id", "need"]))
    listed = needs.groupBy(*key).agg(F.collect_set("need").alias("needs"))
    # A row's calls lie in one part, whose places follow one another.
    row = F.expr(f"place div {IN_ROW}")
    open_ = Table(table.df.select(*key, row.alias("row")).join(listed, key, "left").select(*key, "row", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"), F.lit(0).cast("long").alias("base")))
    found: list[DataFrame] = []
    while True:
        rows = open_.df.groupBy("conv_id", "row").agg(F.collect_list(F.struct("call_id", "needs", "base")).alias("c"))
        tried = Table(settled(rows, ["conv_id", "row"]))
        open_.drop()
        taken = written(tried.df.where("level IS NOT NULL").select(*key, "level"))
        if taken.isEmpty():
            break
        found.append(taken)
        rest = tried.df.where("level IS NULL")
        closed = rest.select(*key, F.explode("needs").alias("need")).join(taken.select("conv_id", F.col("call_id").alias("need"), "level"), ["conv_id", "need"])
        raised = closed.groupBy(*key).agg(F.max("level").alias("below"), F.collect_set("need").alias("gone"))
        left = rest.join(raised, key, "left")
        open_ = Table(left.select(*key, "row", F.array_except("needs", F.coalesce("gone", F.array().cast("array<string>"))).alias("needs"), F.greatest("base", F.coalesce(F.col("below") + 1, F.lit(0))).alias("base")))
        tried.drop()
    out = tried.df.select(*key, F.lit(-1).cast("long").alias("level"))
    for taken in found:
        out = out.unionByName(taken)
    return out


#: The schema of the one tool of the registered query.
REPLY = {"type": "object", "required": ["text", "turn"], "properties": {"text": {"type": "string", "minLength": 20}, "turn": {"type": "integer", "minimum": 0}}, "additionalProperties": False}


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results: a user's turn calls ``reply``, and the next turn, if the assistant's, is
    the result. A call needs the result of the conversation's previous user turn, where that stands two turns before."""
    of = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    arguments = F.to_json(F.struct("turn", "text"))
    calls = messages.where("role = 'user'").select("conv_id", "turn", F.lit(0).alias("place"), of(turn).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(of(turn - 2)).alias("after"))
    results = messages.where("role = 'assistant'").select("conv_id", "turn", of(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def turns_with_needs(messages: DataFrame) -> DataFrame:
    """All turns as calls that need others of their conversation: three turns on, a turn of a hash, in part in circles."""
    of = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    turn, conv = F.col("turn"), F.col("conv_id")
    needs = F.array(of(turn + 3), of((turn * 5 + conv) % 8), of(F.when((turn + conv) % 3 == 0, turn - 1)))
    return messages.select("conv_id", "turn", F.lit(0).alias("place"), of(turn).alias("call_id"), F.lit("reply").alias("name"), F.lit("{}").alias("arguments"), needs.alias("after"))


def call_order(spark, sf_dir: str) -> DataFrame:
    """The level of every turn of ``conversations`` where turns need later and earlier ones; -1 in and behind circles."""
    calls = turns_with_needs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return call_levels(calls, calls.select("conv_id", "call_id", "turn", "place"))


CALL_ORDER = """
    WITH RECURSIVE t AS (SELECT conv_id, turn, unnest([turn + 3, (turn * 5 + conv_id) % 8, CASE WHEN (turn + conv_id) % 3 = 0 THEN turn - 1 END]) AS need FROM conversations),
    e AS (SELECT DISTINCT t.* FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.need),
    reach AS (SELECT conv_id, turn, need FROM e UNION SELECT r.conv_id, r.turn, e.need FROM reach r JOIN e ON e.conv_id = r.conv_id AND e.turn = r.need),
    circle AS (SELECT DISTINCT r.conv_id, r.turn FROM reach r JOIN reach x ON x.conv_id = r.conv_id AND x.turn = x.need AND x.turn IN (r.turn, r.need)),
    free AS (SELECT conv_id, turn FROM conversations ANTI JOIN circle USING (conv_id, turn)),
    depth AS (SELECT conv_id, turn, 0 AS d FROM free UNION SELECT e.conv_id, e.turn, d.d + 1 FROM depth d JOIN e ON e.conv_id = d.conv_id AND e.need = d.turn JOIN free f ON f.conv_id = e.conv_id AND f.turn = e.turn)
    SELECT conv_id, conv_id || '-' || turn AS call_id, CAST(max(d) AS BIGINT) AS level FROM depth GROUP BY conv_id, turn
    UNION ALL SELECT conv_id, conv_id || '-' || turn, -1 FROM circle
"""


def op3(spark, sf_dir: str) -> DataFrame:
    """Each turn of ``conversations`` once: in a call, as its result or as a result without a call, or as a message."""
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    linked = link_calls(*turns_as_calls(messages), {"reply": REPLY})
    others = messages.where("role IS NULL OR role NOT IN ('user', 'assistant')")
    line = F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}"))
    return linked.unionByName(others.select("conv_id", "turn", F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("status"), F.lit(-1).cast("long").alias("level"), F.lit(True).alias("valid"), line.alias("json")))


ORACLE = """
    WITH RECURSIVE u AS (SELECT *, conv_id || '-' || turn AS call_id FROM conversations WHERE role = 'user'),
    a AS (SELECT *, conv_id || '-' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'),
    f AS (SELECT u.*, length(u.text) >= 20 AS ok FROM u),
    depth AS (
        SELECT conv_id, turn, CAST(0 AS BIGINT) AS level FROM u WHERE NOT EXISTS (SELECT 1 FROM u x WHERE x.conv_id = u.conv_id AND x.turn = u.turn - 2)
        UNION ALL SELECT u.conv_id, u.turn, d.level + 1 FROM depth d JOIN u ON u.conv_id = d.conv_id AND u.turn = d.turn + 2
    )
    SELECT f.conv_id, f.turn, f.call_id, CASE WHEN a.conv_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, d.level, f.ok AS valid,
        '{"arguments":{"text":' || to_json(f.text) || ',"turn":' || f.turn || '},"errors":[' || CASE WHEN f.ok THEN '' ELSE '"text: minLength"' END
        || '],"id":' || to_json(f.call_id) || ',"name":"reply","result":' || coalesce(CAST(to_json(a.text) AS VARCHAR), 'null') || '}' AS json
    FROM f JOIN depth d ON d.conv_id = f.conv_id AND d.turn = f.turn LEFT JOIN a ON a.conv_id = f.conv_id AND a.call_id = f.call_id
    UNION ALL
    SELECT a.conv_id, a.turn, a.call_id, 'orphan', -1, false, '{"id":' || to_json(a.call_id) || ',"result":' || to_json(a.text) || '}'
    FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = a.conv_id AND u.turn = a.turn - 1)
    UNION ALL
    SELECT conv_id, turn, NULL, 'message', -1, true, '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}'
    FROM conversations WHERE role NOT IN ('user', 'assistant')
"""
