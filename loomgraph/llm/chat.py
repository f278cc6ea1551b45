"""Chat formatting: linking tool calls with their results.  DataFrame functions only.

Calls and results meet by a hash join on the call's identifier.  Calls are put in a
topological order of what they depend on, their arguments are validated against the
tools' schemas, and each linked call is serialised as canonical JSON: keys in order,
no white space, text escaped as JSON asks and no further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def json_text(c: Column) -> Column:
    """A JSON string literal; null is null."""
    quoted = F.to_json(F.struct(c.cast("string").alias("v")), {"ignoreNullFields": "false"})
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))


def canonical_object(**fields: Column) -> Column:
    """An object of already serialised members, keys in code-point order."""
    parts: list[Column] = []
    for k in sorted(fields):
        parts += [F.lit(("," if parts else "") + f'"{k}":'), fields[k]]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def canonical_map(arguments: Column) -> Column:
    """A map<string, string> as an object with keys in order."""
    entries = F.array_sort(F.map_entries(arguments))
    return F.when(arguments.isNull(), F.lit("{}")).otherwise(
        F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), json_text(e["value"]))), ","), F.lit("}"))
    )


def validate(arguments: Column, schema: Column) -> Column:
    """Sorted complaints about a map of arguments.

    ``schema``: array of struct(arg, kind, required, max_length); kinds are string,
    integer, number and boolean.  An unknown tool (null schema) is one complaint."""
    names = F.transform(schema, lambda s: s["arg"])
    value = lambda s: F.element_at(arguments, s["arg"])
    pattern = {"integer": r"^-?(0|[1-9][0-9]*)$", "number": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "boolean": "^(true|false)$"}
    right = lambda s: F.coalesce(*(F.when(s["kind"] == k, value(s).rlike(p)) for k, p in pattern.items()), F.lit(True))
    missing = F.transform(F.filter(schema, lambda s: s["required"] & value(s).isNull()), lambda s: F.concat(F.lit("missing:"), s["arg"]))
    kind = F.transform(F.filter(schema, lambda s: value(s).isNotNull() & ~right(s)), lambda s: F.concat(F.lit("type:"), s["arg"]))
    long = F.transform(F.filter(schema, lambda s: value(s).isNotNull() & s["max_length"].isNotNull() & (F.length(value(s)) > s["max_length"])), lambda s: F.concat(F.lit("length:"), s["arg"]))
    extra = F.transform(F.array_except(F.map_keys(F.coalesce(arguments, F.create_map().cast("map<string,string>"))), names), lambda k: F.concat(F.lit("unknown:"), k))
    return F.when(schema.isNull(), F.array(F.lit("unknown tool"))).otherwise(F.array_sort(F.concat(missing, kind, long, extra)))


#: Rounds after which the keys raised so far are written as one table.
COMPACT = 8


def _cyclic(needs: DataFrame) -> DataFrame | None:
    """The calls (call_id) on a cycle or on a path between cycles, or None.

    They are what is left when calls that nothing depends on, or that depend on nothing,
    are taken away again and again; each round reads what the one before has left."""
    inner, n = needs.select("call_id", "dep"), needs.count()
    while n:
        step = inner.join(inner.select(F.col("call_id").alias("dep")).distinct(), "dep", "left_semi")
        step = step.join(inner.select(F.col("dep").alias("call_id")).distinct(), "call_id", "left_semi")
        inner = materialise(step.select("call_id", "dep"), "call-cycles")
        left = inner.count()
        if left == n:
            return materialise(inner.select("call_id").distinct(), "cyclic-calls")
        n = left
    return None


def _raised_keys(needs: DataFrame) -> DataFrame:
    """(call_id, k) of calls whose key must rise over those of what they depend on.

    ``needs`` has no cycles and holds both calls' own keys (k, dk).  A round looks only at
    calls that depend on ones raised in the round before."""
    over = lambda k: F.struct(F.col(f"{k}.at").alias("at"), (F.col(f"{k}.hops") + 1).alias("hops"))
    highest = lambda df: df.groupBy("call_id").agg(F.max("k").alias("k"))
    front = materialise(highest(needs.where("dk >= k").select("call_id", over("dk").alias("k"))), "raised-calls")
    raised, rounds = front, 0
    while not front.isEmpty():
        rounds += 1
        pull = needs.drop("dk").join(front.select(F.col("call_id").alias("dep"), F.col("k").alias("dk")), "dep").groupBy("call_id").agg(F.max("k").alias("own"), F.max(over("dk")).alias("new"))
        now = pull.join(highest(raised), "call_id", "left")
        front = materialise(now.where(F.col("new") > F.coalesce("k", "own")).select("call_id", F.col("new").alias("k")), "raised-calls")
        raised = raised.union(front)
        if rounds % COMPACT == 0:
            raised = materialise(highest(raised), "raised-calls")
    return highest(raised)


def topological_keys(calls: DataFrame) -> DataFrame:
    """(call_id, order_key, cyclic): sorting calls by order_key, then position and
    call_id, puts each behind all it depends on.

    A call's key is its position, unless it depends on one with no smaller key: then it
    takes that key with one hop more.  Only where such calls exist there are rounds, as
    many as the longest chain of them.  Calls on a cycle, or on a path between cycles,
    keep their position and are marked; what they depend on doesn't move them.
    """
    own = F.struct(F.col("position").cast("long").alias("at"), F.lit(0).cast("long").alias("hops"))
    start = materialise(calls.groupBy("call_id").agg(F.min(own).alias("k")), "call-order")
    needs = calls.select("call_id", F.explode("depends_on").alias("dep")).where("dep is not null").distinct()
    needs = needs.join(start.select(F.col("call_id").alias("dep"), F.col("k").alias("dk")), "dep").join(start, "call_id")
    needs = materialise(needs.select("call_id", "dep", "k", "dk"), "call-needs")
    if needs.where("dk >= k").isEmpty():
        return start.select("call_id", F.col("k").alias("order_key"), F.lit(False).alias("cyclic"))
    cyclic = _cyclic(needs)
    if cyclic is not None:
        needs = materialise(needs.join(cyclic, "call_id", "left_anti").select("call_id", "dep", "k", "dk"), "call-needs")
    raised = materialise(_raised_keys(needs), "raised-keys").withColumnRenamed("k", "higher")
    keys = start.join(raised, "call_id", "left").select("call_id", F.coalesce("higher", "k").alias("order_key"))
    if cyclic is None:
        return keys.withColumn("cyclic", F.lit(False))
    keys = keys.join(cyclic.withColumn("cyclic", F.lit(True)), "call_id", "left")
    return keys.select("call_id", "order_key", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Links tool calls with results.

    ``calls``: call_id, conv_id, position, name, arguments map<string,string>,
    depends_on array<call_id>.  ``results``: call_id, position, content.  ``schemas``:
    tool, params (see validate), one row per tool.  Extra columns are ignored.

    Returns a row per call and per result without one: call_id, conv_id, name, order_at,
    order_hops, position, status, valid, errors, message (canonical JSON).  Status is
    linked, unanswered (no result), orphan (no call), early (its result is placed before
    it) or cyclic.  Of repeated identifiers the smallest call, and the result placed
    first, count; null identifiers are left out.
    """
    calls = calls.select("call_id", "conv_id", "position", "name", "arguments", "depends_on").where("call_id is not null")
    first = F.struct("position", "conv_id", "name", F.array_sort(F.map_entries("arguments")).alias("arguments"), "depends_on")
    calls = calls.groupBy("call_id").agg(F.min(first).alias("c")).select("call_id", "c.position", "c.conv_id", "c.name", F.map_from_entries("c.arguments").alias("arguments"), "c.depends_on")
    calls = materialise(calls, "calls")
    results = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("position", "content")).alias("r"))
    results = results.select("call_id", F.col("r.position").alias("result_at"), F.col("r.content").alias("content"), F.lit(True).alias("answered"))
    both = calls.withColumn("asked", F.lit(True)).join(results, "call_id", "full").join(topological_keys(calls), "call_id", "left")
    both = both.join(schemas.select(F.col("tool").alias("name"), "params"), "name", "left")
    errors = F.when(F.col("asked"), validate(F.col("arguments"), F.col("params"))).otherwise(F.array().cast("array<string>"))
    status = (
        F.when(F.col("asked").isNull(), "orphan").when(F.col("cyclic"), "cyclic").when(F.col("answered").isNull(), "unanswered")
        .when(F.col("result_at") <= F.col("position"), "early").otherwise("linked")
    )
    message = canonical_object(
        arguments=canonical_map(F.col("arguments")), call_id=json_text(F.col("call_id")), name=json_text(F.col("name")), result=json_text(F.col("content")), status=json_text(status)
    )
    return both.select(
        "call_id", "conv_id", "name", F.coalesce("order_key.at", "result_at").alias("order_at"), F.coalesce("order_key.hops", F.lit(0)).cast("long").alias("order_hops"),
        F.coalesce("position", "result_at").alias("position"), status.alias("status"), (F.size(errors) == 0).alias("valid"), F.array_join(errors, ";").alias("errors"), message.alias("message"),
    )


#: The schema by which conversation turns are read as calls of one tool.
REPLY_SCHEMA = "array(named_struct('arg', 'prompt', 'kind', 'string', 'required', true, 'max_length', 400), named_struct('arg', 'turn', 'kind', 'integer', 'required', true, 'max_length', cast(null as int)), named_struct('arg', 'role', 'kind', 'string', 'required', false, 'max_length', 16))"


#: Length of a prompt from which on it needs the following call's reply.
LONG_PROMPT = 120


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A conversation table as calls, results and schemas.

    Every turn but the assistant's asks for a reply; an assistant turn is the result of
    the turn before it.  A call depends on the one of two turns before.  Opening system
    turns depend on the next turn, and prompts over ``LONG_PROMPT`` letters on the call of
    two turns later instead: such calls are late, and a long prompt before a short one
    makes a cycle of both."""
    ident = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    keyed = turns.where("conv_id is not null and turn is not null")
    asked = keyed.where("role is null or role <> 'assistant'")
    turn = F.col("turn")
    needs = F.when((F.col("role") == "system") & (turn == 0), turn + 1).when(F.length("text") > LONG_PROMPT, turn + 2).when(turn >= 2, turn - 2)
    calls = asked.select(
        ident(turn).alias("call_id"), "conv_id", turn.cast("long").alias("position"), F.lit("reply").alias("name"),
        F.map_filter(F.create_map(F.lit("prompt"), F.col("text"), F.lit("turn"), turn.cast("string"), F.lit("role"), F.col("role")), lambda _, v: v.isNotNull()).alias("arguments"),
        F.when(needs.isNotNull(), F.array(ident(needs))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = keyed.where("role = 'assistant'").select(ident(F.col("turn") - 1).alias("call_id"), F.col("turn").cast("long").alias("position"), F.col("text").alias("content"))
    schemas = turns.sparkSession.range(1).select(F.lit("reply").alias("tool"), F.expr(REPLY_SCHEMA).alias("params"))
    return calls, results, schemas
