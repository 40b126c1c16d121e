"""Operator 8: tool calls linked to their results, ordered, validated and serialised, in DataFrame functions only.

A call is an entry of the array "tool_calls" (or the one "tool_call") in an assistant message whose text is a JSON object:
{"id", "name", "arguments"}; a result is a message of role tool: {"tool_call_id", "content"}. Entries are read one by
one. Calls and results are hash-joined by conversation and identifier. An argument "$id" stands for the result of the
call of that id, which gives the edges of a graph. Its topological order (rows sort by conv_id, turn, depth, call_no)
comes by raking off calls without open dependencies and compressing chains: in each round a dependency on a call that
itself has one dependency only is replaced by that, so a chain of n calls takes about log2(n) rounds, and only a ladder
in which every call has several dependencies takes one a level. Arguments are validated against the schemas of the
tools, and every row is serialised as canonical JSON: keys sorted at every depth, no blanks, all keys present with null
where there is no value, and values with the JSON types that they came with.

Rows are one for each message, and for a message with calls one for each entry; no conversation is gathered in one task.

Defined results: a repeated call id keeps its first call (by turn, then place), later ones get the error duplicate_id; a
call takes the first result at or after its turn, other results are not linked. Text that is no JSON object (or repeats
a key within one) is a plain message; null text is serialised as null. An id that is a number or a boolean counts as
its JSON text. An entry that is no object, or whose id or name is missing or an object, array or null, keeps what it has
and gets the error malformed_entry; without an id it is never linked. An empty array of calls is a plain message.
Dependencies on ids that do not exist, or on calls of later turns, are errors; calls on a cycle, or behind one, get the
error cycle and a null depth. Arguments that are no object are an error. A tool without a schema gives valid = null.
Rows with a null conv_id or turn are kept and not linked. Repeated rows are kept, as repeated ids. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import Workspace

#: tool, parameter, type (string integer number boolean object array any), required
SCHEMAS = [
    ("search", "query", "string", True), ("search", "limit", "integer", False), ("fetch", "url", "string", True),
    ("calculate", "expression", "string", True), ("convert", "value", "number", True), ("convert", "unit", "string", True),
]

TYPES = {
    "string": "^STRING$", "integer": r"^(?:BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(?:BIGINT|DECIMAL.*|DOUBLE|FLOAT)$",
    "boolean": "^BOOLEAN$", "object": "^OBJECT<", "array": "^ARRAY<", "any": "",
}
ROWS = ["conv_id", "turn", "role", "kind", "call_no", "call_id", "name"]


def scalar(v: Column, path: str) -> Column:
    """A string, number or boolean at a path of a variant as text; null for all else."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(~kind.rlike("^(?:OBJECT|ARRAY|VOID)"), F.try_variant_get(v, path, "string"))


def parsed(conversations: DataFrame) -> DataFrame:
    """One row for each message or call: adds kind, call_no, call_id, name, args and _content (both canonical JSON) and _broken."""
    t = F.trim(F.col("text"))
    v = F.try_parse_json(F.when(t.startswith("{"), t))
    m = conversations.withColumn("_v", F.when(F.schema_of_variant(v).startswith("OBJECT<"), v))
    assistant = F.when(F.col("role") == "assistant", F.col("_v"))
    many = F.try_variant_get(assistant, "$.tool_calls", "array<variant>")
    one = F.try_variant_get(assistant, "$.tool_call", "variant")
    tool = F.when(F.col("role") == "tool", F.col("_v"))
    m = m.withColumn("_calls", F.coalesce(many, F.when(one.isNotNull(), F.array(one)))).withColumn("_result", scalar(tool, "$.tool_call_id"))
    m = m.select("conv_id", "turn", "role", "text", "_v", "_result", F.posexplode_outer("_calls").alias("call_no", "_call"))
    kind = F.when(F.col("call_no").isNotNull(), "call").when(F.col("_result").isNotNull(), "result").otherwise("message")
    m = m.withColumn("kind", kind).withColumn("_id", scalar(F.col("_call"), "$.id")).withColumn("name", scalar(F.col("_call"), "$.name"))
    return m.select(
        "conv_id", "turn", "role", "text", "kind", "call_no", F.coalesce("_id", "_result").alias("call_id"), "name",
        F.to_json(F.try_variant_get("_call", "$.arguments", "variant")).alias("args"),
        F.when(F.col("kind") == "result", F.to_json(F.try_variant_get("_v", "$.content", "variant"))).alias("_content"),
        ((F.col("kind") == "call") & (F.col("_id").isNull() | F.col("name").isNull())).alias("_broken"),
    )


def ordered(work: Workspace, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, call_id and depth (the longest chain of dependencies) of each call on and behind no cycle; edges: conv_id, call_id, needs."""
    node = ["conv_id", "call_id"]
    known = calls.join(edges.select(*node).distinct(), node, "left_anti").withColumn("depth", F.lit(0))
    if edges.isEmpty():
        return known
    done = fresh = work.write(known, "depth-0")
    # an edge without needs is a least depth that is known already
    held = work.write(edges.withColumn("weight", F.lit(1)), "edges")
    while True:
        reached = fresh.select("conv_id", F.col("call_id").alias("needs"), F.col("depth").alias("_depth"))
        open_ = held.join(reached, ["conv_id", "needs"], "left").select(
            *node, F.when(F.col("_depth").isNull(), F.col("needs")).alias("needs"), (F.col("weight") + F.coalesce("_depth", F.lit(0))).alias("weight"),
        )
        raked = work.write(open_.groupBy(*node, "needs").agg(F.max("weight").alias("weight")), "raked")
        per = raked.groupBy(*node).agg(F.count("needs").alias("open"), F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"), F.max("needs").alias("needs"))
        per = work.write(per, "calls")
        fresh = work.write(per.where("open = 0").select(*node, F.col("weight").alias("depth")), "ready")
        if fresh.isEmpty():
            return done
        done = work.write(done.union(fresh), "done")
        chain = per.where("open = 1 AND n = 1").select("conv_id", F.col("call_id").alias("needs"), F.col("needs").alias("_next"), F.col("weight").alias("_more"))
        waiting = raked.join(per.where("open > 0").select(*node), node, "left_semi").join(chain, ["conv_id", "needs"], "left")
        work.drop(held)
        held = work.write(waiting.select(*node, F.coalesce("_next", "needs").alias("needs"), (F.col("weight") + F.coalesce("_more", F.lit(0))).alias("weight")), "edges")
        work.drop(raked, per)


def problems(args: Column, schema: Column) -> Column:
    """What is wrong with the arguments (name to type) under a schema (parameter to type and required)."""
    given, known = F.map_keys(args), F.map_keys(schema)
    missing = F.transform(F.filter(known, lambda p: F.element_at(schema, p)["required"] & ~F.array_contains(given, p)), lambda p: F.concat(F.lit("missing:"), p))
    unknown = F.transform(F.array_except(given, known), lambda p: F.concat(F.lit("unknown:"), p))

    def wrong(p: Column) -> Column:
        pattern = F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.element_at(schema, p)["type"])
        return ~F.regexp_like(F.element_at(args, p), pattern)

    typed = F.transform(F.filter(F.array_intersect(given, known), wrong), lambda p: F.concat(F.lit("type:"), p))
    return F.array_sort(F.concat(missing, unknown, typed))


def link(spark: SparkSession, conversations: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """The rows of a conversation table (conv_id, turn, role, text) with their links; see the module's docstring."""
    work = Workspace(spark, "calls")
    some = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = parsed(some)
    special = work.write(rows.where("kind != 'message'"), "special")
    if schemas is None:
        schemas = spark.createDataFrame(SCHEMAS, "tool string, parameter string, type string, required boolean")
    per_tool = schemas.groupBy(F.col("tool").alias("name")).agg(F.map_from_entries(F.collect_set(F.struct("parameter", F.struct("type", F.coalesce("required", F.lit(False)).alias("required"))))).alias("_schema"))

    calls = special.where("kind = 'call' AND call_id IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL")
    results = special.where("kind = 'result' AND conv_id IS NOT NULL AND turn IS NOT NULL")
    at = F.struct("turn", "call_no")
    first = work.write(calls.groupBy("conv_id", "call_id").agg(F.min(at).alias("_first"), F.min_by("args", at).alias("args")), "first-calls")
    taken = results.select("conv_id", "call_id", F.col("turn").alias("_turn")).join(first.select("conv_id", "call_id", "_first"), ["conv_id", "call_id"]).where("_turn >= _first.turn")
    taken = work.write(taken.groupBy("conv_id", "call_id").agg(F.min("_turn").alias("_result_turn")), "taken")
    refs = F.array_distinct(F.regexp_extract_all("args", F.lit(r'"\$([A-Za-z0-9_.:-]+)"'), F.lit(1)))
    needs = first.select("conv_id", "call_id", "_first", F.explode(refs).alias("needs"))
    known = first.select("conv_id", F.col("call_id").alias("needs"), F.col("_first.turn").alias("_need_turn"))
    needs = work.write(needs.join(known, ["conv_id", "needs"], "left"), "needs")
    depth = work.write(ordered(work, first.select("conv_id", "call_id"), needs.where("_need_turn IS NOT NULL").select("conv_id", "call_id", "needs")), "depth")
    fault = F.when(F.col("_need_turn").isNull(), "unknown_reference").when(F.col("_need_turn") > F.col("_first.turn"), "later_reference")
    faults = needs.groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set(fault)).alias("_faults"))
    facts = first.join(taken, ["conv_id", "call_id"], "left").join(depth, ["conv_id", "call_id"], "left").join(faults, ["conv_id", "call_id"], "left")
    facts = work.write(facts.select("conv_id", "call_id", "_first", "_result_turn", F.col("depth").alias("_depth"), "_faults"), "facts")

    linked = special.join(facts, ["conv_id", "call_id"], "left").join(per_tool, "name", "left")
    is_call, is_first = F.col("kind") == "call", (F.col("_first.turn") == F.col("turn")) & F.col("_first.call_no").eqNullSafe(F.col("call_no"))
    link_turn = F.when(is_call & is_first, F.col("_result_turn")).when(~is_call & (F.col("_result_turn") == F.col("turn")), F.col("_first.turn"))
    types = F.from_json("args", "map<string,variant>")
    types = F.transform_values(F.map_from_entries(F.array_distinct(F.transform(F.map_keys(types), lambda k: F.struct(k, F.schema_of_variant(F.element_at(types, k)))))), lambda k, v: v)
    bad_args = is_call & ~F.coalesce(F.schema_of_variant(F.try_parse_json("args")).startswith("OBJECT<"), F.lit(False))
    none = F.array().cast("array<string>")
    checked = F.when(F.col("_broken"), F.array(F.lit("malformed_entry"))).when(bad_args, F.array(F.lit("arguments_not_object"))).when(is_call & F.col("_schema").isNotNull(), problems(types, F.col("_schema"))).otherwise(none)
    graph = F.when(is_call & is_first, F.concat(F.coalesce("_faults", none), F.when(F.col("_depth").isNull(), F.array(F.lit("cycle"))).otherwise(none)))
    graph = F.when(is_call & F.col("_first").isNotNull() & ~is_first, F.array(F.lit("duplicate_id"))).otherwise(F.coalesce(graph, none))
    valid = F.when(is_call, F.when(F.col("_broken") | bad_args, F.lit(False)).when(F.col("_schema").isNotNull(), F.size(checked) == 0))
    keep = {"ignoreNullFields": "false"}
    body = F.when(
        is_call, F.to_json(F.struct(F.try_parse_json("args").alias("arguments"), F.col("call_id").alias("id"), "name", link_turn.alias("result_turn"), "role", "turn"), keep),
    ).otherwise(F.to_json(F.struct(link_turn.alias("call_turn"), F.try_parse_json("_content").alias("content"), "role", F.col("call_id").alias("tool_call_id"), "turn"), keep))
    head = linked.select(
        *ROWS, link_turn.isNotNull().alias("linked"), link_turn.alias("link_turn"), F.when(is_call & is_first, F.col("_depth")).alias("depth"),
        valid.alias("valid"), F.concat(checked, graph).alias("errors"), body.alias("json"),
    )
    plain = rows.where("kind = 'message'").select(
        *ROWS, F.lit(False).alias("linked"), F.lit(None).cast("long").alias("link_turn"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("boolean").alias("valid"),
        none.alias("errors"), F.to_json(F.struct(F.col("text").alias("content"), "role", "turn"), keep).alias("json"),
    )
    return plain.union(head)
