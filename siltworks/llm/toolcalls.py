"""Tool-call linking for chat transcripts, with built-in functions only.

Messages are rows ``conv_id, turn, role, text``. An assistant's text may be a JSON object with ``tool_calls``, a list
of ``{"id", "name", "arguments", "depends_on"}``; a text of role ``tool`` is ``{"tool_call_id", "content"}``. Calls
meet their results by a hash join on conversation and identifier, are put in topological levels by what
they depend on, their arguments are checked against schemas, and each call with its result becomes one record
of canonical JSON: keys sorted, no blanks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import discard, materialise

#: Calls of a conversation that are put in order inside one row.
IN_ROW = 512
#: Types of a parameter and the variant types that fit.
FITS = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "object": r"^OBJECT.*$",
    "array": r"^ARRAY.*$",
}


@dataclass(frozen=True)
class Tool:
    """A tool's parameters by name with their type, and which of them a call must give."""

    name: str
    parameters: dict[str, str]
    required: tuple[str, ...] = field(default=())


def _path(name: str) -> str:
    """The path of a field of exactly this name."""
    if "'" in name and '"' in name:
        raise ValueError(f"no path can name a parameter with both quotes: {name}")
    return f'$["{name}"]' if "'" in name else f"$['{name}']"


def _objects(messages: DataFrame, role: str) -> DataFrame:
    # White space as JSON has it.
    parsed = F.when(F.ltrim("text", F.lit(" \t\n\r")).startswith("{"), F.try_parse_json("text"))
    return messages.filter(F.col("role") == role).select("conv_id", "turn", parsed.alias("v")).filter("v is not null")


def _valid(tools: tuple[Tool, ...]) -> Column:
    """Whether the call's arguments suit its tool; null for a tool that isn't known."""
    out = F.when(F.lit(False), F.lit(False))
    for tool in tools:
        given = lambda p: F.try_variant_get(F.col("arguments"), _path(p), "variant")
        checks = [F.array_size(F.array_except(F.coalesce(F.json_object_keys("canonical"), F.array().cast("array<string>")), F.array(*map(F.lit, tool.parameters)).cast("array<string>"))) == 0]
        for p, kind in tool.parameters.items():
            fits = F.schema_of_variant(given(p)).rlike(FITS[kind])
            missing = given(p).isNull()
            checks.append(~missing & fits if p in tool.required else missing | fits)
        out = out.when(F.col("name") == tool.name, F.coalesce(F.schema_of_variant("arguments").startswith("OBJECT") & reduce(Column.__and__, checks), F.lit(False)))
    return out


def parse_calls(messages: DataFrame, tools: tuple[Tool, ...]) -> DataFrame:
    """conv_id, turn, call_id, name, canonical (arguments), valid, depends_on; repeated identifiers keep the first."""
    calls = _objects(messages, "assistant").select("conv_id", "turn", F.explode(F.expr("try_variant_get(v, '$.tool_calls', 'array<variant>')")).alias("c"))
    get = lambda path, kind: F.expr(f"try_variant_get(c, '$.{path}', '{kind}')")
    calls = calls.select("conv_id", "turn", get("id", "string").alias("call_id"), get("name", "string").alias("name"), get("arguments", "variant").alias("arguments"), get("depends_on", "array<string>").alias("depends_on"))
    calls = calls.filter("call_id is not null").withColumn("canonical", F.coalesce(F.to_json("arguments"), F.lit("null")))
    calls = calls.withColumn("valid", _valid(tools)).drop("arguments")
    first = F.min(F.struct("turn", "canonical", "name", "valid", "depends_on")).alias("f")
    return calls.groupBy("conv_id", "call_id").agg(first).select("conv_id", "call_id", "f.*")


def parse_results(messages: DataFrame) -> DataFrame:
    """conv_id, call_id, result (canonical JSON; the first by turn), n_results, result_turn."""
    results = _objects(messages, "tool").select("conv_id", "turn", F.expr("try_variant_get(v, '$.tool_call_id', 'string')").alias("call_id"), F.coalesce(F.to_json(F.expr("try_variant_get(v, '$.content', 'variant')")), F.lit("null")).alias("result"))
    first = F.min(F.struct("turn", "result")).alias("f")
    return results.filter("call_id is not null").groupBy("conv_id", "call_id").agg(first, F.count("*").alias("n_results")).select("conv_id", "call_id", F.col("f.result").alias("result"), F.col("f.turn").alias("result_turn"), "n_results")


def _levels_by_rounds(calls: DataFrame) -> DataFrame:
    """Each round takes the calls settled last and the dependencies still open, both of which it writes out, so that
    what is settled is not read again; there are as many rounds as levels."""
    ids = ["conv_id", "call_id"]
    renamed = lambda df: df.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    same = lambda call: F.col("conv_id").eqNullSafe(F.col("c")) & (F.col(call) == F.col("i"))
    open_ = materialise(calls.select(*ids, F.explode(F.array_distinct("depends_on")).alias("need")))
    last = materialise(calls.select(*ids).join(renamed(open_).distinct(), same("call_id"), "left_anti"))
    settled, level = last.withColumn("level", F.lit(0)), 0
    while open_.take(1):
        level += 1
        left = materialise(open_.join(renamed(last), same("need"), "left_anti"))
        met = open_.join(renamed(last), same("need"), "left_semi").select(*ids).distinct()
        last = materialise(met.join(renamed(left).distinct(), same("call_id"), "left_anti"))
        discard(open_)
        open_ = left
        if not last.take(1):
            discard(last)
            break
        settled = settled.unionByName(last.withColumn("level", F.lit(level)))
    discard(open_)
    return settled


def _levels_in_rows(calls: DataFrame) -> DataFrame:
    """The calls of a conversation in one row: dependencies are places in it, and levels settle in as many steps as it has calls."""
    rows = calls.groupBy("conv_id").agg(F.collect_list(F.struct("call_id", F.coalesce(F.array_distinct("depends_on"), F.array().cast("array<string>")).alias("needs"))).alias("c"))
    rows = rows.select("conv_id", F.col("c.call_id").alias("ids"), F.col("c.needs").alias("names"))
    rows = rows.select("conv_id", "ids", F.expr("transform(names, x -> transform(x, d -> int(array_position(ids, d))))").alias("needs"))
    # A place of 0 is a call that does not exist, so it has no level, ever.
    settled = "forall(x, p -> p > 0 and get(levels, p - 1) is not null)"
    step = f"transform(needs, x -> if(size(x) = 0, 0, if({settled}, array_max(transform(x, p -> get(levels, p - 1))) + 1, null)))"
    first = "transform(needs, x -> if(size(x) = 0, 0, int(null)))"
    rows = rows.select("conv_id", "ids", F.expr(f"aggregate(sequence(1, size(ids)), {first}, (levels, turn) -> {step})").alias("levels"))
    return rows.select("conv_id", F.inline(F.arrays_zip(F.col("ids").alias("call_id"), F.col("levels").alias("level")))).filter("level is not null")


def topological_levels(calls: DataFrame, in_row: int = IN_ROW) -> DataFrame:
    """conv_id, call_id, level: 0 without dependencies, else one more than the highest of them.

    Calls on a cycle, behind one, or behind a call that doesn't exist get no row. A null conv_id is a conversation of
    its own; no calls give no rows. Conversations of at most ``in_row`` calls are put in order inside a row each,
    whatever their levels; longer ones by rounds over all of them, one for each level.
    """
    large = materialise(calls.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > in_row).select(F.col("conv_id").alias("c")))
    if not large.take(1):
        discard(large)
        return _levels_in_rows(calls)
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    ids = ["conv_id", "call_id", "level"]
    long_ones = _levels_by_rounds(materialise(calls.join(large, same, "left_semi")))
    return _levels_in_rows(calls.join(large, same, "left_anti")).select(*ids).unionByName(long_ones.select(*ids))


def link_tool_calls(messages: DataFrame, tools: tuple[Tool, ...]) -> DataFrame:
    """One row per call, and per identifier that only results name.

    Returns conv_id, call_id, name, turn, level, n_results, status and record. Status is the first that holds of
    orphan_result (no such call), unknown_tool, invalid_arguments, unordered (on or behind a cycle or a missing
    call; level null), missing_result, early_result (a result's turn isn't after the call's), ok. The record is
    canonical JSON of arguments, id, name and result (null where missing); null for orphans. Order by level, then
    turn, is a topological order.

    Messages whose role or text is null, that are no JSON objects or lack an identifier hold no calls and no
    results. A null conv_id is a conversation of its own. Of repeated identifiers in a conversation the first
    call and the first result by turn count (ties: by content). An empty table gives no rows. Extra
    columns are not read.
    """
    messages = messages.select("conv_id", "turn", "role", "text")
    calls = materialise(parse_calls(messages, tools))
    levels = topological_levels(calls).select(F.col("conv_id").alias("lc"), F.col("call_id").alias("li"), "level")
    results = parse_results(messages).select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), "result", "result_turn", "n_results")
    placed = calls.join(levels, F.col("conv_id").eqNullSafe(F.col("lc")) & (F.col("call_id") == F.col("li")), "left")
    both = placed.join(results, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "full_outer")
    orphan = F.col("call_id").isNull()
    status = (
        F.when(orphan, "orphan_result").when(F.col("valid").isNull(), "unknown_tool").when(~F.col("valid"), "invalid_arguments").when(F.col("level").isNull(), "unordered")
        .when(F.col("ri").isNull(), "missing_result").when(F.col("result_turn") <= F.col("turn"), "early_result").otherwise("ok")
    )
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("x")), {"ignoreNullFields": "false"}).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")), {"ignoreNullFields": "false"})) - 6)
    record = F.concat(F.lit('{"arguments":'), "canonical", F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit(',"result":'), F.coalesce("result", F.lit("null")), F.lit("}"))
    return both.select(
        F.when(orphan, F.col("rc")).otherwise(F.col("conv_id")).alias("conv_id"), F.coalesce("call_id", "ri").alias("call_id"), "name", "turn", "level",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), status.alias("status"), F.when(~orphan, record).alias("record"),
    )


#: The tool that plain conversations are read as using: a user's turn asks, the assistant's next turn answers.
ANSWER = (Tool("answer", {"question": "string", "turn": "integer"}, ("question", "turn")),)


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool messages.

    A turn of role user becomes a call of ``answer`` with its text and turn. Numbered from 0 over every second turn,
    question k depends on question (k - 1) // 2, so that a long conversation is a tree of many levels, not as many
    as it has questions. A turn of role assistant becomes the result of the turn before it. Other roles, system turns
    among them, stay as they are: they are neither calls nor results and give no row.
    """
    identifier = lambda turn: F.concat(F.lit("t"), turn.cast("string"))
    turn = F.col("turn")
    call = F.struct(
        identifier(turn).alias("id"), F.lit("answer").alias("name"), F.struct(F.col("text").alias("question"), turn.alias("turn")).alias("arguments"),
        F.when(turn > 1, F.array(identifier(F.floor((F.floor(turn / 2) - 1) / 2) * 2 + turn % 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    asked = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    answered = F.to_json(F.struct(identifier(turn - 1).alias("tool_call_id"), F.col("text").alias("content")))
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    text = F.when(F.col("role") == "user", asked).when(F.col("role") == "assistant", answered).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def chat_report(conversations: DataFrame) -> DataFrame:
    """Linked calls of plain conversations with the MD5 of each record (null for orphans).

    Turns that are null, have a null role or another one than user and assistant hold neither calls nor results; a null
    text of a user makes invalid arguments. Repeated turns count once, with the least text; their results are counted in
    n_results. An empty table gives no rows; extra columns are not read.
    """
    linked = link_tool_calls(as_tool_messages(conversations), ANSWER)
    return linked.select("conv_id", "call_id", "name", "turn", "level", "n_results", "status", F.md5(F.col("record").cast("binary")).alias("record_md5"))


#: The same in DuckDB, straight from the plain turns.
ORACLE_SQL = r"""
WITH RECURSIVE asked AS (
  SELECT conv_id, turn, min(text) AS text, count(*) AS n FROM conversations WHERE role = 'user' AND turn IS NOT NULL GROUP BY ALL
), answered AS (
  SELECT conv_id, turn - 1 AS turn, min(text) AS text, count(*) AS n FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY ALL
), levels(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0 FROM asked WHERE turn <= 1
  UNION ALL
  SELECT a.conv_id, a.turn, l.level + 1 FROM asked a JOIN levels l ON a.conv_id = l.conv_id AND a.turn > 1 AND (a.turn // 2 - 1) // 2 * 2 + a.turn % 2 = l.turn
)
SELECT coalesce(a.conv_id, r.conv_id) AS conv_id, 't' || CAST(coalesce(a.turn, r.turn) AS VARCHAR) AS call_id,
  CASE WHEN a.turn IS NOT NULL THEN 'answer' END AS name, a.turn AS turn, CAST(l.level AS INTEGER) AS level,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_results,
  CASE WHEN a.turn IS NULL THEN 'orphan_result' WHEN a.text IS NULL THEN 'invalid_arguments' WHEN l.level IS NULL THEN 'unordered'
    WHEN r.turn IS NULL THEN 'missing_result' ELSE 'ok' END AS status,
  CASE WHEN a.turn IS NOT NULL THEN md5('{"arguments":{"question":' || CAST(to_json(a.text) AS VARCHAR) || ',"turn":' || CAST(a.turn AS VARCHAR) || '},"id":"t' ||
    CAST(a.turn AS VARCHAR) || '","name":"answer","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}') END AS record_md5
FROM asked a LEFT JOIN levels l ON a.conv_id = l.conv_id AND a.turn = l.turn
FULL OUTER JOIN answered r ON a.conv_id = r.conv_id AND a.turn = r.turn
"""
