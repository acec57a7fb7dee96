"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

DataFrame functions only. Messages are (conv_id, turn, role, text). An assistant's text may be a JSON object with `content` and
`tool_calls`, each of id, name, arguments and `after`, the ids it depends on; a tool's text one with `tool_call_id` and `content`.

One row per message, call and result comes out. Sorted by conv_id, turn, level and position they are the formatted
conversation: calls come after those they depend on, and a linked result takes its call's place.

Rules for odd input: text that is no such object is plain content, null included; a result without a call, and every
result of an id but the first by turn and text, is kept with linked = false; a call without a result is kept likewise;
unknown dependencies are left out; calls on a cycle have a null level; unknown tools and arguments that are no object are not
valid; repeated rows give their rows again; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

MESSAGE = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>,tool_call_id:string>"
#: Types of JSON values and what the schema language calls them.
TYPES = {"BIGINT": "integer", "STRING": "string", "BOOLEAN": "boolean", "DOUBLE": "number", "FLOAT": "number", "VOID": "null"}


def value_type(value: Column) -> Column:
    found = F.schema_of_variant(value)
    plain = F.coalesce(*(F.when(found == k, v) for k, v in TYPES.items()))
    return F.when(found.startswith("DECIMAL"), "number").when(found.startswith("ARRAY"), "array").when(found.startswith("OBJECT"), "object").otherwise(plain)


def canonical(arguments: Column) -> Column:
    """A map of variants as JSON with its keys in order; objects inside are in order already."""
    keys = F.array_sort(F.map_keys(arguments))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(arguments, k))), {"ignoreNullFields": "false"})


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of the calls that depend on others: the length of their longest chain; null on a cycle."""
    ids = calls.select("conv_id", F.col("call_id").alias("dep")).distinct()
    edges = calls.select("conv_id", "call_id", F.explode("after").alias("dep")).distinct().join(ids, ["conv_id", "dep"], "left_semi")
    left = keep(edges, "chat-edges")
    done, level = None, 0
    while left.take(1):
        level += 1
        waiting = left.select("conv_id", F.col("call_id").alias("dep")).distinct()
        blocked = left.join(waiting, ["conv_id", "dep"], "left_semi").select("conv_id", "call_id").distinct()
        rest = keep(left.join(blocked, ["conv_id", "call_id"], "left_semi"), "chat-edges")
        free = left.select("conv_id", "call_id").distinct().join(blocked, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level))
        if not free.take(1):
            free, rest = waiting.select("conv_id", F.col("dep").alias("call_id"), F.lit(None).cast("int").alias("level")), left.limit(0)
        done = free if done is None else done.unionByName(free)
        left = rest
    return done if done is not None else calls.select("conv_id", "call_id", F.lit(0).alias("level")).limit(0)


def format_chats(messages: DataFrame, tools: dict[str, dict[str, str]]) -> DataFrame:
    """conv_id, turn, kind, position, level, call_id, linked, valid, json; tools: the types of each tool's required arguments."""
    spoken = F.when(F.col("role").isin("assistant", "tool") & F.col("text").startswith("{"), F.from_json("text", MESSAGE))
    m = messages.select("conv_id", "turn", "role", "text", spoken.alias("m"))
    is_calls = F.coalesce(F.col("role") == "assistant", F.lit(False)) & F.col("m.tool_calls").isNotNull()
    is_result = F.coalesce(F.col("role") == "tool", F.lit(False)) & F.col("m.tool_call_id").isNotNull()
    whole = {"ignoreNullFields": "false"}
    nothing = [F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("boolean").alias("linked"), F.lit(None).cast("boolean").alias("valid")]
    content = F.when(is_calls, F.col("m.content")).otherwise(F.col("text"))
    plain = m.where(~is_result).select("conv_id", "turn", F.lit("message").alias("kind"), F.lit(-1).alias("position"), F.lit(-1).alias("level"), *nothing, F.to_json(F.struct(content.alias("content"), "role"), whole).alias("json"))

    calls = m.where(is_calls).select("conv_id", "turn", F.posexplode("m.tool_calls").alias("position", "c"))
    calls = calls.select("conv_id", "turn", "position", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.from_json("c.arguments", "map<string,variant>").alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    checks = F.lit(False)
    for name, params in tools.items():
        good = F.lit(True)
        for param, kind in params.items():
            good &= F.coalesce(value_type(F.element_at("arguments", F.lit(param))) == kind, F.lit(False))
        checks = F.when(F.col("name") == name, good).otherwise(checks)
    valid = F.coalesce(F.col("arguments").isNotNull() & checks, F.lit(False))
    calls = calls.select("conv_id", "turn", "position", "call_id", "name", "after", valid.alias("valid"), F.coalesce(canonical(F.col("arguments")), F.lit("null")).alias("arguments"))
    calls = keep(calls, "chat-calls")
    results = m.where(is_result).select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("content"))

    # one row for each id on either side, so that repeated ids cannot multiply
    by_id = ["conv_id", "call_id"]
    first = results.groupBy(*by_id).agg(F.min(F.struct("turn", "content")).alias("first"))
    known = calls.groupBy(*by_id).agg(F.min(F.struct("turn", "position")).alias("call"))
    deep = levels(calls.select("conv_id", "call_id", "after"))
    placed = calls.join(first.hint("shuffle_hash"), by_id, "left").join(deep.withColumn("deep", F.lit(True)).hint("shuffle_hash"), by_id, "left")
    level = F.when(F.col("deep"), F.col("level")).otherwise(0)
    call_rows = placed.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "position", level.alias("level"), "call_id", F.col("first").isNotNull().alias("linked"), "valid",
        F.concat(F.lit('{"arguments":'), "arguments", F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit("}")).alias("json"),
    )
    joined = results.join(known.hint("shuffle_hash"), by_id, "left").join(first.hint("shuffle_hash"), by_id, "left").join(deep.withColumn("deep", F.lit(True)).hint("shuffle_hash"), by_id, "left")
    linked = F.col("call").isNotNull() & (F.struct("turn", "content") == F.col("first"))
    result_rows = joined.select(
        "conv_id", F.when(linked, F.col("call.turn")).otherwise(F.col("turn")).alias("turn"), F.lit("result").alias("kind"),
        F.when(linked, F.col("call.position")).otherwise(0).alias("position"), F.when(linked, level).otherwise(0).alias("level"),
        "call_id", F.coalesce(linked, F.lit(False)).alias("linked"), F.lit(None).cast("boolean").alias("valid"),
        F.to_json(F.struct("content", F.col("call_id").alias("tool_call_id")), whole).alias("json"),
    )
    return plain.unionByName(call_rows).unionByName(result_rows)


def quoted(column: str) -> Column:
    """A string as JSON."""
    inner = F.to_json(F.struct(F.col(column).alias("v")), {"ignoreNullFields": "false"})
    return inner.substr(F.lit(6), F.length(inner) - 6)


#: The tools of the query below.
TOOLS = {"search": {"query": "string", "limit": "integer"}, "fetch": {"url": "string", "depth": "integer"}}


def traffic(conversations: DataFrame) -> DataFrame:
    """The plain conversations as tool traffic, by fixed rules, as the table holds none.

    An assistant's turn calls `search`, and `fetch` after it if its text's length is divisible by 3, without a url if it is
    divisible by 6. A user's turn from the third on is the result of the search before it.
    """
    n = F.length("text")
    first = F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn")
    search = F.struct(first.alias("id"), F.lit("search").alias("name"), F.to_json(F.struct(F.substring("text", 1, 40).alias("query"), (n % 10).alias("limit")), {"ignoreNullFields": "false"}).alias("arguments"), F.array().cast("array<string>").alias("after"))
    url = F.when(n % 6 != 0, F.concat(F.lit("doc:"), n))
    fetch = F.struct(F.concat(first, F.lit("-f")).alias("id"), F.lit("fetch").alias("name"), F.to_json(F.struct(url.alias("url"), (n % 7).alias("depth"))).alias("arguments"), F.array(first).alias("after"))
    calls = F.when(n % 3 == 0, F.array(fetch, search)).otherwise(F.array(search))
    spoken = F.to_json(F.struct(F.col("text").alias("content"), calls.alias("tool_calls")))
    is_result = (F.col("role") == "user") & (F.col("turn") >= 2)
    answer = F.to_json(F.struct(F.concat(F.lit("c"), "conv_id", F.lit("-"), F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")), {"ignoreNullFields": "false"})
    text = F.when((F.col("role") == "assistant") & F.col("text").isNotNull(), spoken).when(is_result, answer).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", F.when(is_result, "tool").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op10(conversations: DataFrame) -> DataFrame:
    return format_chats(traffic(conversations), TOOLS).fillna(False, ["linked", "valid"])


OP10_SQL = """
with c as (select conv_id, turn, role, text, length(text) as n, 'c' || conv_id || '-' || turn as id from conversations),
calls as (
  select conv_id, turn, 0 as position, 1 as level, id || '-f' as call_id, n % 6 <> 0 as valid,
         '{"arguments":{"depth":' || (n % 7) || case when n % 6 <> 0 then ',"url":"doc:' || n || '"' else '' end || '},"id":"' || id || '-f","name":"fetch"}' as json
  from c where role = 'assistant' and text is not null and n % 3 = 0
  union all
  select conv_id, turn, case when n % 3 = 0 then 1 else 0 end, 0, id, true,
         '{"arguments":{"limit":' || (n % 10) || ',"query":' || to_json(substr(text, 1, 40)) || '},"id":"' || id || '","name":"search"}'
  from c where role = 'assistant' and text is not null),
results as (select conv_id, turn, 'c' || conv_id || '-' || (turn - 1) as call_id, text from c where role = 'user' and turn >= 2),
first as (select conv_id, call_id, min({'turn': turn, 'content': text}) as f from results group by all),
known as (select conv_id, call_id, min({'turn': turn, 'position': position}) as k, any_value(level) as level from calls group by all),
r as (
  select r.*, k, level, k is not null and {'turn': r.turn, 'content': r.text} is not distinct from f as linked
  from results r left join known using (conv_id, call_id) left join first using (conv_id, call_id))
select conv_id, turn, 'message' as kind, -1 as position, -1 as level, null::varchar as call_id, false as linked, false as valid,
       '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null') || '}' as json
from c where not coalesce(role = 'user' and turn >= 2, false)
union all
select conv_id, calls.turn, 'call', position, level, call_id, f is not null, valid, json from calls left join first using (conv_id, call_id)
union all
select conv_id, case when linked then k.turn else turn end, 'result', case when linked then k.position else 0 end, case when linked then level else 0 end,
       call_id, linked, false, '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"tool_call_id":"' || call_id || '"}' from r
"""
