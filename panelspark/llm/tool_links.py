"""Chat formatting: link tool calls to their results, order them, check their arguments and write canonical JSON.

All in DataFrame operations. A call has an identifier, a name, arguments (a map from field to text) and at most one
call that it waits for; a result names the identifier of its call. Calls and results meet in a hash join on the
identifier. A call's depth is the number of calls before it in its chain, found by joining each call with the call it
waits for and doubling the step each round, so that a chain of n calls takes log2(n) rounds; every result comes right
after its call (``position``), which makes the order topological. Calls on a circle have no depth. Arguments are checked
against a table of fields by a join on the name.

Canonical JSON: no white space, keys in ascending order, integers and booleans without quotes where their field is
of that kind and they are valid, all other values as strings, absent values as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import stage

#: Fields of the one function into which plain conversations are read: (name, field, kind, required, least, most). For a
#: string, least and most bound its characters; for an integer, the value.
ANSWER_SCHEMA = [
    ("answer", "question", "string", True, 1, 1200),
    ("answer", "turn", "integer", True, 0, 1_000_000),
]
SCHEMA_COLUMNS = "name string, field string, kind string, required boolean, least bigint, most bigint"
#: The patterns of valid values by kind; strings have none.
KIND_PATTERNS = {"integer": r"^(0|-?[1-9][0-9]{0,17})$", "boolean": "^(true|false)$"}


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    Each user turn calls ``answer`` under the identifier conversation:turn and waits for the user turn two before it; an
    assistant turn is the result of the turn before it. Equal rows count once, with their number in ``copies``; different
    texts under one conversation and turn stay apart. A null conversation or turn gives a null identifier. ``other_turns``
    has the rows of all other roles.
    """
    def of(role: str) -> DataFrame:
        rows = turns.where(F.col("role") == role).select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("bigint").alias("at"), "text")
        return rows.groupBy("conv", "at", "text").agg(F.count(F.lit(1)).alias("copies"))

    def ident(back: int) -> Column:
        return F.concat_ws(":", "conv", (F.col("at") - back).cast("string"))

    whole = F.col("conv").isNotNull() & F.col("at").isNotNull()
    arguments = F.map_from_arrays(F.array(F.lit("question"), F.lit("turn")), F.array("text", F.col("at").cast("string")))
    calls = of("user").select(
        F.when(whole, ident(0)).alias("call_id"),
        F.col("conv").alias("conv_id"),
        F.col("at").alias("call_turn"),
        F.lit("answer").alias("name"),
        arguments.alias("arguments"),
        F.when(whole, ident(2)).alias("waits_for"),
        F.col("copies").alias("call_copies"),
    )
    results = of("assistant").select(
        F.when(whole, ident(1)).alias("call_id"), F.col("conv").alias("result_conv"), F.col("at").alias("result_turn"), F.col("text").alias("result"), F.col("copies").alias("result_copies")
    )
    return calls, results


def depths(calls: DataFrame) -> DataFrame:
    """(call_id, depth) of each identified call: calls before it in its chain; null on a circle."""
    known = calls.where("call_id is not null").groupBy("call_id").agg(F.min("waits_for").alias("waits_for"))
    heads = known.select(F.col("call_id").alias("waits_for"), F.lit(True).alias("there"))
    steps = known.join(heads, "waits_for", "left").select("call_id", F.when(F.col("there"), F.col("waits_for")).alias("next"))
    steps = stage(steps.withColumn("depth", F.col("next").isNotNull().cast("bigint")), "steps")
    most, taken = steps.count(), 1
    while taken <= most:
        if steps.where("next is not null").limit(1).count() == 0:
            break
        onward = steps.select(F.col("call_id").alias("next"), F.col("next").alias("then"), F.col("depth").alias("more"))
        joined = steps.join(onward, "next", "left")
        steps = stage(joined.select("call_id", F.col("then").alias("next"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "steps")
        taken *= 2
    return steps.select("call_id", F.when(F.col("next").isNull(), F.col("depth")).alias("depth"))


def _quoted(value: Column) -> Column:
    """A string as JSON; null as null."""
    text = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(text, 2, F.length(text) - 2))


def _plain(value: Column, kind: Column) -> Column:
    """Whether a value is written without quotes."""
    return F.coalesce(F.reduce(F.array(*(((kind == k) & value.rlike(p)) for k, p in KIND_PATTERNS.items())), F.lit(False), lambda a, b: a | F.coalesce(b, F.lit(False))), F.lit(False))


def _problem(value: Column, field: Column) -> Column:
    """What is wrong with a value; null if nothing."""
    kind, integer = field["kind"], value.cast("bigint")
    wrong_kind = kind.isin(*KIND_PATTERNS) & ~_plain(value, kind)
    measure = F.when(kind == "integer", integer).when(kind == "string", F.length(value).cast("bigint"))
    what = (
        F.when(value.isNull(), F.when(field["required"], F.lit("missing")))
        .when(wrong_kind, F.lit("kind"))
        .when((measure < field["least"]) | (measure > field["most"]), F.lit("range"))
    )
    return F.concat(field["field"], F.lit(": "), what)


def link(calls: DataFrame, results: DataFrame, schema: DataFrame) -> DataFrame:
    """A row for each call with its result, and for each result without a call.

    conv_id, call_id, call_turn, result_turn, depth, position, call_copies, result_copies, status (answered, unanswered, orphan,
    conflict, no_id), valid, errors (ascending, joined by "; ") and json. Calls without an identifier are never linked. Where
    an identifier has several calls or several results, none of them are linked: each is a row with the status conflict. A call
    of a name without schema has the error "unknown function"; fields that its schema lacks are unknown as well.
    """
    fields = schema.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("field", "kind", "required", "least", "most"))).alias("fields"))
    checked = calls.join(fields, "name", "left")
    arguments = F.col("arguments")
    wrong = F.transform("fields", lambda f: _problem(F.element_at(arguments, f["field"]), f))
    unknown = F.transform(
        F.array_except(F.map_keys(arguments), F.transform("fields", lambda f: f["field"])), lambda k: F.concat(k, F.lit(": unknown"))
    )
    errors = F.when(F.col("fields").isNull(), F.array(F.lit("unknown function"))).otherwise(F.array_sort(F.array_compact(F.concat(wrong, unknown))))

    def written(key: Column) -> Column:
        value = F.element_at(arguments, key)
        kind = F.element_at(F.col("kinds"), key)
        return F.concat(_quoted(key), F.lit(":"), F.when(_plain(value, kind), value).otherwise(_quoted(value)))

    kinds = F.coalesce(F.map_from_arrays(F.transform("fields", lambda f: f["field"]), F.transform("fields", lambda f: f["kind"])), F.create_map().cast("map<string,string>"))
    checked = checked.withColumns({"errors": errors, "kinds": kinds})
    checked = checked.withColumn("args", F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(arguments)), written), ","), F.lit("}")))
    checked = checked.join(depths(calls), "call_id", "left")
    ids = calls.select("call_id", F.lit(True).alias("asks")).unionByName(results.select("call_id", F.lit(False).alias("asks")))
    several = ids.where("call_id is not null").groupBy("call_id", "asks").count().where("count > 1")
    several = stage(several.select("call_id", F.lit(True).alias("conflict")).distinct(), "conflicts")
    # rows that are not to be linked get an odd part as a call, an even one as a result, which also deals them out
    apart = F.col("call_id").isNull() | F.col("conflict").isNotNull()
    checked = checked.join(several, "call_id", "left")
    checked = checked.withColumn("part", F.when(apart, F.xxhash64("args").bitwiseOR(F.lit(1))).otherwise(F.lit(0))).withColumnRenamed("conflict", "of_calls")
    found = results.join(several, "call_id", "left")
    found = found.withColumn("part", F.when(apart, F.xxhash64("result").bitwiseAND(F.lit(-2))).otherwise(F.lit(0))).withColumnRenamed("conflict", "of_results")
    both = checked.join(found, ["call_id", "part"], "full")
    call, result = F.col("call_copies").isNotNull(), F.col("result_copies").isNotNull()
    status = (
        F.when(F.col("call_id").isNull(), "no_id").when(F.coalesce("of_calls", "of_results"), "conflict").when(call & result, "answered").when(call, "unanswered").otherwise("orphan")
    )
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce("args", F.lit("null")), F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'),
        _quoted(F.col("name")), F.lit(',"result":'), _quoted(F.col("result")), F.lit("}"),
    )
    return both.select(
        F.coalesce("conv_id", "result_conv").alias("conv_id"),
        "call_id",
        "call_turn",
        "result_turn",
        "depth",
        (2 * F.col("depth")).alias("position"),
        "call_copies",
        "result_copies",
        status.alias("status"),
        F.when(call, F.size("errors") == 0).alias("valid"),
        F.array_join("errors", "; ").alias("errors"),
        json.alias("json"),
    )


def answer_schema(spark: SparkSession) -> DataFrame:
    names = [c.split() for c in SCHEMA_COLUMNS.split(", ")]
    rows = [F.struct(*(F.lit(v).cast(kind).alias(c) for v, (c, kind) in zip(row, names, strict=True))) for row in ANSWER_SCHEMA]
    return spark.range(1).select(F.inline(F.array(*rows)))


def other_turns(turns: DataFrame) -> DataFrame:
    """Rows of roles that neither call nor answer (system, tool, null), in the form of ``link``, with the status other.

    Equal rows count once; the name in the JSON is the role, the result the text.
    """
    rest = turns.where(F.coalesce(~F.col("role").isin("user", "assistant"), F.lit(True)))
    rows = rest.groupBy(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("bigint").alias("at"), "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    json = F.concat(F.lit('{"arguments":null,"id":null,"name":'), _quoted(F.col("role")), F.lit(',"result":'), _quoted(F.col("text")), F.lit("}"))
    none = {c: F.lit(None).cast(kind) for c, kind in (("call_id", "string"), ("result_turn", "bigint"), ("depth", "bigint"), ("position", "bigint"))}
    return rows.select(
        F.col("conv").alias("conv_id"), none["call_id"].alias("call_id"), F.col("at").alias("call_turn"), none["result_turn"].alias("result_turn"), none["depth"].alias("depth"),
        none["position"].alias("position"), F.col("copies").alias("call_copies"), F.lit(None).cast("bigint").alias("result_copies"), F.lit("other").alias("status"),
        F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("string").alias("errors"), json.alias("json"),
    )


def conversation_links(turns: DataFrame) -> DataFrame:
    """``link`` over plain conversations, and a row for each turn of another role: no row is left out.

    Only the four columns are looked at; texts of any length, null and empty ones are arguments and results as they are.
    """
    return link(*from_conversations(turns), answer_schema(turns.sparkSession)).unionByName(other_turns(turns))


SQL = """
WITH RECURSIVE calls AS (
  SELECT CAST(conv_id AS VARCHAR) AS conv, turn AS pos, text, count(*) AS copies, CAST(conv_id AS VARCHAR) || ':' || turn AS id FROM conversations WHERE role = 'user' GROUP BY conv_id, turn, text),
results AS (
  SELECT CAST(conv_id AS VARCHAR) AS conv, turn AS pos, text, count(*) AS copies, CAST(conv_id AS VARCHAR) || ':' || (turn - 1) AS id FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn, text),
several AS (
  SELECT DISTINCT id FROM (SELECT id, 'c' AS side FROM calls UNION ALL SELECT id, 'r' FROM results) WHERE id IS NOT NULL GROUP BY id, side HAVING count(*) > 1),
asked AS (SELECT DISTINCT conv, pos, id FROM calls WHERE id IS NOT NULL),
chain AS (
  SELECT conv, pos, id, 0 AS depth FROM asked c WHERE NOT EXISTS (SELECT 1 FROM asked b WHERE b.conv = c.conv AND b.pos = c.pos - 2)
  UNION ALL
  SELECT c.conv, c.pos, c.id, depth + 1 FROM chain JOIN asked c ON c.conv = chain.conv AND c.pos = chain.pos + 2),
c AS (SELECT calls.*, calls.id IS NULL OR calls.id IN (SELECT id FROM several) AS apart FROM calls),
r AS (SELECT results.*, results.id IS NULL OR results.id IN (SELECT id FROM several) AS apart FROM results),
both_ AS (
  SELECT coalesce(x.conv, y.conv) AS conv_id, coalesce(x.id, y.id) AS call_id, x.pos AS call_turn, y.pos AS result_turn, x.copies AS call_copies, y.copies AS result_copies,
    x.text AS question, y.text AS result, false AS apart
  FROM (SELECT * FROM c WHERE NOT apart) x FULL JOIN (SELECT * FROM r WHERE NOT apart) y ON x.id = y.id
  UNION ALL SELECT conv, id, pos, NULL, copies, NULL, text, NULL, true FROM c WHERE apart
  UNION ALL SELECT conv, id, NULL, pos, NULL, copies, NULL, text, true FROM r WHERE apart),
checked AS (
  SELECT both_.*, CASE WHEN call_copies IS NOT NULL THEN chain.depth END AS depth, CASE WHEN call_copies IS NULL THEN NULL ELSE list_filter([
    CASE WHEN question IS NULL THEN 'question: missing' WHEN length(question) NOT BETWEEN 1 AND 1200 THEN 'question: range' END,
    CASE WHEN call_turn IS NULL THEN 'turn: missing' WHEN call_turn NOT BETWEEN 0 AND 1000000 THEN 'turn: range' END], lambda x: x IS NOT NULL) END AS errs
  FROM both_ LEFT JOIN chain ON chain.id = both_.call_id)
SELECT conv_id, call_id, call_turn, result_turn, CAST(depth AS BIGINT) AS depth, CAST(2 * depth AS BIGINT) AS position, call_copies, result_copies,
  CASE WHEN call_id IS NULL THEN 'no_id' WHEN apart THEN 'conflict' WHEN call_copies IS NOT NULL AND result_copies IS NOT NULL THEN 'answered'
    WHEN call_copies IS NOT NULL THEN 'unanswered' ELSE 'orphan' END AS status,
  CASE WHEN call_copies IS NOT NULL THEN len(errs) = 0 END AS valid, array_to_string(errs, '; ') AS errors,
  '{"arguments":' || CASE WHEN call_copies IS NULL THEN 'null' ELSE '{"question":' || coalesce(CAST(to_json(question) AS VARCHAR), 'null')
    || ',"turn":' || coalesce(CAST(call_turn AS VARCHAR), 'null') || '}' END
    || ',"id":' || coalesce(CAST(to_json(call_id) AS VARCHAR), 'null') || ',"name":' || CASE WHEN call_copies IS NULL THEN 'null' ELSE '"answer"' END
    || ',"result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' AS json
FROM checked
UNION ALL
SELECT CAST(conv_id AS VARCHAR), NULL, turn, NULL, NULL, NULL, count(*), NULL, 'other', NULL, NULL,
  '{"arguments":null,"id":null,"name":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"result":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant') GROUP BY conv_id, turn, role, text
"""
