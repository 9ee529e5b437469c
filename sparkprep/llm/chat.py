"""Linking tool calls to their results and writing them as canonical JSON."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.materialize import materialize

MAX_ROUNDS = 62
#: JSON type -> how its variant schema starts
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"),
          "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}
Schema = Mapping[str, Mapping[str, object]]  # field -> type, required, min, max


def _field_error(value: Column, field: str, spec: Mapping[str, object]) -> Column:
    """What is wrong with one field of a parsed argument object, or null."""
    path = f"$.{field}"
    kind = F.schema_of_variant(F.variant_get(value, path, "variant"))
    typed = reduce(lambda a, b: a | b, [kind.startswith(t) for t in _TYPES[str(spec["type"])]])
    error = F.when(kind.isNull(), F.lit(f"{field}: missing") if spec.get("required") else F.lit(None).cast("string"))
    error = error.when(~typed, F.lit(f"{field}: not {spec['type']}"))
    if spec["type"] in ("string", "integer", "number"):
        text = spec["type"] == "string"
        size = F.char_length(F.try_variant_get(value, path, "string")) if text else F.try_variant_get(value, path, "double")
        if spec.get("min") is not None:
            error = error.when(size < F.lit(spec["min"]), F.lit(f"{field}: {'shorter' if text else 'less'} than {spec['min']}"))
        if spec.get("max") is not None:
            error = error.when(size > F.lit(spec["max"]), F.lit(f"{field}: {'longer' if text else 'more'} than {spec['max']}"))
    return error


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Schema]) -> Column:
    """Array of what is wrong with a call's JSON arguments under its tool's schema."""
    value = F.try_parse_json(arguments)
    out = F.when(name.isNull() | ~name.isin(list(schemas)), F.array(F.lit("unknown tool")))
    out = out.when(arguments.isNull() | value.isNull(), F.array(F.lit("not JSON")))
    out = out.when(~F.schema_of_variant(value).startswith("OBJECT"), F.array(F.lit("not an object")))
    for tool, schema in sorted(schemas.items()):
        wrong = [_field_error(value, f, schema[f]) for f in sorted(schema)]
        keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
        more = F.transform(F.array_sort(F.array_except(keys, F.lit(sorted(schema)))),
                           lambda k: F.concat(k, F.lit(": unexpected")))
        listed = F.concat(F.array(*wrong) if wrong else F.array().cast("array<string>"), more)
        out = out.when(name == tool, F.filter(listed, lambda e: e.isNotNull()))
    return out


def call_depths(calls: DataFrame) -> DataFrame:
    """``call_id, after_id, depth`` of calls (call_id, after: ids it may follow, by preference).

    A call follows the first listed id that is a call.  Its depth is the number
    of calls before it on that way, found by doubling pointers: rounds grow with
    the logarithm of the longest way.  Calls on a cycle, or after one, have a
    null depth.
    """
    ids = calls.select(F.col("call_id").alias("after_id"))
    listed = calls.select("call_id", F.posexplode("after").alias("pos", "after_id"))
    follows = (listed.where(F.col("after_id") != F.col("call_id")).join(ids, "after_id", "left_semi")
               .groupBy("call_id").agg(F.min(F.struct("pos", "after_id")).alias("m"))
               .select("call_id", F.col("m.after_id").alias("after_id")))
    base = materialize(calls.select("call_id").join(follows, "call_id", "left"), "follows")
    state = base.select("call_id", F.col("after_id").alias("to"), F.when(F.col("after_id").isNull(), 0).otherwise(1)
                        .cast("bigint").alias("depth"))
    left = open_ = state.where(F.col("to").isNotNull()).count()
    for _ in range(MAX_ROUNDS):
        if not left:
            break
        ahead = state.select(F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        state = materialize(state.join(ahead, "to", "left").select(
            "call_id", F.col("next").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths")
        left = state.where(F.col("to").isNotNull()).count()
        open_ //= 2
        if not open_:  # longer ways than calls: only cycles are left
            break
    depth = F.when(F.col("to").isNull(), F.col("depth"))
    return base.join(state.select("call_id", depth.alias("depth")), "call_id")


def _first_and_further(rows: DataFrame, columns: list[str], count: str) -> tuple[DataFrame, DataFrame]:
    """The first row, by ``columns``, under every key (conv_id, call_id), with the
    number ``count`` of its rows; and the rows after it."""
    key = F.struct("conv_id", "call_id").alias("key")  # as a struct, null conversations compare equal
    numbered = materialize(rows.where(F.col("call_id").isNotNull())
                           .select(key, F.struct(*columns, F.monotonically_increasing_id().alias("_n")).alias("row")), "numbered")
    first = materialize(numbered.groupBy("key").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias(count)), "first")
    further = numbered.join(first.select(F.col("row._n").alias("n")), F.col("row._n") == F.col("n"), "left_anti")
    return first.select("key", "row.*", count).drop("_n"), further.select("key.*", "row.*").drop("_n")


def link_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Schema]) -> DataFrame:
    """One row per call, and per result that no call is linked to.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (array
    of call ids).  ``results``: conv_id, call_id, turn, content.  Identifiers
    hold within a conversation.  The first call and the first result by turn
    under each identifier are joined on it (``n_calls`` and ``n_results`` count
    all).  Returns conv_id, call_id, turn, name, after_id, depth (place in
    topological order), result_turn, n_calls, n_results, status (linked,
    no_result, no_call, cycle, duplicate), errors (of the arguments, "; "
    between), message: canonical JSON, keys sorted, no white space, absent parts
    left out.

    Every further call or result of an identifier is a row of its own with
    status duplicate; rows without an identifier are left out of linking and
    have status no_id; arguments that are not a JSON object have no message;
    empty tables give empty results; other columns are not read.
    """
    one, more_calls = _first_and_further(calls, ["turn", "name", "arguments", "after"], "n_calls")
    got, more_results = _first_and_further(results, ["turn", "content"], "n_results")
    after = F.transform("after", lambda c: F.struct(F.col("key.conv_id").alias("conv_id"), c.alias("call_id")))
    depths = call_depths(one.select(F.col("key").alias("call_id"), after.alias("after")))
    placed = one.join(depths.withColumnRenamed("call_id", "key"), "key")
    both = placed.join(got.withColumnRenamed("turn", "result_turn"), "key", "full")
    status = (F.when(F.col("n_calls").isNull(), "no_call").when(F.col("depth").isNull(), "cycle")
              .when(F.col("n_results").isNull(), "no_result").otherwise("linked"))
    linked = both.select("key.*", "turn", "name", F.col("after_id.call_id").alias("after_id"), "depth", "result_turn",
                         "n_calls", "n_results", status.alias("status"), "arguments", "content")
    lost = [("duplicate", more_calls.drop("after")),
            ("duplicate", more_results.withColumnRenamed("turn", "result_turn")),
            ("no_id", calls.where(F.col("call_id").isNull()).select("conv_id", "turn", "name", "arguments")),
            ("no_id", results.where(F.col("call_id").isNull()).select("conv_id", "turn", "content"))]
    out = linked.where("false")
    for why, rows in lost:
        out = out.unionByName(rows.withColumn("status", F.lit(why)), allowMissingColumns=True)
    linked = out.unionByName(linked)
    said = F.when(F.col("name").isNotNull() | F.col("arguments").isNotNull(),
                  F.concat_ws("; ", argument_errors(F.col("name"), F.col("arguments"), schemas)))
    parts = F.struct(F.try_parse_json("arguments").alias("arguments"), "call_id", "name", F.col("content").alias("result"))
    message = F.when(F.col("arguments").isNull() | F.try_parse_json("arguments").isNotNull(), F.to_json(parts))
    return linked.withColumn("errors", said).withColumn("message", message).drop("arguments", "content")
