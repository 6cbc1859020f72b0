"""Driver-side control of pipelines: bounded loops over conversations, nested calls, replays, self-checks, and JSON schemas and tool dictionaries."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written


def until_quiet(conversations: DataFrame, step: Callable[[DataFrame], DataFrame], calling: Column, most: int = 15) -> DataFrame:
    """Conversations stepped until none makes a call any more, at most ``most`` times.

    Only those that still call are stepped; the others are kept as they are. Each round is written, so a lost executor costs no earlier round.
    """
    table, quiet = written(conversations, "loop"), []
    for _ in range(most):
        busy = table.where(F.coalesce(calling, F.lit(False)))
        if busy.isEmpty():
            break
        quiet.append(table.where(~F.coalesce(calling, F.lit(False))))
        table = written(step(busy), "loop")
    for done in quiet:
        table = table.unionByName(done)
    return table


def nested_calls(calls: DataFrame, name: str, args: str, functions: dict[str, Callable[..., object]]) -> DataFrame:
    """Calls with ``result`` and ``error``, where an argument that is a call itself ({"function": name, "args": {...}}) is carried out first. An error in an inner call is the outer call's error."""

    def value(x: object) -> object:
        if isinstance(x, dict) and set(x) == {"function", "args"}:
            return functions[x["function"]](**{k: value(v) for k, v in x["args"].items()})
        return x

    @F.pandas_udf("result string, error string")
    def apply(names: pd.Series, arguments: pd.Series) -> pd.DataFrame:
        rows = []
        for n, a in zip(names, arguments, strict=True):
            try:
                rows.append((json.dumps(value({"function": n, "args": json.loads(a or "{}")}), default=str, ensure_ascii=False), None))
            except Exception as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["result", "error"])

    return calls.withColumn("_r", apply(name, args)).select(*calls.columns, "_r.result", "_r.error")


def replayed(tasks: DataFrame, calls: str, results: str, answer: str) -> DataFrame:
    """Tasks with ``messages``: an assistant's call and a tool's result for each of the true calls, and the true answer at the end; all messages have role, content and call."""
    message = lambda role, content, call: F.struct(F.lit(role).alias("role"), content.alias("content"), call.alias("call"))
    none = F.lit(None).cast("string")
    pairs = F.flatten(F.zip_with(calls, results, lambda c, r: F.array(message("assistant", F.lit(""), c), message("tool", r, c))))
    return tasks.withColumn("messages", F.concat(pairs, F.array(message("assistant", F.col(answer), none))))


def with_start(messages: Column, system: Column | None, user: Column) -> Column:
    """Messages after a system message, if there is one, and the user's."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(None).cast("string").alias("call"))
    head = [message("system", system)] if system is not None else []
    return F.concat(F.array(*head, message("user", user)), messages)


def self_check(user_tasks: DataFrame, injection_tasks: DataFrame, suite: str, solved: str, injectable: str, secured: str) -> DataFrame:
    """(suite, passed, unsolved, not_injectable, insecure): a suite passes if its truth solves every user task, each shows a placeholder, and every injection task's truth reaches its goal."""
    u = user_tasks.groupBy(suite).agg(F.count_if(~F.coalesce(solved, F.lit(False))).alias("unsolved"), F.count_if(F.coalesce(solved, F.lit(False)) & ~F.coalesce(injectable, F.lit(False))).alias("not_injectable"))
    i = injection_tasks.groupBy(suite).agg(F.count_if(~F.coalesce(secured, F.lit(False))).alias("insecure"))
    joined = u.join(i, suite, "full").na.fill(0, ["unsolved", "not_injectable", "insecure"])
    return joined.select(suite, ((F.col("unsolved") == 0) & (F.col("not_injectable") == 0) & (F.col("insecure") == 0)).alias("passed"), "unsolved", "not_injectable", "insecure")


def inlined_schema(schema: dict, drop: tuple[str, ...] = ("default", "additionalProperties")) -> dict:
    """A JSON schema with its references replaced by their definitions and some keys removed at all levels. A reference to an enclosing definition stays, as it has no end."""
    defs = schema.get("$defs", {})

    def fill(node: object, within: tuple[str, ...]) -> object:
        if isinstance(node, list):
            return [fill(x, within) for x in node]
        if not isinstance(node, dict):
            return node
        if "$ref" in node and (name := node["$ref"].rsplit("/", 1)[-1]) in defs and name not in within:
            rest = {k: v for k, v in node.items() if k != "$ref"}
            return fill(rest | defs[name], (*within, name))
        return {k: fill(v, within) for k, v in node.items() if k not in drop and k != "$defs"}

    return fill(schema, ())


def tool_dictionary(kits: DataFrame, kit: str, tools: str, name: str) -> DataFrame:
    """One row per tool of a table of kits (with an array of structs), named by the kit and the tool together."""
    each = kits.select(F.col(kit).alias("_kit"), F.explode(tools).alias("_t"))
    return each.select(F.concat("_kit", F.col(f"_t.{name}")).alias("tool"), "_t.*")


def simulated_response(cases: DataFrame, tool: str, parameters: str, responses: DataFrame, key: str, response: str) -> DataFrame:
    """Cases with the response kept under "(tool,parameters)"; null parameters are "{}", an unknown key gives null."""
    asked = F.concat(F.lit("("), F.col(tool), F.lit(","), F.coalesce(F.col(parameters), F.lit("{}")), F.lit(")"))
    known = responses.select(F.col(key).alias("_key"), F.col(response).alias("response")).dropDuplicates(["_key"])
    return cases.withColumn("_key", asked).join(known, "_key", "left").drop("_key")

