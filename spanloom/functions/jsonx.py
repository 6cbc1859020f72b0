"""JSON and call texts that no expression can rewrite: vectorised functions over Arrow batches. Anything that doesn't parse gives null."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LEAVES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


def _loaded(text: str | None) -> object:
    if text is None:
        raise ValueError("null")
    return json.loads(text)


def _compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _walk(value: object, path: str = "$"):
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from _walk(v, f"{path}.{k}")
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from _walk(v, f"{path}[{k}]")


def _steps(path: str) -> list[str | int]:
    return [int(i) if i else name for name, i in re.findall(r"\.([^.\[\]]+)|\[(\d+)\]", path)]


def _mapped(value: object, change) -> object:
    if isinstance(value, str):
        return change(value)
    if isinstance(value, dict):
        return {k: _mapped(v, change) for k, v in value.items()}
    return [_mapped(v, change) for v in value] if isinstance(value, list) else value


def _each(f, *columns: pd.Series) -> pd.Series:
    out = []
    for row in zip(*columns, strict=True):
        try:
            out.append(f(*row))
        except (ValueError, SyntaxError, KeyError, IndexError, TypeError, AttributeError, RecursionError, MemoryError):
            out.append(None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(_LEAVES)
def string_leaves(texts: pd.Series) -> pd.Series:
    """All string values of a JSON text with their paths, in order."""
    return _each(lambda t: [{"path": p, "value": v} for p, v in _walk(_loaded(t))], texts)


@F.pandas_udf(T.StringType())
def set_path(texts: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
    """A JSON text with the string at a path ($.a[0].b) replaced; null if there is no such path. Keys keep their order."""

    def put(text: str, path: str, value: str) -> str:
        whole = _loaded(text)
        *head, last = _steps(path)
        node = whole
        for step in head:
            node = node[step]
        node[last]  # the path must be there
        node[last] = value
        return _compact(whole)

    return _each(put, texts, paths, values)


@F.pandas_udf(T.StringType())
def replace_in_strings(texts: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    """A JSON text with a part replaced in all its string values, keys excepted; a text that is no JSON is replaced as it is."""

    def put(text: str, a: str, b: str) -> str:
        try:
            value = json.loads(text)
        except ValueError:
            return text.replace(a, b)
        return _compact(_mapped(value, lambda s: s.replace(a, b)))

    return _each(put, texts, old, new)


@F.pandas_udf(T.StringType())
def repaired(texts: pd.Series) -> pd.Series:
    """JSON of a text that holds JSON or a Python literal, maybe in a code fence, with text after it, or quoted as a whole."""

    def fix(text: str) -> str:
        bare = re.sub(r"^```\w*\s*|\s*```$", "", text.strip())
        for _ in range(2):
            try:
                value, _end = json.JSONDecoder().raw_decode(bare)
            except ValueError:
                value = ast.literal_eval(bare)
            if not isinstance(value, str):
                break
            bare = value
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)

    return _each(fix, texts)


@F.pandas_udf(T.StringType())
def call_source(names: pd.Series, arguments: pd.Series) -> pd.Series:
    """A function call as Python source, from its name and JSON arguments."""

    def source(name: str, args: str) -> str:
        if not name.isidentifier():
            raise ValueError(name)
        return f"{name}({', '.join(f'{k}={v!r}' for k, v in json.loads(args or '{}').items())})"

    return _each(source, names, arguments)


_CALLS = T.ArrayType(T.StructType([T.StructField("function", T.StringType()), T.StructField("args", T.StringType())]))


@F.pandas_udf(_CALLS)
def parsed_calls(sources: pd.Series) -> pd.Series:
    """Calls of a Python expression or list of calls with literal keyword arguments, as names and JSON arguments."""

    def parse(source: str) -> list[dict]:
        body = ast.parse(source.strip(), mode="eval").body
        calls = body.elts if isinstance(body, ast.List | ast.Tuple) else [body]
        if not all(isinstance(c, ast.Call) and isinstance(c.func, ast.Name) and not c.args for c in calls):
            raise ValueError(source)
        return [{"function": c.func.id, "args": _compact({k.arg: ast.literal_eval(k.value) for k in c.keywords})} for c in calls]

    return _each(parse, sources)
