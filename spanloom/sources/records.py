"""Reading and writing record files, traces, tables and environments."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT_KEYS, TAGGER_RECORD, TRACE


def read_jsonl(spark: SparkSession, path: str, schema: str = TAGGER_RECORD) -> DataFrame:
    """JSON lines with an explicit schema and ``_corrupt_record``; blank lines are skipped. The scan splits large files."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array of objects each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_indexed_json(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Files that hold one object of index to record, as rows (file, index, record fields)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", f"map<string,struct<{record}>>").alias("m"))
    return raw.select("file", F.explode("m").alias("index", "r")).select("file", F.expr("try_cast(index as int)").alias("index"), "r.*")


def read_traces(spark: SparkSession, root: str, modified_after: str | None = None) -> DataFrame:
    """Trace files below a folder, one JSON object each, with the five keys of their paths (<pipeline>/<suite>/<user task>/<attack>/<injection task>.json).

    The keys "none" become nulls; files that don't parse have a ``_corrupt_record``. Only files at that depth are read, so
    predicates on the keys can be written as globs of ``root``.
    """
    reader = spark.read.schema(f"{TRACE}, _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    parts = F.split(F.regexp_replace("_metadata.file_path", r"\.json$", ""), "/")
    key = lambda k: F.nullif(F.element_at(parts, -k), F.lit("none"))
    names = ("path_injection_task", "path_attack", "path_user_task", "path_suite", "path_pipeline")
    return reader.json(root).withColumns({"path": F.col("_metadata.file_path"), **{n: key(k + 1) for k, n in enumerate(names)}})


def trace_events(traces: DataFrame) -> DataFrame:
    """One row per defense event of each trace; of the event lists the first that is there counts."""
    keys = [c for c in traces.columns if c not in (*EVENT_KEYS, "messages")]
    return traces.select(*keys, F.posexplode(F.coalesce(*EVENT_KEYS)).alias("event_index", "event")).select(*keys, "event_index", *(F.col(f"event.{f.name}").alias(f"event_{f.name}") for f in traces.schema[EVENT_KEYS[0]].dataType.elementType.fields))


def read_html_table(pages: DataFrame, html: str, table_id: str) -> DataFrame:
    """Cells of a table of each page as (page columns, row, col, text); a cell with a row span also stands in the rows it spans."""
    found = F.regexp_extract(F.col(html), rf'(?is)<table[^>]*\bid="{table_id}"[^>]*>(.*?)</table>', 1)
    keys = [c for c in pages.columns if c != html]
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(found, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    cells = rows.select(*keys, "row", F.posexplode(F.regexp_extract_all("tr", F.lit(r"(?is)(<t[dh][^>]*>.*?)</t[dh]>"), F.lit(1))).alias("cell", "raw"))
    span = F.coalesce(F.expr(r"""try_cast(regexp_extract(raw, '(?i)^<t[dh][^>]*rowspan="?(\\d+)', 1) as int)"""), F.lit(1))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "(?s)<[^>]+>", ""), r"\s+", " "))
    own = cells.select(*keys, "row", "cell", text.alias("text"), span.alias("span"))
    down = own.where("span > 1").select(*keys, F.explode(F.sequence(F.col("row") + 1, F.col("row") + F.col("span") - 1)).alias("row"), F.col("cell").alias("col"), "text")
    taken = down.groupBy(*keys, "row").agg(F.collect_set("col").alias("taken"))
    # A row's own cells fill the places that cells from above leave free.
    placed = own.join(taken, [*keys, "row"], "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(0), F.col("cell") + F.size("taken")), "taken")
    return placed.select(*keys, "row", F.get(free, F.col("cell")).alias("col"), "text").unionByName(down)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and an explicit schema."""
    return spark.read.csv(path, header=True, schema=schema)


def read_environment(path: str) -> dict:
    """An environment file in YAML, with ``!include`` of YAML, JSON or plain text beside it. Environments are small and read on the driver."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def include(loader: yaml.SafeLoader, node: yaml.Node) -> object:
        target = Path(path).parent / loader.construct_scalar(node)
        if target.suffix in (".yaml", ".yml"):
            return read_environment(str(target))
        return json.loads(target.read_text()) if target.suffix == ".json" else target.read_text()

    Loader.add_constructor("!include", include)
    return yaml.load(Path(path).read_text(), Loader)  # noqa: S506 - a subclass of the safe loader


def environment_table(spark: SparkSession, environment: dict, path: str, schema: str) -> DataFrame:
    """A list, or the values of a mapping, at a dotted path of an environment as a table."""
    node: object = environment
    for name in path.split("."):
        node = node[name]
    rows = list(node.values()) if isinstance(node, dict) else node
    return spark.createDataFrame([json.dumps(r, default=str) for r in rows], "string").select(F.from_json("value", schema).alias("r")).select("r.*")


def write_jsonl(records: DataFrame, path: str, ignore_null_fields: bool = False) -> None:
    """Compact JSON lines; other scripts than Latin stay as they are."""
    records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": str(ignore_null_fields).lower()}).alias("value")).write.mode("overwrite").text(path)


def write_grouped_csv(table: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header, in the order of its columns."""
    table.orderBy(*table.columns).coalesce(1).write.mode("overwrite").csv(path, header=True)


def publish(table: DataFrame, path: str) -> None:
    """Write a table beside its place and put it there in two renames. A failed write or rename leaves the old one. Between the two renames the place is empty for a
    moment, so a reader that comes just then fails and has to try again; it never sees a part of a table."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    try:
        table.write.parquet(fresh)
        if fs.exists(at(path)):
            fs.rename(at(path), at(old))
        if not fs.rename(at(fresh), at(path)):
            if fs.exists(at(old)):
                fs.rename(at(old), at(path))
            raise OSError(f"could not publish {path}")
    finally:
        for leftover in (fresh, old):
            if fs.exists(at(leftover)):
                fs.delete(at(leftover), True)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with their path relative to it, size and SHA-256. A file's content is one row, so files are limited to 2 GB each."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = fs.makeQualified(at).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # Paths come as addresses; what follows the folder's own path is the relative one.
    relative = F.expr(f"substring(path, instr(path, {_quoted(root + '/')}) + {len(root) + 1})")
    return files.select(relative.alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def folder_fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted relative paths and hashes of the files of a folder."""
    rows = fingerprint(spark, path).select("path", "sha256")
    whole = rows.agg(F.sort_array(F.collect_list(F.struct("path", "sha256"))).alias("all"))
    return whole.select(F.sha2(F.array_join(F.transform("all", lambda r: F.concat(r["path"], F.lit("\u0000"), r["sha256"])), "\u0000"), 256)).first()[0]


def markdown(table: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; more than ``most`` rows are an error."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def latex(table: DataFrame, most: int = 1000) -> str:
    """A small table as a LaTeX tabular."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else "".join("\\" + c if c in "&%$#_{}" else c for c in str(v))
    body = [" & ".join(map(cell, r)) + r" \\" for r in (table.columns, *rows)]
    return "\\begin{tabular}{" + "l" * len(table.columns) + "}\n" + "\n".join(body) + "\n\\end{tabular}\n"


def html(table: DataFrame, table_id: str, most: int = 1000) -> str:
    """A small table as an HTML table with a head row; more than ``most`` rows are an error."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    line = lambda r, tag: "<tr>" + "".join(f"<{tag}>{cell(v)}</{tag}>" for v in r) + "</tr>"
    return "\n".join([f'<table id="{table_id}">', line(table.columns, "th"), *(line(r, "td") for r in rows), "</table>"]) + "\n"


def write_pretty_json(table: DataFrame, path: str) -> None:
    """A small result as one file with an indented JSON array, in the order of its columns; other scripts stay as they are. Each row is rendered by Spark."""
    ordered = table.orderBy(*[c for c, t in table.dtypes if not t.startswith("map")]).coalesce(1)
    body = ordered.select(F.to_json(F.struct(*table.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("r"))
    body.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("r"), ",\n"), F.lit("\n]")).alias("value")).write.mode("overwrite").text(path)


def replace_file(spark: SparkSession, path: str, content: str) -> None:
    """Write a small text file under another name and rename it, so that no reader sees a part of it. An existing file is replaced."""
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh = f"{path}.new-{uuid.uuid4().hex[:8]}"
    out = fs.create(at(fresh))
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    if fs.exists(at(path)):
        fs.delete(at(path), False)
    if not fs.rename(at(fresh), at(path)):
        fs.delete(at(fresh), False)
        raise OSError(f"could not write {path}")


def copied_lines(spark: SparkSession, sources: dict[str, str], target: str) -> DataFrame:
    """Text files copied into folders below ``target`` by name, where they are there; (name, lines) of each that was."""
    jvm = spark.sparkContext._jvm
    rows = []
    for name, path in sources.items():
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            lines = spark.read.text(path)
            lines.write.mode("overwrite").text(f"{target}/{name}")
            rows.append((name, spark.read.text(f"{target}/{name}").count()))
    return spark.createDataFrame(rows, "name string, lines long")


def existing_splits(spark: SparkSession, folder: str, required: list[str], optional: list[str], ending: str = ".jsonl") -> list[str]:
    """Paths of the split files of a folder in the given order; a required one that isn't there is an error, an optional one is left out."""
    jvm = spark.sparkContext._jvm
    found = []
    for k, name in enumerate([*required, *optional]):
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}{ending}")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            found.append(f"{folder}/{name}{ending}")
        elif k < len(required):
            raise FileNotFoundError(f"{folder}/{name}{ending}")
    return found


def failure_report(failures: DataFrame, title: list[str], fields: list[str], texts: list[str], most: int = 1000) -> str:
    """Failures as Markdown: a heading of the title columns for each, its fields as a list and its texts in fences; more than ``most`` are an error."""
    rows = failures.select(*dict.fromkeys([*title, *fields, *texts])).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    say = lambda v: str(v).lower() if isinstance(v, bool) else "" if v is None else str(v)
    lines = ["# Failures", ""] + ([] if rows else ["None."])
    for r in rows:
        lines += ["## " + " | ".join(say(r[c]) for c in title), "", *(f"- {c}: {say(r[c])}" for c in fields), ""]
        for c in texts:
            lines += [f"### {c}", "", "```text", say(r[c]), "```", ""]
    return "\n".join(lines).rstrip() + "\n"


def long_cells(cells: DataFrame, keys: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide text cells as long rows of numbers; a cell that is no number is null."""
    numbers = cells.select(*keys, *(F.expr(f"try_cast(regexp_replace(trim(`{c}`), '%$', '') as double)").alias(c) for c in columns))
    return numbers.unpivot(keys, columns, name, value)


def merged_metadata(old: dict, new: dict) -> dict:
    """Nested settings with new ones laid over them; lists and values are replaced, objects merged."""
    out = dict(old)
    for k, v in new.items():
        out[k] = merged_metadata(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def environment_defaults(vectors: dict) -> dict[str, str]:
    """Default texts of injection vectors: {name: {"default": text, ...}} as {name: text}; a vector without one has an empty text."""
    return {name: str((v or {}).get("default") or "") for name, v in vectors.items()}


def filled_environment(path: str, values: dict[str, str]) -> dict:
    """An environment file with each {name} replaced in its text before it is parsed; unknown ones stay."""
    import yaml

    text = Path(path).read_text()
    for name, value in values.items():
        text = text.replace("{" + name + "}", json.dumps(value, ensure_ascii=False)[1:-1])
    return yaml.safe_load(text)


def one_trace(traces: DataFrame, pipeline: str, suite: str, user_task: str, attack: str | None, injection_task: str | None) -> DataFrame:
    """The trace of these keys; null keys match null."""
    keys = {"path_pipeline": pipeline, "path_suite": suite, "path_user_task": user_task, "path_attack": attack, "path_injection_task": injection_task}
    for name, value in keys.items():
        traces = traces.where(F.col(name).eqNullSafe(F.lit(value)))
    return traces
