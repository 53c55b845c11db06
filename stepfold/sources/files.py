"""Reading and writing samples, trajectory logs, metrics, timings, skill banks and libraries.

Schemas are explicit. A JSON document that is one array or object is one file and so one
row until it is exploded; line-delimited files, logs among them, and parquet split freely.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfold.functions.normalize import slug

# Keys a sample list may be wrapped in; folders that hold no samples.
WRAPPERS = ["data", "samples", "records"]
RESERVED = ["__pycache__", "api_timings", "eval_dumps", "eval_runs", "logs", "memory_bank", "snapshots"]

SAMPLE_FIELDS = (
    "doc_id string, question_id string, id string, benchmark_name string, problem string, question string, "
    "prompt string, solution string, answer string, images array<string>, source array<string>, category string, "
    "task string, data_source string"
)
BOM = "﻿"


def json_objects(texts: DataFrame, text: str = "value") -> DataFrame:
    """Object texts inside whole-document texts: a list, or an object holding one."""
    t = F.regexp_replace(F.trim(F.ltrim(F.regexp_replace(text, f"^{BOM}", ""))), r"^\s+", "")
    wrapped = F.from_json(t, ", ".join(f"{w} array<string>" for w in WRAPPERS))
    items = F.coalesce(
        F.when(t.startswith("["), F.from_json(t, "array<string>")), *[wrapped[w] for w in WRAPPERS], F.array(t))
    rest = [c for c in texts.columns if c != text]
    d = texts.select(*rest, F.posexplode(items).alias("item_no", "record"))
    return d.where(F.trim("record").startswith("{"))


def _unwrap(record: Column) -> Column:
    """env_kwargs, else extra_info.sample, else the record itself."""
    inner = [F.get_json_object(record, p) for p in ("$.env_kwargs", "$.extra_info.sample")]
    return F.coalesce(*[F.when(c.startswith("{"), c) for c in inner], record)


def _typed(df: DataFrame, schema: str) -> Column | None:
    """The record of each row of a typed table as a struct of ``schema``: env_kwargs where it is
    there, else extra_info.sample, else the row. Only the columns of the schema are read. None if
    a wrapper is there but is no struct."""
    target = T.StructType.fromDDL(schema)

    def record(kind: T.StructType, path: str) -> Column:
        have = {f.name for f in kind.fields}
        return F.struct(*[(F.col(f"{path}`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields])

    def child(kind: T.DataType, name: str) -> T.DataType | None:
        return next((f.dataType for f in kind.fields if f.name == name), None) if isinstance(kind, T.StructType) else None

    options = []
    for names in (["env_kwargs"], ["extra_info", "sample"]):
        kind: T.DataType | None = df.schema
        for n in names:
            kind = child(kind, n)
        if isinstance(kind, T.StructType):
            path = ".".join(f"`{n}`" for n in names)
            options.append(F.when(F.col(path).isNotNull(), record(kind, f"{path}.")))
        elif kind is not None or isinstance(child(df.schema, names[0]), (T.StringType, T.MapType)):
            return None
    return F.coalesce(*options, record(df.schema, ""))


def read_records(spark: SparkSession, paths: Sequence[str], schema: str = SAMPLE_FIELDS) -> DataFrame:
    """Records of .json, .jsonl and .parquet paths with one schema, plus source_path and
    item_no."""
    parts, ready = [], []
    for suffix in ("json", "jsonl", "parquet"):
        group = [p for p in paths if p.rstrip("/").endswith(f".{suffix}")]
        if not group:
            continue
        if suffix == "parquet":
            table = spark.read.parquet(*group)
            place = [F.col("_metadata.file_path").alias("source_path"), F.lit(0).alias("item_no")]
            typed = _typed(table, schema)
            if typed is not None:
                ready.append(table.select(typed.alias("r"), *place).select("r.*", "source_path", "item_no"))
            else:
                parts.append(table.select(F.to_json(F.struct("*")).alias("record"), *place))
            continue
        texts = spark.read.text(group, wholetext=suffix == "json").select("value", F.col("_metadata.file_path").alias("source_path"))
        parts.append(json_objects(texts).select("record", "source_path", "item_no"))
    unknown = [p for p in paths if p.rstrip("/").rsplit(".", 1)[-1] not in ("json", "jsonl", "parquet")]
    if unknown or not parts + ready:
        raise ValueError(f"unsupported record paths: {unknown or paths}")
    parsed = F.from_json(_unwrap(F.col("record")), schema)
    ready += [p.select(parsed.alias("r"), "source_path", "item_no").where("r IS NOT NULL").select("r.*", "source_path", "item_no") for p in parts]
    out = ready[0]
    for p in ready[1:]:
        out = out.unionByName(p)
    return out


def read_specs(spark: SparkSession, specs: Sequence[str], schema: str = SAMPLE_FIELDS) -> DataFrame:
    """Union of "name=path" or "path" specs; a missing benchmark_name becomes the spec's name,
    else the parent folder in lower case with underscores."""
    out = None
    for spec in specs:
        name, _, path = spec.rpartition("=")
        if not name:
            name = path.rstrip("/").split("/")[-2].lower().replace("-", "_")
        d = read_records(spark, [path], schema)
        d = d.withColumn("benchmark_name", F.coalesce(F.nullif("benchmark_name", F.lit("")), F.lit(name)))
        out = d if out is None else out.unionByName(d)
    return out


EVENT_FIELDS = (
    "turn_idx long, text_output string, error string, tool_name string, name string, doc_id string, initial_prompt string, "
    "ground_truth string, tool_call struct<tool_name:string,parameters:string,result:string>, "
    "tool_error struct<tool_name:string,error:string>"
)


def _place(root: str) -> dict[str, Column]:
    """sample_id and rollout_id from a file's path below the root; Spark's name=value folder
    names count by their value."""
    rest = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    folders = F.transform(F.slice(F.split(rest, "/"), F.lit(1), F.size(F.split(rest, "/")) - 1), lambda p: F.regexp_replace(p, "^[^=]*=", ""))
    rollouts = F.filter(folders, lambda p: p.startswith("rollout_"))
    sample = F.element_at(F.filter(folders, lambda p: ~p.startswith("rollout_")), 1)
    return {"sample_id": sample, "rollout_id": F.coalesce(F.try_element_at(rollouts, F.lit(1)), sample), "folders": folders}


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (value, path, block and others, as the text source gives them) with line_no, the
    number of the line in its file, from 1.

    A file may lie in several splits. A task numbers the lines of each split as they come; the
    splits that don't begin a file add the line counts of those before them, a small table of the
    files that were cut. Lines of whole files are never shuffled.
    """
    schema = lines.withColumn("at", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not len(batch):
                continue
            block = batch.column("block").to_numpy()
            path = batch.column("path").dictionary_encode()
            code = path.indices.to_numpy()
            new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])))
            at = np.empty(len(batch), np.int64)
            for a, b in zip(new, [*new[1:], len(batch)]):
                key = (path.dictionary[code[a]].as_py(), block[a])
                n = n if key == last else 0
                at[a:b] = np.arange(n, n + b - a)
                last, n = key, n + b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=schema.names)

    d = lines.mapInArrow(run, schema)
    counts = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.sum("n").over(w)).where("block > 0").select("path", "block", "__before")
    first = d.where("block = 0").withColumn("line_no", F.col("at") + 1)
    later = d.where("block > 0").join(before, ["path", "block"]).withColumn("line_no", F.col("at") + F.col("__before") + 1)
    return first.unionByName(later.select(first.columns)).drop("at")


def read_trajectories(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """Every event of the trajectory files below a folder, with its line number. A file is one
    rollout's log: lines, in as many splits as it fills, or one JSON array, which is one row
    until it is exploded. Bad lines are skipped, but count as lines."""
    place = {n: c.alias(n) for n, c in _place(root).items()}
    where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), *place.values()]
    scan = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, lineSep="\n").select("value", *where)
    scan = scan.where(~F.exists("folders", lambda p: p.isin(RESERVED))).drop("folders").withColumn("value", F.regexp_replace("value", f"^{BOM}", ""))
    # the driver lists all files as it is; of these, the ones that are arrays
    start = F.min_by(F.substring(F.ltrim("value"), 1, 1), F.struct("block", "__at"))
    placed = scan.withColumn("__at", F.monotonically_increasing_id())
    arrays = [r["path"] for r in placed.where(F.trim("value") != "").groupBy("path").agg(start.alias("c")).where("c = '['").select("path").collect()]
    logs = scan.where(~F.col("path").isin(arrays)) if arrays else scan
    d = numbered_lines(logs).select("sample_id", "rollout_id", (F.col("line_no") - 1).alias("line_no"), F.col("value").alias("raw"))
    if arrays:
        whole = spark.read.text(arrays, wholetext=True).select(F.regexp_replace("value", f"^{BOM}", "").alias("value"), place["sample_id"], place["rollout_id"])
        items = whole.select("sample_id", "rollout_id", F.posexplode(F.from_json(F.trim("value"), "array<string>")).alias("line_no", "raw"))
        d = d.unionByName(items.withColumn("line_no", F.col("line_no").cast("long")))
    d = d.where(F.trim("raw").startswith("{")).withColumn("e", F.from_json("raw", EVENT_FIELDS))
    d = d.where(F.try_parse_json("raw").isNotNull())
    return d.select(
        "sample_id", "rollout_id", (F.col("line_no") + 1).cast("long").alias("line_no"), "e.turn_idx", "e.text_output",
        F.coalesce("e.tool_name", "e.name", "e.tool_call.tool_name", "e.tool_error.tool_name").alias("tool_name"),
        F.col("e.tool_call.result").alias("tool_result"), F.col("e.tool_error.error").alias("tool_error"), "e.doc_id",
        "e.initial_prompt", "e.ground_truth", "raw",
    )


def read_rollout_metrics(spark: SparkSession, root: str, trajectories: DataFrame, name: str = "metrics.json") -> DataFrame:
    """One row per rollout of the trajectory list; a missing or malformed file is an error row."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    place = _place(root)
    schema = "accuracy_score string, final_answer string, ground_truth string, trajectory_score string, trajectory_analysis string"
    m = files.select("value", place["sample_id"].alias("sample_id"), place["rollout_id"].alias("rollout_id"))
    good = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    m = m.select("sample_id", "rollout_id", good.alias("__good"), F.from_json("value", schema).alias("m"))
    d = trajectories.select("sample_id", "rollout_id").distinct().join(m, ["sample_id", "rollout_id"], "left")
    score = F.when(F.col("__good"), F.col("m.accuracy_score").try_cast("double"))
    error = F.when(F.col("__good").isNull(), f"missing {name}").when(~F.col("__good"), f"{name} is not an object").otherwise("")
    return d.select("sample_id", "rollout_id", score.alias("accuracy_score"), score.isNotNull().alias("completed"), error.alias("error"),
                    *[F.when(F.col("__good"), F.col(f"m.{c}")).alias(c) for c in ("final_answer", "ground_truth", "trajectory_analysis")],
                    F.regexp_extract("rollout_id", r"(\d+)$", 1).try_cast("long").alias("rollout_idx"))


TIMING_FIELDS = (
    "timestamp string, kind string, request_kind string, endpoint string, latency_sec double, latency double, status_code int, "
    "error_type string, retry_count int, thread_id string, prompt_tokens long, completion_tokens long, total_tokens long"
)


def timing_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.to_timestamp("timestamp").alias("timestamp"), F.coalesce("kind", "request_kind", F.lit("unknown")).alias("kind"),
        F.coalesce("endpoint", F.lit("unknown")).alias("endpoint"), F.coalesce("latency_sec", "latency").alias("latency_sec"),
        "status_code", "error_type", "retry_count", "thread_id", "prompt_tokens", "completion_tokens", "total_tokens")


def read_api_timings(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return timing_columns(reader.schema(TIMING_FIELDS).json(path))


def read_metrics_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("time string, stage string, epoch long, step long, metrics map<string,double>").json(path)


_SKILL = "struct<skill_id:string,title:string,principle:string,when_to_apply:string>"
_MISTAKE = "struct<mistake_id:string,description:string,why_it_happens:string,how_to_avoid:string>"


def read_skill_bank(spark: SparkSession, path: str) -> DataFrame:
    """A bank JSON as the long skill table, missing ids, titles and texts filled in."""
    schema = (
        f"struct<general_skills:array<{_SKILL}>,task_specific_skills:map<string,array<{_SKILL}>>,"
        f"query_type_skills:map<string,array<{_SKILL}>>,common_mistakes:array<{_MISTAKE}>>"
    )
    bank = spark.read.text(path, wholetext=True).select(F.from_json(F.regexp_replace("value", f"^{BOM}", ""), schema).alias("b"))
    none = F.lit(None).cast("string")
    text = lambda c: F.coalesce(c, F.lit(""))

    def skills(d: DataFrame, kind: str, category: Column, prefix: Column) -> DataFrame:
        sid = F.coalesce("s.skill_id", F.concat(prefix, F.format_string("_%03d", F.col("i") + 1)))
        title = F.coalesce("s.title", F.initcap(F.replace(sid, F.lit("_"), F.lit(" "))))
        return d.select(F.lit(kind).alias("kind"), category.alias("category"), F.col("i").cast("long").alias("ord"), sid.alias("skill_id"),
                        title.alias("title"), text(F.col("s.principle")).alias("principle"), text(F.col("s.when_to_apply")).alias("when_to_apply"),
                        none.alias("description"), none.alias("why_it_happens"), none.alias("how_to_avoid"))

    general = skills(bank.select(F.posexplode("b.general_skills").alias("i", "s")), "general", none, F.lit("gen"))
    groups = F.map_concat(F.coalesce("b.task_specific_skills", F.create_map().cast(f"map<string,array<{_SKILL}>>")),
                          F.coalesce("b.query_type_skills", F.create_map().cast(f"map<string,array<{_SKILL}>>")))
    cats = bank.select(F.explode(groups).alias("c", "l")).select("c", F.posexplode("l").alias("i", "s"))
    task = skills(cats, "task", slug(F.col("c")), slug(F.col("c")))
    m = bank.select(F.posexplode("b.common_mistakes").alias("i", "s"))
    wrong = m.select(F.lit("mistake").alias("kind"), none.alias("category"), F.col("i").cast("long").alias("ord"),
                     F.coalesce("s.mistake_id", F.format_string("err_%03d", F.col("i") + 1)).alias("skill_id"), none.alias("title"), none.alias("principle"),
                     none.alias("when_to_apply"), text(F.col("s.description")).alias("description"), text(F.col("s.why_it_happens")).alias("why_it_happens"),
                     text(F.col("s.how_to_avoid")).alias("how_to_avoid"))
    return general.unionByName(task).unionByName(wrong)


def read_experiences(spark: SparkSession, path: str) -> DataFrame:
    """(exp_id, exp_no, text) of a library JSON, wrapped under "experiences" or bare."""
    t = spark.read.text(path, wholetext=True)
    wrapped = F.from_json(F.get_json_object("value", "$.experiences"), "map<string,string>")
    bare = F.from_json("value", "map<string,string>")
    d = t.select(F.explode(F.coalesce(wrapped, bare)).alias("exp_id", "text"))
    return d.withColumn("exp_no", F.regexp_extract("exp_id", r"^E(\d+)$", 1).try_cast("long"))


def write_experiences(df: DataFrame, path: str) -> None:
    """A library as one JSON object. The format is a single document, so the library (prompt
    material, limited by its owner) passes one task; keep large ones as tables."""
    one = df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("exp_id", "text")))).alias("experiences"))
    one.select(F.to_json(F.struct("experiences")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = (), extra: Mapping[str, object] | None = None) -> DataFrame:
    """Writes the data and a JSON manifest of its counts; returns the manifest, computed from
    the written files."""
    if fmt not in ("parquet", "jsonl"):
        raise ValueError(f"unknown format {fmt!r}")
    spark = df.sparkSession
    writer = df.write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(f"{path}/data")
        back = spark.read.parquet(f"{path}/data")
    else:
        writer.json(f"{path}/data")
        back = spark.read.schema(df.schema).json(f"{path}/data")
    manifest = back.groupBy(*by).agg(F.count(F.lit(1)).alias("records"))
    manifest = manifest.withColumn("extra", F.lit(json.dumps(dict(extra or {}), sort_keys=True)))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def write_generation_dump(df: DataFrame, path: str, *, step="step") -> None:
    """input, output, score and extra columns as JSON lines, one folder per step."""
    df.write.mode("append").partitionBy(step).json(path)

