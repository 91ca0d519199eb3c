"""Readers and writers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "src", "target", "dst", "guard", "condition", "exception_type")])
NODE = "id string, type string, ast_type string, line int, code array<string>, successors array<string>, predecessors array<string>, guard string, exception_type string, control_vars array<string>, data_vars array<string>"
GOLD = "nodes array<struct<gold_id: string, type: string, code: string>>, edges array<struct<src_gold_id: string, dst_gold_id: string, label: string>>"
MANIFEST = "uid long, base_uid long, tags array<string>, params map<string, string>, operator string, site string, applicable boolean, label string, source_file string"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Unset, only a local master gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value", "props")


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Multi-line JSON with a fixed schema; a malformed file is an error. Adds `file`."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.col("_metadata.file_path"))


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Bases and mutants of one union-typed file."""
    df = json_files(spark, path, MANIFEST)
    return df.filter("base_uid IS NULL").select("uid", "tags", "params", "source_file"), df.filter("base_uid IS NOT NULL").drop("uid", "tags", "params")


def yaml_cases(spark: SparkSession, path: str) -> DataFrame:
    """uid, tags, sequence of the test cases in YAML files (`tests`, each with `_metadata` and `expected_output.sequence`); a file is read by one task."""

    def run(batches):
        import pandas as pd
        import yaml

        for pdf in batches:
            out = []
            for text in pdf["value"]:
                for t in (yaml.safe_load(text) or {}).get("tests", []):
                    meta = t["_metadata"]
                    out.append((meta["uid"], [str(x) for x in meta.get("tags", [])], t["expected_output"]["sequence"][0]))
            yield pd.DataFrame(out, columns=["uid", "tags", "sequence"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "uid long, tags array<string>, sequence string")


def pairs(spark: SparkSession, path: str, most: int = 150) -> DataFrame:
    """name, path: the first diagrams of a directory tree in order of their paths, named by them. The cap is the feature: a bounded set of pairs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bpmn").option("recursiveFileLookup", True).load(path).select("path")
    root = path.rstrip("/").split("://")[-1].rstrip("/") + "/"
    inner = F.regexp_replace(F.element_at(F.split("path", rf"\Q{root}\E"), -1), r"\.bpmn$", "")
    return files.select(F.concat(F.lit("model_"), F.lower(F.regexp_replace(inner, "[^A-Za-z0-9_]", "_"))).alias("name"), "path").orderBy("path").limit(most)


def typed_variables(df: DataFrame, column: str) -> DataFrame:
    """program, variable, known: the variables that a control-flow JSON declares; of a type that isn't resolved as name_ANY."""
    text = lambda p, t: F.from_json(F.get_json_object(column, p), t)
    plain = df.select("program", F.explode(F.concat(F.coalesce(text("$.control_variables", "array<string>"), F.array().cast("array<string>")), F.coalesce(text("$.data_variables", "array<string>"), F.array().cast("array<string>")))).alias("variable"), F.lit(True).alias("known"))
    typed = df.select("program", F.explode(text("$.types", "map<string,string>")).alias("v", "t"))
    loose = F.col("t").isin("Any", "Union", "Unresolved")
    typed = typed.select("program", F.when(loose, F.concat("v", F.lit("_ANY"))).otherwise(F.col("v")).alias("variable"), (~loose).alias("known"))
    return plain.unionByName(typed).distinct()


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as a CSV of results that was appended to."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def code_graph(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of control-flow JSON texts, in either spelling of an edge's fields; nodes may be bare ids. df: program, column."""
    edge, node = EDGE.simpleString(), NODE
    rows = df.select("program", F.from_json(F.get_json_object(column, "$.nodes"), "array<string>").alias("_n"), F.from_json(F.get_json_object(column, "$.edges"), f"array<{edge}>").alias("_e"))
    n = rows.select("program", F.explode("_n").alias("_x")).withColumn("_p", F.from_json("_x", node))
    n = n.select("program", F.coalesce("_p.id", F.trim(F.col("_x"), F.lit('"'))).alias("id"), *[F.col(f"_p.{c.split()[0]}") for c in node.split(", ")[1:]])
    e = rows.select("program", F.explode("_e").alias("e")).select("program", F.coalesce("e.source", "e.src").alias("src"), F.coalesce("e.target", "e.dst").alias("dst"), F.coalesce("e.guard", "e.condition").alias("guard"), "e.exception_type")
    return n, e


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends rows whose key isn't there yet, and returns the table: a run that stopped goes on."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        done = None
    (df if done is None else df.join(done, key, "left_anti")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Maps, arrays and structs as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A report of a small aggregate; more rows than `most` are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report is for small tables")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
