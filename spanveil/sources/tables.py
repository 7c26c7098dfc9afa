"""Sources and sinks: line-wise JSON, whole texts, checkpoints of predictions, frozen files, policy files."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidConfig

MAX_POLICY_BYTES = 64 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is absent a local one is set, if all runs on one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "/tmp/spanveil-shared"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan dealt over the cores where its files give fewer splits than there are cores.

    Matching costs far more than moving a text once. A scan with splits enough, as of any large table, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parse_ndjson(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(other columns, text, error) of lines that hold {"text": ...}; bad JSON and a missing text become error rows.

    A carriage return before the line end doesn't count, and blank lines are no rows.
    """
    rest = [c for c in lines.columns if c != line_col]
    line = F.regexp_replace(F.col(line_col), r"\r$", "")
    tree = F.try_parse_json(line)
    text = F.try_variant_get(tree, "$.text", "string")
    quoted = F.schema_of_variant(F.try_variant_get(tree, "$.text", "variant")) == "STRING"
    error = F.when(tree.isNull(), "invalid JSON").when(text.isNull() | ~F.coalesce(quoted, F.lit(False)), "missing text")
    return lines.where(F.trim(line) != "").select(*rest, F.when(error.isNull(), text).alias("text"), error.alias("error"))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Lines split at line feeds only, never at other Unicode line ends."""
    return parse_ndjson(spark.read.option("lineSep", "\n").text(path))


def to_ndjson(results: DataFrame) -> DataFrame:
    """(value): {"spans": [...]} or {"error": ...} per row of (spans, error)."""
    good = F.to_json(F.struct("spans"))
    return results.select(F.when(F.col("error").isNull(), good).otherwise(F.to_json(F.struct("error"))).alias("value"))


def write_ndjson(results: DataFrame, path: str) -> None:
    to_ndjson(results).write.text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file one document."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_gold(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    rows = spark.read.schema("id string, split string, text string, spans array<struct<label:string,start:int,end:int>>").json(path)
    return rows.where(F.col("split") == split) if split is not None else rows


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(idx, start, end, label, score) of a checkpoint of {"idx", "spans": [[start, end, label, score?]]}."""
    rows = spark.read.schema("idx int, spans array<array<string>>").json(path)
    s = rows.select("idx", F.explode("spans").alias("s"))
    return s.select("idx", F.get("s", F.lit(0)).cast("int").alias("start"), F.get("s", F.lit(1)).cast("int").alias("end"), F.get("s", F.lit(2)).alias("label"), F.get("s", F.lit(3)).cast("double").alias("score"))


def missing_predictions(gold: DataFrame, done: DataFrame, key: str = "idx") -> DataFrame:
    """Gold rows without a prediction row: a complete checkpoint has none."""
    return gold.join(done.select(key).distinct(), key, "left_anti")


def read_frozen(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """(line): refuses files of which one's SHA-256 isn't the given one; checked where the file is read."""
    raw = spark.read.format("binaryFile").load(path)
    same = F.sha2("content", 256) == sha256
    checked = raw.select(F.when(same, F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("changed: "), F.col("path")))).alias("t"))
    return checked.select(F.explode(F.split("t", "\n", -1)).alias("line")).where("line <> ''")


def bio_spans(tokens: DataFrame) -> DataFrame:
    """(doc_id, label, start, end) from tokens (doc_id, pos, start, end, tag): B- opens, I- of the same label goes on."""
    from pyspark.sql import Window as W

    w = W.partitionBy("doc_id").orderBy("pos")
    label = F.regexp_replace("tag", "^[BI]-", "")
    goes_on = F.col("tag").startswith("I-") & (F.regexp_replace(F.lag("tag").over(w), "^[BI]-", "") == label) & (F.lag("tag").over(w) != "O")
    runs = tokens.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w)).withColumn("label", label)
    return runs.where("tag <> 'O'").groupBy("doc_id", "_run", "label").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


class PolicyError(InvalidConfig):
    """A policy file that can't be used."""


@dataclass(frozen=True)
class Policy:
    disabled: tuple[str, ...] = ()
    cuts: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0
    hosts: dict[str, str] = field(default_factory=dict)
    replace_hosts: bool = False
    restore_tools: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        """The same for equal policies, whatever the order of their keys."""
        return hashlib.sha256(json.dumps(self.__dict__, sort_keys=True, default=list).encode()).hexdigest()[:16]


KEYS = {"disabledCategories", "categories", "categoryThresholds", "threshold", "urlAllowlist", "restoreTools"}


def load_policy(path: str, defaults: Policy, labels: set[str]) -> Policy:
    """A policy from a JSON file of at most 64 KiB; an unknown key or label is an error."""
    if os.path.getsize(path) > MAX_POLICY_BYTES:
        raise PolicyError("policy file too large")
    with open(path, encoding="utf-8") as f:
        try:
            given = json.load(f)
        except ValueError as error:
            raise PolicyError(f"not JSON: {error}") from error
    if not isinstance(given, dict) or (unknown := given.keys() - KEYS):
        raise PolicyError(f"unknown keys: {sorted(unknown)}" if isinstance(given, dict) else "not an object")
    named = {*given.get("disabledCategories", []), *given.get("categories", []), *given.get("categoryThresholds", {})}
    if named - labels:
        raise PolicyError(f"unknown labels: {sorted(named - labels)}")
    disabled = tuple(given.get("disabledCategories", defaults.disabled))
    if "categories" in given:
        disabled = tuple(sorted(labels - set(given["categories"])))
    urls = given.get("urlAllowlist", {})
    return Policy(
        disabled, {**defaults.cuts, **given.get("categoryThresholds", {})}, float(given.get("threshold", defaults.threshold)),
        urls.get("hosts", defaults.hosts), bool(urls.get("replaceDefaults", False)), tuple(given.get("restoreTools", defaults.restore_tools)),
    )
