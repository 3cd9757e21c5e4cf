"""Prediction sets, fold results, caches and submissions as keyed tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def optional_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A dimension that may be missing."""
    return spark.read.parquet(path) if exists(spark, path) else None


def save_predictions(preds: DataFrame, root: str, model: str, meta: dict) -> None:
    """Writes ``custid, split, fold, score`` (as floats) under ``root/scores/model=<model>`` and the model's
    facts, as JSON, under ``root/models/model=<model>``. A model's folder is replaced as a whole."""
    rows = preds.select("custid", "split", *(["fold"] if "fold" in preds.columns else []), F.col("score").cast("float").alias("score"))
    rows.write.mode("overwrite").parquet(f"{root}/scores/model={model}")
    preds.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True, ensure_ascii=False),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{root}/models/model={model}")


def load_predictions(spark: SparkSession, root: str, models: Sequence[str] | None = None) -> DataFrame:
    """``model, custid, split, score``; only the named models' folders are read."""
    df = spark.read.parquet(f"{root}/scores")
    return df.where(F.col("model").isin(list(models))) if models is not None else df


def list_models(spark: SparkSession, root: str, entities: int | None = None) -> list[str]:
    """The models with scores, sorted; with ``entities`` only those that have so many train scores, none
    of them null or NaN."""
    df = spark.read.parquet(f"{root}/scores")
    if entities is None:
        return sorted(r[0] for r in df.select("model").distinct().collect())
    ok = df.where("split = 'train'").groupBy("model").agg(F.countDistinct("custid").alias("n"), F.sum((F.col("score").isNull() | F.isnan("score")).cast("int")).alias("bad"))
    return sorted(r["model"] for r in ok.where((F.col("n") == entities) & (F.col("bad") == 0)).collect())


def import_predictions(scores: DataFrame, spine: DataFrame, entity: str = "custid", score: str = "score") -> tuple[DataFrame, dict]:
    """Foreign scores on the spine's entities, and an audit: missing and unknown entities, nulls, repeats.
    Scores of repeated entities are averaged; missing ones stay null."""
    one = scores.groupBy(entity).agg(F.avg(score).alias("score"), F.count("*").alias("__n"))
    out = spine.select(entity).join(one, entity, "left")
    audit = out.agg(F.sum(F.col("__n").isNull().cast("int")).alias("missing"), F.sum((F.col("__n").isNotNull() & F.col("score").isNull()).cast("int")).alias("nulls"), F.sum((F.col("__n") > 1).cast("int")).alias("repeated")).first()
    unknown = one.join(spine.select(entity), entity, "left_anti").count()
    return out.select(entity, "score"), {**{k: v or 0 for k, v in audit.asDict().items()}, "unknown": unknown}


def write_submission(preds: DataFrame, path: str, entity: str = "custid", to: str = "gender") -> None:
    """The mean test score by entity as one CSV file with a header, sorted by entity. Only for results that
    one task can write."""
    rows = preds.where("split = 'test'").groupBy(entity).agg(F.avg("score").alias(to))
    rows.coalesce(1).sortWithinPartitions(entity).write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A CSV report that spreadsheets open: UTF-8 with a byte-order mark before the header."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


#: Encodings that the CSV reader takes by itself.
READABLE = ("utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32")


def read_log(spark: SparkSession, path: str, schema: str, encoding: str = "cp949") -> DataFrame:
    """A transaction log in CSV with a header and a stated schema; nothing is inferred. Encodings that the
    reader doesn't know are read as single bytes and the strings decoded in batches; this holds for all
    in which separators, quotes and line ends stand for themselves alone, as in cp949."""
    plain = encoding.lower() in READABLE
    df = spark.read.schema(schema).option("header", True).option("encoding", encoding if plain else "iso-8859-1").csv(path)
    if plain:
        return df

    @F.pandas_udf("string")
    def decoded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x.encode("latin-1").decode(encoding, "replace") if x is not None else None)

    return df.select(*[decoded(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def union_tagged(parts: dict[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """Tables under one another with the part's name in ``tag``; columns that one lacks are null there."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def cached(spark: SparkSession, root: str, options: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes, written once under a name made of ``options``."""
    path = f"{root}/" + "_".join(f"{k}-{options[k]}" for k in sorted(options))
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class FoldStore:
    """Results of a training by fold: a fold counts as done once its folder is complete, so a run that was
    broken off goes on where it stood."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def read(self, fold: int) -> DataFrame | None:
        path = f"{self.root}/fold={fold}"
        return self.spark.read.parquet(path) if exists(self.spark, f"{path}/_SUCCESS") else None

    def write(self, fold: int, df: DataFrame) -> DataFrame:
        path = f"{self.root}/fold={fold}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def clear(self) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class TrialLog:
    """Trials of a parameter study as rows under a folder: appended, never changed, read by whoever goes on."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def add(self, study: str, params: dict, value: float) -> None:
        row = [(study, json.dumps(params, sort_keys=True), float(value))]
        self.spark.createDataFrame(row, "study string, params string, value double").coalesce(1).write.mode("append").parquet(self.root)

    def tried(self, study: str) -> list[tuple[dict, float]]:
        """All trials of a study, best first."""
        if not exists(self.spark, self.root):
            return []
        rows = self.spark.read.parquet(self.root).where(F.col("study") == study).orderBy(F.desc("value"), "params").collect()
        return [(json.loads(r["params"]), r["value"]) for r in rows]
