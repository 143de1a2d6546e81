"""Writers: instruction rows, parallel files, fan-out by language, batches of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.lineage import cut


def instruction_rows(df: DataFrame, instruction: str) -> DataFrame:
    """instruction, input, output, aligned, dataset, id; aligned falls back to tgt, dataset to 'unknown'."""
    have = lambda c, other: F.coalesce(F.col(c), other) if c in df.columns else other
    return df.select(F.lit(instruction).alias("instruction"), F.col("src").alias("input"), F.col("tgt").alias("output"), have("aligned", F.col("tgt")).alias("aligned"), have("dataset", F.lit("unknown")).alias("dataset"), F.col("id"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, limit: int = 100_000) -> None:
    """One JSON array in one file, for tables of at most ``limit`` rows; larger ones are refused."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows do not belong into one array; use write_jsonl")
    rows = F.to_json(F.collect_list(F.struct(*df.columns)))
    df.agg(rows.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.select("id", "src", "tgt", "aligned", "dataset").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parallel(df: DataFrame, path: str, key: str = "id") -> None:
    """Line i of part n of ``path/src`` belongs to line i of part n of ``path/tgt``.

    The rows are ordered once and stored; both sides are written from the stored parts.
    """
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\r\n]+", " ")
    ordered = cut(df.select(key, flat("src").alias("src"), flat("tgt").alias("tgt")).sort(key, "src", "tgt"))
    for side in ("src", "tgt"):
        ordered.select(F.col(side).alias("value")).write.mode("overwrite").text(f"{path}/{side}")


def write_by_language(df: DataFrame, path: str) -> DataFrame:
    """Files by language; returns the composition by dataset and language."""
    df.write.mode("overwrite").partitionBy("language").json(path)
    return df.groupBy("dataset", "language").agg(F.count(F.lit(1)).alias("rows"))


def filtered_projection(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """Original columns without target and alignment, then label, reasoning and aligned columns of the filters, sorted."""
    drop = {"tgt", "aligned", "aligned_sentence", "alert"}
    extra = sorted(c for c in df.columns if any(c == f"{p}_{s}" for p in prefixes for s in ("label", "reasoning", "aligned")))
    return df.select(*[c for c in df.columns if c not in drop and c not in extra], *extra)


def comparison_rows(df: DataFrame, optional: tuple[str, ...] = ("reasoning", "writing_type", "model", "total_tokens")) -> DataFrame:
    return df.select("row_id", "gold", "pred", (F.col("gold") == F.col("pred")).alias("same"), *[c for c in optional if c in df.columns])


def outcome(gold: Column, pred: Column) -> Column:
    """correct, error or fail."""
    return F.when(pred.isNull() | pred.isin("Error", "error", "nan", ""), F.lit("fail")).when(gold == pred, F.lit("correct")).otherwise(F.lit("error"))


def write_outcomes(df: DataFrame, path: str) -> None:
    df.withColumn("outcome", outcome(F.col("gold"), F.col("pred"))).write.mode("overwrite").partitionBy("outcome").parquet(path)


def batch_requests(df: DataFrame, model: str, prompt: Column) -> DataFrame:
    """One JSON line a row for a batch service: custom_id and body."""
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"))
    return df.select(F.to_json(F.struct(F.concat(F.lit("row-"), F.col("row_id")).alias("custom_id"), body.alias("body"))).alias("value"))


def write_shards(df: DataFrame, path: str, rows: int) -> None:
    """Files of at most ``rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).option("header", True).csv(path)
