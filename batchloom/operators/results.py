"""Result rows from dispatched answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.functions import responses as R
from batchloom.functions.validate import parsed_output


def generated(answers: DataFrame, endpoint: str, target: type | dict | None = None, parse_output: bool | None = None) -> DataFrame:
    """All result columns, typed. With a target the output is parsed unless told otherwise."""
    r = answers.withColumn("r", R.generation(F.col("response"), endpoint))
    rows = r.select("_index", "r.*", "error", "error_type", "call_id", "metrics", F.col("response").alias("raw_response"))
    parse = target is not None if parse_output is None else parse_output
    parsed = parsed_output(F.col("output_text"), target) if parse and target is not None else F.lit(None).cast("string")
    return rows.withColumn("output_parsed", parsed).withColumn("cost", R.cost(F.col("raw_response"))).withColumn(
        "output_tokens", F.col("token_usage.completion_tokens"),
    )


def records(answers: DataFrame, endpoint: str, parse_json: bool = False, metadata: DataFrame | None = None) -> DataFrame:
    """The columns of an output line: index, text, parsed, usage, request, finish reason, error.

    ``metadata`` (_index, metadata) is joined; rows that failed before a call have none.
    """
    rows = generated(answers, endpoint)
    parsed = F.try_parse_json("output_text") if parse_json else F.lit(None).cast("variant")
    out = rows.select(
        "_index", "output_text", parsed.alias("output_parsed"), "token_usage", "request_id", "finish_reason",
        F.when(
            F.col("request_id").isNull() & F.col("raw_response").isNull(), F.coalesce("error", F.lit("unknown error")),
        ).otherwise(F.col("error")).alias("error"),
    )
    return out if metadata is None else out.join(metadata, "_index", "left")


def embedded(answers: DataFrame, vectors: bool = True) -> DataFrame:
    v = F.try_element_at(R.embeddings(F.col("response")), F.lit(1))
    parsed = F.try_parse_json("response")
    return answers.select(
        "_index", (v if vectors else F.lit(None).cast("array<double>")).alias("embedding"),
        F.when(F.col("response").isNotNull(), F.size(v)).alias("dimensions"),
        F.try_variant_get(parsed, "$.id", "string").alias("request_id"), R.usage(parsed).alias("token_usage"), "call_id", "error",
        "metrics",
    )


def transcribed(answers: DataFrame) -> DataFrame:
    r = R.transcription(F.col("response"))
    return answers.withColumn("r", F.when(F.col("response").isNotNull(), r)).select(
        "_index", "r.text", "r.duration_s", "r.language", "r.request_id", "error", "metrics",
    )


def aligned(rows: DataFrame, n: int | None = None) -> DataFrame:
    """One row: results and errors as arrays in index order, for small batches."""
    fields = [c for c in rows.columns if c not in ("_index", "error")]
    return rows.agg(F.array_sort(F.collect_list(F.struct("_index", F.struct(*fields).alias("result"), "error"))).alias("x")).select(
        F.transform("x", lambda r: F.when(r["error"].isNull(), r["result"])).alias("results"),
        F.transform("x", lambda r: r["error"]).alias("errors"),
    )


def progress(rows: DataFrame, settled_at: str = "settled_at", index: str = "_index") -> DataFrame:
    """``completed``: the running count of settled rows in order of time, then index.

    Rows are numbered within ranges of time, cut at quantiles, and the counts of the ranges before
    are added, so that no task holds the whole log; the driver holds one number for each range.
    Rows without a time come first.
    """
    from pyspark.sql import Window

    spark = rows.sparkSession
    at = F.coalesce(F.col(settled_at).cast("double"), F.lit(float("-inf")))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(
        set(rows.select(F.col(settled_at).cast("double").alias("_at")).approxQuantile("_at", [k / n for k in range(1, n)], 0.2 / n))
    )
    marked = rows.withColumn("_part", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < at)) if cuts else F.lit(0))
    sizes = sorted((r["_part"], r["count"]) for r in marked.groupBy("_part").count().collect())
    before, total = [], 0
    for part, size in sizes:
        before.append((part, total))
        total += size
    table = F.broadcast(spark.createDataFrame(before, "_part int, _before bigint"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(at, index))
    return marked.withColumn("_own", own).join(table, "_part").withColumn(
        "completed", F.col("_own") + F.col("_before"),
    ).drop("_part", "_own", "_before")
