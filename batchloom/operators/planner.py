"""The resume planner: which source rows of a run are still to be done. All joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchloom.schemas import ERROR, PENDING
from batchloom.sources.places import PLACE

KEY = ["record_fingerprint", "occurrence"]
CHUNK = 1 << 20
SHOWN = 10


def with_occurrence(
    source: DataFrame, fingerprint: str = "record_fingerprint", index: str = "source_index", chunk: int = CHUNK,
) -> DataFrame:
    """``occurrence``: how many rows with the same fingerprint stand before this one.

    Rows are numbered within chunks of the index, so that a fingerprint with a third of all rows
    is spread over as many windows as it spans chunks; the counts of its chunks are summed.
    """
    part = F.floor(F.col(index) / chunk).cast("bigint")
    rows = source.withColumn("_chunk", part)
    local = F.row_number().over(Window.partitionBy(fingerprint, "_chunk").orderBy(index)) - 1
    counts = rows.groupBy(fingerprint, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(fingerprint).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(fingerprint, "_chunk", F.coalesce(earlier, F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_local", local).join(before, [fingerprint, "_chunk"])
    return numbered.withColumn("occurrence", (F.col("_local") + F.col("_before")).cast("int")).drop("_chunk", "_local", "_before")


def bootstrap(source: DataFrame) -> DataFrame:
    """A fresh ledger: every row pending, in source order, with its place where the source knows one."""
    place = [c for c in PLACE if c in source.columns]
    return source.select(*KEY, F.col("source_index").alias("output_index"), F.lit(PENDING).cast("tinyint").alias("status"), *place)


def current(ledger: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """The ledger with its settle log applied; of several entries for an index the latest chunk counts.

    ``settled``: output_index, status, chunk_id.
    """
    if settled is None:
        return ledger
    last = settled.groupBy("output_index").agg(F.max_by("status", "chunk_id").alias("_new"))
    return ledger.join(last, "output_index", "left").withColumn(
        "status", F.coalesce("_new", "status").cast("tinyint"),
    ).drop("_new").select(*ledger.columns)


def only_in_source(source: DataFrame, ledger: DataFrame) -> DataFrame:
    return source.join(ledger, KEY, "left_anti")


def only_in_ledger(source: DataFrame, ledger: DataFrame) -> DataFrame:
    return ledger.join(source, KEY, "left_anti")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a beyond their count in b."""
    return a.exceptAll(b)


BUCKET = 8 * 4096  # indices in a bitmap of bitmap_construct_agg


def bitmaps(rows: DataFrame, index: str) -> DataFrame:
    """bucket, bits: which indices there are, 4 KB for each 32768. Tasks combine before the shuffle."""
    at = F.col(index) + 1  # places count from 1
    return rows.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def coverage(wanted: DataFrame, found: DataFrame, wanted_index: str, found_index: str) -> DataFrame:
    """bucket, wanted, covered: how many distinct indices of each bucket ``wanted`` has, and how many of those ``found`` has.

    No join of rows: both sides become bitmaps, and those of a bucket are counted alone and together.
    """
    none = F.lit(None).cast("binary")
    both = bitmaps(wanted, wanted_index).select("bucket", F.col("bits").alias("a"), none.alias("b")).union(
        bitmaps(found, found_index).select("bucket", none.alias("a"), F.col("bits").alias("b"))
    )
    sizes = both.groupBy("bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("a")).alias("a"), F.bitmap_count(F.bitmap_or_agg("b")).alias("b"), F.bitmap_count(F.bitmap_or_agg(F.coalesce("a", "b"))).alias("all"),
    )
    return sizes.where("a > 0").select("bucket", F.col("a").alias("wanted"), (F.col("a") + F.col("b") - F.col("all")).alias("covered"))


def missing_output(ledger: DataFrame, output: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first settled indices without an output row, one more than is shown.

    Bitmaps tell the buckets that lack some; rows are compared in the first ``shown`` + 1 of those only.
    """
    done = ledger.where(F.col("status") != PENDING).select(F.col("output_index").alias("_index"))
    lacking = coverage(done, output, "_index", "_index").where("covered < wanted").orderBy("bucket").limit(shown + 1).select("bucket")
    bucket = F.bitmap_bucket_number(F.col("_index") + 1)
    near = done.withColumn("bucket", bucket).join(F.broadcast(lacking), "bucket", "left_semi").select("_index")  # shown + 1 rows
    return near.join(output.select("_index"), "_index", "left_anti").orderBy("_index").limit(shown + 1)


def todo(ledger: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Ledger rows to be done. Failed rows count as done unless retried."""
    return ledger.where(F.col("status").isin(PENDING, ERROR) if retry_errors else F.col("status") == PENDING)


def pending(source: DataFrame, ledger: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Source rows to be done, with their output index."""
    return source.join(todo(ledger, retry_errors).select(*KEY, "output_index"), KEY)


def chunked(rows: DataFrame, size: int, index: str = "output_index", bucket: int = CHUNK) -> DataFrame:
    """``chunk``: which ``size`` rows a row belongs to, in the order of ``index``, exactly.

    Rows are numbered inside buckets of the index; what stands before a bucket is the sum of a row each.
    """
    part = F.floor(F.col(index) / bucket).cast("bigint")
    counts = rows.groupBy(part.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row for each bucket
    before = counts.select("_bucket", F.coalesce(earlier, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(index)) - 1
    numbered = rows.withColumn("_bucket", part).withColumn("_local", local).join(F.broadcast(before), "_bucket")
    return numbered.withColumn("chunk", F.floor((F.col("_before") + F.col("_local")) / size).cast("int")).drop("_bucket", "_local", "_before")


def digest(rows: DataFrame, *columns: str) -> dict[str, int]:
    """A hash of a multiset of rows in one aggregation, whatever their order: their number, and sums of two hashes
    of each row. Sums of parts add up, so tasks combine before the shuffle."""
    found = rows.agg(
        F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(F.xxhash64(F.lit(k), *columns).cast("decimal(38,0)")), F.lit(0)).alias(f"sum_{k}") for k in (1, 2)),
    ).first()
    return {k: int(v) for k, v in found.asDict().items()}


class MismatchError(ValueError):
    """The source, ledger or output of a run don't belong together."""


def validate(source: DataFrame, ledger: DataFrame, output: DataFrame | None = None) -> None:
    """Raise unless source and ledger hold the same rows and the output covers what is settled.

    Equal digests prove the former without a join; joins only name what differs.
    """
    if digest(source, *KEY) != digest(ledger, *KEY):
        added = only_in_source(source, ledger).select("source_index").orderBy("source_index").limit(SHOWN + 1)
        gone = only_in_ledger(source, ledger).select("output_index").orderBy("output_index").limit(SHOWN + 1)
        raise MismatchError(
            f"the source doesn't match the ledger: rows were added ({_listed(added)}), removed ({_listed(gone)}) or changed"
        )
    if output is not None:
        validate_output(ledger, output)


def _listed(rows: DataFrame) -> str:
    found = [r[0] for r in rows.collect()]
    return ", ".join(map(str, found[:SHOWN])) + (", ..." if len(found) > SHOWN else "") or "none"


def validate_output(ledger: DataFrame, output: DataFrame) -> None:
    gone = missing_output(ledger, output)
    if not gone.isEmpty():
        raise MismatchError(f"the output lacks settled rows: {_listed(gone)}")


def unmatched_log(ledger: DataFrame, settled: DataFrame) -> DataFrame:
    """output_index and rows, of settle-log entries that don't stand for exactly one ledger row."""
    rows = ledger.groupBy("output_index").agg(F.count(F.lit(1)).alias("rows"))
    joined = settled.select("output_index").distinct().join(rows, "output_index", "left")
    return joined.withColumn("rows", F.coalesce("rows", F.lit(0))).where("rows <> 1")


def validate_log(ledger: DataFrame, settled: DataFrame | None) -> None:
    """Bitmaps prove that the log's indices are the ledger's, and counts that those are distinct; only else is it joined."""
    if settled is None:
        return
    lacking = coverage(settled, ledger, "output_index", "output_index").where("covered < wanted")
    kinds = bitmaps(ledger, "output_index").agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()[0]
    if lacking.isEmpty() and kinds == ledger.count():
        return
    if not unmatched_log(ledger, settled).isEmpty():
        raise MismatchError("the settle log names rows that the ledger doesn't hold exactly once")


def fingerprint_counts(source: DataFrame) -> DataFrame:
    """How often each fingerprint occurs."""
    return source.groupBy("record_fingerprint").agg(F.count(F.lit(1)).alias("n"))


def status_counts(ledger: DataFrame) -> DataFrame:
    """How many rows of a ledger are in each state."""
    return ledger.groupBy(F.col("status").cast("int").alias("status")).agg(F.count(F.lit(1)).alias("n"))
