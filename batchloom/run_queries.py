"""Registered queries that go through dispatch, sources, runs and streams, with DuckDB SQL beside them.

Providers are deterministic ones, whose answers and failures SQL can foretell.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.functions import ratelimit as RL
from batchloom.functions.validate import parsed_output
from batchloom.operators import planner
from batchloom.operators.dispatch import DispatchConfig, embed, generate, micro_batches, transcribe
from batchloom.operators.limits import Limits
from batchloom.operators.mapping import embedding_inputs, load_mapper, prepared
from batchloom.operators.provider import EchoProvider, ScriptedProvider, ShortProvider
from batchloom.operators.results import aligned, embedded, generated, progress, records, transcribed
from batchloom.plans import workflow
from batchloom.sources import lines, places
from batchloom.store import Folder, fresh_path, written
from batchloom.streaming import runner

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _query(sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _FOUND.items()}


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- dispatch -------------------------------------------------------------------------------

SCRIPTED = DispatchConfig("echo", ScriptedProvider, backoff_unit=0.0, default_request_kwargs={"price": 0.25})
# A row's fate under ScriptedProvider, by its number n.
_FATE = "CASE WHEN n % 7 = 0 THEN 'refused ' || n WHEN n % 3 = 1 AND n % 5 = 4 THEN 'busy ' || n END"
_TRIES = "CASE WHEN n % 7 <> 0 AND n % 3 = 1 THEN least(n % 5, 3) ELSE 0 END"


def _no_error() -> F.Column:
    return F.lit(None).cast("string").alias("error")


def _numbered(n: F.Column, text: F.Column) -> F.Column:
    return F.concat(n.cast("string"), F.lit(" "), text)


def _chat(content: F.Column) -> F.Column:
    return F.to_json(F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))))


@_query(f"""WITH d AS (SELECT doc_id AS n, doc_id || ' ' || text AS t, CASE WHEN doc_id % 17 = 0 THEN 'held back' END AS held FROM documents),
r AS (SELECT *, coalesce(held, {_FATE}) AS error FROM d)
SELECT n AS _index, CASE WHEN error IS NULL THEN t END AS output_text, error,
  CASE WHEN held IS NULL THEN CAST({_TRIES} AS INTEGER) END AS retries, CASE WHEN error IS NULL THEN 2 * length(t) END AS total_tokens,
  CASE WHEN error IS NULL THEN length(t) END AS output_tokens, CASE WHEN error IS NULL THEN length(t) * CASE WHEN n % 2 = 0 THEN 0.5 ELSE 0.25 END END AS cost,
  CASE WHEN error IS NULL THEN 'stop' END AS finish_reason, CASE WHEN held IS NULL THEN 'echo' END AS deployment,
  CASE WHEN held IS NOT NULL THEN 'ValueError' WHEN error IS NOT NULL THEN 'ProviderError' END AS error_type
FROM r""")
def dispatch_generate(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a chat request: refusals, retries, rows that failed before, options of single calls."""
    n = F.col("doc_id")
    requests = _documents(spark, sf).select(
        n.alias("_index"), _chat(_numbered(n, F.col("text"))).alias("request"), F.when(n % 17 == 0, F.lit("held back")).alias("error"), F.when(n % 2 == 0, F.lit('{"price": 0.5}')).alias("options")
    )
    answers = written(generate(requests, SCRIPTED), "answers")
    names = (
        "_index", "output_text", "error", "metrics.retries", "token_usage.total_tokens", "output_tokens", "cost", "finish_reason",
        "metrics.deployment", "error_type",
    )
    return generated(answers, "chat_completion").select(*names)


@_query("""WITH c AS (SELECT conv_id, turn, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n FROM conversations), t AS (SELECT *, n || ' ' || text AS t FROM c)
SELECT 'text_completion' AS endpoint, n AS _index, CASE WHEN n % 7 <> 0 THEN t END AS output_text, CASE WHEN n % 7 = 0 THEN 'refused ' || n END AS error, CASE WHEN n % 7 <> 0 THEN 2 * length(t) END AS total_tokens FROM t
UNION ALL SELECT 'responses', n, CASE WHEN n % 7 <> 0 THEN t END, CASE WHEN n % 7 = 0 THEN 'refused ' || n END, CASE WHEN n % 7 <> 0 THEN 2 * length(t) END FROM t""")
def dispatch_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """The text and the responses endpoint, over two deployments."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = progress(
        turns.withColumn("_at", F.col("conv_id") * 1000 + F.col("turn")), "_at", "turn",
    ).select((F.col("completed") - 1).alias("_index"), "text")
    text = _numbered(F.col("_index"), F.col("text"))
    two = tuple({"label": f"d{k}", "model": f"m{k}"} for k in range(2))
    found = None
    for endpoint, request in (
        ("text_completion", F.to_json(F.struct(text.alias("t")))), ("responses", F.to_json(F.struct(text.alias("input")))),
    ):
        body = F.regexp_replace(request, r'^\{"t":|\}$', "") if endpoint == "text_completion" else request
        config = DispatchConfig(
            "echo", functools.partial(ScriptedProvider, stumble=0), endpoint, deployments=two, routing_strategy="least-busy",
            backoff_unit=0.0,
        )
        answers = written(generate(rows.select("_index", body.alias("request"), _no_error()), config), "answers")
        own = generated(answers, endpoint).select(
            F.lit(endpoint).alias("endpoint"), "_index", "output_text", "error", "token_usage.total_tokens",
        )
        found = own if found is None else found.unionByName(own)
    return found


@_query("""WITH RECURSIVE d AS (SELECT doc_id, length(doc_id || ' ' || text) AS k, doc_id % 61 = 0 AS bad FROM documents), t AS (
  SELECT min(doc_id) AS lo, count(*) AS n, bool_or(bad) AS bad FROM d GROUP BY doc_id // 32
  UNION ALL
  SELECT s.lo, s.n, (SELECT bool_or(d.bad) FROM d WHERE d.doc_id >= s.lo AND d.doc_id < s.lo + s.n) FROM (
    SELECT unnest([lo, lo + n // 2]) AS lo, unnest([n // 2, n - n // 2]) AS n FROM t WHERE bad AND n > 1) s
), leaf AS (SELECT lo, n, bad FROM t WHERE n = 1 OR NOT bad)
SELECT doc_id AS _index, CASE WHEN NOT leaf.bad THEN 4 END AS dimensions, CASE WHEN NOT leaf.bad THEN 'e-' || lo || '-' || n END AS call_id,
  CASE WHEN NOT leaf.bad THEN sum(k) OVER (PARTITION BY lo) END AS total_tokens, CASE WHEN leaf.bad THEN 'refused ' || doc_id END AS error
FROM d JOIN leaf ON doc_id >= lo AND doc_id < lo + n""")
def dispatch_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in micro-batches of 32, halved where one of them is refused; rows of a call carry its usage."""
    texts = _documents(spark, sf).select(F.col("doc_id").alias("_index"), _numbered(F.col("doc_id"), F.col("text")).alias("text"))
    config = DispatchConfig("echo", functools.partial(ScriptedProvider, refuse=61, stumble=0), backoff_unit=0.0)
    return embedded(written(embed(texts, config), "answers")).select(
        "_index", "dimensions", "call_id", F.col("token_usage.total_tokens").alias("total_tokens"), "error",
    )


@_query("""WITH RECURSIVE d AS (SELECT doc_id, doc_id % 61 = 0 AS bad FROM documents), t AS (
  SELECT min(doc_id) AS lo, count(*) AS n, bool_or(bad) AS bad FROM d GROUP BY doc_id // 32
  UNION ALL
  SELECT s.lo, s.n, (SELECT bool_or(d.bad) FROM d WHERE d.doc_id >= s.lo AND d.doc_id < s.lo + s.n) FROM (
    SELECT unnest([lo, lo + n // 2]) AS lo, unnest([n // 2, n - n // 2]) AS n FROM t WHERE bad AND n > 1) s
), leaf AS (SELECT lo, n, bad FROM t WHERE n = 1 OR NOT bad)
SELECT doc_id AS _index, CASE WHEN NOT leaf.bad THEN 'e-' || lo || '-' || n END AS call_id,
  CASE WHEN leaf.bad THEN 'Embedding response did not contain one vector per input item.' END AS error
FROM d JOIN leaf ON doc_id >= lo AND doc_id < lo + n""")
def short_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that lack a vector count as failed, and the batch is halved down to the text at fault."""
    texts = _documents(spark, sf).select(F.col("doc_id").alias("_index"), _numbered(F.col("doc_id"), F.col("text")).alias("text"))
    return embedded(written(embed(texts, DispatchConfig("echo", ShortProvider)), "answers")).select("_index", "call_id", "error")


@_query("""SELECT strategy, (SELECT count(*) FROM pages) AS calls, used, true AS fair FROM (VALUES ('round-robin', 3), ('cost-based-routing', 1)) t(strategy, used)""")
def routed_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a call over three deployments: in turn, each gets the same in each task; by cost, the cheapest gets all."""
    requests = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("_index"), F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("url").alias("content")))).alias("request"), _no_error())
    three = tuple({"label": f"d{k}", "model": f"m{k}"} for k in range(3))
    found = None
    for strategy in ("round-robin", "cost-based-routing"):
        config = DispatchConfig("echo", EchoProvider, deployments=three, partitions=4, routing_strategy=strategy, router_kwargs={"costs": {"d0": 3.0, "d1": 1.0, "d2": 2.0}})
        n = written(generate(requests, config), "answers").groupBy("metrics.deployment").agg(F.count(F.lit(1)).alias("n"))
        own = n.agg(F.sum("n").alias("calls"), F.count(F.lit(1)).cast("int").alias("used"), (F.max("n") - F.min("n") <= 4).alias("fair"))
        own = own.select(F.lit(strategy).alias("strategy"), "calls", "used", "fair")
        found = own if found is None else found.union(own)
    return found


@_query(
    "SELECT doc_id // 32 AS batch, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY 1"
)
def embed_micro_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = micro_batches(_documents(spark, sf).withColumnRenamed("doc_id", "_index"), 32)
    chars = F.aggregate("texts", F.lit(0).cast("bigint"), lambda a, t: a + F.length(t))
    return rows.select(
        "batch", F.array_min("indices").alias("first"), F.array_max("indices").alias("last"), F.size("indices").cast("bigint").alias("n"),
        chars.alias("chars"),
    )


@_query("""SELECT page_id AS _index, CASE WHEN k <= 6000 THEN k || ' bytes' END AS text, CASE WHEN k <= 6000 THEN k / 16000.0 END AS duration_s, CASE WHEN k <= 6000 THEN 'en' END AS language,
  CASE WHEN k > 6000 THEN 'audio exceeds 6000 bytes' END AS error FROM (SELECT page_id, octet_length(encode(html)) AS k FROM pages)""")
def dispatch_transcribe(spark: SparkSession, sf: str) -> DataFrame:
    """Page bytes stand for audio; those over 6,000 bytes are error rows that make no call."""
    content = F.encode("html", "UTF-8")
    files = spark.read.parquet(f"{sf}/pages.parquet").select(
        F.col("page_id").alias("_index"), F.col("url").alias("path"), F.length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )
    answers = written(transcribe(lines.guarded(files, 6000), DispatchConfig("echo", EchoProvider)), "answers")
    return transcribed(answers).select("_index", "text", "duration_s", "language", "error")


def json_if_even(kind: str, text: str) -> str | None:
    n = int(text.split(" ", 1)[0])
    return f'{{"n": {n}}}' if n % 2 == 0 else None


@_query("""SELECT doc_id AS _index, CASE WHEN doc_id % 7 <> 0 AND doc_id % 2 = 0 THEN doc_id END AS n, CASE WHEN doc_id % 7 <> 0 THEN '{"lang":"' || lang || '"}' END AS metadata,
  CASE WHEN doc_id % 7 = 0 THEN 'refused ' || doc_id END AS error, CASE WHEN doc_id % 7 <> 0 THEN 'stop' END AS finish_reason FROM documents""")
def result_records(spark: SparkSession, sf: str) -> DataFrame:
    """Output records with parsed JSON (null where the text is none) and metadata of rows that were called."""
    docs = _documents(spark, sf)
    requests = docs.select(F.col("doc_id").alias("_index"), _chat(_numbered(F.col("doc_id"), F.col("text"))).alias("request"), _no_error())
    answers = written(
        generate(requests, DispatchConfig("echo", functools.partial(ScriptedProvider, stumble=0, rule=json_if_even))), "answers",
    )
    meta = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("_index"), F.to_json(F.struct("lang")).alias("metadata"))
    rows = records(answers, "chat_completion", True, meta)
    return rows.select("_index", F.try_variant_get("output_parsed", "$.n", "bigint").alias("n"), "metadata", "error", "finish_reason")


@_query("""SELECT count(*) AS n, count(*) FILTER (item_id % 7 = 0) AS failed, sha256(string_agg(CASE WHEN item_id % 7 <> 0 THEN item_id || ' ' || text ELSE '-' END, '|' ORDER BY item_id)) AS digest FROM benchmark""")
def aligned_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results and errors of a small batch (the benchmark's items) as arrays in index order."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.col("item_id").alias("_index"), _chat(_numbered(F.col("item_id"), F.col("text"))).alias("request"), _no_error(),
    )
    answers = written(generate(items, DispatchConfig("echo", functools.partial(ScriptedProvider, stumble=0))), "answers")
    one = aligned(generated(answers, "chat_completion").select("_index", "output_text", "error"))
    said = F.array_join(F.transform("results", lambda r: F.coalesce(r["output_text"], F.lit("-"))), "|")
    return one.select(
        F.size("results").cast("bigint").alias("n"), F.size(F.filter("errors", lambda e: e.isNotNull())).cast("bigint").alias("failed"),
        F.sha2(said, 256).alias("digest"),
    )


# --- sources and mapping ----------------------------------------------------------------------


@_query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS source_index FROM documents")
def source_index(spark: SparkSession, sf: str) -> DataFrame:
    """The gapless index of a scan; the table is in doc_id order."""
    return lines.with_index(_documents(spark, sf).select("doc_id"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("event_id") % 5, F.col("event_id").cast("string")
    odd = F.concat(F.lit('  {"k": 1.0, "b" :[true, null], "a":"\u00e9'), n, F.lit('"}\t'))
    line = F.when(k == 0, odd).when(k == 1, F.concat(F.lit("not json "), n)).when(
        k == 2, F.concat(F.lit("["), n, F.lit("]")),
    ).when(k == 3, F.lit("  \t ")).otherwise(F.col("props"))
    return spark.read.parquet(f"{sf}/events.parquet").select(line.alias("value"))


def _text_of(rows: DataFrame, label: str) -> str:
    path = fresh_path(rows.sparkSession, label)
    rows.write.text(path)
    return path


@_query("""WITH l AS (SELECT event_id % 5 AS k, event_id AS n, props FROM events WHERE event_id % 5 <> 3)
SELECT CASE k WHEN 0 THEN '{"k": 1.0, "b" :[true, null], "a":"é' || n || '"}' WHEN 1 THEN 'not json ' || n WHEN 2 THEN '[' || n || ']' ELSE props END AS raw_line,
  CASE k WHEN 1 THEN 'Expecting value: line 1 column 1 (char 0)' WHEN 2 THEN 'Generation rows must be JSON objects.' END AS parse_error,
  CASE k WHEN 0 THEN sha256('{"a":"é' || n || '","b":[true,null],"k":1.0}') WHEN 1 THEN sha256('__parse_error__not json ' || n) WHEN 2 THEN sha256('__parse_error__[' || n || ']') ELSE sha256(replace(props, ' ', '')) END AS fingerprint
FROM l""")
def strict_lines(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines with blanks around, blank, malformed and non-object lines; canonical fingerprints."""
    rows = lines.json_lines(spark, _text_of(_lines(spark, sf), "lines"))
    return rows.select("raw_line", "parse_error", F.lower(F.hex("record_fingerprint")).alias("fingerprint"))


@_query(
    "SELECT count(*) AS n, min(i) AS first, max(i) AS last, count(DISTINCT i) AS kinds FROM (SELECT row_number() OVER () - 1 AS i FROM events WHERE event_id % 5 <> 3)"
)
def line_index(spark: SparkSession, sf: str) -> DataFrame:
    """The index of non-blank lines is gapless, whatever the number of files and splits."""
    rows = lines.json_lines(spark, _text_of(_lines(spark, sf).repartition(5), "lines"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("source_index").alias("first"), F.max("source_index").alias("last"),
        F.count_distinct("source_index").alias("kinds"),
    )


@_query("""SELECT CASE event_id % 5 WHEN 0 THEN '{"k": 1.0, "b" :[true, null], "a":"é' || event_id || '"}' WHEN 1 THEN 'not json ' || event_id ELSE '[' || event_id || ']' END AS raw_line,
  event_id % 5 = 0 AS parsed FROM events WHERE event_id % 5 < 3 AND event_id % 50 < 5""")
def rows_by_place(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the lines, read again by their places in the files: only their bytes, checked by fingerprint."""
    n = F.regexp_extract("raw_line", r'(?:\u00e9|json |^\[)([0-9]+)(?:"\}|\])?$', 1).try_cast("bigint")
    scanned = lines.json_lines(spark, _text_of(_lines(spark, sf).repartition(5), "lines"))
    pending = scanned.where((n % 50 < 5) & (n % 5 < 3)).select("record_fingerprint", *places.PLACE).sortWithinPartitions(*places.PLACE)
    return places.read_places(pending).select("raw_line", F.col("record").isNotNull().alias("parsed"))


@_query("""WITH d AS (SELECT doc_id AS i, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents WHERE doc_id % 3 <> 0)
SELECT CAST(k // 70 AS INTEGER) AS chunk, count(*) AS rows, min(i) AS first, max(i) AS last FROM d GROUP BY 1""")
def chunk_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Pending rows dealt into chunks of 70 by one write; the manifest lists them."""
    rows = _documents(spark, sf).where("doc_id % 3 <> 0").select(F.col("doc_id").alias("output_index"))
    found = workflow.deal(spark, rows, 70, fresh_path(spark, "work"))
    return spark.createDataFrame([(c["chunk"], c["rows"], c["first"], c["last"]) for c in found], "chunk int, rows bigint, first bigint, last bigint")


@_query("SELECT page_id AS _index, url AS text FROM pages WHERE page_id % 3 <> 0")
def field_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts to embed: of the records, those that have the field."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    record = F.to_json(F.struct(F.when(F.col("page_id") % 3 != 0, F.col("url")).alias("text"), F.col("page_id").alias("k")))
    rows = lines.field_rows(p.select(F.col("page_id").alias("source_index"), record.alias("record")), "text")
    return rows.select("_index", F.element_at(embedding_inputs(F.array("text")), 1).alias("text"))


def example_mapper(record: dict) -> object:
    """Right for 0 and 5 of n % 6, wrong in four ways else."""
    n, text = record["n"], record["text"]
    if n % 6 == 1:
        return {"metadata": {}}
    if n % 6 == 2:
        return [text]
    if n % 6 == 3:
        raise ValueError(f"bad {n}")
    if n % 6 == 4:
        return {"input": text, "metadata": "none"}
    return {"input": text if n % 6 == 0 else [{"role": "user", "content": text}], "metadata": {"n": n} if n % 6 == 0 else None, "more": 1}


@_query("""SELECT doc_id AS source_index, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 6 IN (0, 5) THEN text END AS content, CASE WHEN doc_id % 11 <> 0 AND doc_id % 6 = 0 THEN '{"n": ' || doc_id || '}' END AS metadata,
  CASE WHEN doc_id % 11 = 0 THEN 'broken' ELSE CASE doc_id % 6 WHEN 1 THEN '"Mapper return value is missing required key ''input''"' WHEN 2 THEN 'Mapper must return a dict, got ''list''' WHEN 3 THEN 'bad ' || doc_id WHEN 4 THEN 'Mapper ''metadata'' must be a dict when provided.' END END AS error FROM documents""")
def mapper_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A user's mapper by its name; whatever it does wrong is an error row, and parse errors come first."""
    n = F.col("doc_id")
    record = F.to_json(F.struct(n.alias("n"), "text"))
    rows = _documents(spark, sf).select(
        n.alias("source_index"), F.when(n % 11 != 0, record).alias("record"), F.when(n % 11 == 0, F.lit("broken")).alias("parse_error"),
    )
    done = prepared(rows, "chat_completion", load_mapper("batchloom.run_queries:example_mapper"))
    return done.select("source_index", F.get_json_object("request", "$[0].content").alias("content"), "metadata", "error")


_SCHEMA = {
    "type": "object", "required": ["n", "lang"], "additionalProperties": False,
    "properties": {"n": {"$ref": "#/$defs/count"}, "lang": {"oneOf": [{"enum": ["en", "de"]}, {"pattern": "^f"}]}, "size": {"anyOf": [{"type": "integer", "maximum": 2000}, {"type": "null"}]}},
    "$defs": {"count": {"type": "integer", "minimum": 10, "not": {"multipleOf": 4}}},
}


@_query("""SELECT doc_id, CASE WHEN doc_id >= 10 AND doc_id % 4 <> 0 AND (lang IN ('en', 'de') OR lang LIKE 'f%') AND (doc_id % 5 = 0 OR length(text) <= 2000) AND doc_id % 9 <> 0 THEN doc_id END AS n FROM documents""")
def schema_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Output parsed against a schema with references, alternatives and bounds; null where it fails."""
    n = F.col("doc_id")
    body = F.to_json(
        F.struct(n.alias("n"), "lang", F.when(n % 5 != 0, F.length("text")).alias("size"), F.when(n % 9 == 0, F.lit(1)).alias("odd"))
    )
    return _documents(spark, sf).select("doc_id", F.get_json_object(parsed_output(body, _SCHEMA), "$.n").cast("bigint").alias("n"))


# --- runs, ledgers, streams --------------------------------------------------------------------


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    line = F.when(n % 13 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(_numbered(n, F.col("text")).alias("prompt"))))
    return _documents(spark, sf).select(line.alias("value"))


_RUN = """WITH d AS (SELECT doc_id AS n, doc_id || ' ' || text AS t, doc_id % 13 = 0 AS broken FROM documents)
SELECT CASE WHEN broken THEN NULL ELSE t END AS output_text, CASE WHEN broken THEN 'Expecting property name enclosed in double quotes: line 1 column 2 (char 1)' END AS error FROM d"""


@_query(_RUN)
def durable_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run in several chunks whose provider refuses some rows, resumed with another that answers them."""
    source, folder = _text_of(_prompts(spark, sf), "prompts"), fresh_path(spark, "run")
    size = _documents(spark, sf).count() // 3 + 1
    workflow.run(spark, workflow.RunConfig(folder, SCRIPTED, source, chunk_rows=size))
    workflow.run(
        spark, workflow.RunConfig(folder, DispatchConfig("echo", EchoProvider), source, chunk_rows=size, resume=True, retry_errors=True),
    )
    return workflow.output(spark, folder).select("output_text", "error")


@_query("""WITH d AS (SELECT doc_id AS n, doc_id % 13 = 0 AS broken FROM documents), f AS (SELECT CASE WHEN broken OR n % 7 = 0 OR n % 3 = 1 AND n % 5 = 4 THEN 2 ELSE 1 END AS status FROM d)
SELECT status, count(*) AS n FROM f GROUP BY 1""")
def run_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger's states after a run, by its settle log."""
    folder = fresh_path(spark, "run")
    workflow.run(
        spark,
        workflow.RunConfig(folder, SCRIPTED, _text_of(_prompts(spark, sf), "prompts"), chunk_rows=_documents(spark, sf).count() // 2 + 1),
    )
    ledger, log = spark.read.parquet(f"{folder}/ledger"), workflow.settled(spark, folder)
    planner.validate_log(ledger, log)
    return planner.status_counts(planner.current(ledger, log))


@_query(
    "SELECT doc_id AS output_index, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS rows FROM documents WHERE doc_id % 5 IN (0, 1) AND doc_id % 2 = 0"
)
def log_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Settle-log entries that don't stand for exactly one ledger row."""
    rows = _documents(spark, sf).select(F.col("doc_id").alias("output_index"))
    ledger = rows.where("output_index % 5 <> 1").union(rows.where("output_index % 5 = 0"))
    return planner.unmatched_log(ledger, rows.where("output_index % 2 = 0"))


@_query("""WITH d AS (SELECT doc_id AS n, doc_id % 13 = 0 AS broken FROM documents)
SELECT n AS _index, CASE WHEN broken THEN NULL WHEN n % 7 = 0 OR n % 3 = 1 AND n % 5 = 4 THEN 1 ELSE 0 END AS chunk FROM d WHERE NOT broken""")
def output_union(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier and later output of a run together: of a repeated index the later chunk's row counts."""
    folder = Folder(spark, fresh_path(spark, "run"))
    rows = _documents(spark, sf).select(F.col("doc_id").alias("_index")).where("_index % 13 <> 0")
    late = rows.where("_index % 7 = 0 or _index % 3 = 1 and _index % 5 = 4")
    for k, part in enumerate((rows, late)):
        part.withColumn("output_text", F.lit(str(k))).write.json(f"{folder.path}/output/chunk={k}")
    return workflow.output(spark, folder.path).select("_index", F.col("output_text").cast("int").alias("chunk"))


@_query("SELECT event_id, count(*) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS completed FROM events")
def progress_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("settled_at"))
    return progress(rows, index="event_id").select("event_id", "completed")


@_query(_RUN)
def stream_run(spark: SparkSession, sf: str) -> DataFrame:
    """Arriving files, dispatched in micro-batches."""
    source, target = _text_of(_prompts(spark, sf).repartition(3), "arriving"), fresh_path(spark, "stream")
    runner.run_stream(
        spark, source, f"{target}/out", f"{target}/state", DispatchConfig("echo", EchoProvider), files_per_trigger=2,
    ).awaitTermination()
    return spark.read.schema("output_text string, error string").json(f"{target}/out/batch=*")


@_query("""WITH n AS (SELECT count(*) AS n FROM documents) SELECT n AS rows, 0 AS first, n - 1 AS last, n AS kinds, true AS in_file_order FROM n""")
def stream_index(spark: SparkSession, sf: str) -> DataFrame:
    """Files of different sizes in several batches and two runs of one checkpoint: the index is gapless, and rises inside files."""
    source, target = fresh_path(spark, "arriving"), fresh_path(spark, "stream")
    docs = _documents(spark, sf)
    line = F.to_json(F.struct(_numbered(F.col("doc_id"), F.col("lang")).alias("prompt"))).alias("value")
    for late, part in ((False, docs.where("doc_id % 10 < 7")), (True, docs.where("doc_id % 10 >= 7"))):
        files = part.repartitionByRange(2 + late, (F.col("doc_id") * F.col("doc_id")).alias("size")).sortWithinPartitions("doc_id")
        files.select(line).write.mode("append").text(source)
        runner.run_stream(spark, source, f"{target}/out", f"{target}/state", DispatchConfig("echo", EchoProvider), files_per_trigger=1).awaitTermination()
    rows = spark.read.schema("_index bigint, output_text string, batch int").option("basePath", f"{target}/out").json(f"{target}/out/batch=*")
    n = F.split("output_text", " ")[0].cast("bigint")
    before = F.lag(n).over(Window.partitionBy("batch").orderBy("_index"))
    ordered = rows.select("_index", (before.isNull() | (before < n)).alias("rising"))
    return ordered.agg(
        F.count(F.lit(1)).alias("rows"), F.min("_index").cast("int").alias("first"), F.max("_index").alias("last"), F.count_distinct("_index").alias("kinds"), F.bool_and("rising").alias("in_file_order"),
    )


@_query("""WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch(ts) AS s, CAST(floor(value) % 40 AS INTEGER) AS n, CASE WHEN event_id % 3 = 0 THEN (floor(value) % 40) // 2 END AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), f AS (
  SELECT user_id, event_id, k, s, true AS admitted, 50.0 - coalesce(a, n) AS t, CASE WHEN a = 0 THEN 2.0 ELSE 1.0 END AS r FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, event_id, k, s, ok, CASE WHEN ok THEN lt - coalesce(a, n) ELSE lt END, CASE WHEN ok AND a = 0 THEN lr WHEN ok THEN lr - 1 ELSE lr END FROM (
    SELECT e.user_id, e.event_id, e.k, e.s, e.n, e.a, least(50.0, f.t + (e.s - f.s) * (10 / 60)) AS lt, least(2.0, f.r + (e.s - f.s) * (1 / 60)) AS lr,
      floor(least(50.0, f.t + (e.s - f.s) * (10 / 60))) >= e.n AND floor(least(2.0, f.r + (e.s - f.s) * (1 / 60))) >= 1 AS ok
    FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
) SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS deployment, admitted FROM f""")
def rate_limited_adjust(spark: SparkSession, sf: str) -> DataFrame:
    """A stream under a limiter with state for each key; actual usage corrects reservations, and a request that used nothing gives its slot back."""
    path, target = fresh_path(spark, "requests"), fresh_path(spark, "admitted")
    n = (F.floor("value") % 40).cast("int")
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.select(
        F.col("user_id").cast("string").alias("deployment"), F.col("event_id").alias("request_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), n.alias("tokens"),
        F.when(F.col("event_id") % 3 == 0, F.floor(n / 2).cast("int")).alias("actual"),
    ).write.parquet(path)
    arriving = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    limited = runner.limited(arriving, Limits(rpm=1, tpm=10, max_request_burst=2, max_token_burst=50))
    limited.writeStream.format("parquet").option("path", f"{target}/out").option(
        "checkpointLocation", f"{target}/state",
    ).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{target}/out").select("request_id", "deployment", "admitted")


@_query("""WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch(ts) AS s, CAST(floor(value) % 40 AS INTEGER) AS n, event_id % 4 <> 3 AS told, event_id % 2 = 0 AS minute, event_id % 50 AS left_, CASE WHEN event_id % 3 = 0 THEN 40 END AS lim,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), f AS (
  SELECT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, false AS ok, 60.0::DOUBLE AS tm, s AS am, NULL::DOUBLE AS rm, NULL::DOUBLE AS sm, 2000.0::DOUBLE AS td, s AS ad, NULL::DOUBLE AS rd, NULL::DOUBLE AS sd FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, event_id, k, ok,
    CASE WHEN ok AND told AND minute THEN least(60.0, left_) WHEN ok THEN lm - n ELSE lm END, s,
    CASE WHEN ok AND told AND minute THEN greatest(0.0, (coalesce(least(60.0, lim), 60.0) - least(60.0, left_)) / 30.0) WHEN ok AND n > 0 THEN NULL ELSE rm END,
    CASE WHEN ok AND told AND minute THEN s WHEN ok AND n > 0 THEN NULL ELSE sm END,
    CASE WHEN ok AND told AND NOT minute THEN least(2000.0, left_) WHEN ok THEN ld - n WHEN asked THEN ld ELSE td END, CASE WHEN asked THEN s ELSE ad END,
    CASE WHEN ok AND told AND NOT minute THEN greatest(0.0, (coalesce(least(2000.0, lim), 2000.0) - least(2000.0, left_)) / 600.0) WHEN ok AND n > 0 THEN NULL ELSE rd END,
    CASE WHEN ok AND told AND NOT minute THEN s WHEN ok AND n > 0 THEN NULL ELSE sd END
  FROM (SELECT *, asked AND floor(ld) >= n AS ok FROM (
    SELECT *, floor(lm) >= n AS asked FROM (
      SELECT e.*, f.rm, f.sm, f.rd, f.sd, f.td, f.ad,
        least(60.0, f.tm + (e.s - f.am) * CASE WHEN e.s - f.sm <= 60 THEN f.rm ELSE 60 / 60 END) AS lm,
        least(2000.0, f.td + (e.s - f.ad) * CASE WHEN e.s - f.sd <= 60 THEN f.rd ELSE 2000 / 86400 END) AS ld
      FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)))
) SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS deployment, ok AS admitted FROM f WHERE k > 0""")
def header_synced_limits(spark: SparkSession, sf: str) -> DataFrame:
    """A stream under limits that servers' reports replace: those of a short reset are for the minute's bucket, others for the day's."""
    path, target = fresh_path(spark, "requests"), fresh_path(spark, "admitted")
    k = F.col("event_id")
    told = lambda c: F.when(k % 4 != 3, c)
    spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").cast("string").alias("deployment"), k.alias("request_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"),
        (F.floor("value") % 40).cast("int").alias("tokens"), F.lit(None).cast("int").alias("actual"),
        told(F.when(k % 3 == 0, F.lit(40))).alias("tokens_limit"), told((k % 50).cast("int")).alias("tokens_remaining"), told(F.when(k % 2 == 0, F.lit(30.0)).otherwise(F.lit(600.0))).alias("tokens_reset"),
    ).write.parquet(path)
    arriving = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = runner.limited(arriving, Limits(rpm=1_000_000, tpm=60, tpd=2000))
    out.writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{target}/out").select("request_id", "deployment", "admitted")


@_query("""SELECT doc_id AS _index, CASE WHEN doc_id % 3 = 0 OR doc_id % 7 <> 0 THEN doc_id || ' ' || lang END AS output_text, CASE WHEN doc_id % 3 <> 0 AND doc_id % 7 = 0 THEN 'refused ' || doc_id END AS error FROM documents""")
def replayed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the rows is answered under a journal; a second run replays those answers, which its own provider would refuse, and asks for the rest."""
    n, folder = F.col("doc_id"), fresh_path(spark, "journal")
    requests = _documents(spark, sf).select(n.alias("_index"), _chat(_numbered(n, F.col("lang"))).alias("request"), _no_error())
    config = DispatchConfig("echo", EchoProvider, journal=folder)
    written(generate(requests.where("_index % 3 = 0"), config), "answers")
    again = DispatchConfig("echo", functools.partial(ScriptedProvider, stumble=0), journal=folder)
    return generated(written(generate(requests, again), "answers"), "chat_completion").select("_index", "output_text", "error")


@_query("""SELECT '{"_index":' || doc_id || ',"output_text":' || CASE WHEN doc_id % 5 = 0 THEN 'null' ELSE '"' || lang || ' é"' END || ',"n":' || length(text) || CASE WHEN doc_id % 3 = 0 THEN ',"metadata":{"k": ' || doc_id || '}' ELSE '' END || '}' AS value FROM documents""")
def exported_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Output rows as one text file of JSON lines: nulls are written, metadata as it came and only where there is some."""
    n, path = F.col("doc_id"), f"{fresh_path(spark, 'export')}/out.jsonl"
    rows = _documents(spark, sf).select(
        n.alias("_index"), F.when(n % 5 != 0, F.concat("lang", F.lit(" é"))).alias("output_text"), F.length("text").alias("n"),
        F.when(n % 3 == 0, F.concat(F.lit('{"k": '), n.cast("string"), F.lit("}"))).alias("metadata"),
    )
    workflow.put_lines(spark, workflow.as_lines(rows), path)
    return spark.read.text(path)


@_query("SELECT event_id, user_id, value FROM events WHERE event_id % 4 <> 1")
def typed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines under a schema, where a malformed line would raise."""
    rows = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 4 <> 1").select("event_id", "user_id", "value")
    types = {c: t for c, t in rows.dtypes}
    return lines.strict_json(spark, _text_of(rows.select(F.to_json(F.struct("*")).alias("value")), "typed"), ", ".join(f"{c} {t}" for c, t in types.items()))


@_query(
    "SELECT event_id, list_distinct(list_append(list_filter([1, 8, 32, 128, 512], lambda x: x <= event_id % 600 + 1), CAST(event_id % 600 + 1 AS INTEGER))).list_sort().array_to_string(',') AS sizes FROM events"
)
def batch_sweeps(spark: SparkSession, sf: str) -> DataFrame:
    sizes = RL.batch_sweep((F.col("event_id") % 600 + 1).cast("int"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.array_join(F.array_sort(sizes), ",").alias("sizes"))
