"""Registered queries over the driver's tables, each through the operators, with DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom import run_queries
from batchloom.functions import ratelimit as RL
from batchloom.functions import responses as R
from batchloom.functions.fingerprint import text_fingerprint
from batchloom.functions.text import data_url, guess_mime, insecure_base, thinking
from batchloom.operators import bench, planner
from batchloom.operators.limits import Limits, admission, round_robin
from batchloom.operators.mapping import builtin_input, chat_messages, normalised, truthy_input
from batchloom.sources.lines import cycle

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _query(sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _FOUND.items()} | run_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _FOUND.items()} | run_queries.oracle_sql()


# --- the planner: documents as source, a ledger whose states follow from the index ----------


def _source(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return planner.with_occurrence(
        docs.select(F.col("doc_id").alias("source_index"), text_fingerprint(F.col("text")).alias("record_fingerprint"))
    )


def _ledger(source: DataFrame) -> DataFrame:
    i = F.col("output_index")
    return planner.bootstrap(source).withColumn("status", F.when(i % 7 < 3, 1).when(i % 11 == 0, 2).otherwise(0).cast("tinyint"))


_SRC = """
src AS (
  SELECT doc_id AS source_index, sha256(text) AS record_fingerprint,
         CAST(row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) - 1 AS INTEGER) AS occurrence
  FROM documents
), ledger AS (
  SELECT record_fingerprint, occurrence, source_index AS output_index,
         CASE WHEN source_index % 7 < 3 THEN 1 WHEN source_index % 11 = 0 THEN 2 ELSE 0 END AS status
  FROM src
)"""


@_query(
    f"WITH {_SRC} SELECT record_fingerprint, occurrence, source_index, output_index FROM src JOIN ledger USING (record_fingerprint, occurrence) WHERE status = 0"
)
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    source = _source(spark, sf)
    return planner.pending(source, _ledger(source)).select("record_fingerprint", "occurrence", "source_index", "output_index")


@_query(f"WITH {_SRC} SELECT record_fingerprint, occurrence, output_index FROM ledger WHERE status IN (0, 2)")
def resume_retry_errors(spark: SparkSession, sf: str) -> DataFrame:
    source = _source(spark, sf)
    return planner.pending(source, _ledger(source), retry_errors=True).select("record_fingerprint", "occurrence", "output_index")


@_query(
    "SELECT doc_id AS source_index, sha256(text) AS record_fingerprint, CAST(row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) - 1 AS INTEGER) AS occurrence FROM documents"
)
def occurrence_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf).select("source_index", "record_fingerprint", "occurrence")


@_query(
    f"WITH {_SRC} SELECT * FROM src s WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.record_fingerprint = s.record_fingerprint AND l.occurrence = s.occurrence AND l.status <> 2)"
)
def source_extra(spark: SparkSession, sf: str) -> DataFrame:
    source = _source(spark, sf)
    return planner.only_in_source(source, _ledger(source).where("status <> 2")).select("source_index", "record_fingerprint", "occurrence")


@_query(
    f"WITH {_SRC} SELECT record_fingerprint, occurrence, output_index, status FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM src s WHERE l.record_fingerprint = s.record_fingerprint AND l.occurrence = s.occurrence AND s.source_index % 5 <> 0)"
)
def ledger_extra(spark: SparkSession, sf: str) -> DataFrame:
    source = _source(spark, sf)
    return planner.only_in_ledger(source.where("source_index % 5 <> 0"), _ledger(source)).select(
        "record_fingerprint", "occurrence", "output_index", F.col("status").cast("int"),
    )


@_query("SELECT sha256(text) AS record_fingerprint FROM documents EXCEPT ALL SELECT sha256(text) FROM documents WHERE doc_id % 10 <> 0")
def multiset_difference(spark: SparkSession, sf: str) -> DataFrame:
    rows = _source(spark, sf).select("record_fingerprint", "source_index")
    return planner.multiset_difference(rows.select("record_fingerprint"), rows.where("source_index % 10 <> 0").select("record_fingerprint"))


@_query(
    f"WITH {_SRC} SELECT output_index AS _index FROM ledger l WHERE status <> 0 AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.output_index AND d.doc_id % 3 = 0) ORDER BY 1 LIMIT 11"
)
def missing_output(spark: SparkSession, sf: str) -> DataFrame:
    """The report of at most eleven missing indices; the limit is the feature."""
    source = _source(spark, sf)
    return planner.missing_output(_ledger(source), source.where("source_index % 3 = 0").select(F.col("source_index").alias("_index")))


@_query(f"""WITH {_SRC}, w AS (SELECT output_index AS i, output_index % 3 = 0 AS there FROM ledger WHERE status <> 0)
SELECT 1 + i // 32768 AS bucket, count(*) AS wanted, count(*) FILTER (there) AS covered FROM w GROUP BY 1""")
def output_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many settled indices of each bucket have an output row: bitmaps, no join."""
    source = _source(spark, sf)
    return planner.coverage(_ledger(source).where("status <> 0"), source.where("source_index % 3 = 0"), "output_index", "source_index")


@_query(f"WITH {_SRC} SELECT count(*) AS rows, true AS same_as_ledger, false AS same_without_a_row FROM src")
def source_digest(spark: SparkSession, sf: str) -> DataFrame:
    """A source in any order has its ledger's digest; one row less, and it differs."""
    source = _source(spark, sf)
    mine, ledger = planner.digest(source.repartition("occurrence"), *planner.KEY), planner.digest(_ledger(source), *planner.KEY)
    less = planner.digest(source.where(F.col("source_index") != source.agg(F.min("source_index")).first()[0]), *planner.KEY)
    return spark.createDataFrame([(mine["rows"], mine == ledger, less == ledger)], "rows bigint, same_as_ledger boolean, same_without_a_row boolean")


@_query(f"WITH {_SRC} SELECT CAST(status AS INTEGER) AS status, count(*) AS n FROM ledger GROUP BY 1")
def ledger_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return planner.status_counts(_ledger(_source(spark, sf)))


@_query("SELECT sha256(text) AS record_fingerprint, count(*) AS n FROM documents GROUP BY 1")
def fingerprint_counts(spark: SparkSession, sf: str) -> DataFrame:
    return planner.fingerprint_counts(_source(spark, sf))


@_query(f"""WITH {_SRC}, log AS (
  SELECT output_index, 1 AS s, 0 AS c FROM ledger WHERE status = 0 AND output_index % 2 = 0
  UNION ALL SELECT output_index, 2, 1 FROM ledger WHERE status = 0 AND output_index % 4 = 0
), last AS (SELECT output_index, max_by(s, c) AS s FROM log GROUP BY 1)
SELECT l.output_index, CAST(coalesce(last.s, l.status) AS INTEGER) AS status FROM ledger l LEFT JOIN last USING (output_index)""")
def settle_log(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger with a settle log of two chunks; the later chunk of an index counts."""
    ledger = _ledger(_source(spark, sf))
    open_ = ledger.where("status = 0").select("output_index")
    log = open_.where("output_index % 2 = 0").select("output_index", F.lit(1).alias("status"), F.lit(0).alias("chunk_id")).union(
        open_.where("output_index % 4 = 0").select("output_index", F.lit(2).alias("status"), F.lit(1).alias("chunk_id"))
    )
    return planner.current(ledger, log).select("output_index", F.col("status").cast("int"))


# --- mapping and normalisation ---------------------------------------------------------------


@_query(
    "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS turns, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1"
)
def chat_assembly(spark: SparkSession, sf: str) -> DataFrame:
    lists = chat_messages(spark.read.parquet(f"{sf}/conversations.parquet"), "conv_id", "turn")
    return lists.select(
        "conv_id", F.array_join("messages.role", ",").alias("roles"), F.size("messages").cast("bigint").alias("turns"),
        F.sha2(F.array_join("messages.content", "\n"), 256).alias("digest"),
    )


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Records that hold a prompt, messages or a responses input, null or absent by turn."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("k", (F.col("conv_id") + F.col("turn")) % 4)
    some = F.struct(
        F.when(F.col("k") != 3, F.when(F.col("turn") % 5 == 0, F.lit("")).otherwise(F.col("text"))).alias("prompt"),
        F.when(F.col("k") == 1, F.array(F.struct("role", F.concat("text", F.lit("!")).alias("content")))).alias("messages"),
        F.when(F.col("k") == 2, F.struct(F.col("text").alias("input"))).alias("responses_input"),
    )
    return c.select("conv_id", "turn", "role", "k", F.to_json(some).alias("record"))


_INPUT = """CASE (conv_id + turn) % 4 WHEN 2 THEN '{"input":' || to_json(text) || '}' WHEN 1 THEN '[{"content":' || to_json(text || '!') || ',"role":"' || role || '"}]' WHEN 0 THEN {empty} END"""


@_query("SELECT conv_id, turn, " + _INPUT.replace("{empty}", """CASE WHEN turn % 5 = 0 THEN '""' ELSE to_json(text) END""") + " AS input FROM conversations")
def builtin_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("conv_id", "turn", builtin_input(F.col("record")).alias("input"))


@_query("SELECT conv_id, turn, " + _INPUT.replace("{empty}", """CASE WHEN turn % 5 <> 0 THEN to_json(text) END""") + " AS input FROM conversations")
def truthy_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("conv_id", "turn", truthy_input(F.col("record")).alias("input"))


@_query("""SELECT conv_id, turn,
  CASE (conv_id + turn) % 4 WHEN 0 THEN CASE WHEN turn % 5 = 0 THEN '[{"role":"user","content":""}]' ELSE '[{"role":"user","content":' || to_json(text) || '}]' END
    WHEN 1 THEN '[{"content":' || to_json(text || '!') || ',"role":"' || role || '"}]' END AS chat,
  CASE WHEN (conv_id + turn) % 4 = 0 THEN CASE WHEN turn % 5 = 0 THEN '""' ELSE to_json(text) END END AS plain,
  CASE (conv_id + turn) % 4 WHEN 0 THEN CASE WHEN turn % 5 = 0 THEN '{"input":""}' ELSE '{"input":' || to_json(text) || '}' END WHEN 2 THEN '{"input":' || to_json(text) || '}' END AS responses,
  (conv_id + turn) % 4 IN (2, 3) AS chat_failed
FROM conversations""")
def normalised_inputs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf).withColumn("input", builtin_input(F.col("record")))
    own = lambda e: normalised(F.col("input"), e)
    return rows.select(
        "conv_id", "turn", own("chat_completion")["request"].alias("chat"), own("text_completion")["request"].alias("plain"),
        own("responses")["request"].alias("responses"), own("chat_completion")["error"].isNotNull().alias("chat_failed"),
    )


# --- response parsing -------------------------------------------------------------------------


def _thoughts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    k = (F.col("conv_id") + F.col("turn")) % 5
    wrapped = F.when(
        k == 0, F.concat(F.lit("<think> "), F.col("role"), F.lit("\nplan </think>\n\n"), t),
    ).when(k == 1, F.concat(F.lit("  \n<think>a</think> <think>b</think>\n"), t)).when(k == 2, F.concat(F.lit("so <think>x</think> "), t)).when(k == 3, F.concat(F.lit("<think>"), t)).otherwise(F.concat(F.lit("<think></think>"), t))
    return spark.read.parquet(f"{sf}/conversations.parquet").withColumn("out", wrapped)


@_query(r"""WITH w AS (
  SELECT conv_id, turn, CASE (conv_id + turn) % 5
    WHEN 0 THEN '<think> ' || role || chr(10) || 'plan </think>' || chr(10) || chr(10) || text
    WHEN 1 THEN '  ' || chr(10) || '<think>a</think> <think>b</think>' || chr(10) || text
    WHEN 2 THEN 'so <think>x</think> ' || text
    WHEN 3 THEN '<think>' || text
    ELSE '<think></think>' || text END AS t FROM conversations
), h AS (SELECT *, regexp_extract(t, '^\s*((?:<think>.*?</think>\s*)+)', 0, 's') AS head FROM w)
SELECT conv_id, turn, CASE WHEN head <> '' THEN substr(t, length(head) + 1) ELSE t END AS output_text,
  CASE WHEN head <> '' THEN array_to_string(list_transform(regexp_extract_all(head, '<think>(.*?)</think>', 1, 's'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), chr(10) || chr(10)) END AS reasoning
FROM h""")
def think_strip(spark: SparkSession, sf: str) -> DataFrame:
    return _thoughts(spark, sf).withColumn("r", thinking(F.col("out"))).select(
        "conv_id", "turn", F.col("r.text").alias("output_text"), "r.reasoning",
    )


def _chat_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Chat answers of many shapes, as JSON text: two choices, part lists, reasoning, tool calls."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("k", (F.col("conv_id") + F.col("turn")) % 4)
    n = F.length("text").cast("bigint")
    none = F.lit(None).cast("string")
    call = F.struct(
        F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"),
        F.struct(F.concat(F.lit("f_"), F.col("role")).alias("name"), F.lit('{"x":1}').alias("arguments")).alias("function"),
    )
    calls = F.when(F.col("k") == 3, F.array(call))
    plain = F.struct(
        F.struct(
            F.when(F.col("k") != 3, F.col("text")).alias("content"),
            F.when(F.col("k") == 2, F.lit(" why ")).otherwise(none).alias("reasoning_content"), calls.alias("tool_calls"),
        ).alias("message"),
        F.lit("stop").alias("finish_reason"),
    )
    parts = F.struct(
        F.struct(F.array(F.struct(F.col("role").alias("text")), F.struct(F.lit("+").alias("text"))).alias("content")).alias("message"),
        F.lit("length").alias("finish_reason"),
    )
    usage = F.struct(
        n.alias("prompt_tokens"), (n + 1).alias("completion_tokens"), (2 * n + 1).alias("total_tokens"),
        F.when(F.col("turn") % 2 == 0, F.struct((n % 7).alias("reasoning_tokens"))).alias("completion_tokens_details"),
    )
    head = [
        F.concat(F.lit("r-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.lit("m-1").alias("model"), usage.alias("usage"),
    ]
    raw = F.when(
        F.col("k") == 1, F.to_json(F.struct(*head, F.array(parts).alias("choices"))),
    ).otherwise(F.to_json(F.struct(*head, F.array(plain).alias("choices"))))
    return c.select("conv_id", "turn", raw.alias("raw"))


@_query("""SELECT conv_id, turn, 'm-1' AS model_id,
  CASE (conv_id + turn) % 4 WHEN 1 THEN role || '+' WHEN 3 THEN '' ELSE text END AS output_text,
  CASE WHEN (conv_id + turn) % 4 = 2 THEN 'why' END AS reasoning,
  CASE WHEN (conv_id + turn) % 4 = 1 THEN 'length' ELSE 'stop' END AS finish_reason,
  'r-' || conv_id || '-' || turn AS request_id FROM conversations""")
def response_parse(spark: SparkSession, sf: str) -> DataFrame:
    r = R.generation(F.col("raw"), "chat_completion")
    return _chat_answers(spark, sf).withColumn("r", r).select(
        "conv_id", "turn", "r.model_id", "r.output_text", "r.reasoning", "r.finish_reason", "r.request_id",
    )


@_query("""SELECT conv_id, turn, length(text) AS prompt_tokens, length(text) + 1 AS completion_tokens, 2 * length(text) + 1 AS total_tokens,
  CASE WHEN turn % 2 = 0 THEN length(text) % 7 ELSE -1 END AS reasoning_tokens FROM conversations""")
def usage_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return _chat_answers(spark, sf).withColumn("u", R.usage(F.try_parse_json("raw"))).select(
        "conv_id", "turn", "u.prompt_tokens", "u.completion_tokens", "u.total_tokens",
        F.coalesce("u.reasoning_tokens", F.lit(-1)).alias("reasoning_tokens"),
    )


@_query("""SELECT conv_id, turn, 'c' || turn AS id, 'f_' || role AS name, '{"x":1}' AS arguments FROM conversations WHERE (conv_id + turn) % 4 = 3""")
def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    r = R.generation(F.col("raw"), "chat_completion")
    return _chat_answers(spark, sf).select("conv_id", "turn", F.explode(r["tool_calls"]).alias("t")).select("conv_id", "turn", "t.*")


@_query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || role ELSE text END AS output_text, CAST(turn % 2 AS INTEGER) AS calls,
  CASE WHEN turn % 2 = 1 THEN role END AS first_call, length(text) AS prompt_tokens, turn % 5 AS reasoning_tokens FROM conversations""")
def responses_parse(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    none = F.lit(None).cast("string")
    part = lambda t: F.struct(F.lit("output_text").alias("type"), t.alias("text"))
    empty = F.array().cast("array<struct<type:string,text:string>>")
    message = F.struct(
        F.lit("message").alias("type"),
        F.when(
            F.col("turn") % 3 == 0, F.array(part(F.col("text")), part(F.col("role"))),
        ).otherwise(F.array(part(F.col("text")))).alias("content"),
        none.alias("id"), none.alias("name"), none.alias("arguments"),
    )
    call = F.struct(
        F.lit("function_call").alias("type"), empty.alias("content"), F.lit("i").alias("id"), F.col("role").alias("name"),
        F.lit("{}").alias("arguments"),
    )
    n = F.length("text").cast("bigint")
    usage = F.struct(
        n.alias("input_tokens"), n.alias("output_tokens"), (2 * n).alias("total_tokens"),
        F.struct((F.col("turn") % 5).alias("reasoning_tokens")).alias("output_tokens_details"),
    )
    raw = F.to_json(
        F.struct(F.when(F.col("turn") % 2 == 1, F.array(message, call)).otherwise(F.array(message)).alias("output"), usage.alias("usage"))
    )
    r = c.select("conv_id", "turn", R.generation(raw, "responses").alias("r"))
    return r.select(
        "conv_id", "turn", "r.output_text", F.when(F.col("r.tool_calls").isNull(), 0).otherwise(F.size("r.tool_calls")).alias("calls"),
        F.try_element_at(F.col("r.tool_calls.name"), F.lit(1)).alias("first_call"), "r.token_usage.prompt_tokens",
        "r.token_usage.reasoning_tokens",
    )


@_query(
    "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'd' || user_id % 3 WHEN user_id % 3 = 1 THEN 'http://b' END AS deployment, CAST(floor(value) AS BIGINT) AS total_tokens, CASE WHEN event_id % 2 = 0 THEN event_type END AS remaining FROM events"
)
def deployment_labels(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.col("user_id") % 3
    hidden = F.struct(
        F.when(k == 0, F.concat(F.lit("d"), k.cast("string"))).otherwise(F.when(k == 1, F.lit(""))).alias("deployment"),
        F.when(k == 1, F.lit("http://b")).alias("api_base"),
    )
    raw = F.to_json(
        F.struct(
            hidden.alias("_hidden_params"), F.struct(F.floor("value").alias("total_tokens")).alias("usage"),
            F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("x-r"), F.col("event_type"))).alias("headers"),
        )
    )
    return e.select(
        "event_id", R.deployment(raw).alias("deployment"), R.total_usage(raw).alias("total_tokens"),
        F.try_element_at(R.response_headers(raw), F.lit("x-r")).alias("remaining"),
    )


@_query(
    "SELECT vec_id, len(embedding) AS dimensions, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings"
)
def embedding_responses(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each vector of embedding answers of 32 inputs each."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
    )
    calls = e.groupBy(F.floor(F.col("vec_id") / 32).alias("batch")).agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("r")
    )
    raw = calls.select(
        F.col("r.vec_id").alias("ids"),
        F.to_json(F.struct(F.transform("r", lambda x: F.struct(x["embedding"].alias("embedding"))).alias("data"))).alias("raw"),
    )
    rows = raw.select("ids", F.posexplode(R.embeddings(F.col("raw"))).alias("p", "v"))
    return rows.select(
        F.element_at("ids", F.col("p") + 1).alias("vec_id"), F.size("v").cast("bigint").alias("dimensions"),
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@_query(
    "SELECT page_id, url AS text, CAST(length(html) / 10.0 AS DOUBLE) AS duration_s, CASE WHEN page_id % 2 = 0 THEN 'en' END AS language FROM pages"
)
def transcription_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/pages.parquet")
    raw = F.to_json(
        F.struct(
            F.col("url").alias("text"), (F.length("html") / 10.0).alias("duration"),
            F.when(F.col("page_id") % 2 == 0, F.lit("en")).alias("language"),
        )
    )
    return p.select("page_id", R.transcription(raw).alias("r")).select("page_id", "r.text", "r.duration_s", "r.language")


@_query("SELECT page_id, 'data:image/png;base64,' || base64(encode(html)) AS url FROM pages")
def image_urls(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select(
        "page_id",
        F.regexp_replace(data_url(F.encode("html", "UTF-8"), guess_mime(F.concat("url", F.lit(".PNG")))), r"\r\n", "").alias("url"),
    )


@_query("""SELECT page_id, regexp_matches(lower(u), '^http://') AND lower(regexp_extract(u, '^[A-Za-z]+://([^/:?#]*)', 1)) NOT IN ('localhost', '127.0.0.1', '0.0.0.0') AS insecure
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, 'https://', 'http://') WHEN 1 THEN 'http://localhost:8000/v1' WHEN 2 THEN 'HTTP://127.0.0.1/x' ELSE 'https://h.example.com/' END AS u FROM pages)""")
def insecure_bases(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 4
    u = F.when(
        k == 0, F.replace(F.col("url"), F.lit("https://"), F.lit("http://")),
    ).when(k == 1, F.lit("http://localhost:8000/v1")).when(k == 2, F.lit("HTTP://127.0.0.1/x")).otherwise(F.lit("https://h.example.com/"))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", insecure_base(u).alias("insecure"))


# --- embedding micro-batches, bench -------------------------------------------------------------


def _log(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    ok = F.col("event_type") != "error"
    k = (F.col("event_id") % 6).cast("int")
    t = lambda d: F.when(ok, F.col("value") / d)
    n = lambda f: F.when(ok, F.floor(F.col("value") * f)).otherwise(F.lit(0))
    return e.select(
        k.alias("position"), F.pow(F.lit(2.0), k).cast("int").alias("level"), (~ok & (k % 2 == 1)).alias("failed"),
        t(100).alias("end_to_end_s"), t(200).alias("service_time_s"), t(400).alias("queue_wait_s"),
        F.when(
            F.col("user_id") % 4 != 3, F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string")),
        ).otherwise(F.lit("")).alias("deployment"),
        n(1).alias("prompt_tokens"), n(2).alias("output_tokens"), n(3).alias("total_tokens"),
    )


_LOG = """
log AS (
  SELECT CAST(event_id % 6 AS INTEGER) AS position, CAST(1 << CAST(event_id % 6 AS INTEGER) AS INTEGER) AS level,
    event_type = 'error' AND event_id % 2 = 1 AS failed,
    CASE WHEN event_type <> 'error' THEN value / 100 END AS e, CASE WHEN event_type <> 'error' THEN value / 200 END AS s, CASE WHEN event_type <> 'error' THEN value / 400 END AS q,
    CASE WHEN user_id % 4 <> 3 THEN 'd' || user_id % 4 ELSE '' END AS deployment,
    CASE WHEN event_type <> 'error' THEN floor(value) ELSE 0 END AS p, CASE WHEN event_type <> 'error' THEN floor(value * 2) ELSE 0 END AS o, CASE WHEN event_type <> 'error' THEN floor(value * 3) ELSE 0 END AS t
  FROM events
), took AS (SELECT level, max(position) AS position, count(*) / 8.0 / level AS elapsed_s FROM log GROUP BY level),
rates AS (
  SELECT level, any_value(took.position) AS position, count(*) AS total_submitted, count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failures,
    count(*) FILTER (NOT failed) / any_value(elapsed_s) AS requests_per_second, coalesce(sum(o) FILTER (NOT failed), 0) / any_value(elapsed_s) AS output_tokens_per_second
  FROM log JOIN took USING (level) GROUP BY level
)"""


def _elapsed(log: DataFrame) -> DataFrame:
    return log.groupBy("level").agg((F.count(F.lit(1)) / F.lit(8.0) / F.col("level")).alias("elapsed_s"))


_STATS = ", ".join(
    f"round(coalesce(quantile_cont({c}, {p / 100}), 0), 6) AS p{p}_{n}"
    for n, c in (("latency_s", "e"), ("service_time_s", "s"), ("queue_wait_s", "q"))
    for p in (50, 95, 99)
)


@_query(f"""WITH {_LOG} SELECT level, count(*) AS total_submitted, count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failures,
  round(count(*) FILTER (NOT failed) / any_value(elapsed_s), 6) AS requests_per_second, {_STATS},
  round(sum(p) FILTER (NOT failed) / any_value(elapsed_s), 4) AS prompt_tokens_per_second, round(sum(o) FILTER (NOT failed) / any_value(elapsed_s), 4) AS output_tokens_per_second
FROM log JOIN took USING (level) GROUP BY level""")
def bench_summary_by_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """The same summary, percentiles by ranks."""
    log = _log(spark, sf)
    found = bench.summary(log, _elapsed(log), by_ranks=True)
    stats = [F.round(c, 6).alias(c) for c in found.columns if c.startswith("p") and c[1].isdigit()]
    return found.select(
        "level", "total_submitted", "succeeded", "failures", F.round("requests_per_second", 6).alias("requests_per_second"), *stats,
        F.round("prompt_tokens_per_second", 4).alias("prompt_tokens_per_second"),
        F.round("output_tokens_per_second", 4).alias("output_tokens_per_second"),
    )


@_query(f"""WITH {_LOG} SELECT level, count(*) AS total_submitted, count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failures,
  round(count(*) FILTER (NOT failed) / any_value(elapsed_s), 6) AS requests_per_second, {_STATS},
  round(sum(p) FILTER (NOT failed) / any_value(elapsed_s), 4) AS prompt_tokens_per_second, round(sum(o) FILTER (NOT failed) / any_value(elapsed_s), 4) AS output_tokens_per_second
FROM log JOIN took USING (level) GROUP BY level""")
def bench_summary(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    found = bench.summary(log, _elapsed(log))
    stats = [F.round(c, 6).alias(c) for c in found.columns if c.startswith("p") and c[1].isdigit()]
    return found.select(
        "level", "total_submitted", "succeeded", "failures", F.round("requests_per_second", 6).alias("requests_per_second"), *stats,
        F.round("prompt_tokens_per_second", 4).alias("prompt_tokens_per_second"),
        F.round("output_tokens_per_second", 4).alias("output_tokens_per_second"),
    )


@_query(f"""WITH {_LOG}, best AS (SELECT max(output_tokens_per_second) FILTER (failures = 0) AS b FROM rates)
SELECT min_by(level, position) FILTER (failures = 0 AND output_tokens_per_second >= 0.95 * b) AS recommended, 'output_tok/s' AS metric,
  coalesce(min_by(level, position) FILTER (failures = 0 AND output_tokens_per_second >= 0.95 * b) = max_by(level, position), false) AS still_rising
FROM rates, best""")
def bench_recommend(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    levels = bench.summary(log, _elapsed(log)).withColumn("position", F.log2("level").cast("int"))
    return bench.recommend(levels)


@_query(f"""WITH {_LOG} SELECT max_by(level, requests_per_second) FILTER (failures = 0) AS recommended,
  max_by(level, requests_per_second) FILTER (failures = 0) = max_by(level, position) AND count(*) > 1 AS still_rising FROM rates""")
def embed_recommend(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    levels = bench.summary(log, _elapsed(log)).withColumn("position", F.log2("level").cast("int")).withColumn(
        "vectors_per_second", F.col("requests_per_second"),
    )
    return bench.recommend_embed(levels)


@_query(f"WITH {_LOG} SELECT level, deployment, count(*) AS n FROM log WHERE NOT failed AND deployment <> '' GROUP BY ALL")
def deployment_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return bench.deployment_histogram(_log(spark, sf))


@_query("""WITH r AS (SELECT vec_id % 4 AS level, 'e-' || CAST(floor(vec_id / 32) AS BIGINT) AS call_id, label = 0 AS failed, CAST(floor(vec_id / 32) AS BIGINT) + 7 AS tokens FROM embeddings),
c AS (SELECT level, call_id, any_value(tokens) AS tokens FROM r WHERE NOT failed GROUP BY ALL)
SELECT r.level, r.n AS total_submitted, r.n - r.f AS succeeded, r.f AS failures, coalesce(c.k, 0) AS calls, CAST(coalesce(c.t, 0) AS BIGINT) AS total_tokens
FROM (SELECT level, count(*) AS n, count(*) FILTER (failed) AS f FROM r GROUP BY 1) r LEFT JOIN (SELECT level, count(*) AS k, sum(tokens) AS t FROM c GROUP BY 1) c USING (level)""")
def request_dedupe_tokens(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    batch = F.floor(F.col("vec_id") / 32)
    rows = e.select(
        (F.col("vec_id") % 4).alias("level"), F.concat(F.lit("e-"), batch.cast("string")).alias("call_id"),
        (F.col("label") == 0).alias("failed"), (batch + 7).alias("total_tokens"),
    )
    return bench.embed_calls(rows)


@_query("SELECT event_id, event_id % 3 AS target FROM events")
def round_robin_targets(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", round_robin("event_id", 3).alias("target"))


@_query(
    "SELECT t AS _index, item_id, length(b.text) AS n_chars FROM range(500) r(t) JOIN (SELECT *, (SELECT count(*) FROM benchmark) AS c, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark) b ON t % c = k"
)
def cyclic_workload(spark: SparkSession, sf: str) -> DataFrame:
    """A workload of 500 requests from the benchmark's items in turn; the number is the feature."""
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = b.withColumn("_index", (F.row_number().over(Window.orderBy("item_id")) - 1).cast("bigint"))
    return cycle(rows, 500).select("_index", "item_id", F.length("text").cast("bigint").alias("n_chars"))


# --- limits -------------------------------------------------------------------------------------


@_query(
    "SELECT event_id, least(pow(2.0, event_id % 9), 60.0) AS backoff, CASE WHEN user_id % 2 = 0 THEN least(greatest(value, 0.0), 60.0) ELSE least(pow(2.0, event_id % 9), 60.0) END AS asked FROM events"
)
def retry_backoff(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("event_id") % 9
    header = F.when(F.col("user_id") % 2 == 0, F.col("value").cast("string")).otherwise(F.lit("Wed, 21 Oct 2015 07:28:00 GMT"))
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", RL.retry_delay(a, jitter=F.lit(0.0)).alias("backoff"), RL.retry_delay(a, header, F.lit(0.0)).alias("asked"),
    )


@_query("""WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch(ts) AS s, CAST(floor(value) % 40 AS INTEGER) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), f AS (
  SELECT user_id, event_id, k, s, n <= 50 AND 50.0 >= n AS admitted, CASE WHEN 50.0 >= n THEN 50.0 - n ELSE 50.0 END AS t, CASE WHEN 50.0 >= n THEN 1.0 ELSE 2.0 END AS r FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, event_id, k, s, ok, CASE WHEN ok THEN lt - n ELSE lt END, CASE WHEN ok THEN lr - 1 ELSE lr END FROM (
    SELECT e.user_id, e.event_id, e.k, e.s, e.n, least(50.0, f.t + (e.s - f.s) * (10 / 60)) AS lt, least(2.0, f.r + (e.s - f.s) * (1 / 60)) AS lr,
      floor(least(50.0, f.t + (e.s - f.s) * (10 / 60))) >= e.n AND floor(least(2.0, f.r + (e.s - f.s) * (1 / 60))) >= 1 AS ok
    FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
) SELECT event_id, user_id, admitted FROM f""")
def token_bucket_admission(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = e.select(
        "event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"),
        (F.floor("value") % 40).cast("int").alias("tokens"),
    )
    return admission(
        rows, "user_id", "seconds", "tokens", Limits(rpm=1, tpm=10, max_request_burst=2, max_token_burst=50),
    ).select("event_id", "user_id", "admitted")


@_query("""SELECT event_id, least(100.0, value + (event_id % 50) * 1.5) AS level, floor(value) AS whole,
  CASE WHEN 80 - floor(value) <= 0 THEN 0.0 ELSE (80 - floor(value)) / 1.5 + 1e-9 END AS wait FROM events""")
def bucket_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(
        "event_id", RL.bucket_refill(F.col("value"), (F.col("event_id") % 50).cast("double"), F.lit(1.5), F.lit(100.0)).alias("level"),
        F.floor("value").cast("double").alias("whole"), RL.refill_wait(F.lit(80), F.col("value"), F.lit(1.5)).alias("wait"),
    )


@_query("""SELECT event_id, round(CASE event_id % 8 WHEN 0 THEN n WHEN 1 THEN n + 0.5 WHEN 2 THEN m / 1000.0 WHEN 3 THEN n * 60 + m % 60 WHEN 4 THEN n * 3600 WHEN 7 THEN m END::DOUBLE, 6) AS seconds
FROM (SELECT event_id, event_id % 60 AS n, event_id % 1000 AS m FROM events)""")
def reset_header_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Resets as headers of every form hold them: seconds, durations, epochs, and two that are none."""
    n, m = (F.col("event_id") % 60).cast("string"), F.col("event_id") % 1000
    forms = (
        n, F.concat(n, F.lit(".5")), F.concat(m.cast("string"), F.lit("ms")), F.concat(n, F.lit("m"), (m % 60).cast("string"), F.lit("s")), F.concat(n, F.lit("h")),
        F.concat(n, F.lit(" h")), F.concat(F.lit("x"), n), (m + 2_000_000_000).cast("string"),
    )
    header = F.element_at(F.array(*forms), (F.col("event_id") % 8 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf}/events.parquet")
    return rows.select("event_id", F.round(RL.reset_seconds(header, F.lit(2_000_000_000.0)), 6).alias("seconds"))


@_query(
    "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id ELSE -1 END AS requests_remaining, CAST(100 AS BIGINT) AS tokens_limit, CAST(user_id AS DOUBLE) AS requests_reset FROM events"
)
def rate_header_fields(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    h = F.create_map(
        F.lit("X-RateLimit-Remaining-Requests"),
        F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string")).otherwise(F.lit("many")), F.lit("x-ratelimit-limit-tokens"),
        F.lit("100"), F.lit("LLM-x-ratelimit-reset-requests"), F.concat(F.col("user_id").cast("string"), F.lit("s")),
    )
    return e.select("event_id", RL.rate_headers(h, F.lit(2e9)).alias("h")).select(
        "event_id", F.coalesce("h.requests_remaining", F.lit(-1)).alias("requests_remaining"), "h.tokens_limit", "h.requests_reset",
    )


@_query("""SELECT event_id, list_distinct(list_append(list_transform(range(CAST(floor(log2(event_id % 70 + 1)) AS BIGINT) + 1), lambda k: CAST(1 << CAST(k AS INTEGER) AS INTEGER)), CAST(event_id % 70 + 1 AS INTEGER))).list_sort().list_transform(lambda x: x::VARCHAR).array_to_string(',') AS levels FROM events""")
def sweep_levels(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", F.array_join(F.array_sort(RL.sweep_levels((F.col("event_id") % 70 + 1).cast("int"))), ",").alias("levels"))


@_query(
    "SELECT conv_id, turn, CAST(floor(length(text) / 4) + 1 + turn AS BIGINT) AS estimate, CASE WHEN turn % 2 = 0 THEN turn ELSE 9 END AS most FROM conversations"
)
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    kwargs = F.when(
        F.col("turn") % 2 == 0, F.create_map(F.lit("max_tokens"), F.col("turn").cast("string")),
    ).otherwise(F.create_map(F.lit("max_completion_tokens"), F.lit("9")))
    return c.select(
        "conv_id", "turn", RL.token_estimate(F.col("text"), F.col("turn")).alias("estimate"),
        RL.output_limit(kwargs, F.lit("chat_completion")).alias("most"),
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Pending rows, mapped to requests, dispatched to a deterministic provider and parsed."""
    from batchloom.operators.dispatch import DispatchConfig, generate
    from batchloom.operators.provider import EchoProvider
    from batchloom.operators.results import generated

    source = _source(spark, sf)
    todo = planner.pending(source, _ledger(source)).join(
        spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("source_index"), "text"), "source_index",
    )
    requests = todo.select(
        F.col("output_index").alias("_index"),
        F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))).alias("request"),
        F.lit(None).cast("string").alias("error"),
    )
    return generated(generate(requests, DispatchConfig("echo", EchoProvider)), "chat_completion").select(
        "_index", "output_text", "token_usage", "finish_reason", "request_id", "error",
    )
