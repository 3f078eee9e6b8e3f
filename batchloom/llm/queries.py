"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm.packing import PackConfig, pack

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), PackConfig(_tokenizer("byte_bpe_50k.json")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm.pieces import encode_and_decode

    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer("piece_bpe_32k.model"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm.simhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm.linededup import LineConfig, without_copies

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_copies(docs.select("doc_id", "text"), LineConfig(), report="deleted")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm.tokenfile import TokenFileConfig, token_file_digest

    return token_file_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), TokenFileConfig(_tokenizer("byte_bpe_50k.json")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm.tokencounts import token_counts

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm.toxicity import held_out, learn, scored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, index).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "evidence")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm.pii import find

    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm.editprint import with_edits

    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm.topk import top_k

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors.where("vec_id % 100 = 0"), vectors)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm.quality import held_out, learn, scored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    network = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, network).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm.variants import variants

    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batchloom.llm.phrases import collocations

    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

# crc32 byte by byte, by the table of remainders; near words by their texts less one letter.
OP12_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents WHERE doc_id IS NOT NULL
  ) WHERE length(run) >= 7 GROUP BY ALL
), spelt AS (
  SELECT run, n, hex(encode(doc_id || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x), 2), lambda i: CAST('0x' || x[i + 1:i + 2] AS BIGINT))),
    lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM spelt, crc
), edited AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), d AS (
  SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)
), near AS (
  SELECT a.word, b.word AS near FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word
), ranked AS (
  SELECT near.word, near.near, w.n, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near.near) AS r, count(*) OVER (PARTITION BY near.word) AS n_near
  FROM near JOIN w ON w.word = near.near
), named AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN r.near END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
  FROM w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1
), ways AS (
  SELECT word, word AS root, 0 AS step FROM named
  UNION ALL SELECT ways.word, named.form, step + 1 FROM ways JOIN named ON named.word = ways.root WHERE named.form IS NOT NULL
)
SELECT named.word, named.form, (SELECT arg_max(ways.root, ways.step) FROM ways WHERE ways.word = named.word) AS root, named.n, named.n_near, named.form_n FROM named
"""

OP13_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
), held AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM held, range(1, 6) sizes(size))
), f AS (
  SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), c AS (
  SELECT * FROM f WHERE size > 1 AND a >= 100
), kept AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c x WHERE x.lang = c.lang AND x.size > c.size AND 100 * x.a >= 100 * c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, totals.n, CAST((1000 * cuts.a::HUGEINT * totals.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score, k
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail JOIN totals ON totals.lang = cuts.lang
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored
), listed AS (
  SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score FROM best WHERE place = 1
)
SELECT * FROM listed WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing, "op2_sentencepiece": op2_sentencepiece, "op3_simhash": op3_simhash, "op4_line_dedup": op4_line_dedup,
        "op5_token_files": op5_token_files, "op6_fingerprints": op6_fingerprints, "op7_token_counts": op7_token_counts,
        "op8_toxicity": op8_toxicity, "op9_top_k": op9_top_k, "op10_pii": op10_pii, "op11_quality": op11_quality, "op12_variants": op12_variants, "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_top_k": OP9_SQL, "op12_variants": OP12_SQL, "op13_phrases": OP13_SQL}
