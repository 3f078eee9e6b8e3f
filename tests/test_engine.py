"""Mapping, planner, dispatch, limits and parsing on small fixtures."""

import asyncio
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from batchloom.functions import responses as R
from batchloom.functions.fingerprint import canonical, parse_line
from batchloom.functions.validate import check_schema, conforms, parse_with
from batchloom.operators import mapping, planner, results
from batchloom.operators.dispatch import DispatchConfig, embed, generate, reset_seconds, transcribe
from batchloom.operators.limits import Gate, Limiter, Limits, TokenBucket
from batchloom.operators.provider import EchoProvider, ProviderError
from batchloom.sources import lines, settings as cfg


# --- sources -----------------------------------------------------------------------------------


def test_json_lines(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"prompt": "a"}\n\n   \n[]\nnot json\n{"prompt": "a"}\n{"a":1} trailing\n')
    rows = {r.source_index: r for r in lines.json_lines(spark, str(p)).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4]
    assert rows[0].parse_error is None and "JSON objects" in rows[1].parse_error and rows[2].parse_error and rows[4].parse_error
    assert rows[0].record_fingerprint == rows[3].record_fingerprint != rows[1].record_fingerprint


def test_index_over_many_splits(spark, tmp_path):
    p = tmp_path / "many.txt"
    p.write_text("\n".join(map(str, range(5000))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        found = lines.with_index(spark.read.text(str(p))).select("source_index", F.col("value").cast("bigint").alias("v")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 5000 and all(r.source_index == r.v for r in found)


def test_canonical_fingerprints():
    same = [parse_line(x)["record_fingerprint"] for x in ('{"a":1,"b":"é"}', ' {"b": "é", "a": 1} ')]
    assert same[0] == same[1]
    assert canonical({"b": 1, "a": [1.0, None]}) == '{"a":[1.0,null],"b":1}'
    assert parse_line('{"a":"\\ud800"}')["parse_error"]  # a lone surrogate is an error row


def test_strict_json_raises(spark, tmp_path):
    p = tmp_path / "bad.jsonl"
    p.write_text('{"a": 1}\nnope\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        lines.strict_json(spark, str(p), "a int").collect()


def test_field_rows(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"text": "x"}\n{"other": 1}\n{"text": 5}\n')
    source = lines.json_lines(spark, str(p))
    assert [(r._index, r.text) for r in lines.field_rows(source, "text").orderBy("_index").collect()] == [(0, "x"), (2, "5")]
    with pytest.raises(ValueError):
        lines.field_rows(source, "path")


def test_audio_guard(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"x" * 10)
    (tmp_path / "b.wav").write_bytes(b"x" * 100)
    found = {r.path.rsplit("/", 1)[-1]: r for r in lines.audio(spark, str(tmp_path), 50).collect()}
    assert found["a.wav"].error is None and len(found["a.wav"].content) == 10
    assert "exceeds" in found["b.wav"].error and found["b.wav"].content is None
    paths = lines.items(spark, [str(tmp_path / "a.wav"), str(tmp_path / "none.wav")]).withColumnRenamed("input", "path")
    rows = {r._index: r for r in lines.audio_paths(spark, paths).collect()}
    assert rows[0].content == b"x" * 10 and "regular file" in rows[1].error


def test_settings(tmp_path):
    p = tmp_path / "d.toml"
    p.write_text(
        '[deployments.a]\nmodel = "m"\napi_base = "http://x"\n[deployments.b]\nmodel = "n"\n[deployments.b.extra_kwargs]\nseed = 1\n'
    )
    found = cfg.deployments(str(p))
    assert [d.label for d in found] == ["a", "b"] and found[1].extra == {"seed": 1}
    p.write_text('[deployments.a]\nmodel = "m"\n[deployments.a.extra_kwargs]\napi_key = "s"\n')
    with pytest.raises(ValueError, match="api_key"):
        cfg.deployments(str(p))
    assert cfg.secret_path({"a": [{"api_key": 1}]}) == "a[0].api_key"
    env = {"A": "1"}
    (tmp_path / ".env").write_text("# c\nA=2\nexport B='x y'\nbroken\n")
    cfg.load_env(str(tmp_path / ".env"), env)
    assert env == {"A": "1", "B": "x y"}
    assert "secret" not in repr(cfg.Deployment("l", "m", api_key="secret"))


# --- mapping -----------------------------------------------------------------------------------


def source(spark, records):
    return lines.parsed(spark.createDataFrame([(k, r) for k, r in enumerate(records)], "source_index bigint, raw_line string"))


def test_prepared_errors_in_order(spark):
    rows = source(
        spark,
        [
            '{"prompt": ""}', '{"messages": []}', '{"text": "w"}', "x", '{"responses_input": [1]}',
            '{"prompt": null, "messages": [{"role": "user", "content": "c"}]}', '{"messages": [{"content": "c"}]}',
        ],
    )
    found = [(r.request, r.error) for r in mapping.prepared(rows, "chat_completion").orderBy("source_index").collect()]
    assert json.loads(found[0][0]) == [{"role": "user", "content": ""}] and found[1] == ("[]", None)
    assert found[2] == (None, mapping.NO_FIELD) and found[3][0] is None and found[4][1].startswith("Chat completion")
    assert json.loads(found[5][0])[0]["content"] == "c" and found[6][1]


def test_mapper_rows(spark):
    def mapper(r):
        if r["k"] == 0:
            return {"input": "hi", "metadata": {"a": 1}, "more": 2}
        if r["k"] == 1:
            return {"metadata": {}}
        if r["k"] == 2:
            return "text"
        if r["k"] == 3:
            return {"input": "x", "metadata": {"d": object()}}
        raise RuntimeError("boom")

    rows = source(spark, [json.dumps({"k": k}) for k in range(5)])
    found = mapping.prepared(rows, "chat_completion", mapper).orderBy("source_index").collect()
    assert json.loads(found[0].metadata) == {"a": 1} and found[0].error is None
    assert [w in found[k].error for k, w in ((1, "input"), (2, "dict"), (3, "JSON serializable"), (4, "boom"))] == [True] * 4
    native = mapping.prepared(rows, "text_completion", native=lambda d: d.withColumn("input", F.lit('"n"')))
    assert {r.request for r in native.collect()} == {'"n"'}


def test_mapper_loading_and_fingerprints():
    assert mapping.load_mapper("json:loads") is json.loads
    for bad in ("json", "json:", ":x", "json:nothing"):
        with pytest.raises(ValueError):
            mapping.load_mapper(bad)
    a, b = eval("lambda r: 1"), eval("lambda r: 2")
    assert mapping.mapper_fingerprint(None) == mapping.BUILTIN_FINGERPRINT
    assert mapping.mapper_fingerprint(a, "a") != mapping.mapper_fingerprint(b, "b")
    with pytest.raises(ValueError):
        mapping.check_endpoint("nope")


# --- planner -----------------------------------------------------------------------------------


def frame(spark, keys):
    return spark.createDataFrame([(k, v) for k, v in enumerate(keys)], "source_index bigint, record_fingerprint string")


def test_occurrences_across_chunks(spark):
    keys = ["hot"] * 50 + ["b", "hot", "b"]
    rows = planner.with_occurrence(frame(spark, keys), chunk=7).orderBy("source_index").collect()
    seen = {}
    for r in rows:
        assert r.occurrence == seen.get(r.record_fingerprint, 0)
        seen[r.record_fingerprint] = r.occurrence + 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.randoms())
def test_pending_and_settled_make_the_source(spark, keys, rng):
    src = planner.with_occurrence(frame(spark, keys))
    ledger = planner.bootstrap(src).withColumn("status", (F.col("output_index") % 3).cast("tinyint"))
    shuffled = list(keys)
    rng.shuffle(shuffled)
    again = planner.with_occurrence(frame(spark, shuffled))
    planner.validate(again, ledger)  # any order of the same rows is the same source
    todo = planner.pending(again, ledger)
    done = ledger.where("status <> 0")
    both = todo.select("record_fingerprint", "occurrence").union(done.select("record_fingerprint", "occurrence"))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, src.select("record_fingerprint", "occurrence").collect()))


def test_validate_rejects(spark):
    ledger = planner.bootstrap(planner.with_occurrence(frame(spark, ["a", "a"])))
    for keys in (["a"], ["a", "a", "a"], ["a", "b"], []):
        with pytest.raises(planner.MismatchError):
            planner.validate(planner.with_occurrence(frame(spark, keys)), ledger)
    done = ledger.withColumn("status", F.lit(1).cast("tinyint"))
    out = spark.createDataFrame([(0,)], "_index bigint")
    with pytest.raises(planner.MismatchError, match="1"):
        planner.validate(planner.with_occurrence(frame(spark, ["a", "a"])), done, out)
    empty = planner.bootstrap(planner.with_occurrence(frame(spark, [])))
    planner.validate(planner.with_occurrence(frame(spark, [])), empty)


# --- dispatch ------------------------------------------------------------------------------------


def asks(spark, texts, error=None):
    return spark.createDataFrame([(k, json.dumps(t), error) for k, t in enumerate(texts)], "_index bigint, request string, error string")


class Counting(EchoProvider):
    def __init__(self, folder, fails=(), times=1, retryable=True, pause=0.0):
        super().__init__()
        self.folder, self.fails, self.times, self.retryable, self.pause = folder, fails, times, retryable, pause
        self.now = self.most = 0

    async def call(self, kind, request, deployment, options):
        import os
        import uuid

        key = json.dumps(request) if not isinstance(request, bytes) else "bytes"
        bad = [f for f in self.fails if f in key]
        before = len([n for n in os.listdir(self.folder) if n.startswith(bad[0])]) if bad else 0
        open(f"{self.folder}/{bad[0] if bad else 'call'}-{uuid.uuid4().hex}", "w").close()
        self.now += 1
        self.most = max(self.most, self.now)
        try:
            await asyncio.sleep(self.pause)
            if bad and before < self.times:
                raise ProviderError(f"failed on {bad[0]}", self.retryable, retry_after=0)
            return await super().call(kind, request, deployment, options) | {"most": self.most}
        finally:
            self.now -= 1


def counting(folder, **kw):
    return lambda: Counting(str(folder), **kw)


def calls(folder):
    return len(list(folder.iterdir()))


def test_generate_once_each(spark, tmp_path):
    cfg_ = DispatchConfig("m", counting(tmp_path, pause=0.01), max_parallel_requests=4, partitions=2)
    out = tmp_path.parent / f"{tmp_path.name}-out"
    generate(asks(spark, [f"t{k}" for k in range(20)]), cfg_).write.parquet(str(out))
    rows = results.generated(spark.read.parquet(str(out)), "text_completion").orderBy("_index").collect()
    spark.read.parquet(str(out)).count()
    assert calls(tmp_path) == 20  # two actions over what was written: no further call
    assert [r._index for r in rows] == list(range(20)) and all(r.error is None and r.metrics.retries == 0 for r in rows)
    raw = [json.loads(r.raw_response)["most"] for r in rows]
    assert max(raw) <= 2  # 2 tasks x 2 in flight


def test_immediate_errors_make_no_call(spark, tmp_path):
    rows = generate(asks(spark, ["a"], error="bad row"), DispatchConfig("m", counting(tmp_path))).collect()
    assert rows[0].error == "bad row" and rows[0].response is None and calls(tmp_path) == 0


def test_retry_and_give_up(spark, tmp_path):
    cfg_ = DispatchConfig("m", counting(tmp_path, fails=("x",), times=2), partitions=1)
    row = generate(asks(spark, ["x"]), cfg_).collect()[0]
    assert row.error is None and row.metrics.retries == 2 and calls(tmp_path) == 3
    hard = tmp_path / "hard"
    hard.mkdir()
    row = generate(asks(spark, ["x"]), DispatchConfig("m", counting(hard, fails=("x",), times=9, retryable=False))).collect()[0]
    assert row.error == "failed on x" and row.error_type == "ProviderError" and calls(hard) == 1


def test_strict_raises(spark, tmp_path):
    cfg_ = DispatchConfig("m", counting(tmp_path, fails=("t1",), times=99, retryable=False), strict=True)
    with pytest.raises(Exception, match="failed on t1"):
        generate(asks(spark, ["t0", "t1", "t2"]), cfg_).collect()


def test_embed_bisects(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(8)], "_index bigint, text string")
    cfg_ = DispatchConfig("m", counting(tmp_path, fails=("t3",), times=99, retryable=False), partitions=2)
    found = results.embedded(embed(rows, cfg_, micro_batch_size=4)).orderBy("_index").collect()
    assert [r.error is None for r in found] == [True, True, True, False, True, True, True, True]
    assert len({r.call_id for r in found[4:]}) == 1 and found[0].dimensions == 4
    passing = tmp_path / "p"
    passing.mkdir()
    cfg_ = DispatchConfig("m", counting(passing, fails=("t3",), times=99, retryable=True), max_retries=1, partitions=1)
    found = embed(rows, cfg_, micro_batch_size=4).orderBy("_index").collect()
    assert [r.error is None for r in found] == [False] * 4 + [True] * 4  # a passing failure isn't halved
    with pytest.raises(ValueError):
        embed(rows, cfg_, micro_batch_size=0)


def test_transcribe(spark, tmp_path):
    rows = spark.createDataFrame([(0, bytearray(b"abc"), None), (1, None, "too big")], "_index bigint, content binary, error string")
    # Sorting in Spark would sample, and so dispatch, twice: collect, then sort.
    found = sorted(results.transcribed(transcribe(rows, DispatchConfig("m", counting(tmp_path)))).collect(), key=lambda r: r._index)
    assert found[0].text == "3 bytes" and found[1].error == "too big" and calls(tmp_path) == 1


def test_config_rules():
    for bad in (
        {"model": ""}, {"max_parallel_requests": 0}, {"endpoint": "x"}, {"routing_strategy": "x"},
        {"deployments": ({"model": "a"},), "api_base": "b"}, {"max_retries": -1},
    ):
        with pytest.raises(ValueError):
            DispatchConfig(**({"model": "m", "provider": EchoProvider} | bad))
    c = DispatchConfig(
        "m", EchoProvider, max_parallel_requests=3, default_request_kwargs={"num_retries": 2, "a": 1}, timeout=5.0, api_key="secret",
    )
    assert c.shape()[0] * c.shape()[1] <= 3 and c.options({"a": 2}) == {"a": 2, "timeout": 5.0} and "secret" not in repr(c)


def test_aligned_and_progress(spark):
    rows = spark.createDataFrame([(1, "b", None), (0, None, "e")], "_index bigint, x string, error string")
    r = results.aligned(rows).first()
    assert r.results[0] is None and r.results[1].x == "b" and r.errors == ["e", None]


# --- limits --------------------------------------------------------------------------------------


def test_bucket():
    b = TokenBucket(60, capacity=10)
    assert b.level(0) == 10 and b.take(10, 0) and not b.take(1, 0.5) and b.take(1, 1.0)
    assert b.wait(3, 1.0) == pytest.approx(3.0) and b.take(0, 1.0)
    b.give(100, 1.0)
    assert b.level(1.0) == 10
    b.give(-100, 1.0)
    assert b.level(1.0) == 0
    b.report(20, 4, 11.0, 1.0)
    assert b.level(1.0) == 4 and b.rate(1.0) == pytest.approx(0.6) and b.rate(62.0) == 1.0
    for bad in ((0, None), (1, 0), (True, None), (1.5, None)):
        with pytest.raises(ValueError):
            TokenBucket(*bad)
    with pytest.raises(ValueError):
        b.report(None, 1, 0.0, 5.0)
    z = TokenBucket(5, 5)
    z.take(5, 0)
    z.report(5, 5, 10.0, 0.0)
    z.tokens = 0.0
    assert z.wait(1, 0.0) == pytest.approx(10.0)


def test_limiter_adjust_and_headers():
    m = Limiter(Limits(rpm=2, tpm=100, rpd=10, tpd=1000))
    assert m.try_acquire(60, 0.0) and not m.try_acquire(60, 0.0)
    m.adjust(60, 0, 0.0)
    assert m.requests["minute"].level(0.0) == 2 and m.tokens["minute"].level(0.0) == 100
    m.try_acquire(10, 0.0)
    m.adjust(10, 0, 0.0, failed=False)
    assert m.requests["minute"].level(0.0) == 1  # a success without usage keeps its slot
    m.adjust(0, 5, 0.0, headers={"tokens_remaining": 7, "tokens_reset": 30.0, "requests_remaining": 3, "requests_reset": 4000.0})
    assert m.tokens["minute"].level(0.0) == 7 and m.requests["day"].level(0.0) == 3
    with pytest.raises(ValueError):
        m.try_acquire(101, 0.0)
    with pytest.raises(ValueError):
        m.adjust(-1, 0, 0.0)
    assert Limits(tpm=12_000).requests_per_minute() == 2 and Limits(tpd=7).requests_per_minute() == 7
    shares = [Limits(rpm=10, tpm=7).share(k, 3) for k in range(3)]
    assert [s.rpm for s in shares] == [4, 3, 3] and sum(s.tpm for s in shares) == 7


def test_gate_serves_small_waiters_first():
    async def main():
        gate, order = Gate(Limits(rpm=100_000, tpm=6000, max_token_burst=100)), []

        async def ask(n):
            await gate.acquire(n)
            order.append(n)

        await gate.acquire(100)
        await asyncio.gather(*(ask(n) for n in (9, 3, 6)))
        return order

    assert asyncio.run(main()) == [3, 6, 9]


@pytest.mark.parametrize(
    "text, seconds",
    [
        ("10", 10), ("8.64s", 8.64), ("1m30s", 90), ("100ms", 0.1), ("1.5m", 90), ("1h", 3600), ("", None), ("1 h", None), ("1m 1d", None),
        ("1.2.3", None),
    ],
)
def test_reset_seconds(text, seconds):
    assert reset_seconds(text) == (None if seconds is None else pytest.approx(seconds))


# --- parsing -------------------------------------------------------------------------------------


def parse(spark, body, endpoint="chat_completion"):
    return spark.createDataFrame(
        [(json.dumps(body) if not isinstance(body, str) else body,)], "raw string",
    ).select(R.generation(F.col("raw"), endpoint).alias("r")).first().r


def test_odd_responses(spark):
    assert parse(spark, "not json") is None
    r = parse(spark, {"choices": []})
    assert r.output_text == "" and r.finish_reason is None and r.token_usage is None and r.tool_calls is None and r.model_id == ""
    r = parse(spark, {"choices": [{"text": "a", "finish_reason": "x"}, {"text": "b", "finish_reason": "y"}], "usage": {}})
    assert r.output_text == "ab" and r.finish_reason == "y" and r.token_usage.total_tokens == 0
    r = parse(spark, {"choices": [{"message": {"content": [{"text": "p"}, {"image": 1}]}}]})
    assert r.output_text == "pNone"
    r = parse(spark, {"choices": [{"message": {"content": "<think>a</think>x", "reasoning_content": " why "}}]})
    assert r.output_text == "<think>a</think>x" and r.reasoning == "why"
    r = parse(
        spark,
        {
            "choices": [
                {"message": {"content": "<think>\n" + "y" * 100_000 + "</think>\n z", "tool_calls": [{"name": "n", "arguments": "1"}]}}
            ]
        },
    )
    assert r.output_text == "z" and len(r.reasoning) == 100_000 and r.tool_calls[0].name == "n" and r.tool_calls[0].arguments == "1"


def test_schema_validation():
    s = {
        "type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"enum": ["x", "y"]}}},
        "required": ["a"],
    }
    assert conforms({"a": 1, "b": ["x"]}, s) and not conforms({"b": []}, s) and not conforms({"a": True}, s) and not conforms({"a": 1, "b": ["z"]}, s)
    assert parse_with(s, '{"a": 2}') == '{"a": 2}' and parse_with(s, "{") is None and parse_with(s, None) is None
    with pytest.raises(ValueError):
        check_schema({"properties": {"a": {"contains": {}}}})
    t = {"$defs": {"n": {"type": "integer", "minimum": 2, "exclusiveMaximum": 9}}, "oneOf": [{"$ref": "#/$defs/n"}, {"type": "array", "prefixItems": [{"const": 1}], "items": {"multipleOf": 0.5}, "uniqueItems": True, "maxItems": 3}, {"type": "string", "minLength": 2, "pattern": "^a"}]}
    check_schema(t)
    good, bad = [2, 8, 5.0, [1], [1.0, 2.5], "ab"], [1, 9, True, [2], [1, 0.3], [1, 1], [1, 2, 3, 4], "a", "ba", None, {}]
    assert all(conforms(v, t) for v in good) and not any(conforms(v, t) for v in bad)
    o = {
        "patternProperties": {"^x": {"type": "string"}}, "additionalProperties": {"not": {"type": "string"}}, "minProperties": 1,
        "anyOf": [{"required": ["y"]}, {"required": ["xa"]}],
    }
    assert conforms({"xa": "s"}, o) and conforms({"y": 1}, o) and not conforms({"xa": 1}, o) and not conforms({"y": "s"}, o) and not conforms({"z": 1}, o)
    pydantic = pytest.importorskip("pydantic")
    Model = pydantic.create_model("Model", a=(int, ...))
    assert json.loads(parse_with(Model, '{"a": 3}')) == {"a": 3} and parse_with(Model, '{"a": "z"}') is None


def test_backoff_bounds(spark):
    from batchloom.functions.ratelimit import retry_delay

    rows = spark.range(12).select("id", retry_delay(F.col("id")).alias("d")).collect()
    assert all(min(2.0**r.id, 60) <= r.d <= min(2.0**r.id, 60) + 0.5 for r in rows)
    assert math.isclose(spark.range(1).select(retry_delay(F.lit(0), F.lit("700"))).first()[0], 60.0)


def test_routing_strategies():
    from batchloom.operators.dispatch import Router
    from batchloom.sources.settings import Deployment

    now, targets = [0.0], tuple(Deployment(f"d{k}", "m") for k in range(3))
    make = lambda how, **kw: Router(how, targets, kw, lambda: now[0])
    names = lambda r, n, kind="chat_completion": [r.pick(kind).label for _ in range(n)]
    assert names(make("round-robin"), 4) == names(make("cost-based-routing"), 4, "responses") == ["d0", "d1", "d2", "d0"]
    assert set(names(make("simple-shuffle"), 60)) == {"d0", "d1", "d2"}
    cheap = make("cost-based-routing", costs={"d0": 2.0, "d1": 1.0, "d2": 1.0})
    assert names(cheap, 1) == ["d1"]
    cheap.busy["d1"] = 1
    assert names(cheap, 1) == ["d2"]
    fast = make("latency-based-routing")
    for t, seconds in zip(targets, (3.0, 1.0, 2.0)):
        assert fast.pick("chat_completion") is t  # the untried first
        fast.done(t, seconds, 1)
    assert names(fast, 1) == ["d1"]
    used = make("usage-based-routing", window_s=10.0)
    for t, n in zip(targets, (5, 9, 7)):
        used.done(t, 1.0, n)
    assert names(used, 1) == ["d0"]
    now[0] = 20.0
    used.done(targets[0], 1.0, 1)
    assert names(used, 1) == ["d1"]  # what is older than the window doesn't count
    quiet = make("least-busy")
    quiet.busy["d0"] = 1
    assert names(quiet, 1) == ["d1"]


class Closing(EchoProvider):
    def __init__(self, folder):
        super().__init__()
        self.folder = folder

    async def close(self):
        import uuid

        (self.folder / uuid.uuid4().hex).write_text("closed")


def test_providers_are_closed_and_options_are_the_calls_own(spark, tmp_path):
    import functools

    from batchloom.operators.dispatch import DispatchConfig, generate

    rows = spark.createDataFrame(
        [(k, '"x"', None, f'{{"timeout": {k}}}' if k else None) for k in range(4)],
        "_index bigint, request string, error string, options string",
    )
    assert generate(rows, DispatchConfig("m", functools.partial(Closing, tmp_path), "text_completion", partitions=2)).count() == 4
    assert 1 <= len(list(tmp_path.iterdir())) <= 4
    config = DispatchConfig("m", EchoProvider, timeout=9.0, default_request_kwargs={"a": 1, "num_retries": 2})
    assert config.options() == {"a": 1, "timeout": 9.0} and config.options({"a": 2, "timeout": 1}) == {"a": 2, "timeout": 1}


def test_stdin_spool(spark):
    from batchloom.sources import lines
    from batchloom.store import Folder

    said = [json.dumps({"prompt": f"line {k}"}) for k in range(500)]
    path = lines.stdin_spool(spark, iter([*said[:-1], "", said[-1]]), block=64)
    rows = lines.json_lines(spark, path).orderBy("source_index").collect()
    assert [r.raw_line for r in rows] == said and [r.source_index for r in rows] == list(range(500))
    Folder(spark, path).remove()
    assert not Folder(spark, path).exists()


def test_rows_of_a_duration(spark):
    from batchloom.operators import bench

    rows, took = bench.for_seconds(0.2, lambda k: spark.range(3).withColumn("turn", F.lit(k)))
    n = rows.groupBy("turn").count().collect()
    assert took >= 0.2 and all(r["count"] == 3 for r in n) and sorted(r.turn for r in n) == list(range(len(n)))


def test_run_directories():
    from batchloom.plans.workflow import run_dir_of

    a, b = run_dir_of("/data/x/out.jsonl", "/ledgers"), run_dir_of("/data/y/out.jsonl", "/ledgers")
    assert a != b and a.startswith("/ledgers/out.jsonl.") and a.endswith(".run") and len(a.split(".")[-2]) == 8
    assert run_dir_of("/data/x/out.jsonl") == "/data/x/out.jsonl.run"


def test_running_counts_by_ranges(spark):
    from batchloom.operators.results import progress

    rows = spark.createDataFrame([(k, float(k % 7) if k % 5 else None) for k in range(200)], "_index bigint, settled_at double")
    found = {r._index: r.completed for r in progress(rows).collect()}
    order = sorted(range(200), key=lambda k: (float(k % 7) if k % 5 else float("-inf"), k))
    assert [found[k] for k in order] == list(range(1, 201)) and progress(rows.limit(0)).count() == 0


def test_a_settle_log_names_one_row_each(spark):
    ledger = spark.createDataFrame([(0,), (1,), (1,)], "output_index bigint")
    planner.validate_log(ledger, spark.createDataFrame([(0,)], "output_index bigint"))
    for k in (1, 2):
        with pytest.raises(planner.MismatchError):
            planner.validate_log(ledger, spark.createDataFrame([(k,)], "output_index bigint"))
