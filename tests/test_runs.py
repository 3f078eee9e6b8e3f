"""Whole runs: fresh, resumed, refused; streaming; the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from batchloom import cli
from batchloom.operators import bench
from batchloom.operators.dispatch import DispatchConfig
from batchloom.operators.limits import Limits
from batchloom.operators.planner import MismatchError
from batchloom.operators.provider import EchoProvider, ProviderError
from batchloom.plans import workflow as W
from batchloom.streaming.runner import limited, run_stream


class Noting(EchoProvider):
    """Notes each call in a folder; fails on texts with ``bad``."""

    def __init__(self, folder):
        super().__init__()
        self.folder = folder

    async def call(self, kind, request, deployment, options):
        import uuid

        open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        if "bad" in json.dumps(request):
            raise ProviderError("refused")
        return await super().call(kind, request, deployment, options)


@pytest.fixture
def place(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path


def config(place, text=None, **kw):
    if text is not None:
        (place / "in.jsonl").write_text(text)
    folder = str(place / "calls")
    return W.RunConfig(str(place / "run"), DispatchConfig("m", lambda: Noting(folder), partitions=2), str(place / "in.jsonl"), **kw)


def calls(place):
    return len(os.listdir(place / "calls"))


LINES = "".join(json.dumps({"prompt": p}) + "\n" for p in ("dup", "dup", "tail", "bad")) + "oops\noops\n"


def test_run_and_resume(spark, place):
    assert W.run(spark, config(place, LINES, chunk_rows=2)) == 6
    rows = W.output(spark, str(place / "run")).orderBy("_index").collect()
    assert [r._index for r in rows] == list(range(6))
    assert [r.output_text for r in rows[:3]] == ["dup", "dup", "tail"] and rows[3].error == "refused" and rows[4].error and rows[5].error
    assert calls(place) == 4
    said = []
    assert W.run(spark, config(place, resume=True, on_status=said.append)) == 0 and calls(place) == 4 and said == ["nothing to do"]
    assert W.run(spark, config(place, resume=True, retry_errors=True)) == 3 and calls(place) == 5
    assert W.output(spark, str(place / "run")).count() == 6
    n = W.export(spark, str(place / "run"), str(place / "out.jsonl"))
    found = [json.loads(x) for x in (place / "out.jsonl").read_text().splitlines()]
    assert n == 6 and [x["_index"] for x in found] == list(range(6)) and "metadata" not in found[0] and found[4]["output_text"] is None


def test_resume_after_a_lost_chunk_and_reordering(spark, place):
    import shutil

    W.run(spark, config(place, LINES, chunk_rows=2))
    shutil.rmtree(place / "run" / "settled" / "chunk=0")  # as if it broke off between output and log
    lines = LINES.splitlines(keepends=True)
    assert W.run(spark, config(place, "".join(reversed(lines)), resume=True)) > 0
    rows = W.output(spark, str(place / "run")).orderBy("_index").collect()
    assert [r._index for r in rows] == list(range(6)) and rows[2].output_text == "tail"


def test_refusals(spark, place):
    with pytest.raises(MismatchError):
        W.run(spark, config(place, LINES, resume=True))
    W.run(spark, config(place, LINES))
    with pytest.raises(MismatchError):
        W.run(spark, config(place, LINES + '{"prompt": "new"}\n', resume=True))
    with pytest.raises(MismatchError, match="mapper"):
        W.run(spark, config(place, LINES, resume=True, mapper=lambda r: {"input": "x"}))
    with pytest.raises(ValueError):
        W.RunConfig("x", DispatchConfig("m", EchoProvider))
    # A fresh run that can't begin leaves the old one.
    with pytest.raises(Exception):
        W.run(spark, W.RunConfig(str(place / "run"), DispatchConfig("m", EchoProvider), str(place / "missing.jsonl")))
    assert W.output(spark, str(place / "run")).count() == 6


def test_empty_source(spark, place):
    assert W.run(spark, config(place, "")) == 0
    assert W.run(spark, config(place, resume=True)) == 0 and W.output(spark, str(place / "run")).count() == 0


def test_mapper_metadata_and_json(spark, place):
    text = "".join(json.dumps({"k": k}) + "\n" for k in range(3))

    def mapper(r):
        if r["k"] == 2:
            raise ValueError("no")
        return {"input": json.dumps({"v": r["k"]}), "metadata": {"k": r["k"]}}

    W.run(spark, config(place, text, mapper=mapper, parse_json=True))
    rows = W.output(spark, str(place / "run")).select(
        "_index", F.to_json("output_parsed").alias("p"), "metadata", "error",
    ).orderBy("_index").collect()
    assert rows[1].p == '{"v":1}' and json.loads(rows[1].metadata) == {"k": 1} and rows[2].metadata is None and rows[2].error == "no"


def test_prompt_run(spark, place):
    c = W.RunConfig(str(place / "p"), DispatchConfig("m", EchoProvider, endpoint="responses"), prompt="hello")
    assert W.run(spark, c) == 1 and W.output(spark, str(place / "p")).first().output_text == "hello"


def test_stream(spark, place):
    src = place / "src"
    src.mkdir()
    (src / "a.jsonl").write_text('{"prompt": "a"}\n{"prompt": "b"}\n')
    (src / "b.jsonl").write_text('nope\n{"prompt": "c"}\n')
    folder = str(place / "calls")
    run = lambda: run_stream(spark, str(src), str(place / "o"), str(place / "ck"), DispatchConfig("m", lambda: Noting(folder), partitions=1)).awaitTermination()
    run()
    rows = spark.read.json(str(place / "o"))
    assert rows.count() == 4 and rows.where("error is not null").count() == 1
    n = calls(place)
    run()
    assert calls(place) == n  # nothing is done twice


def test_stream_limiter(spark, place):
    src = place / "reqs"
    spark.createDataFrame(
        [("d", k, float(k), 10, None) for k in range(4)] + [("e", 9, 0.0, 999, None)],
        "deployment string, request_id bigint, seconds double, tokens int, actual int",
    ).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    q = limited(stream, Limits(rpm=2, tpm=100)).writeStream.format("memory").queryName("limited_out").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = {r.request_id: r.admitted for r in spark.table("limited_out").collect()}
    assert rows == {0: True, 1: True, 2: False, 3: False, 9: False}


def test_bench_sweep(spark):
    def run(n):
        return spark.range(20).select(
            F.lit(False).alias("failed"), *[F.lit(0.1).alias(c) for c in ("end_to_end_s", "service_time_s", "queue_wait_s")],
            F.lit("d").alias("deployment"), *[F.lit(n).cast("bigint").alias(c) for c in ("prompt_tokens", "output_tokens", "total_tokens")],
        )

    log, took = bench.sweep(bench.levels_up_to(5), run)
    assert bench.levels_up_to(5) == [1, 2, 4, 5] and bench.batches_up_to(40) == [1, 8, 32, 40]
    fixed = took.withColumn("elapsed_s", F.lit(1.0))
    levels = bench.summary(log, fixed.select("level", "elapsed_s")).join(took.select("level", "position"), "level")
    best = bench.recommend(levels).first()
    assert best.recommended == 5 and best.metric == "output_tok/s" and best.still_rising
    assert json.loads(bench.as_json(levels, bench.recommend(levels)))["recommendation"]["recommended"] == 5
    none = bench.recommend(levels.withColumn("failures", F.lit(1))).first()
    assert none.recommended is None and not none.still_rising


def test_cli(spark, place, capsys):
    src, out = place / "in.jsonl", place / "out.jsonl"
    src.write_text('{"prompt": "a"}\nnope\n')
    assert cli.main(["generate", "--model", "m", "--input-jsonl", str(src), "--output-jsonl", str(out)]) == 0
    rows = [json.loads(x) for x in out.read_text().splitlines()]
    assert rows[0]["output_text"] == "a" and rows[1]["error"]
    assert cli.main(["generate", "--model", "m", "--input-jsonl", str(src), "--output-jsonl", str(out), "--resume"]) == 0
    assert cli.main(["generate", "--model", "m", "--input-jsonl", str(src), "--output-jsonl", str(src)]) == 1
    assert cli.main(["generate", "--model", "", "--prompt", "x"]) == 1
    capsys.readouterr()
    assert cli.main(["generate", "--model", "m", "--prompt", "hi"]) == 0 and json.loads(capsys.readouterr().out)["output_text"] == "hi"
    assert cli.main(["embed", "--model", "m", "--text", "hi", "--no-vectors"]) == 0
    row = json.loads(capsys.readouterr().out)
    assert row["embedding"] is None and row["dimensions"] == 4
    (place / "a.wav").write_bytes(b"12345")
    assert cli.main(["transcribe", "--model", "m", str(place / "a.wav")]) == 0 and json.loads(capsys.readouterr().out)["text"] == "5 bytes"
    assert cli.main(["bench", "generate", "--model", "m", "--prompt", "x", "--warmup", "1", "--requests", "4", "--max-level", "2"]) == 0
    assert [r["level"] for r in json.loads(capsys.readouterr().out)["results"]] == [1, 2]
    with pytest.raises(SystemExit) as e:
        cli.main([])
    assert e.value.code == 2
