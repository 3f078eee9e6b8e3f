"""Lines by place, dealt chunks, digests and bitmaps, the stream's index, journals."""

import json
import os
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchloom.operators import planner
from batchloom.operators.dispatch import DispatchConfig, batch, embed, generate
from batchloom.operators.journal import Journal, answered, followed
from batchloom.operators.provider import EchoProvider, ProviderError
from batchloom.plans import workflow as W
from batchloom.sources import lines, places
from batchloom.streaming.runner import run_stream


def texts(n, seed=3):
    rng = random.Random(seed)
    kinds = [lambda k: json.dumps({"prompt": f"é{k}" * rng.randint(1, 30)}, ensure_ascii=False), lambda k: f"  [{k}]\t", lambda k: "", lambda k: " \x1c ", lambda k: f"nope {k}", lambda k: '{"prompt": "x"}']
    return [rng.choice(kinds)(k) for k in range(n)]


def test_places_over_files_and_blocks(spark, tmp_path):
    folder = tmp_path / "a folder"
    folder.mkdir()
    want = []
    for name, end in (("b.jsonl", "\r\n"), ("a b.jsonl", "\n"), ("c.jsonl", "\r")):
        own = texts(300, len(name))
        data = end.join(own).encode() + (b'\n\xff{"a": 1}\n' if name == "c.jsonl" else b"")
        (folder / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = lines.json_lines(spark, str(folder)).orderBy("source_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name in ("a b.jsonl", "b.jsonl", "c.jsonl"):
        for line in (folder / name).read_bytes().replace(b"\r", b"\n").split(b"\n"):
            if line.decode("utf-8", "replace").strip():
                want.append(line)
    assert [r.source_index for r in rows] == list(range(len(want)))
    assert [r.raw_line for r in rows] == [w.decode("utf-8", "replace").strip() for w in want]
    assert rows[-1].parse_error and rows[-1].record is None  # bytes that aren't UTF-8
    from urllib.parse import unquote, urlparse

    for r, w in zip(rows, want):
        data = open(unquote(urlparse(r.source_file).path), "rb").read()
        assert data[r.byte_start : r.byte_start + r.byte_size] == w
    some = [r for r in rows if r.source_index % 7 == 2]
    frame = spark.createDataFrame(some, "source_index bigint, raw_line string, record string, parse_error string, record_fingerprint binary, source_file string, byte_start bigint, byte_size bigint")
    again = {r.source_index: r for r in places.read_places(frame.repartition(3).sortWithinPartitions(*places.PLACE)).collect()}
    assert {k: (r.raw_line, r.record, r.parse_error) for k, r in again.items()} == {r.source_index: (r.raw_line, r.record, r.parse_error) for r in some}
    data = bytearray((folder / "b.jsonl").read_bytes())
    first = next(r for r in some if r.source_file.endswith("b.jsonl") and "%20b" not in r.source_file)
    data[first.byte_start + first.byte_size - 2] ^= 1
    (folder / "b.jsonl").write_bytes(data)
    with pytest.raises(Exception, match="another row"):
        places.read_places(frame).collect()
    assert places.read_places(frame.limit(0)).count() == 0


def test_few_rows_are_few_bytes():
    rng = np.random.default_rng(1)
    size = rng.integers(500, 4000, 20_000)
    start = np.cumsum(size) - size
    few = np.sort(rng.choice(20_000, 200, replace=False))
    read = sum(int(start[few[j - 1]] + size[few[j - 1]] - start[few[i]]) for i, j in places.spans(start[few], size[few], 4096))
    assert read < 0.02 * size.sum()
    whole = places.spans(start, size, 4096, most=1 << 20)
    assert whole[0][0] == 0 and whole[-1][1] == 20_000 and all(a[1] == b[0] for a, b in zip(whole, whole[1:]))


def test_packed_sources_have_no_places(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "in.jsonl.gz", "wt") as f:
        f.write('{"prompt": "a"}\n{"prompt": "b"}\n')
    rows = lines.json_lines(spark, str(tmp_path / "in.jsonl.gz")).orderBy("source_index").collect()
    assert [r.byte_start for r in rows] == [None, None] and not places.seekable(spark, str(tmp_path / "in.jsonl.gz"))
    run = W.RunConfig(str(tmp_path / "run"), DispatchConfig("m", EchoProvider), str(tmp_path / "in.jsonl.gz"))
    assert W.run(spark, run) == 2 and W.output(spark, run.run_dir).count() == 2


def test_chunks_are_exact_and_read_their_own_files(spark, tmp_path):
    rows = spark.range(0, 5000, 3).select(F.col("id").alias("output_index")).repartition(7)
    found = W.deal(spark, rows, 400, str(tmp_path / "work"))
    assert [c["rows"] for c in found] == [400, 400, 400, 400, 67] and found[1]["first"] == 1200 and found[-1]["last"] == 4998
    for c in found:
        part = W.dealt(spark, str(tmp_path / "work"), c["chunk"])
        assert part.count() == c["rows"] and all(f"/chunk={c['chunk']}/" in f for f in part.inputFiles())
    seen = [f for c in found for f in W.dealt(spark, str(tmp_path / "work"), c["chunk"]).inputFiles()]
    assert len(seen) == len(set(seen))  # each file is read once
    small = planner.chunked(rows, 400, bucket=64).groupBy("chunk").count().collect()
    assert sorted(r["count"] for r in small) == [67, 400, 400, 400, 400]
    assert W.deal(spark, rows.limit(0), 400, str(tmp_path / "none")) == []


def source_of(tmp_path, n):
    path = tmp_path / "in.jsonl"
    path.write_text("".join(json.dumps({"prompt": f"p{k}"}) + "\n" for k in range(n)))
    return path


def test_resume_of_an_unchanged_source_parses_nothing(spark, tmp_path, monkeypatch):
    import shutil

    path = source_of(tmp_path, 50)
    config = W.RunConfig(str(tmp_path / "run"), DispatchConfig("m", EchoProvider, partitions=2), str(path), chunk_rows=20)
    assert W.run(spark, config) == 50
    for kind in ("settled", "output"):
        shutil.rmtree(tmp_path / "run" / kind / "chunk=1")
    again = W.RunConfig(config.run_dir, config.dispatch, str(path), chunk_rows=20, resume=True)
    monkeypatch.setattr(W, "_source", lambda *a: pytest.fail("the source was parsed"))
    assert W.run(spark, again) == 20
    monkeypatch.undo()
    rows = W.output(spark, config.run_dir).orderBy("_index").collect()
    assert [r.output_text for r in rows] == [f"p{k}" for k in range(50)]
    os.utime(path, (1, 1))  # other times: it may be another source, so it's parsed and found to be the same
    shutil.rmtree(tmp_path / "run" / "settled" / "chunk=0")
    assert W.run(spark, again) == 20 and W.output(spark, config.run_dir).count() == 50


def test_a_clean_check_joins_no_rows(spark):
    source = planner.with_occurrence(spark.range(100).select(F.col("id").alias("source_index"), F.sha2((F.col("id") % 9).cast("string"), 256).alias("record_fingerprint")))
    ledger = planner.bootstrap(source)
    assert planner.digest(source.repartition(3), *planner.KEY) == planner.digest(ledger, *planner.KEY)
    assert planner.digest(source.where("source_index <> 5"), *planner.KEY) != planner.digest(ledger, *planner.KEY)
    with pytest.raises(planner.MismatchError, match=r"removed \(5\)"):
        planner.validate(source.where("source_index <> 5").withColumn("occurrence", F.col("occurrence")), ledger)
    plain = spark.range(100).select(F.col("id").alias("a"))
    plan = planner.coverage(plain, plain.where("a % 2 = 0"), "a", "a")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert [tuple(r) for r in planner.coverage(plain, plain.where("a % 2 = 0"), "a", "a").collect()] == [(1, 100, 50)]
    far = spark.createDataFrame([(0,), (32767,), (32768,), (10**12,), (10**12,)], "a bigint")
    assert sorted(tuple(r) for r in planner.coverage(far, plain, "a", "a").collect()) == [(1, 2, 1), (2, 1, 0), (1 + 10**12 // 32768, 1, 0)]


def test_oversized_audio_is_never_read(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"x" * 10)
    with open(tmp_path / "b.wav", "wb") as f:
        f.truncate(3 << 30)  # more than a row can hold
    rows = sorted(lines.audio(spark, str(tmp_path), 50).collect(), key=lambda r: r.path)
    assert len(rows[0].content) == 10 and rows[0].error is None and rows[1].content is None and "exceeds" in rows[1].error
    assert sorted(r._index for r in rows) == [0, 1]


def test_stream_index_over_restarts(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    run = lambda: run_stream(spark, str(src), str(tmp_path / "o"), str(tmp_path / "ck"), DispatchConfig("m", EchoProvider, partitions=1)).awaitTermination()
    n = 0
    for turn, sizes in enumerate(((1, 40, 7), (300, 0, 2))):
        for k, size in enumerate(sizes):
            (src / f"{turn}-{k}.jsonl").write_text("".join(json.dumps({"prompt": f"{turn}-{k}-{j}"}) + "\n\n" for j in range(size)))
            n += size
        run()
    rows = spark.read.json(str(tmp_path / "o")).orderBy("_index").collect()
    assert [r._index for r in rows] == list(range(n))
    for a, b in zip(rows, rows[1:]):
        (f, j), (g, k) = a.output_text.rsplit("-", 1), b.output_text.rsplit("-", 1)
        assert f != g or int(k) == int(j) + 1


class Counting(EchoProvider):
    """Notes each call; fails on 13, a little later than the others answer."""

    def __init__(self, folder, bad=True):
        super().__init__()
        self.folder, self.bad = folder, bad

    async def call(self, kind, request, deployment, options):
        import asyncio
        import uuid

        text = request[0] if kind == "embedding" else request[0]["content"]
        open(f"{self.folder}/{text}.{uuid.uuid4().hex}", "w").close()
        if text == "13" and self.bad:
            await asyncio.sleep(0.3)
            raise ProviderError("refused")
        return await super().call(kind, request, deployment, options)


def requests(spark, n):
    body = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))))
    return spark.range(n).select(F.col("id").alias("_index"), body.alias("request"), F.lit(None).cast("string").alias("error"))


def test_a_strict_failure_stops_all_tasks_and_repeats_no_call(spark, tmp_path):
    import functools

    (tmp_path / "calls").mkdir()
    make = lambda bad: DispatchConfig("m", functools.partial(Counting, str(tmp_path / "calls"), bad), partitions=4, max_parallel_requests=8, strict=True, journal=str(tmp_path / "j"))
    with pytest.raises(Exception, match="refused"):
        generate(requests(spark, 200), make(True)).count()
    time.sleep(2)  # other tasks end after the job
    made = sorted(int(f.split(".")[0]) for f in os.listdir(tmp_path / "calls"))
    assert len(made) == len(set(made)) and 13 in made
    # Another try sees the stop, and calls nothing.
    with pytest.raises(Exception, match="stopped by ProviderError: refused"):
        generate(requests(spark, 200), make(True)).count()
    assert len(os.listdir(tmp_path / "calls")) == len(made)
    kept = answered(spark, str(tmp_path / "j")).count()
    assert 0 < kept <= len(made)
    Journal(str(tmp_path / "j")).reopen()
    rows = generate(requests(spark, 200), make(False)).collect()
    assert sorted(r._index for r in rows) == list(range(200)) and all(r.error is None for r in rows)
    calls = len(os.listdir(tmp_path / "calls"))
    assert calls == len(made) + 200 - kept  # what had been answered isn't asked again
    assert generate(requests(spark, 200), make(False)).count() == 200 and len(os.listdir(tmp_path / "calls")) == calls
    assert {r._index for r in answered(spark, str(tmp_path / "j")).collect()} == set(range(200))


def test_each_row_reaches_a_callback_while_the_job_runs(spark, tmp_path):
    seen, threads = [], set()

    def note(row):
        seen.append(row["_index"])
        threads.add(threading.current_thread())

    config = DispatchConfig("m", EchoProvider, partitions=3, journal=str(tmp_path / "j"))
    n = followed(str(tmp_path / "j"), lambda: generate(requests(spark, 700), config).count(), note, every=0.05)
    assert n == 700 and sorted(seen) == list(range(700)) and threads == {threading.current_thread()}
    with pytest.raises(ZeroDivisionError):
        followed(str(tmp_path / "j"), lambda: 1 / 0, note)
    got, progress = {}, []
    rows = requests(spark, 30).withColumn("error", F.when(F.col("_index") == 4, F.lit("held back")))
    answers = batch(generate, rows, DispatchConfig("m", EchoProvider, partitions=2), lambda i, r: got.setdefault(i, r), lambda k, n: progress.append((k, n)))
    assert sorted(got) == list(range(30)) and got[4]["error"] == "held back" and got[5]["response"] and progress == [(k, 30) for k in range(1, 31)]
    assert answers.count() == 30 and batch(generate, rows, DispatchConfig("m", EchoProvider, partitions=2)).count() == 30
    texts = spark.range(10).select(F.col("id").alias("_index"), F.col("id").cast("string").alias("text"))
    vectors = DispatchConfig("m", EchoProvider, partitions=2, journal=str(tmp_path / "e"))
    first = embed(texts, vectors, micro_batch_size=3).collect()
    again = embed(texts, vectors, micro_batch_size=3).collect()
    assert {(r._index, r.response) for r in first} == {(r._index, r.response) for r in again}


def test_a_run_with_a_journal_repeats_no_answered_call(spark, tmp_path):
    import functools

    (tmp_path / "calls").mkdir()
    path = tmp_path / "in.jsonl"
    path.write_text("".join(json.dumps({"prompt": str(k)}) + "\n" for k in range(40)))
    make = lambda bad, **kw: W.RunConfig(
        str(tmp_path / "run"), DispatchConfig("m", functools.partial(Counting, str(tmp_path / "calls"), bad), partitions=2, strict=True), str(path), chunk_rows=25, **kw,
    )
    seen = []
    with pytest.raises(Exception, match="refused"):
        W.run(spark, make(True, on_row=lambda r: seen.append(r["_index"])))
    before = len(os.listdir(tmp_path / "calls"))
    kept = len(set(seen))
    assert 0 < kept < 25 and len(seen) == kept
    assert W.run(spark, make(False, on_row=lambda r: seen.append(r["_index"]), resume=True)) == 40
    assert sorted(seen) == list(range(40))  # each row once over both tries
    assert len(os.listdir(tmp_path / "calls")) == before + 40 - kept
    rows = W.output(spark, str(tmp_path / "run")).orderBy("_index").collect()
    assert [r.output_text for r in rows] == [str(k) for k in range(40)] and not list((tmp_path / "run" / "journal").glob("chunk=*"))


class Slow(EchoProvider):
    async def call(self, kind, request, deployment, options):
        import asyncio

        await asyncio.sleep(30)
        return await super().call(kind, request, deployment, options)


def test_cancel(spark, tmp_path):
    path = source_of(tmp_path, 4)
    config = W.RunConfig(str(tmp_path / "run"), DispatchConfig("m", Slow, partitions=1), str(path), job_tag="slow-run")
    failed = []

    def work():
        try:
            W.run(spark, config)
        except Exception as error:
            failed.append(error)

    thread = threading.Thread(target=work)
    thread.start()
    began = time.monotonic()
    while thread.is_alive() and time.monotonic() - began < 60:
        if list((tmp_path / "run").glob("work-*/manifest.json")):  # the calls are next
            W.cancel(spark, "slow-run")
        thread.join(0.5)
    assert failed and not thread.is_alive()
    assert W.run(spark, W.RunConfig(config.run_dir, DispatchConfig("m", EchoProvider), str(path), resume=True)) == 4


def test_ranked_percentiles_equal_those_in_memory(spark):
    from batchloom.operators import bench

    rng = random.Random(4)
    rows = [(g, float(rng.choice([0, 0, 0, 1, 2, rng.random()])) if rng.random() < 0.9 else None) for g in ("a", "b", "c") for _ in range(rng.choice([1, 2, 700]))] + [("none", None)]
    data = spark.createDataFrame(rows, "g string, v double")
    found = {(r.g, r.p): r.v for r in bench.ranked_percentiles(data, ["g"], "v", (0, 50, 95, 99, 100)).collect()}
    for g in {g for g, v in rows if v is not None}:
        own = [v for x, v in rows if x == g and v is not None]
        for p in (0, 50, 95, 99, 100):
            assert abs(found[g, p] - np.percentile(own, p)) < 1e-12
    assert all(g != "none" for g, _ in found)
