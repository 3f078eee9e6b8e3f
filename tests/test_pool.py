"""One limit for all tasks, and servers' reports in a stream's state."""

import asyncio
import functools
import threading
import time

import pytest
from pyspark.sql import functions as F

from batchloom.operators.dispatch import DispatchConfig, generate
from batchloom.operators.limits import Limits
from batchloom.operators.pool import Copy, PoolGate
from batchloom.operators.provider import EchoProvider


class Timed(EchoProvider):
    def __init__(self, folder):
        super().__init__()
        self.folder = folder

    async def call(self, kind, request, deployment, options):
        import uuid

        open(f"{self.folder}/{time.time():.4f}.{uuid.uuid4().hex}", "w").close()
        return await super().call(kind, request, deployment, options)


def requests(spark, indices):
    return spark.createDataFrame([(i, '[{"role": "user", "content": "x"}]', None) for i in indices], "_index bigint, request string, error string")


def test_one_task_gets_the_whole_limit(spark, tmp_path):
    """All rows are in one task of four. By shares it would have a quarter, and wait minutes for the rest."""
    config = DispatchConfig("m", functools.partial(Timed, str(tmp_path)), partitions=4, limits=Limits(rpm=600, max_request_burst=20), shared_limits=True)
    began = time.monotonic()
    assert generate(requests(spark, [7] * 40), config).count() == 40
    took = time.monotonic() - began
    at = sorted(float(p.name.rsplit(".", 1)[0]) for p in tmp_path.iterdir())
    assert len(at) == 40 and took < 100
    for a in range(40):  # never more than the burst and what has come in since
        for b in range(a, 40):
            assert b - a + 1 <= 20 + (at[b] - at[a] + 2) * 10  # the clock is that of the calls, which a busy machine delays


def test_the_whole_is_kept_over_all_tasks(spark, tmp_path):
    config = DispatchConfig("m", functools.partial(Timed, str(tmp_path)), partitions=4, limits=Limits(rpm=600, max_request_burst=5), shared_limits=True)
    assert generate(requests(spark, range(30)), config).count() == 30
    at = sorted(float(p.name.rsplit(".", 1)[0]) for p in tmp_path.iterdir())
    assert at[-1] - at[0] > 1.0
    for a in range(30):
        for b in range(a, 30):
            assert b - a + 1 <= 5 + (at[b] - at[a] + 2) * 10
    too_large = DispatchConfig("m", EchoProvider, partitions=2, limits=Limits(tpm=3), shared_limits=True)
    rows = generate(requests(spark, range(3)), too_large).collect()
    assert len(rows) == 3 and all("exceed" in r.error for r in rows)


def test_copies_agree():
    limits = Limits(rpm=60, tpm=100, header_scope="minute")
    copies = [Copy(limits) for _ in range(3)]
    said = [
        [{"now": 10.0, "asks": [(1, 60), (2, 30)], "told": []}, {"now": 99.0, "asks": [(1, 20)], "told": []}, {"now": 0.0, "asks": [], "told": []}],
        [{"now": 10.5, "asks": [], "told": [(20, 5, False, None)]}, {"now": 1.0, "asks": [(2, 1)], "told": [(30, 0, True, None)]}, {"now": 1.0, "asks": [(1, 10)], "told": []}],
        [{"now": 11.0, "asks": [(3, 50)], "told": [(0, 0, False, {"tokens_limit": 100, "tokens_remaining": 2, "tokens_reset": 49.0})]}, {"now": 1.0, "asks": [], "told": []}, {"now": 1.0, "asks": [], "told": []}],
        [{"now": 36.0, "asks": [], "told": []}, {"now": 1.0, "asks": [], "told": []}, {"now": 1.0, "asks": [], "told": []}],
    ]
    granted = [[c.round(x) for x in said] for c in copies]
    assert granted[0] == granted[1] == granted[2]
    assert granted[0][0] == [(1, 1), (0, 2)]  # the smaller first; 60 more aren't there
    assert granted[0][1] == [(1, 2), (2, 1), (0, 1)]  # after refunds
    assert granted[0][2] == [] and granted[0][3] == [(0, 3)]  # 2 left, and 2 a second by the server's report


def test_a_broken_exchange_reaches_those_that_wait():
    def gather(text):
        raise OSError("gone")

    gate = PoolGate(Limits(rpm=5), 0, gather)
    gate.thread.join(5)
    with pytest.raises(OSError):
        asyncio.run(gate.acquire(1))
    with pytest.raises(OSError):
        gate.finish()
    assert threading.active_count() < 200


def test_reports_outlive_a_batch(spark, tmp_path):
    from batchloom.streaming.runner import limited

    src = tmp_path / "reqs"
    schema = "deployment string, request_id bigint, seconds double, tokens int, actual int, tokens_remaining int, tokens_reset double"
    # The server says that none is left and all 600 come in 10 s. Without its report 10 a second would come.
    for part in ([("d", 1, 0.0, 10, None, 0, 10.0)], [("d", 2, 5.0, 200, None, None, None), ("d", 3, 5.0, 150, None, None, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = limited(spark.readStream.schema(schema).parquet(str(src)), Limits(rpm=100, tpm=600, header_scope="minute"))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert {r.request_id: r.admitted for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {1: True, 2: True, 3: False}
