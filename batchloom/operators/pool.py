"""One limiter for all tasks of a dispatch, kept alike in each of them by the rounds of a barrier stage.

Each round a task tells all others what it asks for, and what came back since the last one: refunds, real
usage, servers' reports. Every task applies what all told to its own copy of the limiter, in the order of
tasks and at the time that the first one told, and so all copies grant the same requests: those that wait go in
order of tokens, then of the round, as in one process. A task lets its own granted requests go. The limit
is exact, whichever task the work is in; an idle task holds nothing back. A request waits for a round.

Barrier tasks run all at once or not at all, and fail together: the cluster needs a free core for each
task and no dynamic allocation, and a journal if answers are to outlive a failed try.
"""

from __future__ import annotations

import asyncio
import heapq
import json
import threading
import time
from collections.abc import Callable

from batchloom.operators.limits import Limiter, Limits


class Copy:
    """A task's copy of the limiter and of all that waits."""

    def __init__(self, limits: Limits):
        self.limits, self.limiter, self.turn = limits, None, 0
        self.waiting: list[tuple[int, int, int, int]] = []  # tokens, round, task, the task's number for it

    def round(self, said: list[dict]) -> list[tuple[int, int]]:
        """What all tasks told, in their order; returns the granted requests as (task, number)."""
        now, self.turn = said[0]["now"], self.turn + 1
        if self.limiter is None:
            self.limiter = Limiter(self.limits, now)
        for own in said:
            for reserved, actual, failed, headers in own["told"]:
                self.limiter.adjust(reserved, actual, now, failed, headers)
        for task, own in enumerate(said):
            for number, tokens in own["asks"]:
                heapq.heappush(self.waiting, (tokens, self.turn, task, number))
        granted = []
        while self.waiting and self.limiter.try_acquire(self.waiting[0][0], now):
            granted.append(heapq.heappop(self.waiting)[2:])
        return granted


class PoolGate:
    """Has the calls of ``limits.Gate``; waits for rounds. ``gather`` sends a text to all tasks and returns those of all."""

    def __init__(self, limits: Limits, task: int, gather: Callable[[str], list[str]], every: float = 0.1):
        self.copy, self.task, self.gather, self.every = Copy(limits), task, gather, every
        self.largest = Limiter(limits)
        self.asks: list[tuple[int, int]] = []
        self.told: list[tuple] = []
        self.open: dict[int, tuple[asyncio.AbstractEventLoop, asyncio.Future]] = {}
        self.count = 0
        self.lock, self.done = threading.Lock(), threading.Event()
        self.error: BaseException | None = None
        self.thread = threading.Thread(target=self._rounds, daemon=True)
        self.thread.start()

    async def acquire(self, tokens: int) -> None:
        self.largest.check(tokens)
        loop = asyncio.get_running_loop()
        future = loop.create_future()
        with self.lock:
            if self.error is not None:
                raise self.error
            self.count += 1
            self.open[self.count] = loop, future
            self.asks.append((self.count, int(tokens)))
        await future

    def adjust(self, reserved: int, actual: int, failed: bool, headers: dict | None = None) -> None:
        with self.lock:
            self.told.append((int(reserved), int(actual), failed, headers))

    def finish(self) -> None:
        """No more calls here; this task takes part until none has any."""
        self.done.set()
        self.thread.join()
        if self.error is not None:
            raise self.error

    def _settle(self, number: int, error: BaseException | None = None) -> None:
        loop, future = self.open.pop(number)

        def done() -> None:
            if not future.done():
                future.set_result(None) if error is None else future.set_exception(error)

        loop.call_soon_threadsafe(done)

    def _rounds(self) -> None:
        try:
            while True:
                began = time.monotonic()
                with self.lock:
                    mine = {"now": time.time(), "asks": self.asks, "told": self.told, "done": self.done.is_set() and not self.open}
                    self.asks, self.told = [], []
                said = [json.loads(x) for x in self.gather(json.dumps(mine))]
                if all(x["done"] for x in said):
                    return
                granted = self.copy.round(said)
                with self.lock:
                    for task, number in granted:
                        if task == self.task:
                            self._settle(number)
                time.sleep(max(0.0, self.every - (time.monotonic() - began)))
        except BaseException as error:  # raised in the task's own thread by those that wait, and by finish
            with self.lock:
                self.error = error
                for number in list(self.open):
                    self._settle(number, error)
