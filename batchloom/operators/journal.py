"""A journal of settled calls: answers outlive the task that got them, and a failure stops every task.

Tasks write segments of JSON lines to a folder that driver and executors share, named by the first and
last index inside. A task that is tried again finds there what its rows have got already and replays
it instead of calling. In a strict run the first failure is noted in ``stop.json``: other tasks, and tries of the
same one, see it before their next call and raise the same error without calling. The driver can follow
the segments while the job runs, and hand each settled row to a callback.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from batchloom.schemas import DISPATCHED

STOP = "stop.json"
GRACE = 1.5


class StoppedError(RuntimeError):
    """A strict run failed elsewhere."""


class Journal:
    """A folder, by a URI or path that ``pyarrow.fs`` opens."""

    def __init__(self, uri: str):
        from pathlib import Path

        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else Path(uri).absolute().as_uri())
        self.store.create_dir(self.root, recursive=True)
        self._checked, self._stop = 0.0, None

    def _put(self, name: str, text: str) -> None:
        """Whole or not at all: written under another name, then moved."""
        beside = f"{self.root}/_{uuid.uuid4().hex}"
        with self.store.open_output_stream(beside) as out:
            out.write(text.encode())
        self.store.move(beside, f"{self.root}/{name}")

    def _get(self, name: str) -> str:
        with self.store.open_input_stream(f"{self.root}/{name}") as f:
            return f.read().decode()

    def write(self, rows: list[dict]) -> None:
        if rows:
            found = [r["_index"] for r in rows]
            self._put(f"{min(found):016d}-{max(found):016d}-{uuid.uuid4().hex}.jsonl", "".join(json.dumps(r) + "\n" for r in rows))

    def segments(self) -> list[str]:
        from pyarrow import fs

        files = self.store.get_file_info(fs.FileSelector(self.root))
        return sorted(f.base_name for f in files if f.base_name.endswith(".jsonl") and not f.base_name.startswith("_"))

    def rows(self, name: str) -> Iterator[dict]:
        for line in self._get(name).splitlines():
            yield json.loads(line)

    def load(self, first: int, last: int) -> dict[int, dict]:
        """What rows with indices from ``first`` to ``last`` have got."""
        found = {}
        for name in self.segments():
            low, high = map(int, name.split("-")[:2])
            if low <= last and high >= first:
                found |= {r["_index"]: r for r in self.rows(name) if first <= r["_index"] <= last}
        return found

    def stop(self, error: BaseException) -> None:
        if self.stopped(0.0) is None:
            self._put(STOP, json.dumps({"error": str(error), "type": type(error).__name__}))

    def stopped(self, every: float = 0.2) -> dict | None:
        """The failure that ended the run; looked for every so many seconds."""
        from pyarrow import fs

        now = time.monotonic()
        if self._stop is None and now - self._checked >= every:
            self._checked = now
            if self.store.get_file_info(f"{self.root}/{STOP}").type == fs.FileType.File:
                self._stop = json.loads(self._get(STOP))
        return self._stop

    def check(self, every: float = 0.2) -> None:
        found = self.stopped(every)
        if found is not None:
            raise StoppedError(f"stopped by {found['type']}: {found['error']}")

    def reopen(self) -> None:
        """Let a stopped run go on; its answers stay."""
        if self.stopped(0.0) is not None:
            self.store.delete_file(f"{self.root}/{STOP}")
            self._stop = None


def answered(spark: SparkSession, uri: str) -> DataFrame:
    """The journal's rows as dispatch gives them, one for each index."""
    rows = spark.read.schema(DISPATCHED).option("pathGlobFilter", "*.jsonl").json(uri)
    return rows.dropDuplicates(["_index"])


def followed(uri: str, action: Callable[[], object], on_row: Callable[[dict], None], every: float = 0.2) -> object:
    """Do ``action`` (which runs a dispatch with this journal) and hand each settled row to ``on_row`` meanwhile,
    in this thread and once each. The driver holds a segment at a time, and the names of those it has seen."""
    journal, seen, done = Journal(uri), set(), threading.Event()
    out: list = []

    def work() -> None:
        try:
            out.append((action(), None))
        except BaseException as error:  # raised again below, in the caller's thread
            out.append((None, error))
        finally:
            done.set()

    def fresh(names: Iterable[str]) -> None:
        for name in names:
            if name not in seen:
                seen.add(name)
                for row in journal.rows(name):
                    on_row(row)

    seen |= set(journal.segments())
    worker = InheritableThread(target=work, daemon=True)  # with the job tags of this one
    worker.start()
    while not done.wait(every):
        fresh(journal.segments())
    worker.join()
    result, error = out[0]
    if error is not None:
        time.sleep(GRACE)  # a failed job's other tasks are still writing what they got
    fresh(journal.segments())
    if error is not None:
        raise error
    return result
