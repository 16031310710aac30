"""A judge asked request by request, a bounded number of them at a time, whose answers are kept as they come."""

from __future__ import annotations

import asyncio
import sys
import time
import uuid
from collections.abc import Awaitable, Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from evalspark.session import new_path
from evalspark.sources.answers import RECORD, as_records

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Ask = Callable[[dict], Awaitable[dict]]


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _kept(system: pafs.FileSystem, folder: str) -> list[dict]:
    """Answers kept by tries of this task that died."""
    found = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    files = [f.path for f in found if f.path.endswith(".parquet")]
    return [record for f in files for record in pq.read_table(f, filesystem=system, partitioning=None).to_pylist()]


def _keep(records: list[dict], schema: pa.Schema, system: pafs.FileSystem, folder: str) -> None:
    """Whole files only: written under a name that readers skip, and renamed."""
    name = uuid.uuid4().hex
    system.create_dir(folder, recursive=True)
    pq.write_table(pa.Table.from_pylist(records, schema=schema), f"{folder}/_{name}", filesystem=system)
    system.move(f"{folder}/_{name}", f"{folder}/{name}.parquet")


class WindowScorer:
    """Asks with the coroutine ``ask``, which takes a request (request_key, model, state_json) and returns the fields of its answer.

    A task has at most ``window`` requests in flight. A request is cancelled after ``deadline_s`` seconds and asked again after a growing pause
    when it fails, as long as its task has some of ``retries`` left; then it becomes an error record. Every ``flush`` answers a task writes
    them to the ``journal``, a folder that all executors reach. What lies there is never asked again: not by the next try of a
    task that died, nor by a later run with the same journal. Failures are not kept. A task holds ``window`` requests and ``flush`` answers,
    and at its start the answers kept by its own earlier tries.
    """

    def __init__(self, ask: Ask, window: int = 16, deadline_s: float = 60.0, retries: int = 100, flush: int = 100, pause_s: float = 0.5,
                 journal: str | None = None) -> None:
        self.ask, self.window, self.deadline_s, self.retries = ask, window, deadline_s, retries
        self.flush, self.pause_s, self.journal = flush, pause_s, journal

    def score(self, requests: DataFrame) -> DataFrame:
        spark = requests.sparkSession
        journal = self.journal or new_path(spark, "journal")
        try:
            known = spark.read.schema(RECORD).option("recursiveFileLookup", "true").parquet(journal).dropDuplicates(["request_key"])
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            known = spark.createDataFrame([], RECORD)
        open_ones = requests.join(known.select("request_key"), "request_key", "left_anti").select("request_key", "model", "state_json")
        reused = known.join(requests.select("request_key"), "request_key", "left_semi")
        run = self._task(f"{journal}/{uuid.uuid4().hex}", to_arrow_schema(RECORD))
        return as_records(reused).unionByName(open_ones.mapInPandas(run, RECORD))

    def _task(self, journal: str, schema: pa.Schema) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        ask, window, deadline_s, retries = self.ask, self.window, self.deadline_s, self.retries
        flush, pause_s, names = self.flush, self.pause_s, RECORD.names

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            system, folder = _folder(f"{journal}/{TaskContext.get().partitionId()}")
            earlier = {r["request_key"]: r for r in _kept(system, folder)}
            left = [retries]

            async def answered(request: dict) -> dict:
                pause = pause_s
                while True:
                    start = time.monotonic()
                    try:
                        fields = await asyncio.wait_for(ask(dict(request)), deadline_s)
                        record = {"model": request["model"], "latency_s": time.monotonic() - start, **fields, "request_key": request["request_key"]}
                        pa.Table.from_pylist([record], schema=schema)  # an answer of the wrong type fails alone
                        return record
                    except Exception as err:  # noqa: BLE001 - a failure is a record
                        if left[0] <= 0:
                            return {"request_key": request["request_key"], "error": f"{type(err).__name__}: {err}"}
                    left[0] -= 1
                    await asyncio.sleep(pause)
                    pause *= 2

            def frame(records: list[dict]) -> pd.DataFrame:
                return pd.DataFrame([{n: r.get(n) for n in names} for r in records], columns=names, dtype=object)

            loop = asyncio.new_event_loop()
            flying: set[asyncio.Task] = set()
            ready: list[dict] = []

            def landed(room: int) -> Iterator[pd.DataFrame]:
                """Wait until at most ``room`` requests are in flight; answers leave in groups."""
                nonlocal flying, ready
                while len(flying) > room:
                    done, flying = loop.run_until_complete(asyncio.wait(flying, return_when=asyncio.FIRST_COMPLETED))
                    ready += [d.result() for d in done]
                    if len(ready) >= flush or not flying:
                        good = [r for r in ready if r.get("error") is None]
                        if good:
                            _keep(good, schema, system, folder)
                        yield frame(ready)
                        ready = []

            try:
                for batch in batches:
                    for request in batch.to_dict("records"):
                        if request["request_key"] in earlier:
                            yield frame([earlier[request["request_key"]]])
                            continue
                        yield from landed(window - 1)
                        flying.add(loop.create_task(answered(request)))
                yield from landed(0)
                if ready:
                    yield frame(ready)
            finally:
                for task in flying:
                    task.cancel()
                if flying:
                    loop.run_until_complete(asyncio.gather(*flying, return_exceptions=True))
                loop.close()

        return run
