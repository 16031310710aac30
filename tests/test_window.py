from __future__ import annotations

import asyncio
import os
import uuid

import pytest

from evalspark.operators import requests as reqs
from evalspark.operators import scoring
from evalspark.operators.window import WindowScorer
from evalspark.plans.catalog import DOC_QUALITY
from evalspark.session import new_path


def built(spark, texts):
    rows = spark.createDataFrame([(i, t, "1") for i, t in enumerate(texts)], "row_id long, text string, label string")
    return reqs.build_requests(DOC_QUALITY, rows, DOC_QUALITY.question())


def test_at_most_the_window_is_in_flight(spark):
    flight = {"now": 0}

    async def ask(request):
        flight["now"] += 1
        seen = flight["now"]
        await asyncio.sleep(0.02)
        flight["now"] -= 1
        return {"p_yes": 0.5, "input_tokens": seen}

    requests = built(spark, [f"text {i}" for i in range(40)])
    got = scoring.score_rows(requests, WindowScorer(ask, window=4, flush=7), parallelism=1).collect()
    assert len(got) == 40 and all(r["p_yes"] == 0.5 and r["error"] is None for r in got)
    assert max(r["input_tokens"] for r in got) == 4


def test_failures_deadlines_and_the_retry_budget(spark):
    tries = {}

    async def ask(request):
        text = request["state_json"]
        tries[text] = tries.get(text, 0) + 1
        if "slow" in text:
            await asyncio.sleep(30)
        if "down" in text or ("shaky" in text and tries[text] < 3):
            raise RuntimeError("down")
        return {"p_yes": "no number" if "odd" in text else 0.25}

    requests = built(spark, ["fine", "shaky", "slow", "down", "odd", "fine"])
    scorer = WindowScorer(ask, window=1, deadline_s=0.2, retries=40, pause_s=0.0)
    only = scoring.score_rows(built(spark, ["shaky"]), scorer, parallelism=1).first()
    assert only["p_yes"] == 0.25  # the third try
    got = {r["row_id"]: r for r in scoring.score_rows(requests, WindowScorer(ask, window=2, deadline_s=0.2, retries=3, pause_s=0.0), parallelism=1).collect()}
    assert got[0]["p_yes"] == got[5]["p_yes"] == 0.25
    assert got[2]["error"].startswith("TimeoutError") and got[3]["error"] == "RuntimeError: down" and got[4]["error"].startswith("Arrow")
    none = scoring.score_rows(built(spark, ["x"]).where("row_id < 0"), WindowScorer(ask))
    assert none.count() == 0


def test_answers_survive_a_task_that_dies(spark, tmp_path):
    asked, marker = tmp_path / "asked", tmp_path / "died"
    asked.mkdir()

    async def ask(request):
        if "deadly" in request["state_json"] and not marker.exists():
            await asyncio.sleep(0.5)
            marker.touch()
            os._exit(1)  # the worker is gone, with whatever it held
        (asked / f"{request['request_key']}-{uuid.uuid4().hex}").touch()
        return {"p_yes": 0.75}

    requests = built(spark, [f"text {i}" for i in range(30)] + ["deadly"]).coalesce(1)
    judge = WindowScorer(ask, window=3, flush=1, journal=new_path(spark, "journal-test"))
    with pytest.raises(Exception, match="exit|crash|lost|EOF"):
        scoring.score_rows(requests, judge, parallelism=1).collect()
    before = len(list(asked.iterdir()))
    assert marker.exists() and before > 0
    got = scoring.score_rows(requests, judge, parallelism=1).collect()
    assert len(got) == 31 and all(r["p_yes"] == 0.75 for r in got)
    again = [f.name.split("-")[0] for f in asked.iterdir()]
    assert len(set(again)) == 31 and len(again) <= 31 + 2  # only what was in flight was asked twice
