"""Life cycles of requests on a stream of a run log's events: the rules of runlog.request_spans() as state.

An id's state is its open span. A start opens one (an open one is lost), any other event opens one if there is none and
adds what it says; a finish closes it, and its row goes out. An id that is silent for long, by the
stream's own time, goes out as open and is forgotten. Events of a batch are taken in their order; those of
an earlier line must not come in a later batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROW = (
    "log string, request_id string, place long, request_name string, status string, start_ms double, end_ms double, closed long, lane string, attempt string, "
    "retries long, heartbeats array<double>, ready_ms double, model string, input_tokens long, output_tokens long, cache_read_tokens long, usage_cost double"
)
_NAMES = [c.split(" ")[0] for c in ROW.split(", ")]
_EVENTS = ("requestStart", "requestReady", "requestHeartbeat", "requestRetrying", "requestFinished")
_WAITS = ("lane_wait_ms", "semaphore_wait_ms", "client_wait_ms", "session_create_ms")
_READ = ("event", "entry", "ts_ms", "request_name", "duration_ms", *_WAITS, "lane", "attempt", "attempt_max", "model", "input_tokens", "output_tokens", "cache_read_tokens", "usage_cost")


def _known(x: Any) -> Any:
    return None if pd.isna(x) else x


def advance(span: dict | None, e: dict) -> tuple[dict | None, dict | None]:
    """The open span after an event, and the span that it closed."""
    kind = e["event"]
    worked = sum(e[w] or 0.0 for w in _WAITS) if kind == "requestReady" else 0.0 if kind == "requestStart" else e["duration_ms"] or 0.0
    if kind == "requestStart" or span is None:
        span = {"place": e["entry"], "request_name": e["request_name"], "start_ms": e["ts_ms"] - worked, "retries": 0, "heartbeats": []}
    end = max(e["ts_ms"], span["start_ms"] + worked) if worked else e["ts_ms"]
    if kind in ("requestReady", "requestHeartbeat"):
        span |= {"lane": e["lane"], "attempt": f"{int(e['attempt'])}/{int(e['attempt_max'])}"}
    if kind in ("requestStart", "requestRetrying", "requestFinished"):
        span["model"] = e["model"]
    if kind == "requestReady":
        span["ready_ms"] = end
    elif kind == "requestHeartbeat":
        span["heartbeats"].append(end)
    elif kind == "requestRetrying":
        span["retries"] += 1
    elif kind == "requestFinished":
        used = {c: e[c] for c in ("input_tokens", "output_tokens", "cache_read_tokens", "usage_cost")}
        return None, span | used | {"status": "success", "closed": e["entry"], "end_ms": max(end, span["start_ms"])}
    return span, None


def request_spans(events: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """events: loggrammar.events() of a stream with a watermark on ts (of requests' lines alone, as Spark filters first). Rows of ROW: closed spans as they close, and open ones
    once the watermark is idle_ms beyond their last event, which they then end with."""
    asked = events.where(F.col("event").isin(*_EVENTS)).select("log", "request_id", "ts", *_READ)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        span, last = json.loads(state.get[0]) if state.exists else (None, 0.0)
        if state.hasTimedOut:
            if span:
                out.append(span | {"status": "open", "end_ms": max(last, span["start_ms"])})
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("entry")
            for row in rows[list(_READ)].to_dict("records"):
                e = {c: _known(v) for c, v in row.items()}
                span, done = advance(span, e)
                last = max(last, e["ts_ms"])
                if done:
                    out.append(done)
            if span is None:
                if state.exists:
                    state.remove()
            else:
                state.update((json.dumps([span, last], default=int),))
                state.setTimeoutTimestamp(max(int(last) + idle_ms, state.getCurrentWatermarkMs() + 1))
        made = pd.DataFrame([{"log": key[0], "request_id": key[1]} | s for s in out], columns=_NAMES)
        for c in ("place", "closed", "retries", "input_tokens", "output_tokens", "cache_read_tokens"):
            made[c] = made[c].astype("Int64")
        for c in ("log", "request_id", "request_name", "status", "lane", "attempt", "model"):
            made[c] = made[c].astype(object).where(made[c].notna(), None)  # not pandas' own texts, which come in chunks
        yield made

    return asked.groupBy("log", "request_id").applyInPandasWithState(step, ROW, "open string", "append", GroupStateTimeout.EventTimeTimeout)
