"""Prompt sessions as a keyed state machine over a stream of operations."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id string, seq long, ok boolean, op string, detail string"
STATE = "state string"
#: Operations, and half-width of the crop that a session works in.
OPS = ("init", "set_image", "predict", "reset", "clear_context", "quit")
HALF = 512

Backend = Callable[[str, list, list, dict | None], dict]


def echo_backend(image: str, positive: list, negative: list, context: dict | None) -> dict:
    """A stand-in for a predictor: the positive points' box."""
    xs, ys = [p[0] for p in positive], [p[1] for p in positive]
    return {"box": [min(xs), min(ys), max(xs), max(ys)], "refined": context is not None}


def _prefix(old: list, new: list) -> bool:
    return new[: len(old)] == old


def step(state: dict, op: str, message: dict, backend: Backend = echo_backend) -> tuple[dict, bool, str]:
    """(state, ok, detail) after one operation. state: ready, image, crop, signature, context."""
    if op not in OPS:
        return state, False, f"unknown op {op}"
    if op == "init":
        return {"ready": True}, True, ""
    if op == "quit":
        return {}, True, ""
    if not state.get("ready"):
        return state, False, "not initialised"
    if op == "set_image":
        return {"ready": True, "image": message.get("image")}, True, ""
    if op == "reset":
        return {"ready": True}, True, ""
    if op == "clear_context":
        return {k: v for k, v in state.items() if k in ("ready", "image")}, True, ""
    if not state.get("image"):
        return state, False, "no image"
    positive, negative = message.get("positive") or [], message.get("negative") or []
    if not positive:
        return state, False, "no positive point"
    crop = state.get("crop")
    if not (crop and all(crop[0] <= x <= crop[2] and crop[1] <= y <= crop[3] for x, y in positive)):
        cx, cy = (min(p[0] for p in positive) + max(p[0] for p in positive)) / 2, (min(p[1] for p in positive) + max(p[1] for p in positive)) / 2
        crop, state = [cx - HALF, cy - HALF, cx + HALF, cy + HALF], {k: v for k, v in state.items() if k in ("ready", "image")}
    now = [[[round(x, 3), round(y, 3)] for x, y in part] for part in (positive, negative)]
    old = state.get("signature")
    refine = old is not None and _prefix(old[0], now[0]) and _prefix(old[1], now[1])
    got = backend(state["image"], positive, negative, state.get("context") if refine else None)
    return state | {"crop": crop, "signature": now, "context": got}, True, json.dumps(got, sort_keys=True)


def run(operations: DataFrame, backend: Backend = echo_backend, timeout_ms: int | None = 60_000) -> DataFrame:
    """operations: session_id, seq, op, message (JSON), streaming or not. Replies in order of seq within each batch.

    A session idle for timeout_ms is forgotten; None keeps sessions until they quit.
    """
    def apply(state_json: str | None, rows: pd.DataFrame) -> tuple[str, pd.DataFrame]:
        state, out = json.loads(state_json) if state_json else {}, []
        for r in rows.sort_values("seq").itertuples():
            try:
                message = json.loads(r.message) if isinstance(r.message, str) and r.message else {}
                state, ok, detail = step(state, r.op, message, backend)
            except ValueError as e:
                ok, detail = False, f"bad message: {e}"
            out.append((r.session_id, r.seq, ok, r.op, detail))
        return json.dumps(state), pd.DataFrame(out, columns=["session_id", "seq", "ok", "op", "detail"])

    if not operations.isStreaming:
        return operations.groupBy("session_id").applyInPandas(lambda pdf: apply(None, pdf)[1], OUT)

    def keyed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        new, out = apply(state.get[0] if state.exists else None, rows)
        if rows.sort_values("seq")["op"].iloc[-1] == "quit":
            if state.exists:
                state.remove()
        else:
            state.update((new,))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        yield out

    return operations.groupBy("session_id").applyInPandasWithState(keyed, OUT, STATE, "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
