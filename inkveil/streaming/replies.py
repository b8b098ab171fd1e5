"""A chat model's streamed reply lines, put together as they arrive."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkveil.functions import fixed

_OUT = "content string, stop_reason string, error string"
_STATE = "lines string, content string, next int, over boolean"
_OBJECT = re.compile(r"\{[^{}]*\}")


def repeats(content: str) -> bool:
    """Whether an entity has come 3 times running, or 6 times in all, among the flat objects so far."""
    total: dict[str, int] = {}
    last, streak = None, 0
    for raw in _OBJECT.findall(content):
        try:
            own = json.loads(raw)
        except ValueError:
            continue
        if not (isinstance(own, dict) and isinstance(own.get("type"), str) and isinstance(own.get("value"), str)) or len(own["value"].strip()) < 2:
            continue
        key = f"{own['type']}:{own['value'].strip().lower()}"
        streak = streak + 1 if key == last else 1
        last, total[key] = key, total.get(key, 0) + 1
        if streak >= fixed.MAX_CONSECUTIVE or total[key] >= fixed.MAX_TOTAL:
            return True
    return False


def _taken(lines: dict[int, str], content: str, at: int) -> tuple[str, int, tuple[str | None, str | None] | None]:
    """The content with all lines that follow without a gap, the next line's number, and why it stopped."""
    while at in lines:
        own = json.loads(lines.pop(at))
        at += 1
        part = (own.get("message") or {}).get("content") or ""
        content += part
        if own.get("error") is not None or own.get("done"):
            return content, at, (own.get("done_reason"), own.get("error"))
        if "}" in part and repeats(content):
            return content, at, ("repeat", None)
    return content, at, None


def stream_replies(lines: DataFrame, delay: str = "10 minutes", wait_ms: int = 600_000) -> DataFrame:
    """(doc_id, page, content, stop_reason, error) of each reply, once: when it is done, has an error or has begun to
    repeat itself (stop_reason `repeat`; a caller can stop the model then), or when no line has come for `wait_ms`.

    lines: doc_id, page, seq from 0, line, ts. Lines may come late, twice and in any order: they are held until those
    before them have come. What is held of a page is its lines out of turn and its content so far; a page that is over
    is remembered until the watermark has passed it by `wait_ms`, so that lines that come again start nothing.
    """
    kinds = dict(lines.dtypes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, content, at, over = state.get if state.exists else ("{}", "", 0, False)
        own = {int(k): v for k, v in json.loads(held).items()}
        row = None
        if state.hasTimedOut:
            if not over:
                for k in sorted(own):  # what follows a gap is kept as it stands
                    more, _, stop = _taken({0: own[k]}, "", 0)
                    content += more
                    if stop and stop[0] != "repeat":
                        break
                row = (content, None, None)
            state.remove()
        else:
            latest = state.getCurrentWatermarkMs()
            for batch in batches:
                latest = max(latest, int(batch["ms"].max()))
                own |= {int(s): x for s, x in zip(batch["seq"], batch["line"]) if s >= at and not over}
            if not over:
                content, at, stop = _taken(own, content, at)
                if stop:
                    row, over, own, content = (content, *stop), True, {}, ""
            state.update((json.dumps(own), content, at, over))
            state.setTimeoutTimestamp(latest + wait_ms)
        if row:
            yield pd.DataFrame([(*key, *row)], columns=["doc_id", "page", "content", "stop_reason", "error"])

    rows = lines.withWatermark("ts", delay).select("doc_id", "page", "seq", "line", "ts", F.unix_millis("ts").alias("ms"))
    schema = f"doc_id {kinds['doc_id']}, page {kinds['page']}, {_OUT}"
    return rows.groupBy("doc_id", "page").applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
