"""State functions of the streaming jobs: small, per key, bounded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

REJECTED = "user_id string, request_id long, ts timestamp, recent long"
ACCEPTED = "times array<long>"
ALERT = "name string, event_id long, ts timestamp, previous_status string, status string"
LAST_STATUS = "status string, last_ts long, last_id long"


#: Rows that are taken up at once; a key's micro-batch is otherwise held as a few numbers a row.
BLOCK = 1 << 16
_NO_TIME = np.iinfo(np.int64).min


def _ordered(batches: Iterator[pd.DataFrame], tie: str, label: str | None = None) -> Iterator[tuple[np.ndarray, pd.api.extensions.ExtensionArray, np.ndarray]]:
    """The micro-batch rows of one key in event order, in blocks of ``(microseconds, tie, label)``.

    Frames are dropped as they come: a row stays as its time, its tie-breaker and the number of its label. Rows without a
    time come last, in blocks of their own.
    """
    times, ties, missing, labels, names = [], [], [], [], {}
    for batch in batches:
        if not len(batch):
            continue
        null = batch[tie].isna().to_numpy()
        times.append(batch["ts"].to_numpy("datetime64[us]").view(np.int64))
        ties.append(batch[tie].fillna(0).to_numpy(np.int64))
        missing.append(null)
        if label is not None:
            labels.append(np.array([names.setdefault(x, len(names)) for x in batch[label]], np.int32))
    if not times:
        return
    times, ties, missing = (np.concatenate(x) for x in (times, ties, missing))
    labels = np.concatenate(labels) if labels else None
    known = np.array(list(names), object)
    order = np.lexsort((ties, missing, times) if missing.any() else (ties, times))
    untimed = int((times == _NO_TIME).sum())
    for part in (order[untimed:], order[:untimed]):
        for i in range(0, len(part), BLOCK):
            at = part[i : i + BLOCK]
            yield times[at], pd.arrays.IntegerArray(ties[at], missing[at]), known[labels[at]] if labels is not None else known


def rate_limiter(limit: int, window_seconds: int) -> Callable:
    span = window_seconds * 1_000_000

    def check(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        times, last = list(state.get[0]) if state.exists else [], None
        for now, requests, _ in _ordered(batches, "request_id"):
            recent = np.full(len(now), -1)
            i = 0
            while i < len(now):
                at = int(now[i])
                times = [x for x in times if at - x < span]
                if len(times) < limit:
                    times.append(at)
                    i += 1
                else:  # everyone is turned away until the first accepted request leaves the window
                    j = int(np.searchsorted(now, min(times) + span)) if times else len(now)
                    recent[i:j] = len(times)
                    i = j
            last = int(now[-1]) // 1000
            turned = np.flatnonzero(recent >= 0)
            if len(turned):
                yield pd.DataFrame({
                    "user_id": pd.Series([key[0]] * len(turned), dtype=object), "request_id": requests[turned],
                    "ts": now[turned].view("datetime64[us]"), "recent": recent[turned],
                })
        if last is not None:
            state.update((times,))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + window_seconds * 1000 + 1)

    return check


def status_transitions(key, batches, state):
    """Emits each point whose status differs from that of the point before."""
    previous, last_ts, last_id = state.get if state.exists else (None, None, None)
    seen = False
    for micros, events, statuses in _ordered(batches, "event_id", "status"):
        seen, out = True, []
        for event, status, now in zip(events, statuses, micros.tolist(), strict=True):
            if last_ts is not None and (now, int(event)) <= (last_ts, last_id):
                continue  # arrived after a later point was already judged
            if previous is not None and status != previous:
                out.append((key[0], int(event), np.datetime64(now, "us"), previous, status))
            previous, last_ts, last_id = status, now, int(event)
        if out:
            yield pd.DataFrame(out, columns=["name", "event_id", "ts", "previous_status", "status"])
    if seen and previous is not None:
        state.update((previous, last_ts, last_id))
