"""Structured Streaming forms of the stateful operators: rate limit, sessions, answer cache, incremental ingestion."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.functions import rules
from textloom.operators.sessions import admit, micros


def rate_limited(requests: DataFrame, client: str = "client", ts: str = "ts", order: str = "event_id", limit: int = rules.RATE_LIMIT, window: int = rules.RATE_WINDOW) -> DataFrame:
    """A stream of requests with allowed and retry_after. State of a client: times of its allowed requests within the window, at most `limit` numbers."""
    kind = dict(requests.dtypes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(frames)).sort_values(["_t", order])
        found = admit([t / 1e6 for t in rows["_t"]], limit, window, held)
        state.update((list(held),))
        state.setTimeoutDuration(window * 1000)
        yield pd.DataFrame({client: key[0], order: rows[order].to_numpy(), "allowed": [a for a, _ in found], "retry_after": [r for _, r in found]})

    keyed = requests.select(client, order, micros(ts).alias("_t"))
    out = f"`{client}` {kind[client]}, `{order}` {kind[order]}, allowed boolean, retry_after int"
    return keyed.groupBy(client).applyInPandasWithState(step, out, "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def sessions(turns: DataFrame, key: str = "session_id", ttl: int = rules.SESSION_TTL, most: int = rules.SESSION_TURNS) -> DataFrame:
    """A stream of turns(session_id, turn, user, assistant) as each session's kept turns after every batch; idle sessions are forgotten."""
    kind = dict(turns.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        users, answers = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values("turn")
        users, answers = (users + rows["user"].tolist())[-most:], (answers + rows["assistant"].tolist())[-most:]
        state.update((users, answers))
        state.setTimeoutDuration(ttl * 1000)
        lines = [f"User: {u}\nAssistant: {a}" for u, a in zip(users[-rules.SESSION_HISTORY :], answers[-rules.SESSION_HISTORY :], strict=True)]
        yield pd.DataFrame({key: [k[0]], "n_turns": [len(users)], "history": ["\n".join(lines)]})

    own = turns.select(key, "turn", "user", "assistant")
    return own.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind[key]}, n_turns int, history string", "users array<string>, answers array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, key: str, ts: str = "ts", window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts of each key in tumbling windows; rows later than `late` are left out, so state stays bounded."""
    counted = events.withWatermark(ts, late).groupBy(key, F.window(ts, window).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def new_urls(pages: DataFrame, ts: str = "crawled_at", late: str = "1 day") -> DataFrame:
    """Pages whose url has not been seen within the watermark."""
    return pages.withWatermark(ts, late).dropDuplicatesWithinWatermark(["url"])


def expiring_cache(answers: DataFrame, ttl: int = rules.CACHE_TTL) -> DataFrame:
    """A stream of answers(key, value, ts) as cache rows with their expiry."""
    return answers.select("key", "value", (F.col("ts") + F.make_dt_interval(secs=F.lit(ttl))).alias("expires_at"))


def reply_to(messages: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that answers each micro-batch of messages and hands the answers to a sink; the source is acknowledged by its checkpoint."""
    return messages.writeStream.foreachBatch(lambda batch, n: sink(answer(batch), n)).option("checkpointLocation", checkpoint).start()
