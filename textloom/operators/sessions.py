"""Sessions, rate limits and chat replies as batch operators."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import rules
from textloom.functions import text as T


def micros(ts: str) -> Column:
    """Microseconds of a timestamp with or without zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def session_ids(turns: DataFrame, key: str = "session_id", ts: str = "ts", ttl: int = rules.SESSION_TTL) -> DataFrame:
    """turns with session_no: a new one where a turn comes more than ttl seconds after the one before."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = micros(ts) - F.lag(micros(ts)).over(w)
    return turns.withColumn("_new", (gap > ttl * 1_000_000).cast("int")).withColumn("session_no", F.coalesce(F.sum("_new").over(w), F.lit(0))).drop("_new")


def session_windows(events: DataFrame, key: str, ts: str = "ts", ttl: int = rules.SESSION_TTL) -> DataFrame:
    """key, start, end (of the last event) and n of each run of events with gaps of at most ttl seconds. Partial before its shuffle."""
    found = events.groupBy(key, F.session_window(ts, f"{ttl} seconds").alias("w")).agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("n"))
    return found.drop("w")


def last_turns(turns: DataFrame, n: int = rules.SESSION_HISTORY, key: str = "session_id", order: str = "turn") -> DataFrame:
    """The last n turns of each session; each partition keeps its own n before the shuffle."""
    ranked = turns.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    return ranked.where(F.col("_r") <= n).drop("_r")


def history(turns: DataFrame, key: str = "session_id", order: str = "turn") -> DataFrame:
    """key, history: `User: ...` and `Assistant: ...` lines of the last turns(user, assistant)."""
    line = F.concat(F.lit("User: "), "user", F.lit("\nAssistant: "), "assistant")
    own = last_turns(turns, key=key, order=order).select(key, F.struct(order, line.alias("l")).alias("s"))
    return own.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["l"]), "\n").alias("history"))


def admit(times: list[float], limit: int = rules.RATE_LIMIT, window: int = rules.RATE_WINDOW, held: deque | None = None, unit: int = 1) -> list[tuple[bool, int]]:
    """(allowed, retry_after in seconds of `unit`) of requests at ascending times: a request is refused while `limit` allowed ones lie within the window; refused ones are not remembered."""
    held = deque() if held is None else held
    out = []
    for now in times:
        while held and held[0] <= now - window:
            held.popleft()
        if len(held) >= limit:
            out.append((False, int((held[0] + window - now) // unit) + 1))
        else:
            held.append(now)
            out.append((True, 0))
    return out


def rate_limited(requests: DataFrame, client: str = "client", ts: str = "ts", order: str = "event_id", limit: int = rules.RATE_LIMIT, window: int = rules.RATE_WINDOW, path: str | None = None) -> DataFrame:
    """requests(client, ts, order) with allowed and retry_after.

    Refused requests are not remembered, so a range frame would count too many. But only a client with more than
    `limit` requests within some window can be refused at all: those runs, cut where a pause of a window empties the
    memory, are walked; everyone else is allowed by built-ins. Order is the semantics here, so a client's requests do
    meet in one window, as narrow rows (client, time, order); a run is as long as its client never pauses.
    """
    own = requests if path is None else requests.where(~F.col(path).isin(rules.RATE_EXEMPT))
    w = Window.partitionBy(client).orderBy(ts, order)
    at = micros(ts)
    gap = at - F.lag(at).over(w)
    run = F.sum((F.coalesce(gap, F.lit(0)) >= window * 1_000_000).cast("int")).over(w)
    busy = at - F.lag(at, limit).over(w) < window * 1_000_000  # the limit-th request before lies within the window
    rows = own.select(client, ts, order, at.alias("_t"), run.alias("_run"), F.coalesce(busy, F.lit(False)).alias("_busy"))
    hot = rows.groupBy(client, "_run").agg(F.bool_or("_busy").alias("_hot"))
    marked = rows.drop("_busy").join(hot, [client, "_run"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, order])
        found = admit(pdf["_t"].tolist(), limit, window * 1_000_000, unit=1_000_000)
        return pdf.assign(allowed=[a for a, _ in found], retry_after=[r for _, r in found])[[client, order, "allowed", "retry_after"]]

    kind = dict(own.dtypes)
    schema = f"`{client}` {kind[client]}, `{order}` {kind[order]}, allowed boolean, retry_after int"
    walked = marked.where("_hot").groupBy(client, "_run").applyInPandas(walk, schema)
    free = marked.where("not _hot").select(client, order, F.lit(True).alias("allowed"), F.lit(0).alias("retry_after"))
    return free.unionByName(walked)


def incoming(messages: DataFrame) -> DataFrame:
    """Chat messages to answer: of the message event, not one's own, with a body."""
    return messages.where((F.col("event") == "message") & ~F.coalesce(F.col("data.fromMe"), F.lit(False)) & (T.trim(T.text_or_empty(F.col("data.body"))) != "")).select(F.col("data.id").alias("id"), F.col("data.from").alias("session_id"), T.trim(F.col("data.body")).alias("query"))


def reply(answer: Column, sources: Column, documents: Column) -> Column:
    """An answer with up to five numbered sources and up to five documents."""
    sources = F.slice(F.coalesce(sources, F.array().cast("array<struct<title:string,url:string>>")), 1, rules.SHOWN)
    documents = F.slice(F.coalesce(documents, F.array().cast("array<struct<title:string,url:string>>")), 1, rules.SHOWN)
    listed = F.transform(sources, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["title"], F.lit(" - "), s["url"]))
    linked = F.transform(documents, lambda d: F.concat(F.lit("- "), d["title"], F.lit(": "), d["url"]))
    return F.concat(answer, F.when(F.size(listed) > 0, F.concat(F.lit("\n\nSources:\n"), F.array_join(listed, "\n"))).otherwise(""), F.when(F.size(linked) > 0, F.concat(F.lit("\n\nDocuments:\n"), F.array_join(linked, "\n"))).otherwise(""))


def documents_text(language: Column, documents: Column) -> Column:
    """A heading in the query's language and the first five documents; empty without one."""
    from textloom.operators.query_analysis import message

    lines = F.transform(F.slice(documents, 1, rules.SHOWN), lambda d: F.concat(F.lit("- "), d["title"], F.lit(" ("), d["document_type"], F.lit("): "), d["url"]))
    return F.when(F.size(documents) > 0, F.concat(message(rules.DOCUMENTS_HEADING, language), F.lit("\n"), F.array_join(lines, "\n"))).otherwise("")
