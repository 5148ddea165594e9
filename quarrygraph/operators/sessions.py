"""Session, turn, queue and report analytics in batch form; :mod:`quarrygraph.streaming` has them over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygraph.functions import text as T
from quarrygraph.plans.shared import cut

#: Idle hours that close a session, events and bytes that a queue keeps, remembered pointers.
IDLE_HOURS, KEEP_EVENTS, KEEP_BYTES, REMEMBER = 2, 500, 256 << 10, 40
#: Fixed multipliers of the price of written and read cache tokens.
CACHE_WRITE, CACHE_READ = 1.25, 0.1


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", hours: int = IDLE_HOURS) -> DataFrame:
    """``(user, start, end, events)``: a gap of ``hours`` or more closes a session; ``end`` is the last event."""
    gap = F.session_window(ts, f"{hours} hours")
    out = events.groupBy(F.col(user), gap).agg(F.count("*").alias("events"), F.max(ts).alias("end"))
    return out.select(user, F.col("session_window.start").alias("start"), "end", "events")


def session_report(sessions_: DataFrame) -> DataFrame:
    """``(events_bucket, duration_bucket, sessions)``."""
    ms = (F.col("end").cast("double") - F.col("start").cast("double")) * 1000
    return sessions_.groupBy(T.count_bucket(F.col("events")).alias("events_bucket"), T.duration_bucket(ms).alias("duration_bucket")).agg(F.count("*").alias("sessions"))


def session_counters(events: DataFrame, user: str = "user_id") -> DataFrame:
    """Per-user counters by event type, and the latest event."""
    return events.groupBy(user).agg(F.count("*").alias("events"), *[F.sum((F.col("event_type") == k).cast("bigint")).alias(f"n_{k}") for k in ("click", "view", "purchase")], F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


def last_write_wins(items: DataFrame, key: str, order: Column, first: Column) -> DataFrame:
    """Each key's latest item at the place of the key's first one."""
    return items.groupBy(key).agg(F.max_by(F.struct(*[c for c in items.columns if c != key]), order).alias("item"), F.min(first).alias("place")).select(key, "item.*", "place")


def queue_tail(events: DataFrame, seq: str, size: Column, most: int = KEEP_EVENTS, most_bytes: int = KEEP_BYTES) -> DataFrame:
    """The newest events that fit both caps, up to the first that doesn't. The candidates are at most ``most`` rows, so
    one window holds them."""
    newest = events.orderBy(F.col(seq).desc()).limit(most)
    total = F.sum(size).over(Window.orderBy(F.col(seq).desc()).rowsBetween(Window.unboundedPreceding, 0))
    return newest.withColumn("bytes_so_far", total).where(F.col("bytes_so_far") <= most_bytes)


def novel(pointers: DataFrame, session: str, pointer: str, seq: str, remember: int = REMEMBER) -> DataFrame:
    """Rows whose pointer isn't among the session's last ``remember`` rows. A window by (session, pointer) finds the
    last time; a row's number in its session is counted in the session."""
    numbered = pointers.withColumn("n", F.row_number().over(Window.partitionBy(session).orderBy(seq)))
    before = F.lag("n").over(Window.partitionBy(session, pointer).orderBy(seq))
    return numbered.withColumn("before", before).where(F.col("before").isNull() | (F.col("n") - F.col("before") > remember)).drop("before", "n")


def turn_cost(messages: DataFrame, key: str = "message_id") -> DataFrame:
    """``(session, micros, tokens)`` in millionths of a dollar of ``messages(session, message_id, input_tokens,
    cache_write, cache_read, price)``, each message once; ``price`` is dollars a million tokens."""
    once = messages.dropDuplicates(["session", key])
    micros = F.round((F.col("input_tokens") + CACHE_WRITE * F.col("cache_write") + CACHE_READ * F.col("cache_read")) * F.col("price")).cast("bigint")
    return once.groupBy("session").agg(F.sum(micros).alias("micros"), F.sum(F.col("input_tokens") + F.col("cache_write") + F.col("cache_read")).alias("tokens"))


def audit(turns: DataFrame) -> DataFrame:
    """One row over ``turns(saved, reported)``: turns, share reported, median saved, share within ten percent, outliers."""
    return turns.agg(
        F.count("*").alias("turns"),
        F.round(100.0 * F.count("reported") / F.count("*"), 4).alias("reported_percent"),
        F.median("saved").alias("median_saved"),
        F.round(100.0 * F.sum((F.abs(F.col("reported") - F.col("saved")) <= 0.1 * F.col("saved")).cast("bigint")) / F.count("reported"), 4).alias("within_percent"),
        F.sum((F.col("reported") >= 1_000_000).cast("bigint")).alias("outliers"),
    )


def nearest_rank(values: DataFrame, value: str, p: float) -> DataFrame:
    """The ``ceil(n * p)``-th smallest value, exactly: distinct values are counted and dealt by range; the ranges' sums
    say which one holds the rank, and only its values are summed one by one."""
    n = cut(values.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")).repartitionByRange("value").withColumn("range", F.spark_partition_id()), "ranges")
    sums = n.groupBy("range").agg(F.sum("n").alias("own"))
    upto = sums.withColumn("upto", F.sum("own").over(Window.orderBy("range"))).crossJoin(F.broadcast(n.agg(F.ceil(F.sum("n") * p).alias("rank"))))  # a row a range; one row
    held = upto.where("upto >= rank").agg(F.min_by(F.struct("range", (F.col("upto") - F.col("own")).alias("before"), "rank"), "range").alias("h")).select("h.*")
    run = n.join(F.broadcast(held), "range").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("range").orderBy("value")))
    return run.where("upto >= rank").agg(F.min("value").alias("value"))


def _batches(budget: int, size: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        number, used, out = 0, 0, []
        for n in pdf[size]:
            if used and used + n > budget:
                number, used = number + 1, 0
            used += n
            out.append(number)
        return pdf.assign(batch=out)[["group", "seq", "batch"]]

    return run


def pack_batches(items: DataFrame, group: str, seq: str, size: str, budget: int = 48_000) -> DataFrame:
    """``(group, seq, batch)``: items in order go into a batch until the next would pass the budget; a larger item has a
    batch of its own. A fold in order, one group at a time."""
    plain = items.select(F.col(group).cast("string").alias("group"), F.col(seq).cast("bigint").alias("seq"), F.col(size).cast("bigint").alias("size"))
    return plain.groupBy("group").applyInPandas(_batches(budget, "size"), "group string, seq bigint, batch bigint")


def budgeted(items: DataFrame, order: list[Column], size: Column, budget: int = 300_000, most: int = 120) -> DataFrame:
    """Items in order that still fit the budget, too large ones skipped, ``most`` at the end. ``order`` are columns
    without nulls that order the items fully.

    Each pass takes the keys of the next ``most`` rows that fit what is left, by a top-k in each task. The first of them
    always goes in, so there are at most ``most`` passes, and nothing but their keys reaches the driver."""
    names = [f"__{k}" for k in range(len(order))]
    sized = items.select(*[c.alias(n) for c, n in zip(order, names, strict=True)], size.cast("bigint").alias("__size"))
    taken: list[tuple] = []
    left, last = budget, None
    while len(taken) < most:
        rest = sized.where(F.col("__size") <= left)
        if last is not None:
            later, same = F.lit(False), F.lit(True)
            for n, v in zip(names, last, strict=True):
                later, same = later | (same & (F.col(n) > F.lit(v))), same & (F.col(n) == F.lit(v))
            rest = rest.where(later)
        page = rest.orderBy(*names).limit(most).collect()
        for *key, n in page:
            if len(taken) < most and n <= left:
                taken.append(tuple(key))
                left -= n
        if len(page) < most:
            break
        last = page[-1][:-1]
    keys = items.sparkSession.createDataFrame(taken, sized.select(*names).schema)
    on = [c == F.col(n) for c, n in zip(order, names, strict=True)]
    return items.join(F.broadcast(keys), on, "left_semi")  # at most ``most`` rows


def circuit_breaker(attempts: DataFrame, group: str, seq: str, limit: int = 5) -> DataFrame:
    """``(group, tried, stopped)`` of ``attempts(group, seq, outcome)``: a run stops after ``limit`` failures in a row or
    at a terminal one; quality misses neither count nor reset."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = tried = 0
        stopped = False
        for outcome in pdf.sort_values(seq)["outcome"]:
            tried += 1
            row = 0 if outcome == "ok" else row + (outcome == "failed")
            if outcome == "terminal" or row >= limit:
                stopped = True
                break
        return pd.DataFrame({group: [pdf[group].iloc[0]], "tried": [tried], "stopped": [stopped]})

    kind = attempts.schema[group].dataType.simpleString()
    return attempts.select(group, seq, "outcome").groupBy(group).applyInPandas(run, f"{group} {kind}, tried bigint, stopped boolean")


def admitted(events: DataFrame) -> DataFrame:
    """``events(event, action, draft)`` with ``skip``: null for what is worked on, else the reason."""
    reason = (
        F.when(~F.col("event").isin("pull_request", "issue_comment", "push"), "event")
        .when((F.col("event") == "pull_request") & ~F.coalesce("action", F.lit("")).isin("opened", "synchronize", "reopened", "ready_for_review"), "action")
        .when((F.col("event") == "pull_request") & F.coalesce("draft", F.lit(False)), "draft")
    )
    return events.withColumn("skip", reason)


#: Fixed names of tools that read sources, and of shells.
SOURCE_TOOLS, SHELLS = ("read", "grep", "glob", "search"), ("bash", "shell")


def tool_use(tool: Column, command: Column, own_tools: list[str], own_command: str) -> Column:
    """``own``, ``source`` or null for a use of a tool: an own tool under any server prefix, a tool that reads sources,
    or a shell whose command line calls our program at the start of one of its parts."""
    t = F.lower(F.coalesce(tool, F.lit("")))
    called = command.rlike(rf"(?i)(^|[|&;]\s*)(npx\s+(-y\s+)?)?{own_command}\b")
    return F.when(F.element_at(F.split(t, "[:./]|__"), -1).isin(own_tools), "own").when(t.isin(*SOURCE_TOOLS), "source").when(t.isin(*SHELLS) & F.coalesce(called, F.lit(False)), "own")


def mix_label(own: Column, source: Column) -> Column:
    """The share of our own reads in whole percent."""
    own, source = F.coalesce(own, F.lit(0)), F.coalesce(source, F.lit(0))
    return F.when(own + source == 0, "no retrieval yet").otherwise(F.concat(F.floor(100 * own / (own + source) + 0.5).cast("string"), F.lit("%")))


def latest_session(sessions_: DataFrame) -> DataFrame:
    """The session changed last as one row; of several the greatest id. ``sessions_(session, mtime, ...)``."""
    return sessions_.agg(F.max_by(F.struct(*sessions_.columns), F.struct("mtime", "session")).alias("s")).where("s is not null").select("s.*")


def price_of(model: Column, rates: list[tuple[str, float]]) -> Column:
    """Dollars a million tokens by the first pattern that the model's name matches at its start; null for none. Prices
    change, so the table is the caller's."""
    out = F.lit(None).cast("double")
    for pattern, usd in reversed(rates):
        out = F.when(model.rlike("^(?:" + pattern + ")"), F.lit(float(usd))).otherwise(out)
    return out


def turn_micros(price: Column, fresh: Column, cache_write: Column, cache_read: Column) -> Column:
    """Millionths of a dollar of a turn's input; null where the price isn't known."""
    return F.floor((fresh + CACHE_WRITE * cache_write + CACHE_READ * cache_read) * price + 0.5).cast("bigint")


def dollars_saved(saved: Column, micros: Column, tokens: Column) -> Column:
    """Saved tokens at the rate that the session has paid so far; null where nothing was billed or saved."""
    known = (F.coalesce(micros, F.lit(0)) != 0) & (F.coalesce(tokens, F.lit(0)) != 0) & (saved > 0)
    return F.when(known, saved * (micros / tokens) / 1_000_000)
