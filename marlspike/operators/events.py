"""Audit, telemetry, cache replay, rate limits, presence, tasks: analytics over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.functions.times import millis
from marlspike.operators.iterate import folded

#: Limits by default, and windows in milliseconds.
LIMITS = {"minute": 60, "hour": 1000, "day": 10_000}
WINDOWS = {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
MULTIPLIERS = {"critical": None, "high": 2.0, "normal": 1.0, "low": 0.5}

# Parts of messages by which an error counts as transient.
TRANSIENT = [
    "econnreset", "econnrefused", "epipe", "etimedout", "enotfound", "fetch failed", "network", "500", "502", "503", "504", "internal server error",
    "service unavailable", "gateway timeout", "429", "too many requests", "timeout", "timed out",
]
# Prices by model, for a million tokens in and out.
PRICES = [
    ("claude-sonnet-4-20250514", 3.0, 15.0), ("claude-opus-4-20250514", 15.0, 75.0), ("claude-3-5-sonnet-20241022", 3.0, 15.0),
    ("gpt-4-turbo", 10.0, 30.0), ("gpt-4o", 2.5, 10.0), ("gpt-4o-mini", 0.15, 0.6),
]


def audit_search(audit: DataFrame, last: int | None = None, category=None, actor=None, target=None, outcome=None, since=None, until=None) -> DataFrame:
    """Entries that meet all predicates; with ``last``, of the last so many entries alone (the cut comes first)."""
    d = audit if last is None else audit.orderBy(F.desc("ts"), F.desc("id")).limit(last)
    for column, value in (("category", category), ("actor", actor), ("target", target), ("outcome", outcome)):
        if value is not None:
            d = d.filter(F.col(column) == value)
    if since is not None:
        d = d.filter(F.col("ts") >= since)
    return d if until is None else d.filter(F.col("ts") <= until)


def tool_telemetry(calls: DataFrame) -> DataFrame:
    """By tool: calls, errors, error and cache-hit percentages, mean duration, retries."""
    d = calls.groupBy("tool").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.avg("duration").alias("avg_duration"),
        F.count_if("cache_hit").alias("hits"), F.sum("retries").alias("retries"),
    )
    share = lambda c: 100 * F.col(c) / F.col("calls")
    return d.withColumns({"error_pct": share("errors"), "hit_pct": share("hits")})


def cache_replay(calls: DataFrame, ttl: float) -> DataFrame:
    """``calls(id, session, ts, key, mutating)`` with ``hit``: an equal key was stored within ``ttl`` seconds and nothing was changed since.

    Only misses store, so the place of the last store is carried along: a hit
    chain must not reach back further than ttl to its miss.
    """
    order = Window.partitionBy("session").orderBy("ts", "id")
    changed = F.max(F.when(F.col("mutating"), F.col("id"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = calls.withColumn("change", F.coalesce(changed, F.lit(-1))).filter("not mutating")
    # calls of one key between two changes, in order: a miss opens a period of ttl seconds
    micros = int(ttl * 1e6)

    def step(state: dict, row: tuple) -> tuple:
        session, key, _, us, i = row
        hit = "since" in state and us - state["since"] < micros
        if not hit:
            state["since"] = us
        return session, key, i, hit

    kinds = dict(calls.dtypes)
    d = d.select("session", "key", "change", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "id")
    return folded(d, ["session", "key", "change"], ["us", "id"], step, f"session {kinds['session']}, key {kinds['key']}, id {kinds['id']}, hit boolean")


def reuse_distances(calls: DataFrame, most: int = 1000) -> DataFrame:
    """``session, key, id, distance`` of ``calls(id, session, ts, key)``: how many other keys a session used since it last used this one.

    Null where it never did, or ``most`` others came between. A cache of c keys that
    drops the least recently used hits where distance < c, so one pass answers
    for every size up to ``most``. A session's state is its ``most`` last keys.
    """

    def step(state: dict, row: tuple) -> tuple:
        session, key, _, i = row
        recent = state.setdefault("keys", [])  # the last used at the end
        at = None
        for k in range(len(recent) - 1, -1, -1):
            if recent[k] == key:
                at = k
                break
        distance = None if at is None else len(recent) - 1 - at
        if at is not None:
            del recent[at]
        elif len(recent) == most:
            del recent[0]
        recent.append(key)
        return session, key, i, distance

    kinds = dict(calls.dtypes)
    d = calls.select("session", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "id")
    return folded(d, ["session"], ["us", "id"], step, f"session {kinds['session']}, key {kinds['key']}, id {kinds['id']}, distance bigint")


def lru_hits(calls: DataFrame, capacities: list[int]) -> DataFrame:
    """``capacity, calls, hits, evictions`` of caches of several sizes over the same calls; a cache is a session's own.

    What a cache drops is what it has stored less what it holds at the end.
    """
    by = reuse_distances(calls, max(capacities)).groupBy("session", "key", "distance").agg(F.count("*").alias("n"))
    sizes = F.explode(F.array(*(F.lit(c).cast("bigint") for c in capacities))).alias("capacity")  # a few sizes
    hit = F.coalesce(F.col("distance") < F.col("capacity"), F.lit(False))
    each = by.select("session", "key", "distance", "n", sizes).groupBy("session", "capacity").agg(
        F.sum("n").alias("calls"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("hits"), F.count_distinct("key").alias("keys")
    )
    misses = F.col("calls") - F.col("hits")
    return each.groupBy("capacity").agg(F.sum("calls").alias("calls"), F.sum("hits").alias("hits"), F.sum(misses - F.least("keys", "capacity")).alias("evictions"))


def is_transient(message: Column) -> Column:
    return F.rlike(F.lower(message), F.lit("|".join(TRANSIENT)))


def backoff(attempt: Column, base: int = 200, most: int = 5000) -> Column:
    """Milliseconds before a retry, without jitter."""
    return F.least(base * F.pow(F.lit(2), attempt), F.lit(float(most)))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars; models without a price cost nothing."""
    return F.coalesce((tokens_in * price_in + tokens_out * price_out) / 1e6, F.lit(0.0))


def calendar_counts(requests: DataFrame, limit: int = 60) -> DataFrame:
    """By entity and calendar minute: requests, those over the limit, and whether 80 % is reached."""
    d = requests.groupBy("entity", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"))
    return d.withColumns({"blocked": F.greatest(F.lit(0), F.col("n") - limit), "warned": F.col("n") >= 0.8 * limit})


def usage_level(used: Column, limit: Column, soft: float = 0.8) -> Column:
    """``ok``, ``warning`` from a share of the limit on, ``exceeded`` from the limit on; without a limit always ``ok``."""
    return F.when(limit.isNull(), "ok").when(used >= limit, "exceeded").when(used >= soft * limit, "warning").otherwise("ok")


def effective_limit(base: Column, priority: Column) -> Column:
    """A limit under a priority; null for no limit."""
    out = F.lit(None).cast("double")
    for k, v in MULTIPLIERS.items():
        if v is not None:
            out = F.when(priority == k, v).otherwise(out)
    return F.floor(base * out)


def load_multiplier(load: Column, least: float = 0.5, most: float = 2.0) -> Column:
    return most - F.greatest(F.lit(0.0), F.least(F.lit(1.0), load)) * (most - least)


def fixed_windows(state: dict, now: int, limits: dict[str, int]) -> str | None:
    """Counts one request at ``now`` (ms) in ``state`` (window -> [start, count]); the window that refuses it, or None.

    A window starts anew with the first request after it has run out.
    """
    for k, size in WINDOWS.items():
        if k not in state or now - state[k][0] >= size:
            state[k] = [now, 0]
    for k in WINDOWS:
        if state[k][1] >= limits[k]:
            return k
    for k in WINDOWS:
        state[k][1] += 1
    return None


def admitted(state: dict, now: int, lasts: int, tokens: int, limits: dict[str, int]) -> tuple[str | None, int]:
    """One request at ``now`` (ms) that runs for ``lasts`` ms: what refuses it, and seconds after which to try again.

    Asked in this order: requests in flight, the windows of a minute, an hour and a
    day, tokens of one request. State holds the windows as [start, requests,
    tokens] and the ends of what is in flight, as many as may be.
    """
    for k, size in WINDOWS.items():
        if k not in state or now - state[k][0] >= size:
            state[k] = [now, 0, 0]
    running = state["running"] = [e for e in state.get("running", ()) if e > now]
    if len(running) >= limits["concurrent"]:
        return "concurrent", 1
    for k, size in WINDOWS.items():
        if state[k][1] >= limits[k]:
            return k, -(-(size - (now - state[k][0])) // 1000)
    if tokens > limits["tokens"]:
        return "tokens", 0
    for k in WINDOWS:
        state[k][1] += 1
        state[k][2] += tokens
    running.append(now + lasts)
    return None, 0


def limited(requests: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``id, entity, limit_hit, retry_after, in_flight, hour_tokens`` of ``requests(id, entity, ts, lasts, tokens)``, ``lasts`` in milliseconds.

    ``in_flight`` and ``hour_tokens`` are as the request finds or, if it is allowed, makes them.
    """

    def step(state: dict, row: tuple) -> tuple:
        entity, ms, i, lasts, tokens = row
        hit, again = admitted(state, ms, lasts, tokens, limits)
        return i, entity, hit, again, len(state["running"]), state["hour"][2]

    d = requests.select("entity", millis(F.col("ts")).alias("ms"), "id", F.col("lasts").cast("bigint"), F.col("tokens").cast("bigint"))
    return folded(d, ["entity"], ["ms", "id"], step, "id bigint, entity bigint, limit_hit string, retry_after bigint, in_flight bigint, hour_tokens bigint")


def bucket(state: dict, now: int, size: float, rate: float, need: float = 1.0) -> bool:
    """Takes tokens from a bucket refilled at ``rate`` a second since it was last looked at."""
    tokens, at = state.get("bucket", (size, now))
    tokens = min(size, tokens + max(0, now - at) / 1000 * rate)
    ok = tokens >= need
    state["bucket"] = (tokens - need if ok else tokens, max(now, at))
    return ok


def _in_order(requests: DataFrame, one) -> DataFrame:
    """Each entity's requests through a state machine in time order."""
    d = requests.select("id", "entity", millis(F.col("ts")).alias("ms"))
    return folded(d, ["entity"], ["ms", "id"], lambda state, row: (row[0], row[1], one(state, row[2])), "id bigint, entity bigint, limit_hit string")


def rate_limited(requests: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``id, entity, limit_hit`` under minute, hour and day windows; null where allowed."""
    limits = LIMITS | (limits or {})
    return _in_order(requests, lambda state, ms: fixed_windows(state, ms, limits))


def token_bucket(requests: DataFrame, size: float, rate: float) -> DataFrame:
    return _in_order(requests, lambda state, ms: None if bucket(state, ms, size, rate) else "bucket")


def presence(heartbeats: DataFrame, now: Column, idle: int = 60, gone: int = 300) -> DataFrame:
    """``agent, last_seen, status``: active, disconnected after ``idle`` seconds, removed after ``gone``."""
    d = heartbeats.groupBy("agent").agg(F.max("ts").alias("last_seen"))
    silent = (F.unix_micros(now) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 1e6
    return d.withColumn("status", F.when(silent > gone, "removed").when(silent > idle, "disconnected").otherwise("active"))


def first_claims(claims: DataFrame) -> DataFrame:
    """``task, agent, n_claims``: the first to claim has it."""
    return claims.groupBy("task").agg(F.min_by("agent", F.struct("ts", "agent")).alias("agent"), F.count("*").alias("n_claims"))


def orphans(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """Tasks whose assignee is none of the agents; unassigned ones are none."""
    return tasks.filter("assignee is not null").join(agents.select(F.col("agent").alias("assignee")).distinct(), "assignee", "left_anti")


def file_clashes(active: DataFrame, agent: int) -> DataFrame:
    """``other, files``: agents that hold files which ``agent`` holds too, of ``active(agent, file)``."""
    mine = active.filter(F.col("agent") == agent).select("file").distinct()
    d = active.filter(F.col("agent") != agent).join(mine, "file")
    return d.groupBy(F.col("agent").alias("other")).agg(F.array_sort(F.collect_set("file")).alias("files"))


def debounced(changes: DataFrame, gap: float = 1.0) -> DataFrame:
    """``path, batch_start, n, last_kind``: changes of a path closer than ``gap`` seconds are one, with the last kind."""
    w = Window.partitionBy("path").orderBy("ts", "id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    d = changes.withColumn("_new", F.when(us - F.lag(us).over(w) <= int(gap * 1e6), 0).otherwise(1)).withColumn("_b", F.sum("_new").over(w))
    return d.groupBy("path", "_b").agg(F.min("ts").alias("batch_start"), F.count("*").alias("n"), F.max_by("kind", F.struct("ts", "id")).alias("last_kind")).drop("_b")
