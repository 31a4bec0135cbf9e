"""What services around an engine keep: agents, channels, queues, throttles, typed values, hashed embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.functions.text import terms
from marlspike.operators.iterate import folded, in_blocks

#: Subscribers of everything that are broadcast together.
STARS = 10_000
#: Longest wait before a queued change is tried again, in seconds.
LONGEST_WAIT = 300


def agents_now(log: DataFrame) -> DataFrame:
    """``agent, name, connected_at, last_heartbeat, n_beats`` of agents that are registered, of ``log(agent, ts, id, action, name)``.

    ``register`` connects anew, ``heartbeat`` and ``register`` count as signs of
    life, ``remove`` ends a connection; beats of agents that are not connected
    count for nothing.
    """
    w = Window.partitionBy("agent").orderBy("ts", "id")
    step = F.sum(F.when(F.col("action").isin("register", "remove"), 1).otherwise(0)).over(w)
    d = log.withColumn("_step", step)
    last = d.groupBy("agent", "_step").agg(
        F.min_by("action", F.struct("ts", "id")).alias("_first"), F.min_by("name", F.struct("ts", "id")).alias("name"),
        F.min("ts").alias("connected_at"), F.max("ts").alias("last_heartbeat"), F.count("*").alias("n_beats"),
    )
    newest = last.groupBy("agent").agg(F.max_by(F.struct("_first", "name", "connected_at", "last_heartbeat", "n_beats"), "_step").alias("x"))
    return newest.select("agent", "x.*").filter("_first = 'register'").drop("_first")


def json_type(value: Column) -> Column:
    """string, number, boolean, array or object of a JSON text; a text that is no JSON is a string. A JSON null is an object."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    return (
        F.when(kind.isNull() | (kind == "STRING"), "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT") | (kind == "VOID"), "object").otherwise("number")
    )


def json_text(value: Column) -> Column:
    """The value of a JSON string, the text of other JSON, and the text itself where it is no JSON."""
    parsed = F.try_parse_json(value)
    return F.when(F.schema_of_variant(parsed) == "STRING", F.try_variant_get(parsed, "$", "string")).otherwise(value)


def retry_at(attempts: Column, now: Column) -> Column:
    """When a queued change that has failed so often is tried again: 2, 4, 8 ... seconds later, 300 at most."""
    return F.timestamp_micros((F.unix_micros(now) + F.least(F.lit(float(LONGEST_WAIT)), F.pow(F.lit(2.0), attempts)).cast("bigint") * 1_000_000).cast("bigint"))


def throttled(transfers: DataFrame, per_second: int) -> DataFrame:
    """``id, channel, wait_ms`` of ``transfers(id, channel, ms, size)``: what each waits so that a channel keeps to its bytes a second.

    Bytes count in windows of a second; one that passes the limit waits for its
    excess, and a window starts anew behind the wait. A transfer begins no
    earlier than the one before it has waited.
    """
    def step(state: dict, row: tuple) -> tuple:
        i, channel, ms, size = row
        now = max(ms, state.get("free", ms))
        if "start" not in state or now - state["start"] >= 1000:
            state["start"], state["bytes"] = now, 0
        state["bytes"] += size
        over = state["bytes"] - per_second
        wait = -(-over * 1000 // per_second) if over > 0 else 0
        if wait:
            state["start"], state["bytes"] = now + wait, 0
        state["free"] = now + wait
        return i, channel, wait

    return folded(transfers.select("id", "channel", "ms", "size"), ["channel"], ["ms", "id"], step, "id bigint, channel bigint, wait_ms bigint")


def window_counts(requests: DataFrame, size_ms: int) -> DataFrame:
    """``id, entity, n`` of ``requests(id, entity, ms)``: the shared counter's value after each; it starts anew with the first request after ``size_ms``."""
    def step(state: dict, row: tuple) -> tuple:
        i, entity, ms = row
        if "start" not in state or ms - state["start"] >= size_ms:
            state["start"], state["n"] = ms, 0
        state["n"] += 1
        return i, entity, state["n"]

    return folded(requests.select("id", "entity", "ms"), ["entity"], ["ms", "id"], step, "id bigint, entity bigint, n bigint")


def delivered(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``id, channel, subscriber``: each message once for each subscriber of its channel or of ``*``, but not for its sender.

    ``messages(id, channel, sender)`` meet ``subscriptions(channel, subscriber)`` by equality, those of everything by broadcast.
    """
    exact = messages.join(subscriptions, "channel").select("id", "channel", "sender", "subscriber")
    # a subscriber of everything meets every message: these are counted and broadcast in blocks, so no key holds all messages
    out = exact
    for block in in_blocks(subscriptions.filter("channel = '*'").select("subscriber").distinct(), "subscriber", STARS):
        out = out.unionByName(messages.join(F.broadcast(block)).select("id", "channel", "sender", "subscriber"))
    return out.filter("subscriber <> sender").select("id", "channel", "subscriber").distinct()


def recent(rows: DataFrame, at: str, key: str, limit: int = 10) -> DataFrame:
    """The newest rows, ties by key: a top-k, no sort of all."""
    return rows.orderBy(F.desc(at), key).limit(limit)


def hashed_embedding(docs: DataFrame, dimensions: int = 64) -> DataFrame:
    """``doc_id, embedding`` of ``docs(doc_id, text)``: the hashing trick, an embedder that needs no model and no network.

    Each term adds 1 or -1 at a place; both come from its MD5. Vectors have unit length; a
    text without terms has zeros.
    """
    words = docs.select("doc_id", F.explode(terms(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    code = lambda first: F.conv(F.substring(F.md5("w"), first, 7), 16, 10).cast("bigint")
    placed = words.select("doc_id", (code(1) % dimensions).alias("at"), F.when(code(8) % 2 == 0, F.col("n")).otherwise(-F.col("n")).alias("v"))
    sums = placed.groupBy("doc_id", "at").agg(F.sum("v").alias("v"))
    by = sums.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v")).cast("double")).alias("length"))  # `dimensions` entries at most
    value = lambda i: F.coalesce(F.try_divide(F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"), "length"), F.lit(0.0))
    made = docs.select("doc_id").join(by, "doc_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<bigint,bigint>")))
    return made.select("doc_id", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(dimensions - 1).cast("bigint")), value).alias("embedding"))


def checked_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    """Stored vectors that have the wanted number of components; the others are not read."""
    return vectors.filter(F.size("embedding") == dimensions)


def mutated(texts: DataFrame, alternatives: dict[str, list[str]], seed: int) -> DataFrame:
    """``texts(id, text)`` with each phrase replaced by one of its alternatives, drawn by a hash of seed, id and phrase: the same in every run."""
    text = F.col("text")
    for phrase, others in alternatives.items():
        code = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.lit(phrase))), 1, 7), 16, 10).cast("bigint")
        text = F.replace(text, F.lit(phrase), F.get(F.lit(others), (code % len(others)).cast("int")))
    return texts.withColumn("text", text)


def version_key(version: Column) -> Column:
    """A version of numbers with points as what it sorts by."""
    return F.transform(F.split(version, r"\."), lambda x: x.try_cast("bigint"))


def current_tools(tools: DataFrame) -> DataFrame:
    """``tool, version, n_versions, deprecated`` of ``tools(tool, version, deprecated)``: the newest version that is not deprecated, or the newest of all."""
    best = F.max_by("version", F.struct((~F.col("deprecated")).alias("live"), version_key(F.col("version")).alias("key"), "version"))
    d = tools.groupBy("tool").agg(best.alias("version"), F.count_distinct("version").alias("n_versions"), F.bool_and("deprecated").alias("deprecated"))
    return d.select("tool", "version", "n_versions", "deprecated")


#: How deep calls may be made by calls.
CHAIN_DEPTH = 3


def chained_calls(calls: DataFrame, most: int = CHAIN_DEPTH) -> DataFrame:
    """``id, depth, ran`` of ``calls(id, parent)`` that run or are refused: outer calls have depth 0, and a call that a call of depth ``most - 1`` makes is refused.

    What a refused call would have made never comes up. As many joins as calls may be deep.
    """
    level = calls.filter("parent is null").select("id", F.lit(0).alias("depth"), F.lit(True).alias("ran"))
    out = level
    for depth in range(1, most + 1):
        made = calls.join(level.select(F.col("id").alias("parent")), "parent")
        level = made.select("id", F.lit(depth).alias("depth"), F.lit(depth < most).alias("ran"))
        out = out.unionByName(level)
    return out


#: Events that a client keeps for its next session when they could not be sent.
QUEUE = 200


def sent_or_kept(events: DataFrame, sessions: DataFrame, most: int = QUEUE) -> DataFrame:
    """``client, session, id, state`` of ``events(client, session, id)``: ``sent`` in its session or a later one, ``dropped``, or still ``waiting``.

    ``sessions(client, session, reached)`` says whether a session's batch was
    delivered. One that was not leaves its events, with what was left before, to
    the next; the last ``most`` of them stay. So of a run of sessions that failed the
    last ``most`` events go with the first one that succeeds.
    """
    n = events.groupBy("client", "session").agg(F.count("*").alias("n"))
    all_ = sessions.join(n, ["client", "session"], "left").fillna(0, ["n"])
    later = Window.partitionBy("client").orderBy(F.desc("session"))  # a row for each session
    run = all_.withColumn("run", F.sum(F.col("reached").cast("int")).over(later))
    behind = Window.partitionBy("client", "run").orderBy(F.desc("session")).rowsBetween(Window.unboundedPreceding, -1)
    run = run.withColumn("after", F.coalesce(F.sum(F.when(~F.col("reached"), F.col("n"))).over(behind), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("client", "session").orderBy(F.desc("id")))
    met = events.withColumn("place", place).join(run.select("client", "session", "reached", "run", "after"), ["client", "session"])
    state = F.when(F.col("reached"), "sent").when(F.col("after") + F.col("place") > most, "dropped").when(F.col("run") > 0, "sent").otherwise("waiting")
    return met.select("client", "session", "id", state.alias("state"))


def imported(existing: DataFrame, incoming: DataFrame, overwrite: bool = False) -> DataFrame:
    """Rows of a registry by ``path`` after an import, with ``origin``: ``kept``, ``added`` or ``replaced``.

    A path that is there is skipped, or with ``overwrite`` takes the incoming row's
    columns where these are not null. Of incoming rows with one path the last by ``id`` counts.
    """
    last = incoming.groupBy("path").agg(F.max_by(F.struct("*"), "id").alias("r")).select("r.*")
    columns = existing.columns
    old, new = existing.select(F.col("path").alias("p"), F.struct(*columns).alias("old")), last.select(F.col("path").alias("q"), F.struct(*columns).alias("new"))
    met = old.join(new, F.col("p") == F.col("q"), "full_outer")
    here, there = F.col("old").isNotNull(), F.col("new").isNotNull()
    pick = lambda c: F.when(here & there & F.lit(overwrite), F.coalesce(F.col("new")[c], F.col("old")[c])).when(here, F.col("old")[c]).otherwise(F.col("new")[c])
    origin = F.when(~here, "added").when(there & F.lit(overwrite), "replaced").otherwise("kept")
    return met.select(*(pick(c).alias(c) for c in columns), origin.alias("origin"))
