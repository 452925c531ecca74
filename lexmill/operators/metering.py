"""Usage metering and history: day buckets, scopes, rate limits, recent items, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHIFT_MINUTES = 330


def local_day(ts: Column) -> Column:
    """The day at UTC + 5:30."""
    return F.to_date(ts + F.expr(f"INTERVAL {SHIFT_MINUTES} MINUTES"))


def next_reset(ts: Column) -> Column:
    """The next midnight at UTC + 5:30, in UTC."""
    return F.date_add(local_day(ts), 1).cast("timestamp_ntz") - F.expr(f"INTERVAL {SHIFT_MINUTES} MINUTES")


def usage_by_scope(usage: DataFrame) -> DataFrame:
    """(day, scope, who, used) of rows (day, user, device, tokens): one pass of grouping sets; tokens of 0 or less don't count."""
    rows = usage.where("tokens > 0 and not isnan(tokens)")
    g = rows.groupingSets([["day", "user"], ["day", "device"], ["day"]], "day", "user", "device").agg(F.sum("tokens").alias("used"), F.grouping_id().alias("g"))
    scope = F.when(F.col("g") == 1, "user").when(F.col("g") == 2, "device").otherwise("global")
    who = F.when(F.col("g") == 1, F.col("user")).when(F.col("g") == 2, F.col("device")).otherwise("*")
    return g.select("day", scope.alias("scope"), who.alias("who"), "used")


def tightest(states: DataFrame, *by: str) -> DataFrame:
    """Of states (by, scope, scope_pos, used, limit): ok, the least remaining and its scope (the first scope wins ties)."""
    rem = F.greatest(F.lit(0.0), F.col("limit") - F.col("used"))
    s = states.withColumn("remaining", rem)
    return s.groupBy(*by).agg(F.bool_and(F.col("used") < F.col("limit")).alias("ok"), F.min("remaining").alias("remaining"), F.min_by("scope", F.struct("remaining", "scope_pos")).alias("scope"))


def admitted(calls: DataFrame, per_minute: int, who: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The first calls of every user and minute; refused calls don't count."""
    order = Window.partitionBy(who, F.date_trunc("minute", ts)).orderBy(ts, tie)
    return calls.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_minute).drop("n")


def recent(rows: DataFrame, who: str, when: str, tie: str, k: int = 40) -> DataFrame:
    order = Window.partitionBy(who).orderBy(F.desc(when), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def latest_delivery(messages: DataFrame, key: str = "msg_no", when: str = "received_at") -> DataFrame:
    """One row a message: the first delivery."""
    order = Window.partitionBy(key).orderBy(when)
    return messages.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def merged(local: DataFrame, server: DataFrame, key: str) -> DataFrame:
    """Both lists by key; the server's row stands where it has one."""
    cols = [c for c in local.columns if c != key]
    a, b = local.select(key, F.struct(*cols).alias("l")), server.select(key, F.struct(*cols).alias("s"))
    return a.join(b, key, "full").select(key, *(F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"l.{c}")).alias(c) for c in cols))


def last_items(array: Column, n: int) -> Column:
    """The last n of an array; all of a shorter one."""
    return F.slice(array, F.greatest(F.size(array) - (n - 1), F.lit(1)), F.lit(n))


def new_facts(stored: DataFrame, facts: DataFrame, who: str = "user", text: str = "text", when: str = "created_at", keep: int = 20) -> DataFrame:
    """Stored and new facts of 4 to 239 characters that aren't stored yet (case aside), the newest of each user."""
    fresh = facts.withColumn(text, F.trim(text)).where(F.length(text).between(4, 239))
    key = [F.lower(text).alias("k")]
    known = stored.select(who, *key).distinct()
    fresh = fresh.withColumn("k", F.lower(text)).join(known, [who, "k"], "left_anti").drop("k")
    return recent(stored.unionByName(fresh), who, when, text, keep).drop("rank")


def exhausted_message(reset_seconds: Column, scope: Column) -> Column:
    hours = F.greatest(F.lit(1), F.floor(reset_seconds / 3600 + 0.5)).cast("int")
    unit = F.when(hours == 1, " hour").otherwise(" hours")
    who = F.when(scope == "global", "The shared allowance is used up").otherwise("Your allowance is used up")
    return F.concat(who, F.lit("; it returns in about "), hours.cast("string"), unit, F.lit("."))


def total_tokens(prompt: Column, completion: Column) -> Column:
    return F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))


def stored_chats(messages: DataFrame, user: str = "user_id", chat: str = "chat_id", when: str = "created_at", keep: int = 60, most: int = 40) -> DataFrame:
    """(user, chat, updated, rank, messages): every user's latest chats, each with its last messages (turn, role, content) in order."""
    last = recent(messages, chat, "turn", "msg_no", keep)  # ``keep`` messages of a chat travel at most
    updated = messages.groupBy(user, chat).agg(F.max(when).alias("updated"))
    kept = recent(updated, user, "updated", chat, most)
    packed = last.groupBy(user, chat).agg(F.array_sort(F.collect_list(F.struct("turn", "msg_no", "role", "content"))).alias("messages"))
    return kept.join(packed, [user, chat])


def opened(local: DataFrame, server: DataFrame, key: str, updated: str) -> DataFrame:
    """Chats by key: the server's copy unless the local one is newer; ``origin`` says which."""
    cols = [c for c in local.columns if c != key]
    both = local.select(key, F.struct(*cols).alias("l")).join(server.select(key, F.struct(*cols).alias("s")), key, "full")
    theirs = F.col("s").isNotNull() & (F.col("l").isNull() | F.coalesce(F.col(f"s.{updated}") >= F.col(f"l.{updated}"), F.lit(True)))
    return both.select(key, *(F.when(theirs, F.col(f"s.{c}")).otherwise(F.col(f"l.{c}")).alias(c) for c in cols), F.when(theirs, "server").otherwise("local").alias("origin"))
