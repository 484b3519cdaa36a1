"""Conversations: history, recent context, sessions, language, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.catalog import HISTORY_MESSAGES, RECENT_MESSAGES, SESSION_IDLE_SECONDS


def history(messages: DataFrame, session: str, order: str, keep: int = HISTORY_MESSAGES) -> DataFrame:
    """The last messages of each session."""
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return messages.withColumn("back", back).where(F.col("back") <= keep).drop("back")


def recent_context(messages: DataFrame, session: str, order: str, text: str, keep: int = RECENT_MESSAGES, cut: int = 300) -> DataFrame:
    """``context`` of each message: the texts before it among the last ``keep`` messages, it included, each cut."""
    frame = Window.partitionBy(session).orderBy(order).rowsBetween(-(keep - 1), -1)
    return messages.withColumn("context", F.array_join(F.collect_list(F.substring(text, 1, cut)).over(frame), "\n"))


def sessions(messages: DataFrame, session: str) -> DataFrame:
    return messages.groupBy(session).agg(F.count("*").alias("n_messages"))


def idle_sessions(events: DataFrame, user: str, ts: str, idle: int = SESSION_IDLE_SECONDS) -> DataFrame:
    """user, session_no, start, end, n_events; a pause of more than ``idle`` seconds begins a session."""
    order = Window.partitionBy(user).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(order)
    rows = events.withColumn("new", F.when(F.coalesce(gap > idle * 1_000_000, F.lit(True)), 1).otherwise(0))
    rows = rows.withColumn("session_no", F.sum("new").over(order))
    return rows.groupBy(user, "session_no").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n_events"))


def conversation(messages: DataFrame, keep: int = HISTORY_MESSAGES, recent: int = RECENT_MESSAGES, idle: int = SESSION_IDLE_SECONDS, default: str = "it") -> DataFrame:
    """session_id, message_id, ts, role, text, language, context, n_messages of each message; a pause of more than ``idle`` seconds begins anew.

    messages: session_id, message_id (repeated ones count once), ts, role, text, switch, detected.
    """
    rows = messages.dropDuplicates(["session_id", "message_id"])
    order = Window.partitionBy("session_id").orderBy("ts", "message_id")
    micros = F.unix_micros("ts")
    rows = rows.withColumn("no", F.sum(F.when(micros - F.lag(micros).over(order) > idle * 1_000_000, 1).otherwise(0)).over(order))
    own = Window.partitionBy("session_id", "no").orderBy("ts", "message_id")
    before = F.collect_list(F.substring("text", 1, 300)).over(own.rowsBetween(-(recent - 1), -1))
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    language = F.coalesce(F.last("switch", ignorenulls=True).over(so_far), F.first("detected").over(so_far), F.lit(default))
    count = F.least(F.row_number().over(own), F.lit(keep))
    return rows.select("session_id", "message_id", "ts", "role", "text", language.alias("language"), F.array_join(before, "\n").alias("context"), count.alias("n_messages"))


def session_language(messages: DataFrame, session: str, order: str, switch: str, detected: str, default: str = "it") -> DataFrame:
    """``language`` at each message: the last explicit switch, else what the first message was detected as, else the default."""
    w = Window.partitionBy(session).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(detected).over(so_far)
    return messages.withColumn("language", F.coalesce(F.last(switch, ignorenulls=True).over(so_far), first, F.lit(default)))


def cache_get(cache: DataFrame, now) -> DataFrame:
    """Entries that are still valid: ``now`` before the expiry."""
    return cache.where(F.lit(now) < F.col("expiry"))


def cache_cleanup(cache: DataFrame, now) -> DataFrame:
    """What a cleanup leaves: an expiry that equals ``now`` stays."""
    return cache.where(~(F.col("expiry") < F.lit(now)))


def last_answers(messages: DataFrame, session: str, order: str, n: int = 2) -> DataFrame:
    """The last assistant messages of each session, newest first."""
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return messages.where("role = 'assistant'").withColumn("back", back).where(F.col("back") <= n)


def saved_cache(cache: DataFrame, path: str) -> None:
    """Write a cache (key, value, expiry) in place of the one at ``path``."""
    cache.select("key", "value", "expiry").write.mode("overwrite").parquet(path)


def loaded_cache(spark, path: str) -> DataFrame:
    return spark.read.schema("key string, value string, expiry timestamp").parquet(path)


def rewrite_prompts(incoming: DataFrame, messages: DataFrame, keep: int = RECENT_MESSAGES, cut: int = 300) -> DataFrame:
    """session_id, text, prompt: what a rewriter reads for each message; no prompt for the first of a session.

    messages: session_id, ord, role, text (what was said before); incoming: session_id, text, one a session.
    """
    before = history(messages, "session_id", "ord", keep - 1)
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.substring("text", 1, cut))
    told = before.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("told"))
    prompt = F.concat(F.lit("Earlier messages:\n"), "told", F.lit("\n\nLatest message: "), "text", F.lit("\n\nQuestion that stands alone:"))
    return incoming.join(told, "session_id", "left").select("session_id", "text", prompt.alias("prompt"))


def chat_turn(incoming: DataFrame, messages: DataFrame, sessions: DataFrame, rewriter, answers, detector=None, switcher=None) -> tuple[DataFrame, DataFrame]:
    """(turns, messages): one message of each session answered, and the history with both sides added.

    incoming: session_id, text; sessions: session_id, language. Turns: session_id, language, original_query,
    resolved_query, answer. A session's second message on is rewritten with what was said before; where the rewriter
    fails, the message stands. ``answers`` maps (qid, question) to (qid, answer). ``detector`` names the language of a
    first message that is long enough; ``switcher`` (it, en, es or no) tells what a message with an unclear hint asks for.
    """
    from quillgraph.functions import language
    from quillgraph.operators.providers import called

    asked = rewrite_prompts(incoming, messages)
    resolved = called(asked.where("prompt IS NOT NULL"), "session_id", "prompt", rewriter).select("session_id", F.nullif(F.trim("value"), F.lit("")).alias("resolved"))
    rows = asked.join(resolved, "session_id", "left").join(sessions, "session_id", "left").withColumn("current", language.normalize_language("language"))
    first = F.col("prompt").isNull()
    rows = rows.withColumn("switch", language.explicit_switch("text", "current"))
    if detector is not None:
        long = rows.where(first & F.col("switch").isNull() & language.should_detect("text"))
        seen = called(long, "session_id", "text", detector).select("session_id", F.col("value").alias("detected"))
        rows = rows.join(seen, "session_id", "left").withColumn("switch", F.coalesce("switch", F.when(F.col("detected").isNotNull(), language.normalize_language("detected"))))
    if switcher is not None:
        unclear = rows.where(F.col("switch").isNull() & language.unclear_switch("text"))
        told = called(unclear, "session_id", "text", switcher).select("session_id", F.col("value").alias("reply"))
        rows = rows.join(told, "session_id", "left").withColumn("switch", F.coalesce("switch", language.switch_reply("reply", "current")))
    turns = rows.select("session_id", F.coalesce("switch", "current").alias("language"), F.col("text").alias("original_query"), F.coalesce("resolved", "text").alias("resolved_query"))
    given = answers(turns.select(F.col("session_id").alias("qid"), F.col("resolved_query").alias("question")))
    turns = turns.join(given.select(F.col("qid").alias("session_id"), "answer"), "session_id", "left")
    last = messages.groupBy("session_id").agg(F.max("ord").alias("last"))
    added = turns.join(last, "session_id", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    said = lambda role, text, step: added.select("session_id", (F.col("last") + step).alias("ord"), F.lit(role).alias("role"), F.col(text).alias("text"))
    after = messages.select("session_id", "ord", "role", "text").unionByName(said("user", "original_query", 1)).unionByName(said("assistant", "answer", 2))
    return turns, history(after, "session_id", "ord")
