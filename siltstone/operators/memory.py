"""Conversation memory: recent turns, rule extraction, redaction, upsert and recall."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.embedding import profile
from siltstone.operators import dense
from siltstone.operators import fixed as X
from siltstone.operators.planning import has_any

RECENT = 8


def recent_turns(turns: DataFrame, keep: int = RECENT) -> DataFrame:
    """The last turns of each session with `age` from 1 for the newest; ties in time go by id."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    return turns.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= keep)


def session_context(turns: DataFrame, shown: int = 4, most: int = 1600) -> DataFrame:
    """(session_id, context): the last turns of each session as lines, of which the last `most` characters stay."""
    last = recent_turns(turns, shown)
    number = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("age")))
    line = F.concat(F.col("number"), F.lit(". 用户："), F.coalesce("user_text", F.lit("")), F.lit("\n   助手摘要："), T.preview(F.coalesce("answer", F.lit("")), 220))
    lines = last.withColumn("number", number).select("session_id", F.struct("number", line.alias("line")).alias("l")).groupBy("session_id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    whole = F.concat(F.lit("最近对话：\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return lines.select("session_id", F.right(whole, F.lit(most)).alias("context"))


def effective_query(turns: DataFrame) -> DataFrame:
    """(id, query): a short or referring question with the two questions before it in its session."""
    before = Window.partitionBy("session_id").orderBy("created_at", "id").rowsBetween(-2, -1)
    earlier = F.array_join(F.collect_list("user_text").over(before), " ")
    q = F.coalesce("user_text", F.lit(""))
    needs = (F.char_length(q) < 24) | has_any(q, X.REFERRING)
    return turns.withColumn("earlier", earlier).select("id", F.when(needs & (F.col("earlier") != ""), T.strip(F.concat("earlier", F.lit(" "), q))).otherwise(q).alias("query"))


def is_memory_question(question: Column | str) -> Column:
    return has_any(F.col(question) if isinstance(question, str) else question, X.MEMORY_QUESTIONS)


def sanitize(content: Column) -> Column:
    """Secrets redacted, white space squashed, at most 600 characters."""
    hidden = F.regexp_replace(T.squash(content), r"sk-[a-zA-Z0-9_\-]{12,}", "[REDACTED_SECRET]")
    return F.substring(F.regexp_replace(hidden, r"(?i)(api[_ -]?key|secret|token)\s*[:=]\s*\S+", "[REDACTED_SECRET]"), 1, 600)


def storable(content: Column) -> Column:
    return (F.char_length(content) >= 8) & ~(content.contains("[REDACTED_SECRET]") & (F.char_length(content) < 40))


def extract_memories(turns: DataFrame) -> DataFrame:
    """(id, namespace, created_at, kind, content, importance): what the rules keep of each turn."""
    user = T.squash(F.coalesce("user_text", F.lit("")))
    wish = user.rlike("(?i)(" + "|".join(X.WISHES) + ")")
    kind = F.when(user.rlike("(" + "|".join(X.PREFERENCES) + ")"), "preference").otherwise("goal")
    state = F.lit(False)
    for word in X.PROJECT_WORDS:
        state = state | user.contains(word)
    summary = F.concat(F.lit("项目对话进展：用户问题是“"), F.substring(user, 1, 180), F.lit("”；助手输出摘要："), T.preview(F.coalesce("answer", F.lit("")), 280))
    found = F.array_compact(F.array(
        F.when(wish, F.struct(kind.alias("kind"), F.concat(F.lit("用户长期偏好或目标："), F.substring(user, 1, 260)).alias("content"), F.lit(0.75).alias("importance"))),
        F.when(state, F.struct(F.lit("project_state").alias("kind"), summary.alias("content"), F.lit(0.55).alias("importance"))),
    ))
    rows = turns.select("id", "namespace", "created_at", F.explode(found).alias("m")).select("id", "namespace", "created_at", "m.*")
    return rows.withColumn("content", sanitize(F.col("content"))).filter(storable(F.col("content")))


def upsert(memories: DataFrame) -> DataFrame:
    """One row per namespace, kind and content: the first id and time, the greatest importance, the last update."""
    keyed = memories.withColumn("content_hash", F.sha2(F.concat("kind", F.lit("\n"), "content"), 256))
    return keyed.groupBy("namespace", "content_hash").agg(
        F.min(F.struct("created_at", "id")).alias("first"), F.max("importance").alias("importance"), F.max("created_at").alias("updated_at"), F.min("kind").alias("kind"), F.min("content").alias("content"), F.count(F.lit(1)).alias("times")
    ).select("namespace", "content_hash", F.col("first.id").alias("id"), F.col("first.created_at").alias("created_at"), "importance", "updated_at", "kind", "content", "times")


def recall_score(distance: Column, importance: Column, updated_at: Column, as_of: float) -> Column:
    """0.72 semantic + 0.18 importance + 0.10 recency, as of a stated time in epoch seconds."""
    age = F.greatest(F.lit(0.0), (F.lit(as_of) - updated_at) / 86400)
    recency = F.when(updated_at.isNull() | (updated_at == 0), 0.0).otherwise(1 / (1 + age))
    return F.round(0.72 / (1 + F.greatest(F.lit(0.0), distance)) + 0.18 * importance + 0.10 * recency, 6)


def recall(queries: DataFrame, memories: DataFrame, as_of: float, k: int = 5, embed: Callable[[Column], Column] = profile) -> DataFrame:
    """The k best memories of each query's namespace, with `query_id`, distance, score and rank.

    queries are (query_id, namespace, query). Of the 3 k memories nearest to a query within its namespace the k with
    the best blend of nearness, importance and recency come out; ties go to the nearer, then the smaller hash. The
    search keeps 3 k rows per task and query, so a namespace that holds a third of all memories isn't gathered.
    """
    key = F.concat_ws("\x1f", "namespace", "content_hash")
    held = memories.withColumn("vec_id", key)
    vectors = held.select("vec_id", embed(F.col("content")).alias("embedding"), F.col("namespace").alias("label"))
    near = dense.l2_search(queries.select("query_id", embed(F.col("query")).alias("embedding"), F.col("namespace").alias("label")), vectors, 3 * k)
    scored = near.drop("rank").join(held, "vec_id").withColumn("score", recall_score(F.col("distance"), F.col("importance"), F.col("updated_at"), as_of))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "distance", "content_hash")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("vec_id")


def memory_line(rank: Column, kind: Column, importance: Column, score: Column, content: Column) -> Column:
    return F.format_string("%d. [%s, importance=%.2f, score=%.3f] %s", rank, kind, importance, score, content)
