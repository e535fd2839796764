"""Canonical views: the driver's tables as message timelines, as pure projections.

Each view is also given as a DuckDB expression of the same meaning, for the SQL of registered queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """``events`` as messages of conversations: dense ones of 30 users each, or (sparse) one per user."""
    e = table(spark, sf_dir, "events")
    kinds = F.when(F.col("event_type").isin("click", "view"), 1).when(F.col("event_type") == "purchase", 43).when(F.col("event_type") == "signup", 47).otherwise(10000)
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") if sparse else F.expr("user_id div 30")).alias("conversation_id"), F.col("user_id").alias("member"),
        "ts", F.unix_timestamp("ts").alias("ts_sec"), (F.col("event_id") % 2).cast("int").alias("is_sender"), kinds.alias("message_type"),
        F.concat_ws(" ", "event_type", "props").alias("content"),
    )


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose content is the kind and the number of an event, so that neighbours share words or don't."""
    numbers = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", F.regexp_replace("props", "[^0-9]", "")).alias("content"))
    return messages(spark, sf_dir).drop("content").join(numbers, "id")


#: Values of events that count as neither good nor bad: the middle of their range, and about their median.
MIDDLE, MEDIAN = 250, 35


def sentiment(spark: SparkSession, sf_dir: str, neutral: int = MIDDLE) -> DataFrame:
    """``message_id, intensity, polarity`` of every event."""
    level = F.least(F.lit(1.0), F.round(F.col("value") / neutral - 1, 4))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("message_id"), level.alias("intensity"), F.when(level > 0.3, 1).when(level < -0.3, -1).otherwise(0).alias("polarity"))


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentiment of three messages in four, so that some stay uncovered."""
    return sentiment(spark, sf_dir).where("message_id % 4 <> 3")


def dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as turns without times."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", 1).otherwise(0).alias("is_sender"), "role", "text")


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per token of a document, in order: ``doc_id, lang, pos, token``; the language comes along, so that no count by it joins the tokens."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


def _messages_sql(conversation: str) -> str:
    return f"""select event_id as id, {conversation} as conversation_id, user_id as member, ts, cast(floor(epoch(ts)) as bigint) as ts_sec,
  cast(event_id % 2 as int) as is_sender, case when event_type in ('click', 'view') then 1 when event_type = 'purchase' then 43
  when event_type = 'signup' then 47 else 10000 end as message_type, concat_ws(' ', event_type, props) as content from events"""


#: DuckDB common table expressions of the views.
M = f"m as ({_messages_sql('user_id // 30')})"
MS = f"ms as ({_messages_sql('user_id')})"
def _sentiment_sql(neutral: int) -> str:
    return f"""s as (select *, case when intensity > 0.3 then 1 when intensity < -0.3 then -1 else 0 end as polarity
  from (select event_id as message_id, least(1, round(value / {neutral} - 1, 4)) as intensity from events))"""


S, LIVELY = _sentiment_sql(MIDDLE), _sentiment_sql(MEDIAN)
C = "c as (select * from s where message_id % 4 <> 3)"
D = "d as (select conv_id, turn, case when role = 'user' then 1 else 0 end as is_sender, role, text from conversations)"
_LETTERS = r"[\p{L}\p{N}]+"
TOKENS = f"""tokens as (select doc_id, lang, p as pos, ws[p + 1] as token from (select doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '{_LETTERS}') as ws from documents),
  unnest(range(len(ws))) as x(p))"""

#: What ``{name}`` in a declared query stands for; all other names are tables.
VIEWS = {"m": (messages, (M,)), "ms": (lambda s, d: messages(s, d, sparse=True), (MS,)), "s": (sentiment, (S,)), "c": (covered, (S, C)), "d": (dialog, (D,)), "tokens": (doc_tokens, (TOKENS,))}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name][0](spark, sf_dir) if name in VIEWS else table(spark, sf_dir, name)


def with_views(names: list[str], text: str) -> str:
    """``text`` with the views it needs in front of its own common table expressions."""
    needed = list(dict.fromkeys(x for n in names if n in VIEWS for x in VIEWS[n][1]))
    if not needed:
        return text
    own = text.lstrip()
    return f"with {', '.join(needed)}, {own[5:]}" if own.lower().startswith("with ") else f"with {', '.join(needed)} {own}"
