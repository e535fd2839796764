"""A sample of a conversation's exchanges from four windows, within a budget of exchanges and characters.

The windows are picked by rankings whose cut-offs Spark applies before it shuffles; what is left is a few dozen exchanges per conversation, over
which a fold trims the largest window's edge until the budget is met.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "conversation_id"
#: In the order in which an exchange that lies in several windows is given to one.
WINDOWS = ("origin", "conflict", "recent", "icebreak")


@dataclass(frozen=True)
class Quotas:
    """Exchanges of each window at most; days of the recent one, seconds of a bucket and of a silence that is broken; and the budget."""

    origin: int = 12
    conflict: int = 12
    recent: int = 12
    icebreak: int = 6
    recent_seconds: int = 30 * 86_400
    bucket_seconds: int = 7 * 86_400
    silence_seconds: int = 24 * 3_600
    most_pairs: int = 40
    most_chars: int = 8_000
    least_each: int = 2


QUOTAS = Quotas()


def _ranked(rows: DataFrame, by: list[Column], most: int, name: str = "_k") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(KEY).orderBy(*by))).where(F.col(name) <= most)


def balanced(rows: DataFrame, quota: int, order: str = "_k") -> DataFrame:
    """Of a few rows per conversation a quota, polarity by polarity in turn, the largest group first (of equal ones the first to occur); rows keep their order within a group."""
    group = Window.partitionBy(KEY, "polarity")
    turns = rows.withColumns({"_turn": F.row_number().over(group.orderBy(order)), "_size": F.count("*").over(group), "_first": F.min(order).over(group)})
    place = F.row_number().over(Window.partitionBy(KEY).orderBy("_turn", F.desc("_size"), "_first"))
    return turns.withColumn("_place", place).where(F.col("_place") <= quota).drop("_turn", "_size", "_first", "_place")


def four_windows(pairs: DataFrame, sessions: DataFrame, now_sec: int, quotas: Quotas = QUOTAS) -> DataFrame:
    """``pairs`` with their ``window``, those of several windows in each of them."""
    at = ["ts_sec", "pair_id"]
    late = [F.desc("ts_sec"), F.desc("pair_id")]
    origin = balanced(_ranked(pairs, [F.col(c) for c in at], 2 * quotas.origin), quotas.origin)
    # the newest ones, of the last days where these have any
    newest = _ranked(pairs, late, 2 * quotas.recent)
    fresh = F.col("ts_sec") >= now_sec - quotas.recent_seconds
    kept = newest.withColumn("_any", F.max(fresh).over(Window.partitionBy(KEY))).where(fresh | ~F.col("_any")).drop("_any")
    recent = balanced(kept, quotas.recent)
    bucket = F.expr(f"ts_sec div {quotas.bucket_seconds}")
    worst = pairs.where("polarity = -1").groupBy(KEY, bucket.alias("_b")).agg(F.count("*").alias("_n")).groupBy(KEY).agg(F.max_by("_b", F.struct("_n", "_b")).alias("_b"))
    conflict = _ranked(pairs.withColumn("_b", bucket).join(worst, [KEY, "_b"], "left_semi").drop("_b"), [F.col(c) for c in at], quotas.conflict)
    ended = F.max("end_sec").over(Window.partitionBy(KEY).orderBy("start_sec").rowsBetween(Window.unboundedPreceding, -1))  # a row per session
    broken = sessions.select(KEY, "start_sec", ended.alias("_ended")).where(F.col("start_sec") - F.col("_ended") > quotas.silence_seconds)
    broken = _ranked(broken, [F.desc("start_sec")], quotas.icebreak).select(KEY, F.col("start_sec").alias("_start"))
    first = pairs.join(broken, KEY).where("ts_sec >= _start").groupBy(KEY, "_start").agg(F.min_by(F.struct(*pairs.columns), F.struct(*at)).alias("p"))
    icebreak = first.select("p.*")
    found = [rows.select(*pairs.columns, F.lit(name).alias("window")) for name, rows in zip(WINDOWS, (origin, conflict, recent, icebreak), strict=True)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def trimmed(windows: dict[str, list[tuple]], quotas: Quotas = QUOTAS) -> dict[str, list[tuple]]:
    """Windows of (time, pair, characters) in ascending order, cut to the budget: exchange by exchange at the edge of the largest window, by number
    and then by characters; of equal ones the origin last. The origin loses its newest ones, others their oldest; each keeps some."""
    kept = {name: list(rows) for name, rows in windows.items() if rows}

    def cut(size, among: list[str]) -> None:  # noqa: ANN001
        largest = max(among, key=lambda w: (size(kept[w]), w != "origin"))
        kept[largest].pop(-1 if largest == "origin" else 0)

    while sum(map(len, kept.values())) > quotas.most_pairs and max(map(len, kept.values())) > quotas.least_each:
        cut(len, list(kept))
    chars = lambda rows: sum(r[2] for r in rows)
    while sum(map(chars, kept.values())) > quotas.most_chars:
        among = [w for w in kept if len(kept[w]) > quotas.least_each]
        if not among:
            break
        cut(chars, among)
    return kept


def stratified(pairs: DataFrame, sessions: DataFrame, now_sec: int, quotas: Quotas = QUOTAS) -> DataFrame:
    """``conversation_id, window, pair_id, ts_sec, chars`` of the sample.

    ``pairs`` are ``conversation_id, pair_id, ts_sec, polarity, chars``, ``sessions`` ``conversation_id, start_sec, end_sec``. The windows: the first
    exchanges and the newest ones of the last days before ``now_sec`` (or else simply the newest), both balanced by polarity; those of the seven days
    with most negative ones; and the first one after each silence of a day. An exchange stays in the first window that has it. Null polarities are neutral.
    """
    rows = pairs.select(KEY, "pair_id", "ts_sec", F.coalesce("polarity", F.lit(0)).alias("polarity"), F.col("chars").cast("long").alias("chars"))
    rank = F.create_map(*(F.lit(x) for i, w in enumerate(WINDOWS) for x in (w, i)))
    picked = four_windows(rows, sessions, now_sec, quotas).groupBy(KEY, "pair_id", "ts_sec", "chars").agg(F.min_by("window", rank[F.col("window")]).alias("window"))

    def fit(own: pd.DataFrame) -> pd.DataFrame:  # as many rows as the quotas allow
        own = own.sort_values(["ts_sec", "pair_id"])
        windows = {w: list(zip(*(own.loc[own["window"] == w, c].tolist() for c in ("ts_sec", "pair_id", "chars")), strict=True)) for w in WINDOWS}
        return pd.DataFrame([(own[KEY].iat[0], w, p, t, c) for w, found in trimmed(windows, quotas).items() for t, p, c in found], columns=[KEY, "window", "pair_id", "ts_sec", "chars"])

    kind = rows.schema[KEY].dataType.simpleString(), rows.schema["pair_id"].dataType.simpleString()
    return picked.groupBy(KEY).applyInPandas(fit, f"{KEY} {kind[0]}, window string, pair_id {kind[1]}, ts_sec long, chars long")
