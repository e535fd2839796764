"""Exports of timelines: text, CSV and HTML, written by tasks, and small reports rendered from an aggregate."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import html_escaped
from parley.operators.timeline import with_day, with_previous

COLOURS = 8


def text_lines(messages: DataFrame) -> DataFrame:
    """``conversation_id, id, line``; a line starts with a separator where its day differs from the one before."""
    linked = with_previous(with_day(messages), ["day"], ["conversation_id"], ["ts", "id"])
    mark = F.when(F.col("prev_day").isNull() | (F.col("prev_day") != F.col("day")), F.concat(F.lit("--- "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" ---\n"))).otherwise("")
    who = F.when(F.col("is_sender") == 1, "me").otherwise(F.concat(F.lit("member "), F.col("member").cast("string")))
    return linked.select("conversation_id", "id", F.concat(mark, F.date_format("ts", "HH:mm:ss"), F.lit(" "), who, F.lit(": "), F.coalesce("content", F.lit(""))).alias("line"))


def html_bubbles(messages: DataFrame) -> DataFrame:
    """``conversation_id, id, html``; colours go by the order in which a conversation's members first appear."""
    first = messages.groupBy("conversation_id", "member").agg(F.min(F.struct("ts_sec", "id")).alias("_first"))
    colours = first.select("conversation_id", "member", ((F.row_number().over(Window.partitionBy("conversation_id").orderBy("_first")) - 1) % COLOURS).alias("_colour"))
    style = F.when(F.col("is_sender") == 1, "me").otherwise(F.concat(F.lit("c"), F.col("_colour").cast("string")))
    return messages.join(colours, ["conversation_id", "member"]).select("conversation_id", "id", F.concat(F.lit('<p class="'), style, F.lit('">'), html_escaped(F.coalesce("content", F.lit(""))), F.lit("</p>")).alias("html"))


def write_text(messages: DataFrame, path: str) -> None:
    """One folder per conversation; lines are range-partitioned by time, so a long conversation is several files in order."""
    lines = text_lines(messages.select("*")).join(messages.select("id", "ts"), "id")
    ordered = lines.repartitionByRange("conversation_id", "ts", "id").sortWithinPartitions("conversation_id", "ts", "id")
    ordered.select("conversation_id", F.col("line").alias("value")).write.partitionBy("conversation_id").text(path)


#: What tells spreadsheets that a file is UTF-8.
BYTE_ORDER_MARK = "\ufeff"


def write_csv(messages: DataFrame, path: str) -> None:
    """CSV with a header and a byte order mark in front of it, in each file; fields that hold the separator, quotes or line ends are quoted."""
    first = messages.columns[0]
    messages.withColumnRenamed(first, BYTE_ORDER_MARK + first).write.option("header", True).option("escape", '"').csv(path)


def radar_report(title: str, scores: dict[str, float]) -> str:
    """A one-file HTML page with a radar drawing of scores between 0 and 100."""
    n = max(1, len(scores))
    at = lambda i, r: (100 + r * math.sin(2 * math.pi * i / n), 100 - r * math.cos(2 * math.pi * i / n))
    ring = " ".join("{:.1f},{:.1f}".format(*at(i, 0.8 * max(0, min(100, v)))) for i, v in enumerate(scores.values()))
    names = "".join('<text x="{:.1f}" y="{:.1f}">{}</text>'.format(*at(i, 90), k) for i, k in enumerate(scores))
    rows = "".join(f"<tr><td>{k}</td><td>{v:.1f}</td></tr>" for k, v in scores.items())
    return f'<!DOCTYPE html><title>{title}</title><svg viewBox="0 0 200 200"><polygon points="{ring}"/>{names}</svg><table>{rows}</table>'
