"""Reading and merging batches of messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OVERLAP = 86_400
NEAR = 59
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


def since_watermark(rows: DataFrame, marks: DataFrame, key: str = "conversation_id", overlap: int = OVERLAP) -> DataFrame:
    """``rows`` whose ``ts_sec`` lies within ``overlap`` of their key's ``watermark``; keys without one come whole."""
    joined = rows.join(marks.select(key, "watermark"), key, "left")
    return joined.where(F.col("watermark").isNull() | F.col("ts_sec").between(F.col("watermark") - overlap, F.col("watermark") + overlap))


def new_rows(batch: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose key is neither held nor repeated. Rows with a null in the key are always new."""
    nulls = F.array_contains(F.array(*(F.col(k).isNull() for k in keys)), True)
    fresh = batch.where(~nulls).dropDuplicates(keys).join(held.select(*keys), keys, "left_anti").select(*batch.columns)
    return fresh.unionByName(batch.where(nulls))


def reconcile(imported: DataFrame, live: DataFrame, same: list[str], near: int = NEAR) -> DataFrame:
    """Pairs ``live_id, id, distance`` of captures and imported rows that agree in ``same`` and lie within ``near`` seconds.

    Each round pairs the rows that are each other's nearest (ties by id); pairs are taken out and rounds go on until no
    pair is left. Times meet through cells of ``near`` seconds, so a content of many rows is not compared with itself.
    """
    a = imported.select("id", *same, F.col("ts_sec").alias("_a"), F.expr(f"ts_sec div {near + 1}").alias("_cell"))
    b = live.select("live_id", *same, F.col("ts_sec").alias("_b"), F.explode(F.expr(f"array(ts_sec div {near + 1} - 1, ts_sec div {near + 1}, ts_sec div {near + 1} + 1)")).alias("_cell"))
    open_ = a.join(b, [*same, "_cell"]).where(F.abs(F.col("_a") - F.col("_b")) <= near).select("live_id", "id", F.abs(F.col("_a") - F.col("_b")).alias("distance"))
    found: DataFrame | None = None
    while True:
        open_ = open_.persist()
        best = lambda own, other: F.row_number().over(Window.partitionBy(own).orderBy("distance", other))
        pairs = open_.withColumn("_x", best("live_id", "id")).withColumn("_y", best("id", "live_id")).where("_x = 1 and _y = 1").select("live_id", "id", "distance").persist()
        if pairs.isEmpty():
            return pairs if found is None else found
        found = pairs if found is None else found.union(pairs)
        open_ = open_.join(pairs.select("live_id"), "live_id", "left_anti").join(pairs.select("id"), "id", "left_anti")


def decode_content(rows: DataFrame, raw: str = "raw", kind: str = "message_type") -> DataFrame:
    """``rows`` with ``content``: the text of ``raw`` (UTF-8, or that within a zstandard frame), else a placeholder by kind."""

    def decoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import zstandard

        names = {3: "[image]", 34: "[voice]", 43: "[video]", 47: "[sticker]"}

        def one(data: bytes | None, code: int) -> str | None:
            if data is None:
                return None
            try:
                plain = zstandard.ZstdDecompressor().decompressobj().decompress(data) if data.startswith(ZSTD_MAGIC) else data
                text = plain.decode()
            except (zstandard.ZstdError, UnicodeDecodeError):
                return names.get(code, "[binary]")
            return names.get(code, "[binary]") if "\x00" in text else text

        for data, codes in batches:
            yield pd.Series([one(None if d is None else bytes(d), c) for d, c in zip(data, codes, strict=True)], dtype=object)

    return rows.withColumn("content", F.pandas_udf(decoded, "string")(raw, kind)).drop(raw)


def synthetic_messages(spark: SparkSession, conversations: int, each: int, seed: int = 7, start: int = 1_700_000_000) -> DataFrame:
    """``conversations`` timelines of ``each`` messages, all values by hash of (seed, conversation, position)."""
    n = F.col("n")
    h = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "conversation_id", n), F.lit(1_000_000))
    rows = spark.range(conversations * each).select(F.col("id"), F.expr(f"id div {each}").alias("conversation_id"), F.expr(f"id % {each}").alias("n"))
    seconds = F.lit(start) + n * 90 + F.expr(f"n div 40") * 40_000 + h(1) % 60
    kinds = F.when(h(2) % 20 == 0, 3).when(h(2) % 20 == 1, 34).otherwise(1)
    return rows.select(
        "id", "conversation_id", F.timestamp_seconds(seconds).alias("ts"), seconds.alias("ts_sec"), (h(3) % 2).cast("int").alias("is_sender"), kinds.alias("message_type"),
        F.when(kinds == 1, F.concat(F.lit("word"), (h(4) % 97).cast("string"), F.lit(" word"), (h(5) % 89).cast("string"))).alias("content"),
    )
