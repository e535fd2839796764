from pyspark.sql import functions as F

from parley.llm import url_filter

ROWS = [
    (1, "http://a.example.org/es/x?q=/y#z"), (2, "https://EXAMPLE.org/en/12"), (3, "http://example.org/en/2"), (4, "http://x.com/fr/1"), (5, "http://x.com/de/1"), (6, "http://casino1.net/"),
    (7, "http://fine.net"), (8, None), (9, "no scheme"), (10, ""), (11, "ftp://h#frag"), (12, "http://h?x://y/z"), (13, "http://spam.net/a"), (13, "http://spam.net/a"), (None, "http://myorg/x"), (14, "a://b://c/d"),
    (15, "http://notexample.org/es/"), (16, "http://" + "p" * 50_000 + ".net/"),
]


def judged(spark):
    df = spark.createDataFrame([(i, u, "a", "b") for i, u in ROWS], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([("Casino1.net",), ("spam.net",), ("spam.net",), (None,), ("elsewhere.net",)], "host string")
    return [r.asDict() for r in url_filter.filter_urls(df, listed).collect()]


def test_rules_and_list(spark):
    by = {r["page_id"]: r for r in judged(spark)}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (by[2]["host"], by[2]["rule"], by[2]["verdict"]) == ("example.org", "example.org/en/1", "block")
    assert (by[3]["rule"], by[3]["verdict"]) == ("org/", "allow")
    assert (by[4]["rule"], by[5]["rule"]) == ("com/fr/", "com/de/")
    assert (by[6]["rule"], by[6]["verdict"]) == (None, "block")
    assert (by[7]["rule"], by[7]["verdict"], by[7]["path"]) == (None, "allow", "")
    for i in (8, 9, 10):
        assert (by[i]["host"], by[i]["path"], by[i]["rule"], by[i]["verdict"]) == ("", "", None, "allow")
    assert (by[11]["host"], by[11]["path"]) == ("h", "")
    assert by[15]["rule"] == "org/"
    assert by[14]["host"] == "b:"
    assert len(judged(spark)) == len(ROWS)


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("host"), F.col("id").cast("string")).alias("key"), (F.col("id") % 7 == 3).alias("listed"))
    cascade = url_filter.build_cascade(keys)
    assert len(cascade.bits) >= 2
    probed = keys.withColumn("shard", cascade.shard(F.col("key"))).join(cascade.table, "shard").withColumn("found", cascade.listed(F.col("key")))
    assert probed.where("found <> listed").count() == 0
    assert probed.count() == 20_000


def test_many_hosts_shards_and_levels(spark, monkeypatch):
    """A list of a third of all hosts, over several shards, with a host of a third of all pages."""
    monkeypatch.setattr(url_filter, "SHARD_KEYS", 1_000)
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 4)
    host = F.when(F.col("id") % 3 == 0, "hot.net").otherwise(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".net")))
    pages = spark.range(9_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), host, F.lit("/p")).alias("url"))
    listed = spark.range(9_000).where("id % 5 < 2").select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".net")).alias("host"))
    keys = pages.select(url_filter.host_of(F.col("url")).alias("key")).distinct().join(listed.select(F.col("host").alias("key"), F.lit(True).alias("listed")), "key", "left").fillna(False)
    cascade = url_filter.build_cascade(keys)
    assert cascade.shards > 3 and len(cascade.bits) >= 3
    got = {(r.page_id, r.listed, r.verdict) for r in url_filter.filter_urls(pages, listed).collect()}
    assert got == {(i, x, "block" if x else "allow") for i in range(9_000) for x in [i % 3 != 0 and i % 5 < 2]}


def test_all_none_and_no_rows(spark):
    keys = spark.range(100).select(F.col("id").cast("string").alias("key"), F.lit(True).alias("listed"))
    for df in (keys, keys.withColumn("listed", F.lit(False))):
        cascade = url_filter.build_cascade(df)
        out = df.withColumn("shard", cascade.shard(F.col("key"))).join(cascade.table, "shard", "left").withColumn("found", cascade.listed(F.col("key")))
        assert out.where("found <> listed").count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
