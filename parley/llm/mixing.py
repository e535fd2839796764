"""Mixing sources to target weights: exact block quotas, dealt to output shards by a splitting tree.

Every source is cut into blocks of documents by a hash of the id. Its target (in words) fixes how many whole passes
over all blocks are taken and, in a last pass, which blocks of a seeded order, up to the word where the target is
reached. These exact counts of blocks, one per source, are split by a binary tree: each node hands its left half a
multivariate hypergeometric draw of its sources' counts, as if all its blocks were shuffled and cut in the middle, so
that leaves (output shards) get equal numbers of blocks and quotas that add up. A source's blocks, in a second seeded
order, then go to the shards in disjoint runs of those lengths, and rows are ordered by a hash within each shard.

Only DataFrame and SQL functions are used. Documents meet tables of one row per (source, block) only; a source of a
third of all rows is spread over all its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.support import WORD, staged

#: Weights by the order of sources, repeating; most passes over a source.
WEIGHTS, MOST = (5, 2, 1), 3
#: Blocks of a source; shards are 2 ** LEVELS.
BLOCKS, LEVELS, SEED = 1024, 6, 20_240_501


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Rows ``(source, source_size)`` to those with ``rank, target``: shares of the total by weight, none above
    ``most`` times its source's size, the excess shared again by weight.

    The fixed point is found in one pass: in ascending order of cap over weight, sources stay capped as long as
    the rest, shared by the remaining weights, would lift them above their cap. The window runs over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size").cast("double") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / heavy)
    free = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")).alias("x"))).over(everything)
    shared = level.withColumn("share", free["level"])
    target = F.when(F.col("share").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("share") * F.col("weight")))
    return shared.select("source", "source_size", "rank", target.alias("target"))


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body``, which uses ``value`` by its name; the value is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _drawn(total: str, good: str, draws: str, u: str) -> str:
    """SQL of how many good ones are among ``draws`` of ``total``, by inverting the distribution at ``u``.

    Weights relative to the mode follow from the ratio of neighbouring terms, and beyond 14 deviations they are nothing.
    """
    # the weight of k + 1 over that of k
    up = lambda k: f"(double(s.good - ({k})) * (s.draws - ({k})) / (double({k} + 1) * (s.total - s.good - s.draws + ({k}) + 1)))"
    share = "(s.good / double(greatest(s.total, 1)))"
    bounds = f"""named_struct('lo', greatest(0L, s.draws + s.good - s.total), 'hi', least(s.draws, s.good),
      'guess', bigint(floor(double(s.draws + 1) * (s.good + 1) / (s.total + 2))),
      'reach', bigint(ceil(14 * sqrt(s.draws * {share} * (1 - {share}) * (greatest(s.total, 1) - s.draws) / greatest(s.total - 1, 1.0D)) + 14)))"""
    mode = "least(b.hi, greatest(b.lo, b.guess))"
    limits = f"named_struct('mode', {mode}, 'first', greatest(b.lo, {mode} - b.reach), 'last', least(b.hi, {mode} + b.reach))"
    # a sum holds the weights before the last one
    side = lambda ks, w: f"aggregate({ks}, named_struct('w', 1.0D, 's', 0.0D), (a, k) -> named_struct('w', {w}, 's', a.s + a.w))"
    above = side("if(r.last > r.mode, sequence(r.mode, r.last - 1), cast(array() as array<bigint>))", f"a.w * {up('k')}")
    below = side("if(r.mode > r.first, sequence(r.mode - 1, r.first, -1L), cast(array() as array<bigint>))", f"a.w / {up('k')}")
    # the mode's weight, 1, is in both sums
    goal = "s.u * (t.above.s + t.above.w + t.below.s + t.below.w - 1)"
    found = f"""aggregate(sequence(r.first, r.last), named_struct('w', t.below.w, 's', 0.0D, 'k', r.first),
      (a, k) -> named_struct('w', if(k < r.last, a.w * {up('k')}, 0.0D), 's', a.s + a.w, 'k', if(a.s < {goal}, k, a.k)), a -> a.k)"""
    inverted = _let("b", bounds, _let("r", limits, _let("t", f"named_struct('above', {above}, 'below', {below})", found)))
    whole = f"case when s.good = 0 or s.draws = 0 then 0L when s.draws = s.total then s.good else {inverted} end"
    return _let("s", f"named_struct('total', {total}, 'good', {good}, 'draws', {draws}, 'u', {u})", whole)


def hypergeometric(rows: DataFrame) -> DataFrame:
    """``rows(total, good, draws, u)`` with ``drawn``, the number of good ones among ``draws`` of ``total``."""
    return rows.withColumn("drawn", F.expr(_drawn("total", "good", "draws", "u")))


def _with_left_half(nodes: DataFrame, level: int, sources: int) -> DataFrame:
    """``nodes(shard, counts)`` with ``left``: a multivariate hypergeometric draw of half of a node's blocks, by source.

    The sources are halved again and again, a column a time; how many of a group's draws go to its first half is hypergeometric.
    """
    sum_ = lambda x: f"aggregate({x}, 0L, (n, x) -> n + x)"
    nodes = nodes.withColumn("left", F.expr(f"array(named_struct('counts', counts, 'draws', {sum_('counts')} - {sum_('counts')} div 2))"))
    for bit in reversed(range(sources.bit_length() - 1)):
        size = 1 << bit
        u = f"(pmod(xxhash64({SEED}, {level}, {size}, shard, at), {1 << 52}L) + 0.5D) / {1 << 52}D"
        first = _drawn(sum_("g.counts"), sum_(f"slice(g.counts, 1, {size})"), "g.draws", u)
        halves = f"array(named_struct('counts', slice(g.counts, 1, {size}), 'draws', n), named_struct('counts', slice(g.counts, {size + 1}, {size}), 'draws', g.draws - n))"
        nodes = nodes.withColumn("left", F.expr(f"flatten(transform(left, (g, at) -> {_let('n', first, halves)}))"))
    return nodes


def split_quotas(quotas: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row ``(counts array<long>)``, a block count per source in rank order, to ``(shard, counts)`` of 2**levels shards.

    A level is a few columns and an explode over at most as many rows as there are shards, without a shuffle; each is
    computed by itself, so that no plan holds more than one level's expressions.
    """
    row = quotas.select(F.size("counts")).first()
    width = 1 << max(0, ((row[0] if row else 0) - 1).bit_length())
    nodes = quotas.selectExpr("0L as shard", f"concat(counts, array_repeat(0L, {width} - size(counts))) as counts")
    for level in range(levels):
        halves = "array(named_struct('shard', shard * 2, 'counts', left.draws), named_struct('shard', shard * 2 + 1, 'counts', zip_with(counts, left.draws, (a, b) -> a - b)))"
        nodes = staged(_with_left_half(nodes, level, width).select(F.explode(F.expr(halves)).alias("half")).select("half.shard", "half.counts"))
    return nodes


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, draws``.

    ``draws`` lists the document's copies in the mix: pass, output shard, words taken of it, and its place within the
    shard (a seeded order). The words taken of a source are its target, to the word. A null source is a source of its
    own, ordered last; a null or blank text has size 0 and no draws; repeated rows are documents of their own; ids may
    be null. Where all sizes are 0, targets are 0. A table without rows gives none. Very long texts count whole, and may be
    taken in part; rows whose places tie are ordered by id. Other columns are not read, whatever their names.
    """
    mixed = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    sized = staged(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size"))
        .withColumn("at", F.coalesce(mixed, F.lit(0))).withColumn("block", F.pmod(F.col("at"), F.lit(BLOCKS)).cast("int"))
    )
    blocks = staged(sized.groupBy("source", "block").agg(F.sum("size").alias("words")))
    targets = staged(source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size"))))
    named = targets.withColumnRenamed("source", "_source")
    full = blocks.join(named, F.col("source").eqNullSafe(F.col("_source"))).select("source", "block", "words", "source_size", "rank", "target", F.round("target").cast("long").alias("goal"))
    of_source = Window.partitionBy("rank")
    chosen = of_source.orderBy(F.xxhash64(F.lit(SEED + 1), "rank", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0)).cast("int"))
    rest = F.col("goal") - F.col("passes") * F.col("source_size") - F.coalesce(F.sum("words").over(chosen), F.lit(0))
    full = full.withColumn("rest", F.greatest(F.lit(0), F.least("words", rest)).cast("long"))
    # copies of blocks that are taken, in a second seeded order within their source
    copies = full.where("words > 0").select("rank", "block", F.explode(F.expr("filter(sequence(0, passes), p -> p < passes or rest > 0)")).alias("pass"))
    copies = copies.withColumn("place", F.row_number().over(of_source.orderBy(F.xxhash64(F.lit(SEED + 2), "rank", "block", "pass"), "block", "pass")) - 1)
    counted = targets.join(copies.groupBy("rank").agg(F.count("*").alias("n")), "rank", "left")
    quotas = staged(counted.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("n", F.lit(0).cast("long")).alias("n")))), lambda x: x.n).alias("counts")))
    dealt = split_quotas(quotas).select("shard", F.posexplode("counts").alias("rank", "count"))
    runs = dealt.withColumn("upto", F.sum("count").over(of_source.orderBy("shard"))).where("count > 0")
    runs = runs.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("runs"))
    placed = copies.join(runs, "rank").select("rank", "block", F.struct("pass", F.expr("filter(runs, r -> r.upto > place)[0].shard").alias("shard")).alias("copy"))
    plan = full.join(placed.groupBy("rank", "block").agg(F.array_sort(F.collect_list("copy")).alias("copies")), ["rank", "block"], "left")
    plan = plan.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "words", "source_size", "target", "passes", "rest", "copies")
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    # of the one block per source that is taken in part, documents are taken in order of their hash, up to the goal
    whole = joined.where("rest = 0 or rest = words").withColumn("part", F.when(F.col("rest") > 0, F.col("size")).otherwise(F.lit(0).cast("long")))
    inner = Window.partitionBy("source", "block").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = joined.where("rest > 0 and rest < words").withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.coalesce(F.sum("size").over(inner), F.lit(0)))).cast("long"))
    words = lambda c: F.when(c["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("part"))
    draws = F.transform(F.coalesce("copies", F.expr("array()").cast("array<struct<pass:int,shard:bigint>>")), lambda c: F.struct(c["pass"].alias("pass"), c["shard"].alias("shard"), words(c).alias("words"), F.xxhash64(F.lit(SEED + 3), "at", c["pass"]).alias("place")))
    out = whole.union(cut).withColumn("draws", F.filter(draws, lambda d: d["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("bigint"), lambda a, d: a + d["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws")


def mixed_rows(mix: DataFrame) -> DataFrame:
    """The mix itself, one row per copy of a document: ``doc_id, shard, place, pass, words``."""
    return mix.select("doc_id", F.explode("draws").alias("d")).select("doc_id", "d.shard", "d.place", "d.pass", "d.words")
