"""One query per corpus operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import chroma, conversation_repair, ctph, filter_audit, line_dedup, lm_mixing, mixing, near_dedup, packing, pieces, pii, quality, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


#: A label of a host that starts so puts it on the block list of op2, which no table holds.
LISTED_LABELS = "spam|casino|phish|malware"


def block_list(pages: DataFrame) -> DataFrame:
    """The hosts of op2's block list, as a table."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host"))
    return hosts.where(F.col("host").rlike(rf"(^|\.)({LISTED_LABELS})")).distinct()


def op2_url_filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, block_list(pages))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "draws")


def op4_context_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.lm_scores(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as melodies, since no table holds recordings."""
    found = chroma.match_recordings(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", decode=chroma.tones)
    return found.withColumnRenamed("id", "vec_id")


def op7_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    joined = lambda kept: F.concat_ws(",", F.transform(kept, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))
    base = F.filter(spans, lambda s: s.kind.isin(*pii.BASE))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.BASE]
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_ctph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.fingerprints(_table(spark, sf_dir, "documents"))


def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repairs(conversation_repair.damage(_table(spark, sf_dir, "conversations")))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pieces.decode_documents(pieces.encode_documents(_table(spark, sf_dir, "documents")))
    return texts.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_minhash_near_dedup, op2_url_filter_cascade, op3_source_mixing, op4_context_mixing_lm, op5_quality_classifier,
        op6_chroma_fingerprints, op7_pii_anchor_expansion, op8_line_dedup, op9_ctph_fingerprints, op10_hilbert_packing,
        op11_conversation_repair, op12_sentencepiece, op13_filter_interaction_audit,
    )}


_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x20\x09-\x0D]+'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), {_WORD}) as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 75 * (x.n + y.n - c)),
u as (select a, b from e union all select b, a from e),
r as (select doc_id as node, doc_id as reach from w union select r.node, u.b from r join u on r.reach = u.a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id, w.doc_id = m.c as kept
from w left join n using (doc_id) join (select node, min(reach) as c from r group by node) m on m.node = w.doc_id"""

_RULES = [(rule, verdict, *rule.partition("/")[::2]) for verdict, rule in url_filter.RULES]
OP2_SQL = rf"""
with u as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_ASCII}) as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
rules(rule, verdict, name, start) as (values {', '.join(f"('{r}', '{v}', '{n}', '/{s}')" for r, v, n, s in _RULES)}),
f as (select page_id, max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) as r from u join rules
  on (host = name or ends_with(host, '.' || name)) and starts_with(path, start) group by page_id)
select u.page_id, host, path, r.rule as rule, coalesce(r.verdict, case when listed then 'block' else 'allow' end) as verdict, listed
from (select *, regexp_matches(host, '(^|\.)({LISTED_LABELS})') as listed from u) u left join f using (page_id)"""

OP8_SQL = f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(trim(line, {_BLANKS}), {_ASCII}) as key from l),
f as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3)
select doc_id, count(*) as n_lines, count(*) filter (where f.key is not null and k.doc_id <> f.last) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null or k.doc_id = f.last), '')) as kept_sha256
from k left join f using (key) group by doc_id"""


#: CRC-32 of ``conv_id:turn`` by its bits, then a backward recursion over the turns (costs of the states START, SYSTEM, USER, ASSISTANT) and a forward one over the edits.
OP11_SQL = r"""
with recursive raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
crc as (select *, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(name, ''), lambda x: ascii(x)::ubigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::ubigint[]), lambda c, i: xor(c >> 1, (c & 1::ubigint) * 3988292384::ubigint))), 4294967295::ubigint) % 20 as kind from raw),
dam as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
  unnest(range(case when kind = 3 then 2 else 1 end)) as copy from crc where kind <> 0),
dig as (select *, sha256(length(role) || ':' || role || text) as digest from dam),
pos as (select *, row_number() over (partition by conv_id order by turn nulls first, digest, copy) as p, row_number() over (partition by conv_id, digest order by turn nulls first, copy) as seen from dig),
t as (select conv_id, p, turn, role, text, case when role[1] in ('s', 'u', 'a') then role[1] else '?' end as i, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when seen > 1 then 2
  when right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) not in ('.', '!', '?') then 3 else 0 end as fault from pos),
n as (select conv_id, max(p) as n from t group by 1),
back(conv_id, p, f) as (select conv_id, n + 1, [0, 10, 5, 0] from n union all
  select conv_id, p, [least(g[1], 5 + g[3], 10 + g[4]), least(g[2], 5 + g[3], 10 + g[4]), least(g[3], 5 + g[4]), least(g[4], 5 + g[3])] from (
    select t.conv_id, t.p, list_transform([1, 2, 3, 4], lambda q: least(2 + f[q], case when fault in (1, 2) then 1000000000 else
      (case when fault = 3 then 5 else 0 end) + least(1 + f[[3, 3, 4, 3][q]], case when i = 's' and q = 1 then f[2] when i = 'u' and q <> 3 then f[3] when i = 'a' and q = 3 then f[4] else 1000000000 end) end)) as g
    from back join t on t.conv_id is not distinct from back.conv_id and t.p = back.p - 1)),
walk(conv_id, p, q, audit, lines) as (select conv_id, 1::bigint, 1, '', []::varchar[] from n union all
  select conv_id, case when e = 'I' then p else p + 1 end, case e when 'D' then q when 'K' then (case i when 's' then 2 when 'u' then 3 else 4 end) else [3, 3, 4, 3][q] end, audit || e,
    case e when 'D' then lines when 'K' then list_append(lines, role || ':' || text) else list_append(lines, (case when q = 3 then 'assistant:' else 'user:' end) || (case when e = 'R' then text else '' end)) end from (
    select w.*, t.i, t.role, t.text, case when t.p is null then 'I' when 2 + a.f[q] = b.f[q] then 'D' when 5 + b.f[[3, 3, 4, 3][q]] = b.f[q] then 'I'
      when (case when fault = 3 then 5 else 0 end) + (case when i = 's' and q = 1 then a.f[2] when i = 'u' and q <> 3 then a.f[3] when i = 'a' and q = 3 then a.f[4] else 1000000000 end) = b.f[q] then 'K' else 'R' end as e
    from walk w join back b on b.conv_id is not distinct from w.conv_id and b.p = w.p left join t on t.conv_id is not distinct from w.conv_id and t.p = w.p
      left join back a on a.conv_id is not distinct from w.conv_id and a.p = w.p + 1 where t.p is not null or b.f[q] > 0)),
done as (select conv_id, audit, lines from (select w.*, row_number() over (partition by conv_id order by length(audit) desc) as r from walk w) where r = 1),
sums as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate,
  count(*) filter (where fault = 3) as truncated, count(*) filter (where before || i not in ('su', 'ua', 'au')) as illegal from (select *, lag(i) over (partition by conv_id order by p) as before from t) group by 1)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(b.f[1], 0)::bigint as cost,
  coalesce(audit, '') as audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join sums s on s.conv_id is not distinct from c.conv_id left join done d on d.conv_id is not distinct from c.conv_id
left join back b on b.conv_id is not distinct from c.conv_id and b.p = 1"""

OP13_SQL = rf"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_WORD}) as ws from documents),
g as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
x as (select part, (case when len(ws) < 100 then 1 else 0 end) + (case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 2 else 0 end)
  + (case when 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) then 4 else 0 end)
  + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end) + (case when t.doc_id > f.first then 16 else 0 end) as mask, good, toxic
  from t join (select text, min(doc_id) as first from t group by 1) f using (text) left join g on g.doc_id = t.doc_id),
cells as (select part, mask, count(*) as n, count(*) filter (where good = 1) as good, count(*) filter (where toxic = 1) as toxic from x group by 1, 2),
letters(l, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
steps as (select v.l || w.l || x.l || y.l || z.l as filter_order, s.step, [v.b, w.b, x.b, y.b, z.b] as bs from letters v join letters w on w.b <> v.b
  join letters x on x.b not in (v.b, w.b) join letters y on y.b not in (v.b, w.b, x.b) join letters z on z.b not in (v.b, w.b, x.b, y.b), (select unnest(range(1, 6)) as step) s),
masks as (select filter_order, step, bs[step] as own, coalesce(list_sum(bs[1:step - 1]), 0)::bigint as before from steps)
select part, filter_order, step::int as step, sum(case when mask & (own | before)::bigint = 0 then n else 0 end)::bigint as kept,
  sum(case when mask & own <> 0 and mask & before = 0 then n else 0 end)::bigint as removed, sum(case when mask & own <> 0 and mask & before <> 0 then n else 0 end)::bigint as redundant,
  sum(case when mask = own then n else 0 end)::bigint as unique_fails, sum(case when mask & own <> 0 and mask & before = 0 then good else 0 end)::bigint as good_lost,
  sum(case when mask & own <> 0 and mask & before = 0 then toxic else 0 end)::bigint as toxic_lost,
  sum(case when mask & own <> 0 then n * 120 // bit_count(mask) else 0 end)::bigint as shapley
from cells, masks group by part, filter_order, step"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1_SQL, "op2_url_filter_cascade": OP2_SQL, "op8_line_dedup": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op13_filter_interaction_audit": OP13_SQL}

