"""Scalar functions over texts and times, applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import redaction, text
from parley.functions.numbers import rounded
from parley.functions.ratio import matching_ratio
from parley.operators import engagement
from parley.plans.ctes import WORDS
from parley.registry import declare, operator
from parley.views import M, TOKENS, messages, table

_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)<msg>.*?</msg>', ' ', 'g'), '\[(image|voice|video|sticker|file)\]', ' ', 'g'), '\s+', ' ', 'g'))"


@operator("str_01", f"select conv_id, turn, md5({_CLEAN}) as cleaned, length({_CLEAN}) >= 2 as is_valid, regexp_matches(text, '(?s)<msg>.*?</msg>') as has_markup from conversations")
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without markup and placeholders, white space collapsed; whether two characters are left."""
    c = text.cleaned(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(c).alias("cleaned"), (F.length(c) >= 2).alias("is_valid"), F.col("text").rlike("(?s)<msg>.*?</msg>").alias("has_markup"))


declare("str_02", "Characters without blanks, and whether there is punctuation.", """
select conv_id, turn, length(replace(text, ' ', '')) as chars, text like '%.%' or text like '%,%' or text like '%!%' as punctuated from {conversations}""")


@operator("str_03", r"select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) as words from documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between white space."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")).alias("words"))


#: A keycap, a flag, or a sign with its variants, joined ones as one.
_EMOJI = r"(?:[\x{1F1E6}-\x{1F1FF}]{2}|[0-9#*]\x{FE0F}?\x{20E3}|[\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}]\x{FE0F}?[\x{1F3FB}-\x{1F3FF}]?(?:\x{200D}[\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}]\x{FE0F}?[\x{1F3FB}-\x{1F3FF}]?)*)"


@operator("str_04", f"select conv_id, turn, array_to_string(regexp_extract_all(text, '{_EMOJI}'), ' ') as emoji from conversations")
def emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emoji clusters (keycaps, flags, joined sequences and skin tones as one) of each text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.regexp_extract_all("text", F.lit(_EMOJI), F.lit(0)), " ").alias("emoji"))


@operator("str_05", f"""with {M}, r as (select id, case when id % 3 = 0 then '<emoji md5="' || md5(content) || '"/>' when id % 3 = 1 then md5(content) else content end as raw from m where message_type = 47)
select id, coalesce(nullif(regexp_extract(raw, 'md5="([0-9a-f]{{32}})"', 1), ''), nullif(regexp_extract(raw, '^([0-9a-f]{{32}})$', 1), ''), 'other') as sticker from r""")
def sticker_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sticker ids: an attribute, a bare hash, else one bucket for all others."""
    c = F.col("content")
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit('<emoji md5="'), F.md5(c), F.lit('"/>'))).when(F.col("id") % 3 == 1, F.md5(c)).otherwise(c)
    found = [F.nullif(F.regexp_extract(raw, p, 1), F.lit("")) for p in ('md5="([0-9a-f]{32})"', "^([0-9a-f]{32})$")]
    return messages(spark, sf_dir).where("message_type = 47").select("id", F.coalesce(*found, F.lit("other")).alias("sticker"))


@operator("str_06", "select doc_id, regexp_matches(text, '(?i)(license|copyright)') as legal, regexp_matches(text, '(?i)(token|secret|password)') as secret, regexp_matches(text, '(?i)(http|www)') as link from documents")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of words found in documents, whatever their case."""
    found = {"legal": "license|copyright", "secret": "token|secret|password", "link": "http|www"}
    return table(spark, sf_dir, "documents").select("doc_id", *(F.col("text").rlike(f"(?i)({p})").alias(k) for k, p in found.items()))


@operator("str_07", "select doc_id, len(regexp_extract_all(lower(text), '(^|[^a-z])(we|us|our)([^a-z]|$)')) as we, len(regexp_extract_all(lower(text), '(^|[^a-z])(i|me|my)([^a-z]|$)')) as i from documents")
def pronouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of pronouns of the first person."""
    low = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", *(F.regexp_count(low, F.lit(f"(^|[^a-z])({p})([^a-z]|$)")).alias(k) for k, p in (("we", "we|us|our"), ("i", "i|me|my"))))


@operator("str_08", f"""with {M}, r as (select id, left(content, cast(1 + id % 16 as int)) as reply from m)
select id, reply, reply <> '' and reply not in ('view {{"k": 2}}') and (reply in ('click {{"k": 4}}', 'view {{"k": 2}}') or length(reply) <= 2) as perfunctory from r""")
def perfunctory_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that say little: on a list or of two characters at most, but neither empty nor engaged."""
    r = messages(spark, sf_dir).select("id", F.expr("left(content, cast(1 + id % 16 as int))").alias("reply"))
    return r.withColumn("perfunctory", engagement.perfunctory(F.col("reply"), WORDS))


@operator("str_09", f"with {M} select id, starts_with(content, 'view') and length(content) <= 14 as morning, starts_with(content, 'click') and length(content) <= 14 as night from m")
def greetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greetings of the morning and the night by their first words and length."""
    return messages(spark, sf_dir).select("id", *(engagement.greeting(F.col("content"), WORDS, k).alias(k) for k in ("morning", "night")))


@operator("str_10", r"""with w as (select vec_id, 'vector ' || vec_id || ' of label ' || label as t from embeddings), k as (select vec_id, t, replace(t, ' ', '') as c from w)
select vec_id, array_to_string(list_concat(list_filter(string_split(t, ' '), lambda x: length(x) >= 2), list_transform(range(1, length(c)), lambda i: substring(c, i, 2)), list_transform(range(1, length(c) - 1), lambda i: substring(c, i, 3)), list_transform(range(1, length(c) - 2), lambda i: substring(c, i, 4)))[1:300], '|') as grams from k""")
def gram_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two letters or more, then character runs of two, three and four, 300 at most."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("vector "), F.col("vec_id").cast("string"), F.lit(" of label "), F.col("label").cast("string")).alias("t"))
    c = F.replace(F.col("t"), F.lit(" "), F.lit(""))
    grams = F.concat(F.filter(F.split("t", " "), lambda x: F.length(x) >= 2), *(text.character_grams(c, n) for n in (2, 3, 4)))
    return t.select("vec_id", F.array_join(F.slice(grams, 1, 300), "|").alias("grams"))


@operator("str_11", """select c_custkey, array_to_string(list_sort(list_distinct(flatten(list_transform(string_split(lower(replace(c_name, '#', ' ')), ' '), lambda w: list_concat([w], list_transform(range(1, length(w)), lambda i: substring(w, i, 2))))))), ' ') as tokens from customer""")
def segment_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole segments and their pairs of characters, as a set."""
    words = F.split(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(" "))), " ")
    each = F.transform(words, lambda w: F.concat(F.array(w), text.character_grams(w, 2)))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(F.array_distinct(F.flatten(each))), " ").alias("tokens"))


@operator("str_12", """with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as ws from documents),
p as (select lang, ws[i] || ' ' || ws[i + 1] as phrase from w join documents using (doc_id), unnest(range(1, len(ws))) as x(i) where length(ws[i]) between 2 and 5 and length(ws[i + 1]) between 2 and 5)
select lang, phrase, count(*) as n from p group by 1, 2 having count(*) >= 3""")
def candidate_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring short words that occur three times or more in a language; a longer word is a boundary."""
    words = table(spark, sf_dir, "documents").select("lang", text.tokens(F.col("text")).alias("w")).where("size(w) > 1")
    pairs = words.select("lang", F.explode(F.expr("transform(filter(sequence(1, size(w) - 1), i -> length(w[i - 1]) between 2 and 5 and length(w[i]) between 2 and 5), i -> concat(w[i - 1], ' ', w[i]))")).alias("phrase"))
    return pairs.groupBy("lang", "phrase").agg(F.count("*").alias("n")).where("n >= 3")


@operator("str_13", f"""with {TOKENS}, n as (select token, count(*) as n from tokens group by 1) select token, n from n where length(token) >= 2 and token not in ('the', 'and', 'der', 'und', 'les', 'los')
  and not regexp_full_match(token, '[0-9]+') and replace(token, token[1], '') <> '' and not (length(token) >= 4 and length(token) % 2 = 0 and token[:length(token) // 2] = token[length(token) // 2 + 1:])""")
def accepted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that count: two characters or more, no stop word, no number, no repeated character or doubled half."""
    from parley.views import doc_tokens

    n = doc_tokens(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n"))
    return n.where((F.length("token") >= 2) & ~F.col("token").isin("the", "and", "der", "und", "les", "los") & ~F.col("token").rlike(r"^[0-9]+$|^(.)\1+$|^(.{2,})\2$"))


#: The classes of personal data for an engine without look-around: what may not stand beside a match is taken into it.
_BESIDE, _AFTER, _NO_DIGIT, _END = "(?:^|[^0-9A-Za-z])", "(?:$|[^0-9A-Za-z])", "(?:^|[^0-9])", "(?:$|[^0-9])"
PII_SQL = {
    "api_key": f"(?i){_BESIDE}(?:sk|api[_-]?key|token|secret)[-_:=\\s]*[A-Za-z0-9_-]{{16,}}(?:$|[^0-9A-Za-z_-])", "id_card": f"{_BESIDE}[0-9]{{17}}[0-9Xx]{_AFTER}", "bank_card": f"{_BESIDE}(?:[0-9][ -]?){{16,19}}{_AFTER}",
    "phone": f"{_NO_DIGIT}(?:\\+?86[-\\s]?)?1[3-9][0-9]{{9}}{_END}", "email": f"{_BESIDE}[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}{_AFTER}",
    "url": f"(?i){_BESIDE}(?:https?://|www\\.)", "landline": f"{_NO_DIGIT}(?:0[0-9]{{2,3}}[-\\s]?[0-9]{{7,8}}|400[-\\s]?[0-9]{{3,4}}[-\\s]?[0-9]{{3,4}}){_END}",
    "address": "[\u4e00-\u9fa5]{2,}(?:省|市|区|县|镇|乡|路|街|巷|号楼|单元|室)[\u4e00-\u9fa5A-Za-z0-9-]{2,30}",
}


@operator("str_14", "select doc_id, " + ", ".join(f"coalesce(regexp_matches(text, '{PII_SQL[k]}'), false) as has_{k}" for k in redaction.KINDS) + " from documents")
def personal_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of eight guarded classes of personal data a text holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", redaction.entities(F.col("text")).alias("kinds"))
    return docs.select("doc_id", *(F.array_contains("kinds", k).alias(f"has_{k}") for k in redaction.KINDS))


@operator("str_15")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by placeholders that are the same for the same value, overlaps resolved, and what was replaced."""
    return table(spark, sf_dir, "documents").select("doc_id", redaction.redacted(F.col("text")).alias("r")).select("doc_id", "r.redacted", F.size("r.spans").alias("n_spans"), F.to_json("r.spans").alias("spans"))


@operator("str_16", r"select doc_id, md5(regexp_replace(regexp_replace(text, '[0-9]', '*', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '<email>', 'g')) as masked from documents")
def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong masking: every digit, every address."""
    hidden = F.regexp_replace(F.regexp_replace("text", "[0-9]", "*"), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<email>")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(hidden).alias("masked"))


declare("str_17", "Content keys.", "select doc_id, md5(text) as key from {documents}")

declare("str_18", "Texts clipped to 80 characters.", "select conv_id, turn, case when length(text) > 80 then concat(substring(text, 1, 80), '…') else text end as clipped from {conversations}")


@operator("str_19", """with a as (select turn, conv_id, 'see [' || (turn + 1) || '] and [' || (turn + 5) || '] and [1]' as answer from conversations)
select conv_id, turn, array_to_string(list_filter(list_sort(list_distinct(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1))), lambda x: cast(x as int) <= 4), ',') as cited from a""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of an answer that are among the four sources shown."""
    answer = F.concat(F.lit("see ["), (F.col("turn") + 1).cast("string"), F.lit("] and ["), (F.col("turn") + 5).cast("string"), F.lit("] and [1]"))
    found = F.filter(F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), F.lit(1)))), lambda x: x.cast("int") <= 4)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("cited"))


declare("str_20", "Direction of negativity: pronouns and signals add up, beyond 1.5 they tell a side.", """
with k as (select id, (case when content like '%: 1%' then 2.0 else 0.0 end) - (case when content like '%: 2%' then 2.0 else 0.0 end) + (case when content like 'error%' then 1.5 else 0.0 end) as score from {m})
select id, cast(score as double) as score, case when score >= 1.5 then 'other' when score <= -1.5 then 'self' else 'unclear' end as direction, cast(round(least(1.0, abs(score) / 4.0), 4) as double) as confidence from k""")

declare("str_21", "A layer of word rules over a model's score.", """
with k as (select m.id, s.intensity, case when m.content like 'error%' then least(1.0, s.intensity * 1.2) when m.content like '%: 7%' then s.intensity * 0.5 when length(m.content) <= 12 then 0.0 else s.intensity end as level from {m} m join {s} s on s.message_id = m.id)
select id, cast(round(level + 1e-9, 4) as double) as level, case when level > 0.3 then 1 when level < -0.3 then -1 else 0 end as polarity from k""")


@operator("str_22")
def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gestalt matching ratio of neighbouring turns, over their whole texts."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return turns.select("conv_id", "turn", rounded(matching_ratio(F.col("before"), F.col("text"))).alias("ratio"))


declare("str_23", "Escaped for HTML.", """
select page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) as escaped from {pages}""")

declare("dat_01", "Labels of buckets: day, week from Monday, month, year.", """
select id, cast(ts as date) as day, cast(date_trunc('week', ts) as date) as week, cast(date_trunc('month', ts) as date) as month, year(ts) as year from {m}""")

declare("dat_02", "Epoch of the week's start.", "select id, ts_sec - mod(ts_sec + 259200, 604800) as week_sec from {m}")


@operator("dat_03", f"with {M} select id, isodow(ts) - 1 as weekday from m")
def weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays from Monday, 0."""
    return messages(spark, sf_dir).select("id", F.weekday("ts").alias("weekday"))


declare("dat_04", "Whether a pause of eight hours from here spans the night.", """
select id, (ts_sec + 28800) {div} 86400 <> ts_sec {div} 86400 or (mod(ts_sec, 86400) < 25200 and mod(ts_sec + 28800, 86400) >= 25200) as asleep from {m}""")

declare("dat_05", "Whether three hours from here hold an hour from two to six.", """
select id, """ + " or ".join(f"(ts_sec + 10800 - {h * 3600}) {{div}} 86400 > (ts_sec - {h * 3600}) {{div}} 86400" for h in range(2, 7)) + " as deep from {m}")

declare("dat_06", "Names of hours.", """
select id, case when hour(ts) < 5 then 'late night' when hour(ts) < 8 then 'early' when hour(ts) < 11 then 'morning' when hour(ts) < 14 then 'noon' when hour(ts) < 18 then 'afternoon' when hour(ts) < 22 then 'evening' else 'night' end as part from {m}""")

declare("dat_07", "Holidays within a day: fixed ones, and the third Monday of January.", """
with d as (select distinct cast(ts as date) as day, day(ts) as dom, month(ts) as mon, ts_sec {div} 86400 as n from {m}),
k as (select day, dom, mon, case when mon = 1 and dom <= 2 then 'new year' when mon = 1 and n - mod(n + 3, 7) - (n - dom) between 15 and 21 and mod(n + 3, 7) <= 1 then 'third monday' when mon = 1 and dom between 24 and 26 then 'january 25' end as holiday from d)
select day, holiday from k where holiday is not null""")

declare("dat_08", "Minutes in words.", """
with r as (select id, ts_sec % 7200 {div} 60 as minutes from {m}) select id, case when minutes < 60 then concat(cast(minutes as varchar(10)), ' min') else concat(cast(minutes {div} 60 as varchar(10)), ' h ', cast(minutes % 60 as varchar(10)), ' min') end as said from r""")

declare("dat_09", "Weights that decay with age, never below 0.2.", """
select id, round(greatest(0.2e0, exp(-(1706572800 - ts_sec) / 86400e0 / 60e0)) + 1e-9, 4) as weight from {m}""")
