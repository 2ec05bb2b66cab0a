"""The thin queries op1 to op13 over the corpus tables, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import (
    ball_kmeans, bpe_backtrack, chat_windows, html_template, line_chunks, ordinal_classifier, parity_join, quality_rules, simhash_windows, suffix_dedup, token_align, url_filter, warc_members,
)
from graphloom.llm.store import written

SENTENCE_MODEL, BYTE_MODEL, BYTE_RANKS = "piece_bpe_32k.model", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
KMEANS = {"k": 8, "rounds": 10, "seed": 3, "dims": 64}
#: Fixed values of the URL rules.
URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]
#: Advert hosts, by their first label after ``www.`` and ``m.``, whose URLs make up the list.
ADVERT_LABELS = ["ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
CONTROL_TURN = "<|im_end|><|im_start|>assistant ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return parity_join.near_duplicates(docs, k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(SENTENCE_MODEL)
    return bpe_backtrack.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe_backtrack.sha_of_ids(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def listed_adverts(pages: DataFrame) -> DataFrame:
    """The list for op3: canonical URLs of all pages on advert hosts."""
    url = url_filter.canonical(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    return pages.select(url.alias("listed_url")).where(F.substring_index("listed_url", ".", 1).isin(ADVERT_LABELS))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, listed_adverts(pages), URL_RULES).drop("url")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_chunks.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_removed_").alias("n_removed"), F.col("n_spans_").alias("n_spans"), sha.alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_windows.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 of low quality, 2 good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    ratings = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select("doc_id", grade.alias("grade"))
    sample = written(ordinal_classifier.bounded_sample(ratings), "ratings")
    model = ordinal_classifier.fit(docs.join(F.broadcast(sample), "doc_id"), 3)
    return ordinal_classifier.score(docs, model).drop("text")


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL_TURN).alias("text"))
    return chat_windows.conversation_digests(chat_windows.chat_windows(turns.unionByName(added)))


def op10_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_members.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ball_kmeans.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), **KMEANS)
    sha = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return out.withColumn("centroid", sha).withColumnRenamed("centroid", "centroid_sha256")


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    sha = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_align.corpus_alignment(docs, path(BYTE_MODEL), path(SENTENCE_MODEL), path(BYTE_RANKS), public_tokenizers.PATTERN, keep_text=False, digest=sha)
    return out.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    "op1_parity_join": op1_parity_join,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_url_filter": op3_url_filter,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_line_chunks": op5_line_chunks,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality_rules": op7_quality_rules,
    "op8_ordinal_quality": op8_ordinal_quality,
    "op9_chat_windows": op9_chat_windows,
    "op10_warc_members": op10_warc_members,
    "op11_html_template": op11_html_template,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_token_align": op13_token_align,
}

def kmeans_sql(k: int, rounds: int, seed: int, dims: int) -> str:
    """Plain k-means over all vectors and centroids, a few common table expressions a round."""
    apart = "list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = "a{i} as materialized (select r, any_value(vec_id) as vec_id, any_value(p) as p, arg_min(c, d * {k} + c) as c, min(d) as d from (select v.r, v.vec_id, v.p, c.c, {apart} as d from v cross join c{last} c) group by r)"
    parts = [
        f"""v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as p
  from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)""",
        f"c0 as materialized (select row_number() over (order by h, p) - 1 as c, p from (select sha256('{seed}:' || coalesce(cast(vec_id as varchar), '')) as h, p from v order by h, p limit {k}))",
    ]
    for i in range(1, rounds + 1):
        parts += [
            near.format(i=i, last=i - 1, k=k, apart=apart),
            f"s{i} as (select c, j, cast(sum(x) as bigint) as s, count(*) as n from (select c, unnest(p) as x, unnest(range({dims})) as j from a{i}) group by c, j)",
            f"n{i} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as p from s{i} group by c)",
            f"c{i} as materialized (select o.c, coalesce(n{i}.p, o.p) as p from c{i - 1} o left join n{i} using (c))",
        ]
    parts.append(near.format(i=rounds + 1, last=rounds, k=k, apart=apart))
    return f"""with {", ".join(parts)}
select vec_id, cast(a.c as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
       sha256(array_to_string(c.p, ',')) as centroid_sha256
from a{rounds + 1} a join c{rounds} c using (c)
"""


ORACLE_SQL = {
    "op12_ball_kmeans": kmeans_sql(**KMEANS),
    "op5_line_chunks": r"""
with lines as (
  select doc_id, i, string_split(coalesce(text, ''), chr(10))[i] as line
  from (select doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from documents)
), hashed as (
  select *, cast('0x' || substr(md5(line), 1, 8) as bigint) as h from lines
), rolled as (
  select *, (h + 31 * coalesce(lag(h, 1) over o, 0) + 961 * coalesce(lag(h, 2) over o, 0)) % 4 = 0 as cut from hashed window o as (partition by doc_id order by i)
), numbered as (
  select *, coalesce(sum(cast(cut as int)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as no from rolled
), chunks as (
  select doc_id, no, count(*) as n, count(*) filter (where regexp_matches(line, '[^ \t\n\x0B\f\r]')) as solid, string_agg(line, chr(10) order by i) as body
  from numbered group by doc_id, no
), judged as (
  select *, solid >= 2 and row_number() over (partition by body, solid >= 2 order by doc_id, no) > 1 as gone from chunks
)
select doc_id, cast(sum(n) as bigint) as n_lines, cast(coalesce(sum(n) filter (where gone), 0) as bigint) as n_removed, count(*) filter (where gone) as n_spans,
       sha256(coalesce(string_agg(body, chr(10) order by no) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
""",
    "op3_url_filter": r"""
with rest as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') as path
  from rest
), named as (
  select *, case when host = '' then '' else regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') end as canon from parts
), listed as (
  select distinct canon from named where string_split(canon, '.')[1] in ('ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm')
), rules(v, h, p) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), best as (
  select page_id, arg_max(v, length(h || p)) as v, arg_max(h || p, length(h || p)) as rule
  from named join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
)
select page_id, host, path, rule, coalesce(v, case when canon in (select canon from listed) then 'block' else 'allow' end) as verdict
from named left join best using (page_id)
""",
    "op10_warc_members": r"""
with base as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), hashed as (
  select page_id, octet_length(payload) as payload_bytes, sha1(payload) as hex, min(page_id) over (partition by payload) as first_id from base
), bits as (
  select *, array_to_string(list_transform(string_split(hex, ''), lambda x: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', x)]), '') as bin from hashed
)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         cast(1 + list_sum(list_transform(range(5), lambda j: cast(substr(bin, i * 5 + j + 1, 1) as int) * (16 >> j))) as int), 1)), '') as payload_digest,
       case when page_id > first_id then 'revisit' else 'response' end as record_type,
       case when page_id > first_id then first_id end as refers_to
from bits
""",
    "op9_chat_windows": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e as (
  select *, length(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) + 4 as cost,
         length('<|im_start|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10)) as chars
  from t
), p as (
  select *, row_number() over o - 1 as pos, sum(cost) over (o rows unbounded preceding) - cost as prefix
  from e window o as (partition by conv_id order by turn nulls first, role, text)
), w as (
  select *, cast(floor(prefix / 448) as bigint) as win from p
), firsts as (
  select conv_id, win, min(prefix) as first_prefix, lead(min(prefix)) over (partition by conv_id order by win) as next_prefix from w group by conv_id, win
), places as (
  select w.conv_id, chars, pos = 0 and role = 'system' as sys, (next_prefix is not null and next_prefix - prefix <= 128) as again
  from w join firsts using (conv_id, win)
), sized as (
  select conv_id, sum(chars * (case when again and not sys then 2 else 1 end)) as chars, coalesce(max(chars) filter (where sys), 0) as sys_chars from places group by conv_id
), nwin as (
  select conv_id, count(*) as n from firsts group by conv_id
), said as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
         coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss
  from t group by conv_id
)
select conv_id, n_turns, turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
       cast(chars + sys_chars * (n - 1) as bigint) as formatted_chars
from said join sized using (conv_id) join nwin using (conv_id)
""",
}
