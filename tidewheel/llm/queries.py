"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, licences
from .common import on_workers
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .html_extract import extract_pages
from .jaccard_join import near_duplicates
from .quality import classify
from .secret_scan import find_secrets, summary
from .sentencepieces import encode_and_decode
from .sharding import shard
from .suffix_dedup import repeated_passages
from .token_counts import token_counts
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("matches")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("bucket", "local_depth", "owner")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("+", x["first"], x["words"])), ";")
    return found.withColumn("spans", spans)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(find_secrets(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_token_counts": op2_token_counts,
    "op3_sentencepiece": op3_sentencepiece,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_sharding": op6_sharding,
    "op7_license_scans": op7_license_scans,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_exact_dedup": op9_exact_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_secret_scans": op13_secret_scans,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op4_ngram_jaccard_join": f"""
with recursive w as (select doc_id, {_SPACED} as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) >= 5 then [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p where 100 * c >= 80 * (na + nb - c)),
bi as (select a, b from l union all select b, a from l),
r as (select doc_id as x, doc_id as y from documents union select r.x, bi.b from r join bi on bi.a = r.y)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, c.component_id from s join (select x as doc_id, min(y) as component_id from r group by 1) c using (doc_id)
""",
    "op5_benchmark_decontamination": f"""
with w as (select doc_id, {_ALNUM} as ws from documents),
it as (select item_id, {_ALNUM} as ws from benchmark),
iw as (select distinct item_id, k, array_to_string(ws[i:i + k - 1], ' ') as g from (select item_id, ws, least(10, len(ws)) as k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from it where len(ws) > 0)),
dw as (select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') as g from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w cross join (select distinct k from iw))),
m as (select doc_id, item_id, dw.k, i from dw join iw on iw.k = dw.k and iw.g = dw.g),
h as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + k)) as pos from m) group by 1),
n as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names from m group by 1)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from w left join h using (doc_id) left join n using (doc_id)
""",
    "op10_suffix_array_dedup": f"""
with w as (select doc_id, {_SPACED} as ws from documents),
g as (select doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) as g from (select doc_id, ws, unnest(range(0, len(ws) - 49)) as i from w where len(ws) >= 50)),
k as (select g, min(doc_id) as origin from g group by 1 having count(*) > 1),
m as (select doc_id, i, origin, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh from g join k using (g)),
r as (select doc_id, i, origin, sum(fresh) over (partition by doc_id order by i) as run from m),
s as (select doc_id, run, min(i) as first, max(i) + 50 - min(i) as words, min(origin) as origin from r group by 1, 2)
select s.doc_id, cast(any_value(len(ws)) as bigint) as n_words, cast(sum(words) as bigint) as n_repeated, min(origin) as first_doc_id, string_agg(first || '+' || words, ';' order by first) as spans from s join w using (doc_id) group by 1
""",
    "op7_license_scans": licences.oracle_sql(),
    "op11_source_divergence": divergence.oracle_sql(),
    "op9_exact_dedup": r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents),
g as (select norm, count(*) as group_size, arg_min(doc_id, (-length(t), doc_id)) as keep_id from d group by norm)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.norm) as text_sha256 from d join g using (norm)
""",
}
