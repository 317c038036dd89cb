"""The registered queries of this folder and, where SQL can say it, the SQL each must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clinicframe.llm import (
    cover_dedup, embedding_dedup, golomb_dedup, impact_search, ngram_join, orchard_codes, pattern_packing, pii_disclosure, polynomial_whitening,
    quality_classifier, suffix_dedup, warc_chunks, weighted_mix,
)
from clinicframe.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_disclosure.digest(table(spark, sf_dir, "documents"))


def op3_cover_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_dedup.digest(table(spark, sf_dir, "documents"))


def op4_golomb_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golomb_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_mix.mix(table(spark, sf_dir, "documents"))


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc_chunks.write_archives(table(spark, sf_dir, "pages"), path)
    return warc_chunks.read_archives(spark, path)


def op7_universe_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_copies(table(spark, sf_dir, "embeddings"))


def op10_suffix_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op11_polynomial_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polynomial_whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(table(spark, sf_dir, "embeddings"))


def op13_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard_codes.encode(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_classifier, op2_pii_disclosure, op3_cover_substring_dedup, op4_golomb_exact_dedup, op5_weighted_mix, op6_warc_chunks,
        op7_universe_ngram_join, op8_embedding_dedup, op9_pattern_packing, op10_suffix_substring_dedup, op11_polynomial_whitening, op12_impact_search,
        op13_orchard_codes,
    )
}

_NEAREST_SQL = """
a{n} as (
  select vec_id, label, part, any_value(s) as s, min(struct_pack(d := list_dot_product(s, s) - 2 * list_dot_product(s, c) + list_dot_product(c, c), e := entry)) as best
  from p join b{n} using (part) group by vec_id, label, part)"""

_MOVED_SQL = """
m{n} as (
  select part, best.e as entry, [floor(sum(s[1]) / count(*)), floor(sum(s[2]) / count(*)), floor(sum(s[3]) / count(*)), floor(sum(s[4]) / count(*))] as c
  from a{n} group by part, best.e),
b{next} as (select b.part, b.entry, coalesce(m.c, b.c) as c from b{n} b left join m{n} m using (part, entry))"""

#: For vectors of 64 components, as the test tables have them.
_CODES_SQL = f"""
with v as (
  select vec_id, label, list_transform(embedding, lambda c: floor(256 * c::double)) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
p as (select vec_id, label, part, x[4 * part + 1 : 4 * part + 4] as s from v, range(16) r(part)),
b0 as (
  select part, entry, s as c from (select part, s, row_number() over (partition by part order by vec_id) - 1 as entry from p) where entry < 64),
{_NEAREST_SQL.format(n=0)}, {_MOVED_SQL.format(n=0, next=1)}, {_NEAREST_SQL.format(n=1)}, {_MOVED_SQL.format(n=1, next=2)}, {_NEAREST_SQL.format(n=2)},
r as (select vec_id, label, string_agg(printf('%02x', best.e::int), '' order by part) as code, sum(best.d)::bigint as error from a2 group by vec_id, label),
t as (select label, sum(error)::bigint as label_error from r group by label),
k as (
  select sha256(string_agg(list_aggregate(list_transform(c, lambda z: z::bigint::varchar), 'string_agg', ','), ',' order by part, entry)) as codebooks_sha256 from b2)
select vec_id, code, error, label_error, codebooks_sha256 from r join t on r.label is not distinct from t.label, k
"""

ORACLES: dict[str, str] = {
    "op4_golomb_exact_dedup": r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as n from documents)
select doc_id, min(doc_id) over (partition by n) as keep_id, count(*) over (partition by n) as group_size,
       doc_id = min(doc_id) over (partition by n) as kept, sha256(n) as text_sha256
from t
""",
    "op6_warc_chunks": r"""
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select *, octet_length(encode(html)) as n, max(page_id) over (partition by html) as leader from p)
select page_id, n as payload_bytes, sha1(html) as payload_digest,
       case when n >= 1000 and page_id <> leader then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id <> leader then leader end as refers_to
from q
""",
    "op5_weighted_mix": r"""
with d as (
  select doc_id, source, coalesce(text, '') as t from documents),
k as (
  select doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::bigint as size,
         -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':0:' || md5(t)), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
           / (1 / (1 + 20 * (length(t) - length(translate(t, '#$%&*!|', '')))::double / greatest(length(t), 1))) as key
  from d),
s as (
  select source, sum(size)::bigint as source_size,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight
  from k group by source),
b as (select *, 2.0 * source_size::double as lim, 1.5 * (sum(source_size) over ())::double as budget from s),
r as (
  select *, coalesce(sum(lim) over w, 0.0) as used, sum(weight) over () - coalesce(sum(weight) over w, 0.0) as rest
  from b window w as (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, case when (budget - used) / rest * weight < lim then (budget - used) / rest end as one_level from r),
g as (select *, max(one_level) over () as level from l),
x as (
  select source, source_size, least(lim, coalesce(level * weight, lim)) as target,
         case when source_size > 0 then floor(least(lim, coalesce(level * weight, lim)) / source_size) else 0 end as epochs from g),
o as (
  select k.*, x.source_size, x.target, x.epochs, x.target - x.epochs * x.source_size as rest,
         coalesce(sum(size) over (partition by k.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from k join x on k.source is not distinct from x.source)
select doc_id, size, source_size, target,
       (size * (epochs + case when before + size / 2.0 <= rest then 1 else 0 end))::bigint as taken
from o
""",
    "op12_impact_search": r"""
with v as (
  select vec_id, list_transform(embedding, lambda c: floor(64 * c::double)) as x from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
""",
    "op13_orchard_codes": _CODES_SQL,
}
