"""The registered queries of this package, one for each operator, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_quantisation, flac, katz, language_id, mixing, packing, phrases, pii, sharding, simhash, toxicity, url_filter, whitening
from .common import local_rows, remainder

#: The contract's rules, in its own words: action, host, path.
URL_RULES = '[{"action":"block","host":"com","path":"/en/"},{"action":"allow","host":"example.com","path":"/en/7"},{"action":"allow","host":"net","path":"/de/"},{"action":"block","host":"example.net","path":"/de/8"},{"action":"block","host":"org","path":"/es/"}]'
SHARDS = 40


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"), local_rows(spark, URL_RULES, "action string, host string, path string"))


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_features(flac.with_media(_read(spark, sf_dir, "documents")))


def op3_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = katz.score(_read(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) != 2)
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit(docs))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards"), F.col("order").alias("place"))


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_ranges(_read(spark, sf_dir, "documents"), SHARDS)


def op7_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    known = language_id.learn(docs, ~held)
    return language_id.identify(docs, known).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op8_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op9_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quantisation.search(_read(spark, sf_dir, "embeddings"))


def op10_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_stripes_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op12_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 5) == 0
    model = toxicity.learn(docs, _read(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_flac_media, op3_katz_scoring, op4_pii_boosting, op5_source_mixing, op6_sampled_splitters, op7_compression_language, op8_cutting_stock_packing, op9_additive_quantisation, op10_simhash_blocks, op11_stripes_phrases, op12_bit_sliced_whitening, op13_counterfactual_toxicity, pipeline)}


OP1_SQL = r"""
with u as (
  select page_id, case when url is not null and position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), r(action, rhost, rpath) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
select page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) as "rule", coalesce(arg_max(action, length(rhost || rpath)), 'allow') as verdict
from p left join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
group by page_id, host, path
"""


OP11_SQL = r"""
with p as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents where text is not null
), w as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p
), g as (
  select lang, k as m, array_to_string(list_slice(ws, i, i + k - 1), ' ') as phrase
  from w, unnest([1, 2, 3, 4, 5]) as s(k), unnest(range(1, len(ws) - k + 2)) as q(i)
), f as (
  select lang, m, phrase, count(*) as a from g group by all
), n as (
  select lang, cast(sum(a) as bigint) as n from f where m = 1 group by lang
), c as (
  select * from f where a >= 100 and m > 1
), held as (
  select c.lang, c.phrase from c join c as d on c.lang = d.lang and d.m > c.m and 100 * d.a >= 100 * c.a and contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')
), cuts as (
  select lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') as head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') as rest
  from c, unnest([1, 2, 3, 4]) as s(k) where k < m and (lang, phrase) not in (select (lang, phrase) from held)
), scored as (
  select cuts.lang, cuts.phrase, cuts.a, k, x.a as l, y.a as r, n.n, cast((cast(1000 as hugeint) * cuts.a * n.n) // (cast(x.a as hugeint) * y.a) as bigint) as score
  from cuts join f as x on x.lang = cuts.lang and x.phrase = head join f as y on y.lang = cuts.lang and y.phrase = rest join n on n.lang = cuts.lang
), low as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as "rank", phrase, a, l, r, n, score from low qualify "rank" <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op11_stripes_phrases": OP11_SQL}
