"""One query for each operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op2_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    return shards(table(spark, sf_dir, "documents"))


def op3_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents name their site by source; language is the level below."""
    from .site_bayes import site_quality

    return site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "source", "lang")


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decision_list import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup

    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wordpiece import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op8_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .golay import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnow import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_hash")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import licenses

    return licenses(table(spark, sf_dir, "documents"))


def op11_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clusters import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows that take part, with components as whole numbers.
_WHOLE = "list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint))"
_GOOD = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: cast(x[1] * x[2] as bigint)))"


def _rounds(n: int = 5) -> str:
    """Centroids c0 to cn and assignments a0 to an, a pair of tables a round."""
    out = []
    for i in range(n + 1):
        out.append(f"""d{i} as materialized (select rid, k, cast(list_sum(list_transform(list_zip(q, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as bigint) as d from v, c{i}),
a{i} as materialized (select rid, arg_min(k, (d, k)) as k, min(d) as d from d{i} group by rid)""")
        if i < n:
            out.append(f"""m{i} as (select k, p, cast(floor(sum(x) / count(*)) as bigint) as x from (select k, unnest(range(1, 65)) as p, unnest(q) as x from a{i} join v using (rid)) group by k, p),
c{i + 1} as materialized (select k, coalesce(n, c) as c from c{i} left join (select k, list(x order by p) as n from m{i} group by k) using (k))""")
    return ",\n".join(out)


SQL: dict[str, str] = {
    "op12_hard_negatives": f"""
with v as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {_WHOLE} as q from embeddings where label is not null and {_GOOD}),
s as materialized (select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same, cast({_DOT.format("a.q", "v.q")} as bigint) as s from v a join v on a.vec_id % 100 = 0 and a.vec_id <> v.vec_id and len(a.q) = len(v.q)),
p as (select anchor_id, vec_id as positive_id, s as positive_score from s where same qualify row_number() over (partition by anchor_id order by s desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by s desc, vec_id) as integer) as rank, vec_id as negative_id, positive_score, s as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * s and 100 * s <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by s desc, vec_id) <= 10""",
    "op13_centroid_clusters": f"""
with v as materialized (select row_number() over () as rid, vec_id, {_WHOLE} as q from embeddings where {_GOOD} and len(embedding) = 64),
c0 as materialized (select row_number() over (order by sha256('2:' || vec_id), vec_id) - 1 as k, q as c from v qualify k < 40),
{_rounds()},
t as (select k, sum(d) as t from a5 group by k)
select vec_id, cast(k as integer) as cluster, d as distance, cast(t as bigint) as cluster_inertia, cast((select sum(d) from a5) as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a5 join v using (rid) join t using (k) join c5 using (k)""",
    "op2_extendible_hashing": """
with d as (select row_number() over () as rid, doc_id, coalesce(octet_length(encode(text)), 0) as n_bytes,
             right(lpad(bin(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint), 60, '0'), 60) as a from documents),
     p as (select rid, depth, substr(a, 1, depth) as shard, n_bytes from d, range(0, 61) as t(depth)),
     s as (select depth, shard, sum(n_bytes) as bytes, count(*) as n from p group by all),
     m as (select rid, min(depth) as depth from p join s using (depth, shard) where bytes <= 1048576 or n = 1 group by rid)
select doc_id, cast(n_bytes as bigint) as n_bytes, substr(a, 1, depth) as shard, cast(depth as integer) as depth from d join m using (rid)""",
    "op9_winnowing": rf"""
with d as (select row_number() over () as rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
     i as (select cast(item_id as varchar) as item_id,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
     iw as (select distinct item_id, least(13, len(w)) as k, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') as g
            from i, unnest(range(1, greatest(1, len(w) - 12) + 1)) as t(p) where len(w) > 0),
     dw as (select rid, k, p, array_to_string(w[p:p + k - 1], ' ') as g
            from d, (select distinct k from iw) as s, unnest(range(1, cast(len(w) - k + 2 as bigint))) as t(p) where len(w) >= k),
     m as (select rid, p, k, item_id from dw join iw using (k, g)),
     hit as (select rid, count(distinct q) as n_hit from m, unnest(range(p, p + k)) as t(q) group by rid),
     ids as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct rid, item_id from m) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (rid) left join ids using (rid)""",
}


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
