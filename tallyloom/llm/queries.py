"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import ann, clustering, exact_dedup, jaccard, mixing, packing, quality, sharding, simhash, substring, suffix, token_counts, vector_codes
from tallyloom.llm.common import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.with_chances(documents(spark, sf_dir), keep=0.8, power=0.7)


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), 16)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("th")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(documents(spark, sf_dir), window=20, digest=True)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(documents(spark, sf_dir), width=3, num=90, den=100)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_suffixes(documents(spark, sf_dir), window=200, digest=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return token_counts.count_with_edits(docs, token_counts.drill, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=4, entries=256, rounds=4, scale=1024)
    return codes.withColumn("codebooks_sha256", F.lit(vector_codes.books_sha256(books)))


def op12_drake_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, scale=256, length=64)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(documents(spark, sf_dir), width=4, most=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_mixing, op3_inverted_multi_index, op4_sharding, op5_quality_classifier, op6_substring_dedup, op7_ngram_jaccard_join, op8_suffix_array_dedup, op9_packing, op10_token_counts, op11_vector_codes, op12_drake_clustering, op13_simhash)}

#: Floor of a division of integers, in SQL.
_FLOOR = "(({s}) - ((({s}) % {n}) + {n}) % {n}) // {n}"


def _vector_codes(rounds: int) -> str:
    """Rounds unrolled: a<i> assigns every part, b<i> has the codebooks."""
    floor = _FLOOR.format(s="sum(u.v)", n="count(*)")
    parts = [
        """e as (select vec_id, label, list_transform(embedding, lambda x: floor(x::double * 1024)::bigint) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "p as materialized (select vec_id, label, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] as v from e, range(4) as r(p))",
        "b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as k, v from (select * from p qualify row_number() over (partition by p order by vec_id) <= 256))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as materialized (select vec_id, label, p, any_value(v) as v, min(struct_pack(d := d, k := k)) as m from
            (select p.vec_id, p.label, p.p, p.v, b.k, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from p join b{i} as b on p.p = b.p) group by vec_id, label, p)""")
        if i < rounds:
            parts.append(f"""b{i + 1} as materialized (select b.p, b.k, coalesce(n.v, b.v) as v from b{i} as b left join (select p, k, list(v order by i) as v from
                (select p, m.k as k, u.i, ({floor})::bigint as v from a{i}, unnest(v) with ordinality as u(v, i) group by p, m.k, u.i) group by p, k) as n on n.p = b.p and n.k = b.k)""")
    parts.append(f"c as (select vec_id, label, string_agg(printf('%02x', m.k), '' order by p) as code, sum(m.d)::bigint as error from a{rounds} group by vec_id, label)")
    parts.append(f"h as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, k)) as h from b{rounds})")
    return f"with {', '.join(parts)} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from c, h"


def _clusters(rounds: int) -> str:
    """Rounds unrolled: a<i> assigns every vector, c<i> has the centroids."""
    floor = _FLOOR.format(s="sum(u.v)", n="count(*)")
    parts = [
        """v as materialized (select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "c0 as materialized (select row_number() over (order by sha256('2:' || vec_id)) - 1 as k, v from (select * from v order by sha256('2:' || vec_id) limit 40))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as materialized (select vec_id, any_value(v) as v, min(struct_pack(d := d, k := k)) as m from
            (select v.vec_id, v.v, c.k, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v, c{i} as c) group by vec_id)""")
        if i < rounds:
            parts.append(f"""c{i + 1} as materialized (select c.k, coalesce(n.v, c.v) as v from c{i} as c left join (select k, list(v order by i) as v from
                (select m.k as k, u.i, ({floor})::bigint as v from a{i}, unnest(v) with ordinality as u(v, i) group by m.k, u.i) group by k) as n using (k))""")
    return f"""with {", ".join(parts)} select vec_id, m.k::int as cluster, m.d as distance, (sum(m.d) over (partition by m.k))::bigint as cluster_inertia, (sum(m.d) over ())::bigint as inertia,
        sha256(array_to_string(c.v, ',')) as centroid_sha256 from a{rounds} join c{rounds} as c on c.k = m.k"""


#: DuckDB SQL for the rows of those queries that SQL can express.
ORACLES = {
    "op1_exact_dedup": r"""
        with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
        g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from d join g using (t)""",
    "op6_substring_dedup": r"""
        with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        s as (select doc_id, unnest(range(1, len(w) - 18)) as i, w from d),
        v as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as t from s),
        again as (select doc_id, i from (select doc_id, i, row_number() over (partition by t order by doc_id, i) as n from v) where n > 1),
        gone as (select doc_id, list_sort(list_distinct(flatten(list(range(i, i + 20))))) as g from again group by doc_id)
        select doc_id, len(w) as n_words, coalesce(len(g), 0) as n_removed,
            sha256(array_to_string(case when g is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda k: not list_contains(g, k)), lambda k: w[k]) end, ' ')) as kept_sha256
        from d left join gone using (doc_id)""",
    "op7_ngram_jaccard_join": r"""
        with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as s from d),
        t as (select doc_id, len(s) as n, unnest(s) as t from s),
        links as (select a.doc_id as a, b.doc_id as b from t as a join t as b on a.t = b.t and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
            group by all having 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
        edges as (select a, b from links union all select b, a from links),
        reach as (select doc_id as x, doc_id as y from s union select r.x, e.b from reach as r join edges as e on r.y = e.a)
        select doc_id, len(s) as n_shingles, c.component_id from s join (select x, min(y) as component_id from reach group by x) as c on c.x = s.doc_id""",
    "op11_vector_codes": _vector_codes(4),
    "op12_drake_clustering": _clusters(5),
}
