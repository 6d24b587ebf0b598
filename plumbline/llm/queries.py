"""The registered query of each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, then all documents; each row has the id of its own table."""
    from pyspark.sql import functions as F

    from .langid import identify_documents, identify_pages

    docs = table(spark, sf_dir, "documents")
    pages = identify_pages(table(spark, sf_dir, "pages"), docs)
    return pages.withColumn("doc_id", F.lit(None).cast("long")).unionByName(identify_documents(docs, docs).withColumn("page_id", F.lit(None).cast("long")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), held=1_000_000)  # no later stage needs the memory


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess

    return assess(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), 40)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece import encode

    return encode(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import mine

    return mine(table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("source")


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def _quality_sql() -> str:
    from .quality import RULES, STOP_WORDS

    fits = []
    for name, measure, low, high in RULES:
        top, bottom = measure.split(" / ")
        ratio = f"{top} / nullif({bottom}, 0)::double"
        both = [f"{ratio} >= {low}"] * (low is not None) + [f"{ratio} <= {high}"] * (high is not None)
        fits.append(f"coalesce({' and '.join(both)}, true) as fits_{name}")
    stop = ", ".join(repr(w) for w in dict.fromkeys(STOP_WORDS))
    return f"""with d as (select doc_id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') as a,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) as l from documents),
    g as (select doc_id, a, unnest(range(1, len(a) - 1)) as i from d where len(a) > 2),
    c as (select doc_id, i, count(*) over (partition by doc_id, a[i], a[i + 1], a[i + 2]) as n from g),
    r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from c where n > 1) group by 1),
    m as (select d.doc_id, len(a)::bigint as n_words, length(regexp_replace(t, '[ \\x09-\\x0D]', '', 'g'))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
      (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::bigint as n_marks, len(l)::bigint as n_lines,
      len(list_filter(a, lambda x: lower(x) in ({stop})))::bigint as n_stop_words from d left join r on d.doc_id = r.doc_id),
    f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {', '.join(fits)} from m)
    select *, not base_failed and {' and '.join(f'fits_{r[0]}' for r in RULES)} as kept from f"""


_TOPK_SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings),
s as (select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::bigint as score from v q, v where q.vec_id % 50 = 0 and q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) select query_id, rank, vec_id, score from r where rank <= 5"""


_COLLOCATIONS_SQL = """with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as a from p),
g as (select lang, k, unnest(list_transform(range(1, len(a) - k + 2), lambda i: array_to_string(a[i:i + k - 1], ' '))) as phrase from w, range(1, 6) t(k)),
f as (select lang, k, phrase, count(*)::bigint as n from g group by all),
c as (select lang, k, phrase, n as a, string_split(phrase, ' ') as x from f where k > 1 and n >= 100),
t as (select lang, sum(n)::bigint as n from f where k = 1 group by 1),
s as (select c.lang, c.phrase, c.a, l.n as l, r.n as r, t.n, i, (1000::hugeint * c.a * t.n // (l.n::hugeint * r.n))::bigint as score from c, range(1, 5) u(i), f l, f r, t
  where i < c.k and l.lang = c.lang and l.phrase = array_to_string(x[1:i], ' ') and r.lang = c.lang and r.phrase = array_to_string(x[i + 1:c.k], ' ') and t.lang = c.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, i) = 1),
o as (select * from b where not exists (select 1 from c where c.lang = b.lang and 100 * c.a >= 100 * b.a and c.phrase <> b.phrase and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a, l, r, n, score from o qualify rank <= 2000"""

_MIXING_SQL = """with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from d group by 1),
r as (select *, sum(source_size) over () as t, sum(w) over () as tw, coalesce(sum(source_size) over o, 0) as size_before, coalesce(sum(w) over o, 0) as w_before from s
  window o as (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding)),
h as (select *, (t - 3 * size_before) * w > 3 * source_size * (tw - w_before) as stops from r),
x as (select *, t - 3 * coalesce(sum(source_size) filter (stops) over (), 0) as rest, tw - coalesce(sum(w) filter (stops) over (), 0) as rest_w from h),
y as (select source, source_size, case when stops then 3 * source_size::double else least((rest * w)::double / greatest(rest_w, 1)::double, 3 * source_size::double) end as target from x),
z as (select doc_id, size, source_size, target, floor(target)::bigint as budget, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs,
  coalesce(sum(size) over (partition by d.source order by md5('mix:' || coalesce(doc_id::varchar, '')), size rows between unbounded preceding and 1 preceding), 0) as before from d join y on d.source is not distinct from y.source)
select doc_id, size, source_size, target, (epochs * size + part)::bigint as taken, epochs, part from (select *, least(greatest(budget - epochs * source_size - before, 0), size)::bigint as part from z)"""


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds as one common table each: vectors, then alternately centroids and assignments."""
    parts = [
        """v as materialized (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        f"c0 as materialized (select row_number() over (order by sha256('2:' || vec_id), x) - 1 as c, x as m from v qualify c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as materialized (select vec_id, x, arg_min(c, (d, c)) as c, min(d) as d from (select vec_id, x, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, c{i}) group by vec_id, x)""")
        if i < rounds:
            parts.append(f"""s{i} as (select c, i, sum(x[i])::bigint as s, count(*) as n from a{i}, range(1, 65) t(i) group by 1, 2)""")
            parts.append(f"""c{i + 1} as materialized (select c{i}.c, coalesce(y.m, c{i}.m) as m from c{i} left join (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as m from s{i} group by 1) y on y.c = c{i}.c)""")
    return f"""with {', '.join(parts)}
    select vec_id, a.c::int as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256 from a{rounds} a join c{rounds} c on a.c = c.c"""


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can say. The others' hashes, tokens, links and models can't be said in it; tests hold these against brute force."""
    return {
        "op4_quality_rules": _quality_sql(), "op8_topk": _TOPK_SQL, "op11_collocations": _COLLOCATIONS_SQL, "op12_mixing": _MIXING_SQL, "op13_clustering": _clustering_sql(),
    }
