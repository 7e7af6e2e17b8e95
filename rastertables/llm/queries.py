"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    byte_bpe, exact_dedup, mtree, packing, pivot_permutation, prob_minhash, quality_gam, rans, secret_scan, spelling_variants, substring_dedup, toxicity,
    whitening,
)
from .common import table


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def secret_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [rule.kind for rule in secret_scan.BASE_RULES]
    counts = [(F.size("spans") - F.size(F.array_remove("spans.kind", kind))).cast("long").alias(f"n_{kind}") for kind in base]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def token_file_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.read_ids(spark, rans.write_ids(table(spark, sf_dir, "documents")))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def byte_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def top_k_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_classes(table(spark, sf_dir, "documents")).drop("text_key")


def spelling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_groups(table(spark, sf_dir, "documents"))


def whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def embedding_links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_permutation.embedding_links(table(spark, sf_dir, "embeddings"))


REGISTRY = {
    "op1_secret_scan": secret_query,
    "op2_near_dedup": near_dedup_query,
    "op3_token_file": token_file_query,
    "op4_packing": packing_query,
    "op5_byte_bpe": byte_bpe_query,
    "op6_toxicity": toxicity_query,
    "op7_exact_dedup": exact_dedup_query,
    "op8_exact_top_k": top_k_query,
    "op9_substring_dedup": substring_query,
    "op10_quality_classifier": quality_query,
    "op11_spelling_variants": spelling_query,
    "op12_embedding_whitening": whitening_query,
    "op13_embedding_near_dedup": embedding_links_query,
}


def _secret_sql() -> str:
    """Spans of all rules: places are the lengths of what stands between and in the matches before."""
    def spans(order: int, rule: secret_scan.Rule) -> str:
        pattern = "'" + (rule.quick or rule.pattern).replace("'", "''") + "'"
        found = f"regexp_extract_all(coalesce(text, ''), {pattern})"
        between = f"string_split_regex(coalesce(text, ''), {pattern})"
        total = "coalesce(list_sum(list_transform({}, lambda t: length(t))), 0)"
        start = f"{total.format(f'{between}[1:i]')} + {total.format(f'{found}[1:i - 1]')}"
        held = f"length(regexp_extract({found}[i], {pattern}, {rule.group}))"
        each = f"{{'s': ({start})::bigint, 'o': {order}, 'k': '{rule.kind}', 'e': ({start} + length({found}[i]))::bigint, 'n': {held}}}"
        return f"list_filter(list_transform(range(1, len({found}) + 1), lambda i: {each}), lambda x: x.n >= {rule.least})"

    lists = [spans(i, rule) for i, rule in enumerate(secret_scan.RULES)]
    base = len(secret_scan.BASE_RULES)
    text = "coalesce(list_aggregate(list_transform(list_sort({}), lambda x: concat(x.k, ':', x.s, ':', x.e)), 'string_agg', ','), '')"
    counts = ", ".join(f"len(list_filter(a, lambda x: x.k = '{rule.kind}')) as n_{rule.kind}" for rule in secret_scan.BASE_RULES)
    return f"""
        select doc_id, {counts}, sha256({text.format(f"list_filter(a, lambda x: x.o < {base})")}) as base_sha256, {text.format("a")} as spans
        from (select doc_id, {" || ".join(lists)} as a from documents)"""


ORACLES = {
    "op1_secret_scan": _secret_sql(),
    "op2_near_dedup": r"""
        with recursive texts as (
            select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
        shingles as (
            select doc_id, g, count(*)::double as c from (
                select doc_id, unnest(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: array_to_string(words[i:i + 4], ' '))) as g
                from texts where len(words) > 0) group by all),
        sizes as (select doc_id, sum(c) as total from shingles group by doc_id),
        near as (  -- shared mass bounds the similarity from above
            select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id
            join sizes s on s.doc_id = a.doc_id join sizes t on t.doc_id = b.doc_id
            group by all having sum(least(a.c / s.total, b.c / t.total)) >= 0.799999),
        shapes as (
            select a, b, x, y, count(*) as n from (
                select a, b, g, sum(case when doc_id = a then c else 0 end) as x, sum(case when doc_id = b then c else 0 end) as y
                from near join shingles on doc_id = a or doc_id = b group by a, b, g) group by all),
        shared as (
            select s.a, s.b, s.x, s.y, any_value(s.n) as n, sum(t.n * greatest(t.x / s.x, t.y / s.y)) as spread
            from shapes s join shapes t on s.a = t.a and s.b = t.b where s.x > 0 and s.y > 0 group by s.a, s.b, s.x, s.y),
        links as (select a, b from shared group by a, b having sum(n / spread) >= 0.8),
        reach as (
            select doc_id, doc_id as other from texts
            union select reach.doc_id, case when links.a = reach.other then links.b else links.a end
            from reach join links on links.a = reach.other or links.b = reach.other),
        classes as (select doc_id, min(other) as class_id, count(*) as class_size from reach group by doc_id)
        select doc_id, class_id, class_size, doc_id = class_id as kept from classes""",
    "op9_substring_dedup": r"""
        with texts as (
            select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
        windows as (
            select doc_id, s, array_to_string(words[s:s + 49], ' ') as t
            from (select doc_id, words, unnest(range(1, len(words) - 48)) as s from texts where len(words) >= 50)),
        firsts as (select t, min(doc_id) as first from windows group by t),
        covered as (
            select distinct doc_id, unnest(range(s, s + 50)) as i from windows join firsts using (t) where doc_id > first),
        placed as (select doc_id, unnest(words) as w, unnest(range(1, len(words) + 1)) as i from texts),
        kept as (
            select doc_id, count(*) as n, string_agg(w, ' ' order by i) as t from placed anti join covered using (doc_id, i) group by doc_id)
        select doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from texts left join kept using (doc_id)""",
    "op8_exact_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
        scored as (
            select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint as score
            from v as q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0),
        ranked as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scored)
        select query_id, rank, vec_id, score from ranked where rank <= 5""",
    "op7_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id is not distinct from max(doc_id) over same as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))""",
    "op11_spelling_variants": r"""
        with recursive codes as (  -- CRC-32 of single bytes
            select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
        runs as (
            select doc_id, run, count(*) as n from (
                select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run
                from documents) group by all),
        bytes as (
            select doc_id, run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c:
                case when unicode(c) < 128 then [unicode(c)] else [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] end)) as b from runs),
        hashed as (
            select doc_id, run, n, xor(list_reduce(list_prepend(4294967295, b::bigint[]), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) as h
            from bytes, codes),
        words as (
            select word, sum(n)::bigint as n from (
                select n, case when doc_id is not null and h % 97 = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end as word from hashed)
            where length(word) >= 5 group by word having sum(n) >= 3),
        cuts as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
        short as (select word, n, i, word[1:i - 1] || word[i + 1:] as rest from cuts),
        pairs as (
            select a.word, b.word as other, b.n as m from short a join short b on a.i = b.i and a.rest = b.rest and a.word <> b.word
            union select s.word, w.word, w.n from short s join words w on s.rest = w.word
            union select w.word, s.word, s.n from short s join words w on s.rest = w.word),
        near as (
            select word, count(*) as n_near, max(m) as form_n, arg_min(other, (-m, other)) as form from pairs group by word),
        formed as (
            select words.word, n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * n then form end as form, case when form_n >= 2 * n then form_n end as form_n
            from words left join near using (word)),
        paths as (
            select word, form as root from formed where form is not null
            union all select paths.word, formed.form from paths join formed on formed.word = paths.root where formed.form is not null),
        ends as (select paths.word, root from paths join formed on formed.word = paths.root where formed.form is null)
        select formed.word, form, coalesce(root, formed.word) as root, n, n_near, form_n from formed left join ends using (word)""",
    "op13_embedding_near_dedup": """
        with recursive v as (
            select vec_id, embedding::double[] as e from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links as (
            select a.vec_id as a, b.vec_id as b from v as a join v as b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
            where list_cosine_similarity(a.e, b.e) >= 0.9),
        reach as (
            select vec_id, vec_id as other from embeddings
            union select reach.vec_id, links.b from reach join links on links.a = reach.other),
        least as (select vec_id, min(other) as component_id from reach group by vec_id),
        counts as (select a as vec_id, count(*) as n_links from links group by a)
        select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id is not distinct from component_id as kept
        from least left join counts using (vec_id)""",
}
