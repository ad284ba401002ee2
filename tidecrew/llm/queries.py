"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecrew.llm import (
    boosting,
    bpe,
    htmltext,
    language,
    linededup,
    markov,
    negatives,
    neighbours,
    pulearning,
    resampling,
    simhash,
    warc,
    wumanber,
)
from tidecrew.llm.tables import fold_of, spread_evenly, table
from tidecrew.plans.durable import new_folder

VOCABULARY = "byte_bpe_50k.tiktoken"


TOXIC_FROM = 0.3
GOOD_FROM = 0.3


def op1_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(spread_evenly(table(spark, sf_dir, "pages")))


def op2_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_evenly(table(spark, sf_dir, "documents"))
    forest = boosting.fitted(docs, table(spark, sf_dir, "labels"))
    return boosting.judged(docs, forest)


def op3_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_evenly(table(spark, sf_dir, "documents"))
    index = neighbours.build(docs, table(spark, sf_dir, "labels"), neighbours.allowed_labels())
    return neighbours.scored(docs, index).select(
        "doc_id",
        (fold_of("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        "evidence",
    )


def op4_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linededup.cleaned(docs).select(F.col("row.doc_id").alias("doc_id"), "text", "n_lines", "n_removed")


def op5_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_evenly(table(spark, sf_dir, "documents"))
    model = pulearning.fitted(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 5) != 0)
    return pulearning.scored(docs, model).select(
        "doc_id",
        (fold_of("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"),
    )


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_archives(spread_evenly(table(spark, sf_dir, "pages")), path)
    return warc.resolved(warc.read_archives(spark, path))


def op7_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(spread_evenly(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op8_benchmark_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_evenly(table(spark, sf_dir, "documents"))
    found = wumanber.contaminated_words(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_evenly(table(spark, sf_dir, "documents"))
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).drop("ids")


def op10_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, docs = (spread_evenly(table(spark, sf_dir, name)) for name in ("pages", "documents"))
    return language.identified(pages, docs)


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_evenly(table(spark, sf_dir, "documents"))
    found = markov.scored(docs, fold_of("doc_id", 5) != 1)
    return found.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_prefix_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_evenly(table(spark, sf_dir, "documents"))
    return resampling.resampled(docs, table(spark, sf_dir, "benchmark"))


def op13_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(spread_evenly(table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_template_text,
        op2_boosted_rules,
        op3_toxic_neighbours,
        op4_line_winnowing,
        op5_positive_unlabelled,
        op6_warc_segments,
        op7_simhash_vantage,
        op8_benchmark_search,
        op9_byte_bpe,
        op10_language_fusion,
        op11_hidden_markov,
        op12_prefix_crc,
        op13_residue_negatives,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op8_benchmark_search": f"""
        with item as (select item_id, {_WORDS} as w from benchmark),
        sized as (select item_id, w, least(10, len(w)) as l from item where len(w) > 0),
        needle as (select distinct item_id, l, array_to_string(w[i : i + l - 1], ' ') as k
                   from (select *, unnest(range(1, len(w) - l + 2)) as i from sized)),
        doc as (select doc_id, {_WORDS} as w from documents),
        hay as (select doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') as k
                from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as i from doc, (select distinct l from needle))),
        met as (select doc_id, i, l, item_id from hay join needle using (l, k)),
        hit as (select doc_id, count(distinct spot) as n from (select doc_id, unnest(range(i, i + l)) as spot from met) group by 1),
        own as (select doc_id, count(*) as n, string_agg(s, ',' order by s) as ids
                from (select distinct doc_id, cast(item_id as varchar) as s from met) group by 1)
        select doc.doc_id, len(w) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(own.n, 0) as n_items,
               sha256(coalesce(ids, '')) as items_sha256, hit.n is not null as contaminated
        from doc left join hit using (doc_id) left join own using (doc_id)""",
    "op12_prefix_crc": f"""
        with recursive doc as (select doc_id, {_WORDS} as w from documents),
        gold as (select {_WORDS} as w from benchmark),
        word as (select distinct w from (select unnest(w) as w from doc union all select unnest(w) from gold)),
        step as (select list(list_reduce(list_prepend(n, range(8)),
                             lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by n) as t
                 from range(256) as r(n)),
        byte as (select w, list_prepend(4294967295, list_transform(range(octet_length(encode(w))),
                        lambda k: cast('0x' || substr(hex(encode(w)), 2 * k + 1, 2) as bigint))) as b from word),
        code as (select w, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) % 10000 as k
                 from byte, step),
        mine as (select k, count(*) as s from (select unnest(w) as w from doc) join code using (w) group by k),
        aims as (select k, count(*) as t from (select unnest(w) as w from gold) join code using (w) group by k),
        sums as (select (select coalesce(sum(s), 0) from mine) as s, (select coalesce(sum(t), 0) from aims) as t),
        gain as (select k, floor(1000 * ln((coalesce(aims.t, 0) + 1)::double * (sums.s + 10000)::double
                        / ((mine.s + 1)::double * (sums.t + 10000)::double)))::bigint as g
                 from mine left join aims using (k), sums),
        own as (select doc_id, count(*) as n, floor(sum(g) / count(*))::bigint as weight
                from (select doc_id, unnest(w) as w from doc) join code using (w) join gain using (k) group by doc_id),
        scored as (select doc.doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
                          coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc.doc_id), 1, 8))::bigint + 0.5)
                          / 4294967296.0)))::bigint as score
                   from doc left join own using (doc_id)),
        placed as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n
                   from scored where n_features >= 20)
        select doc_id, n_features, weight, score, case when place <= n * 10 // 100 then place end as rank
        from scored left join placed using (doc_id)""",
    "op13_residue_negatives": """
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                          list_transform(embedding, lambda x: floor(256 * x::double)) as q
                   from embeddings where label is not null and embedding is not null
                   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        met as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same,
                       list_inner_product(a.q, b.q)::bigint as score
                from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
        near as (select anchor_id, other as positive_id, score as positive_score from met where same
                 qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
        select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other)::int as rank,
               other as negative_id, positive_score, score as negative_score
        from near join met using (anchor_id)
        where not same and 80 * positive_score <= 100 * score and score <= positive_score
        qualify rank <= 5""",
}
