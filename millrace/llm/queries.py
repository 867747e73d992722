"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.secret_scan import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.language import language_report

    return language_report(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.html import page_texts

    return page_texts(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.substrings import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), keep_first=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.near import near_classes

    return near_classes(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.resample import importance_sample

    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op13_ranking_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.ranking import line_places

    return line_places(table(spark, sf_dir, "sale_lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_quality": op3_quality,
    "op4_html_text": op4_html_text,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_bpe_roundtrip": op7_bpe_roundtrip,
    "op8_near_dedup": op8_near_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_importance_resample": op11_importance_resample,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_ranking_ties": op13_ranking_ties,
}


def _crc32(hexed: str) -> str:
    """CRC-32 in SQL of the bytes that a column of hexadecimal text holds, bit by bit."""
    byte = f"('0x' || substr({hexed}, 2 * k - 1, 2))::bigint"
    bit = "case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end"
    return f"xor(list_reduce(list_transform(range(1, length({hexed}) // 2 + 1), lambda k: {byte}), lambda c, b: list_reduce(range(8), lambda a, j: {bit}, xor(c, b)), 4294967295::bigint), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op10_exact_dedup": """
        with n as (
          select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
          from documents)
        select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from n""",
    "op11_importance_resample": rf"""
        with d as (
          select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
          from documents),
        b as (
          select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
          from benchmark),
        dw as (select doc_id, unnest(words) as word from d), bw as (select unnest(words) as word from b),
        known as (select word, hex(encode(word)) as h from (select word from dw union select word from bw)),
        code as (select word, {_crc32("h")} % 10000 as bucket from known),
        s as (select bucket, count(*) as n from dw join code using (word) group by bucket),
        t as (select bucket, count(*) as n from bw join code using (word) group by bucket),
        gain as (
          select s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::double * ((select sum(n) from s) + 10000)::double) / ((s.n + 1)::double * (coalesce((select sum(n) from t), 0) + 10000)::double)))::bigint as g
          from s left join t using (bucket)),
        w as (select doc_id, count(*) as n, sum(g)::bigint as total from dw join code using (word) join gain using (bucket) group by doc_id),
        f as (
          select doc_id, coalesce(n, 0) as n_features, coalesce((total - ((total % n) + n) % n) // n, 0) as weight,
                 ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h
          from d left join w using (doc_id)),
        scored as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from f),
        drawn as (
          select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n
          from scored where n_features >= 20)
        select doc_id, n_features, weight, score, case when r <= 10 * n // 100 then r end as rank
        from scored left join drawn using (doc_id)""",
    "op13_ranking_ties": f"""
        with code as (select sale_id, {_crc32("h")} % 5 = 0 as one from (select sale_id, hex(encode(sale_id::varchar)) as h from (select distinct sale_id from sale_lines where sale_id is not null))),
        r as (
          select case when coalesce(one, false) then -1 else vendor_id end as vendor_id,
                 case when coalesce(one, false) then -1 else coalesce(item_id % 10, -1) end as part,
                 case when coalesce(one, false) then -1 else coalesce(100 * year(shipped_at) + month(shipped_at), -1) end as month,
                 floor(quantity / 10)::bigint as tens, floor(100 * discount + 0.5)::bigint as percent, l.sale_id,
                 line_no::bigint as line_no, quantity::bigint as quantity, floor(100 * amount + 0.5)::bigint as amount_cents
          from sale_lines l left join code on l.sale_id = code.sale_id),
        p as (
          select *, rank() over (g order by tens desc nulls first, percent nulls first) as place, count(*) over (partition by vendor_id, part, month, tens, percent) as tied,
                 row_number() over (g order by tens desc nulls first, percent nulls first, sale_id nulls last, line_no nulls last, quantity nulls last, amount_cents nulls last) as pos
          from r window g as (partition by vendor_id, part, month))
        select vendor_id, part, month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied from p where place <= 3""",
}
