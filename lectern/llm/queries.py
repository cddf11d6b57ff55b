"""The training-data queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, collocations, fingerprint, langid, linededup, lm, ngramjoin, packing, quality, secrets, tokencount, urlfilter, whitening
from lectern.llm.shared import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(quality.text_stats(docs), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join_components(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), langid.held_out("doc_id", 7, 2))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out("doc_id", 4, 2)
    model = langid.fit(docs.where(~out))
    return langid.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: int) -> Column:
        return F.size(F.filter("base.kind", lambda k: k == kind)).cast("long")

    counts = [count(i).alias(n) for i, n in enumerate(["n_assign", "n_access", "n_hex"])]
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_join": op2_ngram_join,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_packing": op8_packing,
    "op9_imatch": op9_imatch,
    "op10_url_filter": op10_url_filter,
    "op11_token_counts": op11_token_counts,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}

_BLOCKED = ", ".join(f"'{h}'" for h in urlfilter.BLOCKED_HOSTS)

ORACLES: dict[str, str] = {
    "op10_url_filter": f"""
        with cut as (
          select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        parts as (
          select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') as path from cut),
        ruled as (
          select *, case
            when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
            when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
            when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
            when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from parts),
        listed(name) as (select unnest([{_BLOCKED}]))
        select page_id, host, path, rule,
               case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
                    when exists (select 1 from listed where host = name or ends_with(host, '.' || name)) then 'block' else 'allow' end as verdict
        from ruled""",
    "op12_collocations": """
        with cut as (select coalesce(lang, 'und') as lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
        spoken as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') as ws from cut),
        grams as (select lang, k, ws[i:i + k - 1] as ph from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from spoken cross join (select unnest([1, 2, 3, 4, 5]) as k) where len(ws) >= k)),
        f as (select lang, k, array_to_string(ph, ' ') as phrase, ph, count(*) as a from grams group by lang, k, ph),
        totals as (select lang, sum(a) as n from f where k = 1 group by lang),
        often as (select * from f where a >= 100),
        cuts as (select c.lang, c.k, c.phrase, c.a, j, array_to_string(c.ph[1:j], ' ') as p1, array_to_string(c.ph[j + 1:], ' ') as p2 from (select *, unnest(range(1, k)) as j from often where k > 1) c),
        priced as (select c.lang, c.k, c.phrase, c.a, c.j, x.a as l, y.a as r, t.n, (1000::hugeint * c.a * t.n) // (x.a::hugeint * y.a) as score
                   from cuts c join often x on x.lang = c.lang and x.phrase = c.p1 join often y on y.lang = c.lang and y.phrase = c.p2 join totals t on t.lang = c.lang),
        best as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) as o from priced) where o = 1),
        longer as (select lang, phrase, max(a) as a from (select lang, unnest([array_to_string(ph[1:k - 1], ' '), array_to_string(ph[2:], ' ')]) as phrase, a from often where k > 2) group by lang, phrase),
        kept as (select b.* from best b left join longer g on g.lang = b.lang and g.phrase = b.phrase where g.a is null or 100 * g.a < 100 * b.a)
        select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
        from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= 2000""",
}
