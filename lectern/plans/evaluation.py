"""Evaluation metrics over prediction tables, and service-log reports."""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import adapters
from lectern.plans.quantiles import percentiles
from lectern.plans.retrieval import _KNN_ORACLE, knn
from lectern.plans.text import edit_distance, register_edits, word_error_rate
from lectern.registry import dialect, register, register_dialects, register_sql
from lectern.storage import written

_ERRORS = "e0 as (select sample_id, category, confidence, truth, prediction, levenshtein(truth, prediction) as distance from ocr_pairs), e as (select *, cast(distance as double) / greatest(1, length(truth)) as cer from e0)"
_MEDIAN = {"MEDIAN(": ("percentile(", "quantile_cont(")}
_WORDS = {"BOTH(": ("array_intersect(", "list_intersect("), "WORDS(": ("split(", "string_split(")}


def _oracle(views: list[str], body: str) -> dict:
    return {"views": views, "oracle": dialect(body, 1, **_MEDIAN, **_WORDS)}


def _beside(means: DataFrame, found: DataFrame, keys: list[str], *names: str) -> DataFrame:
    """means with the percentiles of the same groups, a column each; groups without values have none."""
    p = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.round(F.get("p", F.lit(i)), 6).alias(name) for i, name in enumerate(names)])
    both = F.lit(True)
    for k in keys:
        both = both & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return means.join(p, both, "left").select(*means.columns, *names)


#: Runs of white space, for both engines.
_GAPS = r"[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]+"


def normalized(text: Column) -> Column:
    """Lower case, each run of white space one blank, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, _GAPS, " ")))


def ocr_errors(pairs: DataFrame) -> DataFrame:
    """(cer, wer, distance, exact, size, words) of each pair (truth, prediction), compared in lower case with single blanks.

    An error rate of a truth without characters (or words) is 0 beside an empty prediction, else 1. size counts the characters of the truth as it is.
    """
    texts = pairs.select(F.length("truth").alias("size"), normalized(F.col("truth")).alias("t"), normalized(F.col("prediction")).alias("p"))
    rows = texts.select("size", "t", "p", edit_distance("t", "p").alias("distance"), word_error_rate("t", "p").alias("wer"))
    cer = F.when(F.length("t") > 0, F.col("distance").cast("double") / F.length("t")).otherwise(F.when(F.col("p") == "", 0.0).otherwise(1.0))
    return rows.select(cer.alias("cer"), "wer", "distance", (F.col("t") == F.col("p")).alias("exact"), "size", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", " "))).alias("words"))


def _ocr_metrics(s: SparkSession, d: str) -> DataFrame:
    e = written(ocr_errors(adapters.view(s, d, "ocr_pairs")), "errors")
    rates = [f(x).alias(f"{name}_{x}") for x in ("cer", "wer") for name, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("sd", lambda c: F.round(F.stddev_pop(c), 6)))]
    means = e.agg(F.count("*").alias("samples"), *rates, F.round(F.avg(F.col("exact").cast("double")), 6).alias("exact_rate"), F.round(F.avg("distance"), 6).alias("mean_distance"), F.sum("size").alias("chars"), F.sum("words").alias("words"))
    for x in ("cer", "wer"):
        means = _beside(means, percentiles(e, [], x, [0.5]), [], f"median_{x}")
    return means


# word edits in SQL: pairs of one length of which no word that differs on one side differs on the other count their places; the few others go row by row
# through the table of distances
_OCR_ORACLE = f"""with recursive texts as (select sample_id, truth, lower(trim(regexp_replace(truth, '{_GAPS}', ' ', 'g'))) as t, lower(trim(regexp_replace(prediction, '{_GAPS}', ' ', 'g'))) as p from ocr_pairs),
    split as (select *, case when t = '' then [] else string_split(t, ' ') end as a, case when p = '' then [] else string_split(p, ' ') end as b from texts),
    apart as (select *, list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] is distinct from b[i]) as places from split),
    sides as (select *, len(a) = len(b) and not list_has_any(list_transform(places, lambda i: a[i]), list_transform(places, lambda i: b[i])) as plain from apart),
    steps as (select sample_id, a, b, 0 as j, range(0, len(a) + 1) as cells from sides where not plain
      union all select sample_id, a, b, j + 1, list_transform(range(0, len(a) + 1), lambda i: i + list_min(list_transform(range(0, i + 1), lambda k: case when k = 0 then cells[1] + 1 else least(cells[k + 1] + 1, cells[k] + case when a[k] = b[j + 1] then 0 else 1 end) end - k))) from steps where j < len(b)),
    words as (select len(a) as n, len(b) as m, len(places) as edits from sides where plain union all select len(a), len(b), cells[len(a) + 1] from steps where j = len(b)),
    w as (select n, case when n > 0 then cast(edits as double) / n when m = 0 then 0e0 else 1e0 end as wer from words),
    c as (select truth, t, p, levenshtein(t, p) as distance, case when t <> '' then cast(levenshtein(t, p) as double) / length(t) when p = '' then 0e0 else 1e0 end as cer from texts),
    chars as (select count(*) as samples, round(avg(cer), 6) as mean_cer, round($MEDIAN(cer, 0.5), 6) as median_cer, round(stddev_pop(cer), 6) as sd_cer, round(avg(case when t = p then 1e0 else 0e0 end), 6) as exact_rate, round(avg(distance), 6) as mean_distance, cast(sum(length(truth)) as bigint) as chars from c)
    select chars.*, x.* from chars cross join (select round(avg(wer), 6) as mean_wer, round($MEDIAN(wer, 0.5), 6) as median_wer, round(stddev_pop(wer), 6) as sd_wer, cast(sum(n) as bigint) as words from w) x"""


def _latency(s: SparkSession, d: str) -> DataFrame:
    rows = adapters.view(s, d, "latency")
    means = rows.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 6).alias("mean"), F.round(F.stddev_pop("ms"), 6).alias("sd"), F.min("ms").alias("low"), F.max("ms").alias("high"))
    return _beside(means, percentiles(rows, ["stage"], "ms", [0.5, 0.9, 0.95, 0.99]), ["stage"], "p50", "p90", "p95", "p99")


def _scores(s: SparkSession, d: str) -> DataFrame:
    rows = written(adapters.query(s, d, ["rag_cases"], dialect(f"with {_RANKS} select relevance >= 2 as correct, 1e0 / place as score from ranked", 0, **_WORDS)), "scores")
    means = rows.groupBy("correct").agg(F.count("*").alias("candidates"), F.round(F.avg("score"), 6).alias("mean_score"))
    return _beside(means, percentiles(rows, ["correct"], "score", [0.5]), ["correct"], "median_score")


def _register_errors(key: str, views: list[str], body: str) -> None:
    register_edits(key, views, dialect(body, 0, **_MEDIAN), dialect(body, 1, **_MEDIAN))


register("ocr_metrics", _ocr_metrics, **_oracle(["ocr_pairs"], _OCR_ORACLE))
_register_errors("ocr_by_category", ["ocr_pairs"], f"with {_ERRORS} select sample_id % 5 as category, count(*) as samples, round(avg(cer), 4) as mean_cer, round($MEDIAN(cer, 0.5), 4) as median_cer from e group by rollup(sample_id % 5)")
register_edits("ocr_error_bins", ["ocr_pairs"], f"with {_ERRORS}, bins(bin, low) as (select * from (values (0, '0'), (1, '<.05'), (2, '<.1'), (3, '<.2'), (4, '<.5'), (5, '>=.5')) v(bin, low)), b as (select case when cer = 0 then 0 when cer < 0.05 then 1 when cer < 0.1 then 2 when cer < 0.2 then 3 when cer < 0.5 then 4 else 5 end as bin from e) select n.bin, n.low as label, count(b.bin) as samples from bins n left join b on b.bin = n.bin group by n.bin, n.low")
register_edits("confidence_correlation", ["ocr_pairs"], f"with {_ERRORS} select round(coalesce(corr(confidence, 1 - cer), 0e0), 6) as correlation from e")
register_edits("worst_samples", ["ocr_pairs"], f"with {_ERRORS} select sample_id, round(cer, 6) as cer from e order by round(cer, 6) desc, sample_id limit 10")
# documents of a question by the share of its distinct words that they hold
_RANKS = "held as (select query_id, doc_id, relevance, category, $SIZE($BOTH($DISTINCT($WORDS(lower(question), ' ')), $DISTINCT($WORDS(lower(content), ' ')))) as shared from rag_cases), ranked as (select query_id, doc_id, relevance, category, row_number() over (partition by query_id order by shared desc, doc_id) as place from held)"
_Q = "per_query as (select query_id, max(category) as category, min(case when relevance >= 2 then place end) as first_hit, count(case when relevance >= 2 then 1 end) as relevant, count(*) as docs, count(case when relevance >= 2 and place <= 3 then 1 end) as hits3, sum(case when relevance >= 2 and place <= 10 then 1 / log2(place + 1) else 0e0 end) as dcg, sum(case when place <= 10 then (power(2e0, relevance) - 1) / log2(place + 1) else 0e0 end) as graded from ranked group by query_id)"
CUTS = (1, 3, 5, 10)


def ranking_metrics(ranked: DataFrame, totals: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """A row for each query of totals (query_id, total): rr, and hit, precision, recall and NDCG at each cut.

    ranked is (query_id, place, relevant); gains are binary, and the ideal list holds all relevant items that there are. Queries
    without candidates, or without a relevant item, score 0.
    """
    gain = F.when(F.col("relevant"), 1 / F.log2(F.col("place") + 1)).otherwise(0.0)

    def upto(k: int, value: Column) -> Column:
        return F.sum(F.when(F.col("place") <= k, value).otherwise(0.0))

    sums = [upto(k, value).alias(f"{name}_{k}") for k in cuts for name, value in (("found", F.col("relevant").cast("double")), ("dcg", gain))]
    found = ranked.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("place"))).alias("first"), *sums)
    rows = totals.join(found, "query_id", "left")

    def at(k: int) -> list[Column]:
        hits, dcg = F.coalesce(f"found_{k}", F.lit(0.0)), F.coalesce(f"dcg_{k}", F.lit(0.0))
        ideal = F.get(F.array(F.lit(0.0), *[F.lit(sum(1 / math.log2(i + 2) for i in range(n))) for n in range(1, k + 1)]), F.least(F.col("total"), F.lit(k)).cast("int"))
        return [(hits > 0).alias(f"hit_{k}"), F.round(hits / k, 6).alias(f"precision_{k}"), F.when(F.col("total") > 0, F.round(hits / F.col("total"), 6)).otherwise(0.0).alias(f"recall_{k}"), F.when(ideal > 0, F.round(dcg / ideal, 6)).otherwise(0.0).alias(f"ndcg_{k}")]

    return rows.select("query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), *[c for k in cuts for c in at(k)])


def _ir_topk(s: SparkSession, d: str) -> DataFrame:
    """Vectors with ids divisible by 20 look for others of their label; ranks are those of the exact search."""
    vectors = adapters.view(s, d, "embeddings").select("vec_id", "embedding", "label")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("wanted"))
    found = knn(asked.select("query_id", "embedding"), vectors.select("vec_id", "embedding"), max(CUTS) + 1).where("query_id <> vec_id")
    judged = found.join(vectors.select("vec_id", "label"), "vec_id").join(asked.select("query_id", "wanted"), "query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    ranked = judged.select("query_id", place.alias("place"), (F.col("label") == F.col("wanted")).alias("relevant")).where(F.col("place") <= max(CUTS))
    sizes = vectors.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("total"))
    return ranking_metrics(ranked, asked.select("query_id", "wanted").join(sizes, "wanted").select("query_id", "total"))


def _ir_oracle() -> str:
    columns = ", ".join(
        f"found_{k} > 0 as hit_{k}, round(found_{k} / {k}, 6) as precision_{k}, case when total > 0 then round(found_{k} / total, 6) else 0 end as recall_{k}, "
        f"case when total > 0 then round(dcg_{k} / (select sum(1 / log2(i + 1)) from range(1, {k} + 1) t(i) where i <= total), 6) else 0 end as ndcg_{k}" for k in CUTS
    )
    sums = ", ".join(f"coalesce(sum(case when place <= {k} and rel then 1.0::double else 0 end), 0) as found_{k}, coalesce(sum(case when place <= {k} and rel then 1 / log2(place + 1) else 0 end), 0) as dcg_{k}" for k in CUTS)
    return f"""with {_KNN_ORACLE}, others as (select query_id, vec_id, row_number() over (partition by query_id order by place) as place from dense where query_id <> vec_id and place <= {max(CUTS) + 1}),
        judged as (select o.query_id, o.place, a.label = b.label as rel from others o join embeddings a on a.vec_id = o.query_id join embeddings b on b.vec_id = o.vec_id where o.place <= {max(CUTS)}),
        asked as (select vec_id as query_id, count(*) over (partition by label) - 1 as total from embeddings qualify vec_id % 20 = 0),
        sums as (select a.query_id, max(a.total) as total, min(case when rel then place end) as first, {sums} from asked a left join judged j on j.query_id = a.query_id group by a.query_id)
        select query_id, round(coalesce(1.0::double / first, 0), 6) as rr, {columns} from sums"""


register("ir_topk_metrics", _ir_topk, [], _ir_oracle())
register_dialects("ident_metrics", ["rag_cases"], f"with {_RANKS}, {_Q} select count(*) as queries, round(avg(coalesce(1e0 / first_hit, 0e0)), 6) as mrr, round(stddev_pop(coalesce(1e0 / first_hit, 0e0)), 6) as sd_rr, round(avg(case when first_hit <= 5 then 1e0 else 0e0 end), 6) as hit_rate from per_query", **_WORDS)
register_dialects("ir_by_category", ["rag_cases"], f"with {_RANKS}, {_Q} select category, count(*) as queries, round(avg(coalesce(1e0 / first_hit, 0e0)), 6) as mrr, round(avg(case when first_hit = 1 then 1e0 else 0e0 end), 6) as p1, round(avg(cast(docs as double)), 6) as candidates from per_query group by category", **_WORDS)
register("score_distribution", _scores, **_oracle(["rag_cases"], f"with {_RANKS} select relevance >= 2 as correct, count(*) as candidates, round(avg(1e0 / place), 6) as mean_score, round($MEDIAN(1e0 / place, 0.5), 6) as median_score from ranked group by relevance >= 2"))
register_dialects("rag_retrieval_metrics", ["rag_cases"], f"with {_RANKS}, {_Q} select query_id, round(cast(relevant as double) / docs, 6) as precision_all, round(graded, 6) as dcg10, round(coalesce(1e0 / first_hit, 0e0), 6) as rr from per_query", **_WORDS)
register_sql("relevance_join", ["rag_cases"], "with judged as (select query_id, doc_id, relevance from rag_cases where doc_id % 3 <> 0) select r.query_id, r.doc_id, coalesce(j.relevance, 0) as relevance from rag_cases r left join judged j on j.query_id = r.query_id and j.doc_id = r.doc_id")
register_sql("rag_citation_metrics", ["rag_cases"], "with cited as (select query_id, doc_id from rag_cases where doc_id % 2 = 0), expected as (select query_id, doc_id from rag_cases where relevance >= 2), both_sides as (select coalesce(c.query_id, e.query_id) as query_id, c.doc_id as c, e.doc_id as e from cited c full outer join expected e on e.query_id = c.query_id and e.doc_id = c.doc_id) select query_id, round(coalesce(count(case when c = e then 1 end) / nullif(cast(count(c) as double), 0), 0e0), 6) as citation_precision, round(coalesce(count(case when c = e then 1 end) / nullif(cast(count(e) as double), 0), 0e0), 6) as citation_recall from both_sides group by query_id")
# Words that say nothing about a sentence.
COMMON_WORDS = ["this", "that", "which", "where", "when", "what", "have", "been", "were", "will", "would", "could", "should", "there", "their", "about"]
register_dialects(
    "hallucination_rate", ["rag_cases"],
    f"""with one as (select query_id, max(answer) as answer from rag_cases group by query_id), cut as (select query_id, $EXPLODE($SENTENCES) as sentence from one),
        claims as (select distinct query_id, trim(sentence) as sentence from cut where length(trim(sentence)) >= 20),
        cw as (select distinct query_id, sentence, w from (select query_id, sentence, $EXPLODE(regexp_extract_all(lower(sentence)$TAIL)) as w from claims) q where w not in ({', '.join(f"'{w}'" for w in COMMON_WORDS)})),
        kw as (select distinct query_id, w from (select query_id, $EXPLODE(regexp_extract_all(lower(content)$TAIL)) as w from rag_cases) q),
        judged as (select cw.query_id, cw.sentence, count(*) as words, count(kw.w) as found from cw left join kw on kw.query_id = cw.query_id and kw.w = cw.w group by cw.query_id, cw.sentence)
        select o.query_id, count(j.sentence) as claims, round(coalesce(avg(case when j.found < 0.3e0 * j.words then 1e0 when j.words is not null then 0e0 end), 0e0), 6) as hallucination_rate
        from one o left join judged j on j.query_id = o.query_id group by o.query_id""",
    SENTENCES=("split(answer, '[.!?]')", "string_split_regex(answer, '[.!?]')"),
    TAIL=(", '[\\\\p{L}\\\\p{N}_]{4,}', 0", ", '[\\p{L}\\p{N}_]{4,}'"),
)
register_sql("rag_by_category", ["rag_cases"], "select category, count(*) as rows_seen, round(avg(case when relevance >= 2 then 1e0 else 0e0 end), 6) as precision_all, round(avg(cast(length(answer) as double)), 4) as answer_length from rag_cases group by category")
register_sql("grounding_check", ["rag_cases"], "select query_id, bool_and(relevance >= 1) as grounded, count(case when relevance < 1 then 1 end) as ungrounded from rag_cases group by query_id")
register("latency_percentiles", _latency, **_oracle(["latency"], "select stage, count(*) as n, round(avg(ms), 6) as mean, round(stddev_pop(ms), 6) as sd, min(ms) as low, max(ms) as high, round($MEDIAN(ms, 0.5), 6) as p50, round($MEDIAN(ms, 0.9), 6) as p90, round($MEDIAN(ms, 0.95), 6) as p95, round($MEDIAN(ms, 0.99), 6) as p99 from latency group by stage"))
register_dialects("e2e_latency", ["latency"], "with placed as (select stage, ms, row_number() over (partition by stage order by event_id) as n from latency), short as (select min(c) as m from (select count(*) as c from placed group by stage) q), sums as (select n, sum(ms) as total from placed cross join short where n <= m group by n) select count(*) as samples, round(avg(total), 6) as mean, round($MEDIAN(total, 0.95), 6) as p95 from sums", **_MEDIAN)
register_sql("e2e_accuracy", ["boxes"], "with expected as (select distinct image_id, box_no from boxes), found as (select distinct image_id, box_no from boxes where confidence >= 0.95) select count(*) as expected, count(f.box_no) as correct, round(count(f.box_no) / cast(count(*) as double), 6) as accuracy from expected e left join found f on f.image_id = e.image_id and f.box_no = e.box_no")
_register_errors("eval_summary", ["ocr_pairs", "latency"], f"with {_ERRORS}, a as (select count(*) as samples, avg(cer) as cer from e), b as (select $MEDIAN(ms, 0.95) as p95 from latency) select coalesce(samples, 0) as ocr_samples, round(coalesce(cer, 0e0), 6) as ocr_cer, round(coalesce(p95, 0e0), 6) as latency_p95 from a cross join b")
register_sql("compare_runs", ["latency"], "select stage as metric, round(avg(case when user_id % 2 = 0 then ms end), 6) as run_a, round(avg(case when user_id % 2 = 1 then ms end), 6) as run_b from latency group by stage")
_PATH = "p as (select event_id, user_id, ts, ms, concat('/api/', stage, case when event_id % 3 = 0 then '/bulk' else '' end) as path, case when event_id % 37 = 0 then 500 when event_id % 11 = 0 then 404 else 200 end as status from latency)"
register_sql("request_log_report", ["latency"], f"with {_PATH} select path, case when status >= 500 then 'error' when status >= 400 or ms > 20 then 'warning' else 'info' end as level, count(*) as requests, round(avg(case when ms > 20 then 1e0 else 0e0 end), 6) as slow_share from p where path <> '/api/signup' group by path, case when status >= 500 then 'error' when status >= 400 or ms > 20 then 'warning' else 'info' end")
register_sql("endpoint_limits", ["latency"], f"with {_PATH}, rules(ord, prefix, per_minute) as (select * from (values (1, '/api/view/bulk', 10), (2, '/api/view', 30), (3, '/api/click', 20)) v(ord, prefix, per_minute)), hit as (select p.path, r.per_minute, row_number() over (partition by p.path order by r.ord) as place from (select distinct path from p) p left join rules r on substring(p.path, 1, length(r.prefix)) = r.prefix) select path, coalesce(per_minute, 60) as per_minute from hit where place = 1")
register_sql("client_identity", ["latency"], "with r as (select event_id, case when event_id % 3 = 0 then concat('key-', cast(user_id as varchar(12))) end as api_key, case when event_id % 2 = 0 then concat(' 10.0.0.', cast(user_id as varchar(12)), ', 10.1.1.1') end as xff, concat('192.168.0.', cast(user_id as varchar(12))) as ip from latency) select event_id, coalesce(api_key, trim(substring(xff, 1, position(',' in xff) - 1)), ip) as client from r")
register_dialects("conversation_summarize", ["turns"], "with placed as (select *, row_number() over (partition by conv_id order by turn desc) as back, count(*) over (partition by conv_id) as n from turns), old as (select distinct conv_id, book_id from placed where n >= 6 and back > 3), ranked as (select *, row_number() over (partition by conv_id order by book_id) as r from old) select conv_id, $LIST as summary from ranked where r <= 10 group by conv_id", LIST=("array_join(transform(sort_array(collect_list(book_id)), x -> cast(x as string)), ' | ')", "string_agg(cast(book_id as varchar), ' | ' order by book_id)"))
register_dialects("conversation_store", ["turns"], "select conv_id, $LIST as document from turns group by conv_id", LIST=("array_join(transform(sort_array(collect_list(struct(turn, role, token_count))), x -> concat(x.turn, ':', x.role, ':', x.token_count)), ',')", "string_agg(concat(turn, ':', role, ':', token_count), ',' order by turn)"))
