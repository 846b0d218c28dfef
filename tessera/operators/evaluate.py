"""Quality of answers by rule: five metrics a case, and their summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

#: Score from which a metric counts as passed.
THRESHOLDS = {"faithfulness": 0.7, "answer_relevance": 0.6, "context_precision": 0.5, "context_recall": 0.5, "citation_accuracy": 0.6}


def share(part: Column, whole: Column) -> Column:
    """Of the different members of ``whole``, the part that is in ``part``; 0 of nothing."""
    n = F.size(F.array_distinct(whole))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(part, whole)) / n)


def lowered(c) -> Column:
    return F.transform(X.col(c), F.lower)


def faithfulness() -> Column:
    words, known = X.word_set("answer"), X.word_set("context")
    overlap = F.when(F.size(words) == 0, 1.0).otherwise(F.least(F.lit(1.0), X.jaccard(words, known) * 3))
    return F.when(F.col("error").isNotNull(), 0.0).when(F.col("is_fallback"), 1.0).when(X.strip_ws("answer") == "", 1.0).when(X.strip_ws("context") == "", 0.0).otherwise(overlap)


def answer_relevance() -> Column:
    asked = X.content_words("query")
    coverage = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, X.word_set("answer"))) / F.size(asked))
    text = F.lower("answer")
    concepts = F.when(F.size("query_entities") > 0, F.size(F.filter(lowered("query_entities"), lambda e: F.contains(text, e))) / F.size("query_entities"))
    mean = F.coalesce((coverage + concepts) / 2, coverage, concepts, F.lit(0.5))
    return F.when(F.col("error").isNotNull(), 0.0).when(F.col("is_fallback"), 0.5).when(X.strip_ws("answer") == "", 0.0).otherwise(mean)


def context_precision() -> Column:
    cited = share(F.col("cited"), F.col("retrieved"))
    return F.when(F.col("error").isNotNull() | (F.size("retrieved") == 0), 0.0).when(F.size("expected") > 0, share(F.col("expected"), F.col("retrieved"))).when(F.col("is_fallback") & (F.size("cited") == 0), 1.0).otherwise(cited)


def context_recall() -> Column:
    return F.when(F.col("error").isNotNull(), 0.0).when(F.size("expected") > 0, share(F.col("retrieved"), F.col("expected"))).when(F.size("true_entities") > 0, share(lowered("found_entities"), lowered("true_entities"))).otherwise(0.5)


def citation_accuracy() -> Column:
    marks = X.citation_marks("answer")
    valid = F.size(F.filter(marks, lambda m: F.array_contains(F.col("cited"), m)))
    syntax = F.when(F.size(marks) > 0, valid / F.size(marks)).when(F.size("cited") > 0, 0.5).otherwise(0.0)
    source = F.when(F.size("expected_videos") == 0, 1.0).otherwise(share(F.col("cited_videos"), F.col("expected_videos")))
    return F.when(F.col("error").isNotNull(), 0.0).otherwise(0.6 * syntax + 0.4 * source)


METRICS: dict[str, Callable[[], Column]] = {"faithfulness": faithfulness, "answer_relevance": answer_relevance, "context_precision": context_precision, "context_recall": context_recall, "citation_accuracy": citation_accuracy}


def register_metric(name: str, score: Callable[[], Column], threshold: float) -> None:
    METRICS[name], THRESHOLDS[name] = score, threshold


def scores(cases: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(case_id, query_type, error, metric, score, passed): all metrics of all cases in one pass. Names that no metric
    has are left out."""
    known = [m for m in metrics or METRICS if m in METRICS]
    each = F.array(*(F.struct(F.lit(m).alias("metric"), X.clamped(METRICS[m]()).alias("score"), F.lit(THRESHOLDS[m]).alias("limit")) for m in known))
    rows = cases.select("case_id", "query_type", "error", F.inline(each))
    return rows.select("case_id", "query_type", "error", "metric", F.round("score", 6).alias("score"), (F.col("score") >= F.col("limit")).alias("passed"))


def case_scores(long: DataFrame) -> DataFrame:
    """(case_id, query_type, overall): the mean of a case's metrics, 0 for one that failed."""
    ok = F.when(F.col("error").isNull(), F.col("score"))
    return long.groupBy("case_id", "query_type", "error").agg(F.round(F.coalesce(F.avg(ok), F.lit(0.0)), 6).alias("overall"))


def metric_summary(long: DataFrame) -> DataFrame:
    """(metric, average, pass_rate, cases) over the cases that succeeded; the rate is of all of those, also of cases that
    lack the metric."""
    good = long.where("error is null")
    all_cases = good.agg(F.countDistinct("case_id").alias("all"))  # one row
    sums = good.groupBy("metric").agg(F.round(F.avg("score"), 6).alias("average"), F.sum(F.col("passed").cast("int")).alias("passes"), F.count("*").alias("cases"))
    return sums.join(F.broadcast(all_cases)).select("metric", "average", F.round(F.col("passes") / F.col("all"), 6).alias("pass_rate"), "cases")


def by_group(cases: DataFrame, column: str) -> DataFrame:
    """Cases and mean score by a column, null as ``unknown``."""
    return cases.where("error is null").groupBy(F.coalesce(column, F.lit("unknown")).alias(column)).agg(F.count("*").alias("cases"), F.round(F.avg("overall"), 6).alias("average"))


def report(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.round(F.avg(F.when(F.col("error").isNull(), F.col("overall"))), 6).alias("overall"))


def select_cases(cases: DataFrame, ids: list[str] = (), difficulties: list[str] = (), tags: list[str] = ()) -> DataFrame:
    for column, values in (("id", ids), ("difficulty", difficulties)):
        cases = cases.where(F.col(column).isin(list(values))) if values else cases
    return cases.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else cases


#: What a case must have, and what its fields may be.
REQUIRED = ["id", "query", "expected_answer", "query_type"]
ALLOWED = {"query_type": ["local", "global", "auto"], "difficulty": ["easy", "medium", "hard"]}


def case_errors(cases: DataFrame) -> DataFrame:
    """(id, error) for every rule that a case breaks: missing fields, unknown values, ids used before."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED]
    unknown = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(v), F.concat(F.lit(f"invalid {c}: "), F.col(c))) for c, v in ALLOWED.items()]
    own = cases.select("id", F.explode(F.array_compact(F.array(*missing, *unknown))).alias("error"))
    repeated = cases.groupBy("id").count().where("count > 1 and id is not null").select("id", F.lit("repeated id").alias("error"))
    return own.unionByName(repeated)


def testset_units(units: DataFrame, video: str | None = None, longer: int = 100) -> DataFrame:
    """Text units long enough to ask about, of one video if named."""
    rows = units.where(F.length("raw_text") > longer)
    return rows.where(F.contains("source_video", F.lit(video))) if video else rows


def testset_sample(units: DataFrame, n: int, seed: int = 0, video: str | None = None, longer: int = 100) -> DataFrame:
    """``n`` text units to ask about: of more than ``longer`` characters, of one video if named, least hash first."""
    return testset_units(units, video, longer).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def summary_table(long: DataFrame) -> DataFrame:
    """A row a case and a column a metric, in order of name."""
    return long.groupBy("case_id").pivot("metric", sorted(METRICS)).agg(F.round(F.first("score"), 4))


def samples(cases: DataFrame) -> DataFrame:
    """(case_id, user_input, response, retrieved_contexts, reference): what an outer evaluation reads; cases that failed
    are left out, an empty reference is null."""
    good = cases.where("error is null")
    contexts = F.coalesce("contexts", F.array().cast("array<string>"))
    reference = F.when(F.coalesce("expected_answer", F.lit("")) != "", F.col("expected_answer"))
    return good.select("case_id", F.col("query").alias("user_input"), F.col("answer").alias("response"), contexts.alias("retrieved_contexts"), reference.alias("reference"))


def report_json(long: DataFrame, by_case: DataFrame, run_id: str, metadata: str = "{}") -> DataFrame:
    """(run_id, body): the report as JSON, with its summary and means to four places. Cases are rows of their own, as
    :func:`case_json` gives them."""
    place = lambda c: F.round(c, 4)
    means = metric_summary(long).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", place("average"))))).alias("metric_averages"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", place("pass_rate"))))).alias("metric_pass_rates"))
    kinds = by_group(by_case, "query_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("query_type", F.struct("cases", place("average").alias("average")))))).alias("by_query_type"))
    total = report(by_case).select(F.col("total").alias("total_cases"), F.col("succeeded").alias("successful_cases"), F.col("failed").alias("failed_cases"), place("overall").alias("overall_average"))
    one = total.join(F.broadcast(means)).join(F.broadcast(kinds))  # one row each
    body = F.struct(F.lit(run_id).alias("run_id"), F.from_json(F.lit(metadata), "map<string,string>").alias("testset_metadata"), F.struct(*one.columns).alias("summary"))
    return one.select(F.lit(run_id).alias("run_id"), F.to_json(body).alias("body"))


def case_json(cases: DataFrame, long: DataFrame, answer_chars: int = 500) -> DataFrame:
    """(case_id, body): a case as JSON with its scores to four places. The answer is cut to what a report shows."""
    scores_ = long.where("error is null").groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.round("score", 4))))).alias("metric_scores"))
    rows = cases.select("case_id", "query", "query_type", "is_fallback", "error", F.substring("answer", 1, answer_chars).alias("answer")).join(scores_, "case_id", "left")
    return rows.select("case_id", F.to_json(F.struct(*rows.columns)).alias("body"))


def judged_means(replies: DataFrame, *by: str) -> DataFrame:
    """(by, score): the mean of a judge's replies of yes, partly or no."""
    return replies.groupBy(*by).agg(F.avg(X.judged_yes_no("reply")).alias("score"))
