"""Quality of answers by a judging model: the rules' five metrics, a question to the judge for each claim or passage."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import backends
from tessera.functions import text as X
from tessera.functions.prompts import prompt
from tessera.operators.evaluate import THRESHOLDS, citation_accuracy, scores
from tessera.sources.scratch import once, saved

CASE = ["case_id", "query_type", "error"]

#: Parts of a judged citation score: the marks' form, what they mean, and their sources.
FORM, MEANING, SOURCE = 0.4, 0.4, 0.2


def asked(cases: DataFrame) -> DataFrame:
    """(case_id, metric, prompt): what the judge is asked of cases that succeeded. Claims are those of whole answers, the
    evidence is the whole context."""
    good = cases.where("error is null")
    plain = X.plain_answer("answer")
    has_context = X.strip_ws("context") != ""
    ask = lambda rows, metric, text: rows.select("case_id", F.lit(metric).alias("metric"), text.alias("prompt"))
    supported = prompt("claim", claim=F.col("claim"), context=F.col("context"))
    said = good.where(~F.col("is_fallback") & has_context).select("case_id", "context", F.explode(X.claims(plain)).alias("claim"))
    wanted = good.where(has_context & (F.coalesce("expected_answer", F.lit("")) != "")).select("case_id", "context", F.explode(X.claims("expected_answer")).alias("claim"))
    whole = good.where(~F.col("is_fallback") & (plain != ""))
    found = good.select("case_id", "query", F.explode("chunks").alias("c"))
    cited = _cited(good).where("passage is not null")
    return functools.reduce(DataFrame.unionByName, [
        ask(said, "faithfulness", supported), ask(wanted, "context_recall", supported),
        ask(whole, "answer_relevance", prompt("relevance", query=F.col("query"), answer=plain)),
        ask(found, "context_precision", prompt("passage", query=F.col("query"), passage=F.col("c.content"))),
        ask(cited, "citation_accuracy", prompt("citation", statement=F.col("statement"), passage=F.col("passage"))),
    ])


def _cited(cases: DataFrame) -> DataFrame:
    """(case_id, statement, passage) for each sentence and each chunk it cites; passage is null where there is none."""
    sentences = cases.select("case_id", "chunks", F.explode(X.cited_sentences(X.normal_citations("answer"))).alias("s"))
    each = sentences.select("case_id", "chunks", F.col("s.sentence").alias("statement"), F.explode("s.ids").alias("id"))
    hit = F.filter("chunks", lambda c: c["chunk_id"] == X.strip_ws("id"))
    return each.select("case_id", "statement", F.try_element_at(F.transform(hit, lambda c: c["content"]), F.lit(1)).alias("passage"))


def judged_scores(cases: DataFrame, complete: backends.Complete) -> DataFrame:
    """(case_id, query_type, error, metric, score, passed) as :func:`tessera.operators.evaluate.scores` gives them, from a
    judge. ``cases`` also have expected_answer and chunks (chunk_id, content).

    Where there is nothing to ask, and for a case that failed, the rule decides, but that an answer without a claim has
    0.5 for faithfulness, and an answer that cites nothing has full meaning of its citations. A reply that failed counts
    nothing.
    """
    cases = once(cases, "cases")
    told = saved(backends.replies(asked(cases), F.col("prompt"), complete).where("reply is not null"), "judged")
    reply = F.when(F.col("metric") == "answer_relevance", X.judged_score("reply")).otherwise(X.judged_yes_no("reply"))
    lost = _cited(cases.where("error is null")).where("passage is null").select("case_id", F.lit("citation_accuracy").alias("metric"), F.lit(0.0).alias("mark"))
    marks = told.select("case_id", "metric", reply.alias("mark")).unionByName(lost)
    means = marks.groupBy("case_id", "metric").agg(F.avg("mark").alias("mean"))
    by_rule = scores(cases).drop("passed")
    facts = cases.select("case_id", _source_share().alias("source"), (citation_accuracy() / 1.0).alias("rule"), _mute().alias("mute"))
    rows = by_rule.join(means, ["case_id", "metric"], "left").join(facts, "case_id")
    form = (F.col("rule") - 0.4 * F.col("source")) / 0.6  # the rule is 0.6 of form and 0.4 of source
    cited = FORM * form + MEANING * F.coalesce("mean", F.lit(1.0)) + SOURCE * F.col("source")
    score = (
        F.when(F.col("error").isNotNull(), F.col("score")).when(F.col("metric") == "citation_accuracy", cited)
        .when((F.col("metric") == "faithfulness") & F.col("mute"), F.lit(0.5)).otherwise(F.coalesce("mean", "score"))
    )
    limit = functools.reduce(lambda out, m: out.when(F.col("metric") == m, THRESHOLDS[m]), THRESHOLDS, F.when(F.lit(False), 0.0))
    out = rows.withColumn("score", F.round(X.clamped(score), 6))
    return out.select(*CASE, "metric", "score", (F.col("score") >= limit).alias("passed"))


def _source_share() -> Column:
    expected = F.array_distinct("expected_videos")
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect("cited_videos", expected)) / F.size(expected))


def _mute() -> Column:
    """Whether an answer says something, with evidence there, and yet makes no claim."""
    plain = X.plain_answer("answer")
    return ~F.col("is_fallback") & (plain != "") & (X.strip_ws("context") != "") & (F.size(X.claims(plain)) == 0)
