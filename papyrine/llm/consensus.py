"""Consensus of several annotators' free-text answers.

Answers are first brought to their value, so that form doesn't matter. Each annotator has a confusion matrix with
smoothing: per matter (the row: which kind of value is asked for) the probabilities of stating the true value or
another one; item posteriors over the values stated and the matrices are estimated by expectation-maximisation from
the share of votes. Agreement is reported apart: per matter the observed agreement of pairs, the one expected by
chance from how often values coincide between items of the matter, and the chance-corrected coefficient.

All steps are joins and aggregations; nothing is collected. Blank answers count for nothing. Repeated rows of an
annotator on an item count once. An item with one answer has that answer as consensus; values of equal posterior are
decided by votes, then by the smaller value.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.values import YEAR, fold, matter_of, value_of
from papyrine.runtime import cut

ROUNDS = 8
#: Pseudo-counts of right and wrong answers per annotator and matter, and the weight of the annotator's overall rate.
PRIOR_RIGHT, PRIOR_WRONG, OVERALL = 4.0, 1.0, 6.0
#: Values that a wrong answer is taken to be spread over beside those seen for the item.
WRONG_VALUES = 4.0


def read_answers(batches):
    for batch in batches:
        matters, values = [], []
        for question, answer in zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist(), strict=True):
            asked = fold(question or "")
            matter = matter_of(asked)
            years = set(YEAR.findall(asked))
            values.append(value_of(answer, matter, years.pop() if len(years) == 1 else None))
            matters.append(matter or "other")
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(matters, pa.string()), pa.array(values, pa.string())], names=[*names, "matter", "value"])


def answers_of(tables: Iterable[DataFrame]) -> DataFrame:
    """(id, annotator_id, matter, value), one row per item and annotator, of tables of annotations."""
    rows = None
    for t in tables:
        part = t.select("id", "annotator_id", "question", F.col("annotator_answer").alias("answer"), "labelled_at")
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.filter(F.col("id").isNotNull() & F.col("annotator_id").isNotNull())
    read = rows.mapInArrow(read_answers, "id string, annotator_id string, question string, answer string, labelled_at timestamp, matter string, value string")
    stated = read.filter(F.col("value").isNotNull())
    return stated.groupBy("id", "annotator_id").agg(F.max_by(F.struct("matter", "value"), F.struct("labelled_at", "value")).alias("m")).select("id", "annotator_id", "m.matter", "m.value")


def rates(scored: DataFrame) -> DataFrame:
    """(annotator_id, matter, right): the smoothed confusion rates, given the posterior of each answer's value."""
    by = scored.groupBy("annotator_id", "matter").agg(F.sum("posterior").alias("hits"), F.count("*").alias("n"))
    whole = Window.partitionBy("annotator_id")
    overall = (F.sum("hits").over(whole) + PRIOR_RIGHT) / (F.sum("n").over(whole) + PRIOR_RIGHT + PRIOR_WRONG)
    return by.select("annotator_id", "matter", ((F.col("hits") + OVERALL * overall) / (F.col("n") + OVERALL)).alias("right"), "hits", "n")


def posteriors(answers: DataFrame, rate: DataFrame) -> DataFrame:
    """(id, matter, value, votes, posterior) per item and stated value."""
    item, value = Window.partitionBy("id"), ["id", "matter", "value"]
    votes = answers.join(rate.select("annotator_id", "matter", "right"), ["annotator_id", "matter"])
    right = F.least(F.greatest(F.col("right"), F.lit(1e-4)), F.lit(1 - 1e-4))
    gain = F.log(right) - F.log((1 - right) / WRONG_VALUES)
    sums = votes.groupBy(*value).agg(F.sum(gain).alias("gain"), F.count("*").alias("votes"))
    raised = sums.withColumn("e", F.exp(F.col("gain") - F.max("gain").over(item)))
    return raised.select(*value, "votes", (F.col("e") / F.sum("e").over(item)).alias("posterior"))


def estimate(answers: DataFrame, *, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, posteriors, rates) after expectation-maximisation; the first two are materialised."""
    answers = cut(answers)
    counts = answers.groupBy("id", "matter", "value").agg(F.count("*").alias("votes"))
    post = counts.withColumn("posterior", F.col("votes") / F.sum("votes").over(Window.partitionBy("id")))
    for k in range(rounds):
        rate = rates(answers.join(post.select("id", "value", "posterior"), ["id", "value"]))
        post = posteriors(answers, rate)
        if k % 2:
            post = cut(post)
    post = cut(post) if rounds % 2 else post
    return answers, post, rates(answers.join(post.select("id", "value", "posterior"), ["id", "value"]))


def consensus(post: DataFrame) -> DataFrame:
    """(id, matter, value, votes, posterior): one row per item."""
    best = F.min_by(F.struct("matter", "value", "votes", "posterior"), F.struct(-F.round("posterior", 9), -F.col("votes"), "value"))
    return post.groupBy("id").agg(best.alias("b")).select("id", "b.matter", "b.value", "b.votes", "b.posterior")


def against_consensus(answers: DataFrame, post: DataFrame) -> DataFrame:
    """(id, annotator_id) of the answers that state another value than the consensus."""
    chosen = consensus(post).select("id", F.col("value").alias("chosen"))
    return answers.join(chosen, "id").filter(F.col("value") != F.col("chosen")).select("id", "annotator_id")


def agreement(answers: DataFrame) -> DataFrame:
    """(matter, items, answers, observed, expected, kappa): agreement of pairs of answers, and chance-corrected."""
    per_value = answers.groupBy("matter", "id", "value").agg(F.count("*").alias("n"))
    per_item = per_value.groupBy("matter", "id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).filter(F.col("n") > 1)
    observed = per_item.groupBy("matter").agg(
        F.count("*").alias("items"), F.sum("n").alias("answers"), F.sum(F.col("same") / (F.col("n") - 1)).alias("agreeing")
    )
    shares = answers.groupBy("matter", "value").agg(F.count("*").alias("n"))
    chance = shares.groupBy("matter").agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), 2)).alias("expected"))
    joined = observed.join(chance, "matter").withColumn("observed", F.col("agreeing") / F.col("answers"))
    kappa = F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    return joined.select("matter", "items", "answers", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round(kappa, 6).alias("kappa"))


def reliability(rate: DataFrame) -> DataFrame:
    """(annotator_id, answers, reliability): the share of answers expected to state the true value."""
    by = rate.groupBy("annotator_id").agg(F.sum("n").alias("answers"), F.sum("hits").alias("hits"))
    return by.select("annotator_id", "answers", F.round((F.col("hits") + PRIOR_RIGHT) / (F.col("answers") + PRIOR_RIGHT + PRIOR_WRONG), 6).alias("reliability"))
