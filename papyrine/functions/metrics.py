"""Scores of answers: exact match, token F1, keyword overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions import text


def token_list(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " ", -1), lambda t: t != "")


def bag_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two bags of tokens: 1 if both are empty, 0 if one is."""
    shared = F.aggregate(
        F.array_distinct(predicted),
        F.lit(0),
        lambda n, t: n + F.least(F.size(F.filter(predicted, lambda x: x == t)), F.size(F.filter(gold, lambda x: x == t))),
    )
    precision, recall = shared / F.size(predicted), shared / F.size(gold)
    return (
        F.when((F.size(predicted) == 0) & (F.size(gold) == 0), F.lit(1.0))
        .when((F.size(predicted) == 0) | (F.size(gold) == 0) | (shared == 0), F.lit(0.0))
        .otherwise(2 * precision * recall / (precision + recall))
    )


def exact_match(prediction: Column, reference: Column) -> Column:
    return (text.normalize_answer(prediction) == text.normalize_answer(reference)).cast("double")


def token_f1(prediction: Column, reference: Column) -> Column:
    return bag_f1(token_list(text.normalize_answer(prediction)), token_list(text.normalize_answer(reference)))


def label_f1(a: Column, b: Column) -> Column:
    """Token F1 under the normalisation that agreement uses."""
    return bag_f1(token_list(text.normalize_label(a)), token_list(text.normalize_label(b)))


def references_of(joined: Column) -> Column:
    """The alternatives of a reference line, parted by semicolons; blank ones don't count."""
    return F.filter(F.transform(F.split(joined, ";", -1), lambda r: F.trim(r)), lambda r: r != "")


def best_score(prediction: Column, joined: Column, metric) -> Column:
    """The best score of a prediction against any alternative; 0 without one."""
    return F.coalesce(F.array_max(F.transform(references_of(joined), lambda r: metric(prediction, r))), F.lit(0.0))


def keyword_score(question_tokens: Column, text_tokens: Column) -> Column:
    """Sum of 1 + ln(tf) over the distinct tokens of the question that the text has."""
    def add(total: Column, term: Column) -> Column:
        tf = F.size(F.filter(text_tokens, lambda t: t == term))
        return total + F.when(tf > 0, 1 + F.log(tf.cast("double"))).otherwise(F.lit(0.0))

    return F.aggregate(F.array_distinct(question_tokens), F.lit(0.0), add)
