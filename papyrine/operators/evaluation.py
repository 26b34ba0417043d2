"""Scoring predictions and comparing two annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions import metrics
from papyrine.functions import text as T


def scored(predictions: DataFrame) -> DataFrame:
    """Adds em and f1 to rows with prediction and references (joined by semicolons); null counts as empty."""
    p, r = F.coalesce("prediction", F.lit("")), F.coalesce("references", F.lit(""))
    return predictions.withColumns({"em": metrics.best_score(p, r, metrics.exact_match), "f1": metrics.best_score(p, r, metrics.token_f1)})


def comparison(predictions: DataFrame, by: str = "system") -> DataFrame:
    """(by, examples, exact_match, token_f1, answer_recall): means in percent; recall is the share with any overlap."""
    rows = scored(predictions)
    return rows.groupBy(by).agg(
        F.count("*").alias("examples"),
        F.round(F.avg("em") * 100, 4).alias("exact_match"),
        F.round(F.avg("f1") * 100, 4).alias("token_f1"),
        F.round(F.avg((F.col("f1") > 0).cast("double")) * 100, 4).alias("answer_recall"),
    )


def by_position(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Joins (line_no, prediction) with (line_no, references); different numbers of lines are an error."""
    a, b = predictions.count(), references.count()
    if a != b:
        raise ValueError(f"{a} predictions but {b} references")
    return predictions.join(references, "line_no")


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, question, a_answer, b_answer, a_notes, b_notes): the items both annotators have.

    a and b have (id, question, annotator_answer, notes), one row per id. Blank answers become ''.
    """
    left = a.select("id", "question", F.trim(F.coalesce("annotator_answer", F.lit(""))).alias("a_answer"), F.trim(F.coalesce("notes", F.lit(""))).alias("a_notes"))
    right = b.select("id", F.trim(F.coalesce("annotator_answer", F.lit(""))).alias("b_answer"), F.trim(F.coalesce("notes", F.lit(""))).alias("b_notes"))
    return left.join(right, "id")


def alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b, other_question): one row of counts that must all be 0 for aligned annotations."""
    left, right = a.select("id", F.col("question").alias("qa"), F.lit(1).alias("in_a")), b.select("id", F.col("question").alias("qb"), F.lit(1).alias("in_b"))
    joined = left.join(right, "id", "full")
    return joined.agg(
        F.sum(F.when(F.col("in_b").isNull(), 1).otherwise(0)).alias("only_a"),
        F.sum(F.when(F.col("in_a").isNull(), 1).otherwise(0)).alias("only_b"),
        F.sum(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.col("qa").eqNullSafe(F.col("qb")), 1).otherwise(0)).alias("other_question"),
    )


def agreement(rows: DataFrame, *, soft: float = 0.80) -> DataFrame:
    """One row about aligned answers: items, blanks, exact and soft agreement, mean token F1, disagreements."""
    na, nb = T.normalize_label(F.col("a_answer")), T.normalize_label(F.col("b_answer"))
    each = rows.select("a_answer", "b_answer", (na == nb).alias("exact"), metrics.label_f1(F.col("a_answer"), F.col("b_answer")).alias("f1"))
    counts = each.agg(
        F.count("*").alias("item_count"),
        F.count_if((F.col("a_answer") == "") | (F.col("b_answer") == "")).alias("blank_answer_count"),
        F.count_if("exact").alias("exact_agreement_count"),
        F.count_if(F.col("f1") >= soft).alias("soft_agreement_count"),
        F.coalesce(F.round(F.avg("f1"), 6), F.lit(0.0)).alias("mean_token_f1"),
    )
    share = lambda c: F.when(F.col("item_count") > 0, F.round(F.col(c) / F.col("item_count"), 6)).otherwise(0.0)
    return counts.select("*", share("exact_agreement_count").alias("exact_agreement"), share("soft_agreement_count").alias("soft_agreement"), (F.col("item_count") - F.col("exact_agreement_count")).alias("disagreement_count"))


def disagreements(rows: DataFrame) -> DataFrame:
    """The aligned items whose normalised answers differ, with token F1 as text of four decimals."""
    na, nb = T.normalize_label(F.col("a_answer")), T.normalize_label(F.col("b_answer"))
    f1 = F.format_string("%.4f", metrics.label_f1(F.col("a_answer"), F.col("b_answer")))
    named = rows.select("id", "question", F.col("a_answer").alias("annotator_a_answer"), F.col("b_answer").alias("annotator_b_answer"), na.alias("normalized_a"), nb.alias("normalized_b"), f1.alias("token_f1"), F.col("a_notes").alias("notes_a"), F.col("b_notes").alias("notes_b"))
    return named.filter(F.col("normalized_a") != F.col("normalized_b"))
