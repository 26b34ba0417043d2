"""The pN_ queries, each over its whole tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import consensus, content, encoding, language, lines, overlap, packing, pairs, subjects, tokens


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p4_found(spark, folder):
    return lines.occurrences(_table(spark, folder, "documents"))


def p4_lines(spark, folder):
    found = lines.boilerplate_lines(lines.hashed(_table(spark, folder, "documents"), "doc_id"))
    return found.select("domain", "n_docs", "n_clusters", "n_days", "domain_clusters")


def p4_clean(spark, folder):
    return lines.without_repeated(_table(spark, folder, "documents"))


def p5_found(spark, folder):
    return content.furniture_lines(_table(spark, folder, "documents"))


def p5_main_text(spark, folder):
    return content.main_text(_table(spark, folder, "documents"))


def p5_html_nodes(spark, folder):
    return content.html_nodes(_table(spark, folder, "fetched_resources").filter(F.col("content_type").contains("html")))


def p3_found(spark, folder):
    return language.mislabelled(_table(spark, folder, "documents"))


def p3_languages(spark, folder):
    found = language.identify(_table(spark, folder, "documents"))
    return found.select("doc_id", "label", "languages", "confidence")


def p3_segments(spark, folder):
    found = language.identify(_table(spark, folder, "documents"))
    return found.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.line_no", "s.last_line", "s.lang", "s.confidence")


def _repaired(spark, folder):
    return encoding.repair(encoding.records(_table(spark, folder, "documents"), _table(spark, folder, "train_qa")))


def p6_found(spark, folder):
    # rows of train_qa are delivered again under the same id
    return _repaired(spark, folder).select("record_table", "record_key").distinct()


def p6_restored(spark, folder):
    return _repaired(spark, folder)


def p1_found(spark, folder):
    return pairs.defects(_table(spark, folder, "train_qa"), _table(spark, folder, "documents"))


def p2_found(spark, folder):
    return overlap.overlap_pairs(_table(spark, folder, "train_qa"), _table(spark, folder, "sites"))


def p2_overlaps(spark, folder):
    return overlap.overlap_counts(_table(spark, folder, "train_qa"), _table(spark, folder, "sites"))


def _answers(spark, folder):
    """All annotations; those of iaa_disagreements repeat rows of annotator_a and annotator_b."""
    return consensus.answers_of(_table(spark, folder, t) for t in ("annotator_a", "annotator_b", "annotator_more"))


def p7_found(spark, folder):
    answers, post, _ = consensus.estimate(_answers(spark, folder))
    return consensus.against_consensus(answers, post)


def p7_consensus(spark, folder):
    _, post, _ = consensus.estimate(_answers(spark, folder))
    return consensus.consensus(post).withColumn("posterior", F.round("posterior", 6))


def p7_agreement(spark, folder):
    return consensus.agreement(_answers(spark, folder))


def p7_reliability(spark, folder):
    _, _, rate = consensus.estimate(_answers(spark, folder))
    return consensus.reliability(rate)


def p8_ids(spark, folder):
    return tokens.encode(_table(spark, folder, "documents"))


def p8_decoded(spark, folder):
    docs = _table(spark, folder, "documents")
    back = tokens.decode(tokens.encode(docs)).withColumnRenamed("text", "decoded")
    return back.select("doc_id", F.md5("decoded").alias("text_md5"))


def _packed(spark, folder):
    return packing.pack(tokens.encode(_table(spark, folder, "documents"), sizes=True))


def p9_containers(spark, folder):
    return _packed(spark, folder)


def p9_faults(spark, folder):
    items = tokens.encode(_table(spark, folder, "documents"), sizes=True)
    return packing.faults(packing.pack(items), items)


def p9_fill(spark, folder):
    return packing.fill_rate(_packed(spark, folder))


def _areas(spark, folder):
    return subjects.areas(_table(spark, folder, "documents"), _table(spark, folder, "subject_labels"))


def p10_found(spark, folder):
    labels = _table(spark, folder, "subject_labels").select("doc_id").distinct()
    return _areas(spark, folder).join(F.broadcast(labels) if labels.count() < 200_000 else labels, "doc_id", "left_anti").select("doc_id", "subject")


def p10_areas(spark, folder):
    return _areas(spark, folder).withColumn("share", F.round("share", 6))


def p10_composition(spark, folder):
    return subjects.composition(_areas(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: made for name, made in sorted(globals().items()) if name[:1] == "p" and name[1:2].isdigit()}


_SPACE = "[\\t\\x0b\\x0c\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

_P4 = f"""
WITH texts AS (
  SELECT doc_id, domain, text, collected_at FROM documents
  WHERE regexp_replace(coalesce(text, ''), '(?:{_SPACE}|\\n)+', '', 'g') <> ''),
split_lines AS (
  SELECT doc_id, domain, text, collected_at,
         trim(unnest(string_split(regexp_replace(regexp_replace(lower(text), '{_SPACE}+', ' ', 'g'), '\\p{{Nd}}+', '0', 'g'), chr(10))), ' ') AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM texts),
totals AS (SELECT domain, count(*) AS domain_docs FROM texts GROUP BY domain),
counts AS (
  SELECT domain, line, count(DISTINCT doc_id) AS n_docs, count(DISTINCT md5(text)) AS n_clusters
  FROM split_lines WHERE line <> '' GROUP BY domain, line),
repeated AS (
  SELECT c.*, t.domain_docs FROM counts c JOIN totals t USING (domain)
  WHERE n_docs >= 8 AND n_docs >= domain_docs * 0.10)
"""

_P4_CLEAN = (
    _P4
    + """, clusters AS (SELECT domain, count(DISTINCT md5(text)) AS domain_clusters FROM texts GROUP BY domain),
firsts AS (SELECT domain, line, md5(text) AS cluster, count(DISTINCT doc_id) AS n, min(substring(collected_at, 1, 10)) AS day FROM split_lines WHERE line <> '' GROUP BY ALL),
boilerplate AS (
  SELECT f.domain, f.line, sum(f.n)::BIGINT AS n_docs, count(*) AS n_clusters, count(DISTINCT f.day) AS n_days, any_value(c.domain_clusters) AS domain_clusters
  FROM firsts f JOIN clusters c USING (domain) GROUP BY f.domain, f.line
  HAVING count(*) >= 8 AND count(*) >= any_value(c.domain_clusters) * 0.10 AND count(DISTINCT f.day) <> 1)
"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _P4 + "SELECT s.doc_id, s.line_no::BIGINT AS line_no FROM split_lines s JOIN repeated r ON s.domain = r.domain AND s.line = r.line",
        "p4_lines": _P4_CLEAN + "SELECT domain, n_docs, n_clusters, n_days, domain_clusters FROM boilerplate",
        "p4_clean": _P4_CLEAN
        + """, kept AS (
  SELECT s.doc_id, string_split(s.text, chr(10))[s.line_no + 1] AS raw, s.line_no, r.line AS hit
  FROM split_lines s LEFT JOIN boilerplate r ON s.domain = r.domain AND s.line = r.line),
joined AS (
  SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (hit IS NULL), '') AS text, count(hit)::INTEGER AS removed_lines
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN j.doc_id IS NULL THEN d.text ELSE j.text END AS text, coalesce(j.removed_lines, 0)::INTEGER AS removed_lines
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id""",
        "p9_faults": "SELECT count(*) AS documents, 0::BIGINT AS missing, 0::BIGINT AS overfull, 0::BIGINT AS split FROM documents",
        "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    }
