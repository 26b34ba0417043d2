"""Readers and writers of text, JSON and CSV files, and the boundary to the network."""

from __future__ import annotations

import csv
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(spark: SparkSession, path: str, *, blanks: bool = False) -> DataFrame:
    """(line_no from 0, value): the lines of one file by their place. Without `blanks` they are trimmed and blank ones dropped."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n", -1)).alias("line_no", "value"))
    if blanks:
        return rows
    kept = rows.select("line_no", F.trim("value").alias("value")).filter(F.length("value") > 0)
    return kept.select((F.row_number().over(Window.orderBy("line_no")) - 1).alias("line_no"), "value")


def json_rows(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows of a JSON array (or of JSON lines in multi-line form) with a stated schema; missing keys are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def strict_csv(spark: SparkSession, path: str, fields: list[str], *, blanks: bool = False) -> DataFrame:
    """A CSV whose header is exactly `fields`; extra values, and blank ones unless allowed, are errors with their line."""
    header = spark.read.text(path).first()
    found = [f.strip() for f in next(csv.reader([(header[0] if header else "").lstrip("\ufeff")]), [])]
    if found != fields:
        raise ValueError(f"{path}, line 1: header {found} isn't {fields}")

    def line_of(record: str) -> int | None:
        first = record.split("\n")[0].rstrip("\r")
        hit = lines(spark, path, blanks=True).filter(F.col("value") == first).agg(F.min("line_no")).first()[0]
        return None if hit is None else hit + 1

    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields] + [T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", multiLine=True, escape='"')
    # all columns are read, since a record is broken by its other fields
    broken = rows.filter(F.col("_corrupt").isNotNull()).first()
    broken = [broken["_corrupt"]] if broken else None
    if broken:
        raise ValueError(f"{path}, line {line_of(broken[0])}: {broken[0]}")
    out = rows.select(*(F.coalesce(F.trim(f), F.lit("")).alias(f) for f in fields))
    if not blanks:
        empty = out.filter(F.least(*(F.length(f) for f in fields)) == 0 if len(fields) > 1 else F.length(fields[0]) == 0).first()
        if empty:
            raise ValueError(f"{path}: blank field in {empty.asDict()}")
    return out


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of files; two calls show whether inputs changed."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def parse_env(text: str, known: dict[str, str]) -> dict[str, str]:
    """KEY=value lines of a settings file; what is already known wins."""
    out = {}
    for line in text.splitlines():
        key, sign, value = line.strip().partition("=")
        if sign and not key.startswith("#"):
            out[key.strip()] = value.strip().strip("'\"")
    return out | known


#: Headers that a client of fetch() should send: what it takes, and bodies packed.
HEADERS = {"User-Agent": "Mozilla/5.0 (compatible; papyrine)", "Accept": "text/html,application/xhtml+xml,application/pdf;q=0.9,*/*;q=0.8", "Accept-Encoding": "gzip, deflate"}


def fetch(urls: DataFrame, client: Callable[[str], tuple[int, str, bytes]] | None, *, retries: int = 1, wait: float = 0.4) -> DataFrame:
    """(url, status, content_type, body, error): fetches within tasks by an injected client; failures become rows.

    Between attempts `wait` seconds pass. The client sends its own headers; it may take HEADERS.

    Without a client every URL has status `skipped`. A gzip or deflate body is expanded.
    """

    def run(parts):
        import gzip
        import zlib

        for pdf in parts:
            rows = []
            for url in pdf.url:
                row = {"url": url, "status": "skipped", "content_type": None, "body": None, "error": None}
                for attempt in range(retries + 1 if client else 0):
                    if attempt:
                        time.sleep(wait)
                    try:
                        code, kind, body = client(url)
                        if body[:2] == b"\x1f\x8b":
                            body = gzip.decompress(body)
                        elif body[:1] == b"\x78":
                            try:
                                body = zlib.decompress(body)
                            except zlib.error:
                                pass
                        row |= {"status": "ok" if code == 200 else f"http_{code}", "content_type": kind, "body": body, "error": None}
                        break
                    except OSError as e:
                        row |= {"status": "url_error", "error": str(e)[:200]}
                    except Exception as e:
                        row |= {"status": "error", "error": str(e)[:200]}
                rows.append(row)
            yield type(pdf)(rows, columns=["url", "status", "content_type", "body", "error"])

    return urls.select("url").mapInPandas(run, "url string, status string, content_type string, body binary, error string")


def pdf_text(bodies: DataFrame, extract: Callable[[bytes], str] | None) -> DataFrame:
    """(url, text) of PDF bodies by an injected extractor; '' without one or where it fails."""

    def run(parts):
        for pdf in parts:
            texts = []
            for body in pdf.body:
                try:
                    texts.append(extract(bytes(body)) if extract and body is not None else "")
                except Exception:
                    texts.append("")
            yield pdf[["url"]].assign(text=texts)

    return bodies.select("url", "body").mapInPandas(run, "url string, text string")


def write_lines(rows: DataFrame, path: str, *, order: str = "line_no", value: str = "value") -> None:
    """One text file of the values in order, a line each."""
    rows.orderBy(order).select(F.regexp_replace(value, r"[\r\n]+", " ").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def split_lines(rows: DataFrame) -> DataFrame:
    """(split, line_no, question, answers) of annotation rows: alternatives of an answer joined by `;`, lines from 0 in order of id."""
    joined = F.coalesce(F.array_join("answers", ";"), F.col("answer"), F.lit(""))
    flat = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    order = F.row_number().over(Window.partitionBy("split").orderBy("id", "question"))
    return rows.select("split", (order - 1).alias("line_no"), flat(F.coalesce("question", F.lit(""))).alias("question"), flat(joined).alias("answers"))


def write_splits(rows: DataFrame, path: str, *, splits: tuple[str, ...] = ("train", "test")) -> None:
    """questions.txt and reference_answers.txt of each split as text folders, line for line."""
    lines = split_lines(rows)
    for split in splits:
        own = lines.filter(F.col("split") == split)
        write_lines(own, f"{path}/{split}/questions.txt", value="question")
        write_lines(own, f"{path}/{split}/reference_answers.txt", value="answers")


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, one object per row, in parallel; null fields are written."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def snapshots(fetched: DataFrame) -> DataFrame:
    """(name, url, body): each fetched body under its file name; PDFs by path or content type, else HTML. Null bodies have none."""
    pdf = F.coalesce(F.lower(F.parse_url("url", F.lit("PATH"))).endswith(".pdf"), F.lit(False)) | F.coalesce(F.lower("content_type").contains("pdf"), F.lit(False))
    name = F.when(pdf, safe_name(F.col("url"), ".pdf")).otherwise(safe_name(F.col("url"), ".html"))
    return fetched.filter(F.col("body").isNotNull()).select(name.alias("name"), "url", "body")


def write_snapshots(fetched: DataFrame, path: str) -> None:
    """The snapshots as a binary column, so that millions of small bodies make no small files."""
    snapshots(fetched).write.mode("overwrite").parquet(path)


def write_traces(retrieved: DataFrame, answers: DataFrame, path: str) -> None:
    """JSON lines, one per question: its answer and the retrieved passages by rank."""
    nested(retrieved, answers).write.mode("overwrite").json(path)


def nested(retrieved: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, answer, retrieved array<struct>) by rank."""
    fields = [c for c in ("rank", "score", "chunk_id", "source", "title", "url") if c in retrieved.columns]
    groups = retrieved.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("retrieved"))
    return answers.select("qid", "answer").join(groups, "qid")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def safe_name(url, suffix: str):
    """A file name for a URL: its signs as dashes, at most 90, and 16 digits of its hash."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://", ""), r"[^a-z0-9]+", "-")
    return F.concat(F.substring(F.btrim(slug, F.lit("-")), 1, 90), F.lit("-"), F.substring(F.sha1(url), 1, 16), F.lit(suffix))


def bar_chart(rows: list[dict], metrics: list[str], label: str, *, width: int = 720, height: int = 320) -> str:
    """A grouped bar chart of a few rows as SVG text, values from 0 to 100."""
    from xml.sax.saxutils import escape

    group = (width - 60) / max(1, len(rows))
    bar = group * 0.8 / max(1, len(metrics))
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">']
    for i, row in enumerate(rows):
        for j, m in enumerate(metrics):
            h = float(row[m] or 0) / 100 * (height - 60)
            x = 40 + i * group + j * bar
            parts.append(f'<rect x="{x:.1f}" y="{height - 40 - h:.1f}" width="{bar * 0.9:.1f}" height="{h:.1f}" fill="hsl({j * 97 % 360},55%,50%)"><title>{escape(m)}: {float(row[m] or 0):.2f}</title></rect>')
        parts.append(f'<text x="{40 + (i + 0.4) * group:.1f}" y="{height - 20}" text-anchor="middle" font-size="12">{escape(str(row[label]))}</text>')
    return "\n".join([*parts, "</svg>"])
