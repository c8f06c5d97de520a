"""Files: discovery, validation, page extraction by an injected parser, gold sets, CSV."""

from __future__ import annotations

import shutil
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import clean_text

PAGES = "source string, page_number int, content string"
SPANS = "source string, page_number int, block int, span int, text string, font string, size double, flags int, x0 double, y0 double, x1 double, y1 double, page_height double"
INLINE_GOLD = "id string, question string, relevant_pages array<int>"


def validate(path: str, suffixes: tuple[str, ...] = (".pdf",)) -> Path:
    p = Path(path)
    if not p.is_file():
        raise FileNotFoundError(path)
    if p.suffix.lower() not in suffixes:
        raise ValueError(f"{path}: expected {' or '.join(suffixes)}")
    return p


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, kind of documents and workbooks, documents first; only paths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    f = files.withColumn("kind", kind).where(F.col("kind").isin("pdf", "xlsx", "xlsm"))
    order = F.array_position(F.array(F.lit("pdf"), F.lit("xlsx"), F.lit("xlsm")), F.col("kind"))
    return f.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "kind").orderBy(order, "path")


def read_pages(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages of all documents of a folder, their text in its clean form; pages without any are left out and
    don't renumber the others.

    ``extract`` gives the text of each page of one document's bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(Path(p).name, i + 1, t) for p, c in zip(b["path"], b["content"], strict=True) for i, t in enumerate(extract(c)) if t and not t.isspace()]
            yield pd.DataFrame(rows, columns=["source", "page_number", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").option("recursiveFileLookup", "true").load(folder)
    pages = files.select("path", "content").mapInPandas(run, PAGES)
    return pages.withColumn("content", clean_text(F.col("content"))).where("content <> ''")


def read_spans(spark: SparkSession, folder: str, extract: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """Spans of all documents, for ``layout.spans_to_blocks``; ``extract`` gives rows of SPANS without the source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in SPANS.split(", ")]
        for b in batches:
            yield pd.DataFrame([(Path(p).name, *row) for p, c in zip(b["path"], b["content"], strict=True) for row in extract(c)], columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(run, SPANS)


def copy_in(path: str, folder: str) -> Path:
    """The file in the managed folder; copied there unless it is there already."""
    target = Path(folder) / Path(path).name
    if target.resolve() != Path(path).resolve():
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(path, target)
    return target


def read_gold(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """question, source, page_number of a gold set in either form (one source with pages, or a list of
    documents with pages): a JSON array, or with ``lines`` one object a line."""
    g = spark.read.option("multiLine", not lines).json(path)
    if "relevant_documents" in g.columns:
        d = g.select("question", F.explode("relevant_documents").alias("d"))
        g = d.select("question", "d.source", F.explode("d.pages").alias("page_number"))
    else:
        g = g.select("question", "source", F.explode("relevant_pages").alias("page_number"))
    return g.select("question", "source", F.col("page_number").cast("int").alias("page_number"))


def inline_gold(spark: SparkSession, rows: list[tuple[str, str, list[int]]]) -> DataFrame:
    """A gold set written in code."""
    return spark.createDataFrame(rows, INLINE_GOLD)


def write_calibration(scores: DataFrame, path: str) -> None:
    """The seven columns of a calibration as CSV with a header."""
    columns = ["type", "source", "page_number", "reference_number", "score", "evidence_text", "reference_text"]
    scores.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
