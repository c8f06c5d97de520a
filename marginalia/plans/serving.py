"""Queries that go through files, stores, workbooks and the service: what they read was written just before."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import answering, plugins
from marginalia.operators import alignment, layout
from marginalia.operators.orphans import source_key
from marginalia.plans.citing import share_of_tokens
from marginalia.plans.common import BLOCKS, EVIDENCE, PAGES, REFS, blocks, evidence, pages, refs, s_clean, s_key, s_nfkc
from marginalia.plans.retrieval import _asked, _contents, _vectors
from marginalia.service import KnowledgeService
from marginalia.session import checkpoint_dir, staged
from marginalia.sources import files, workbook
from marginalia.sources.store import ReferenceStore, VectorStore
from marginalia.sources.tables import once, read


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _documents(spark: SparkSession, sf: str) -> str:
    """A folder with a file for each source of the pages: the JSON list of its pages' texts, blank where one is missing."""
    folder = _folder(spark, "documents")
    Path(folder).mkdir(parents=True)
    p = pages(spark, sf).where("source IS NOT NULL AND page_number IS NOT NULL")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, got in zip(b["source"], b["pages"], strict=True):
                texts = {int(x["page_number"]): x["content"] for x in got}
                Path(f"{folder}/{source}").write_text(json.dumps([texts.get(i) for i in range(1, max(texts) + 1)]))
            yield b[["source"]]

    p.groupBy("source").agg(F.collect_list(F.struct("page_number", "content")).alias("pages")).mapInPandas(write, "source string").count()
    return folder


def list_sources(spark: SparkSession, sf: str) -> DataFrame:
    return files.list_files(spark, _documents(spark, sf)).select("name", "kind")


def load_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = files.read_pages(spark, _documents(spark, sf), json.loads)
    return p.select("source", "page_number", F.md5("content").alias("digest"))


def span_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks put together from spans: each block's text in two halves, the first in its font, the other in a lighter one."""
    b = blocks(spark, sf, "font_size", "is_bold", "x0", "y0", "x1", "y1").where("source IS NOT NULL AND page_number IS NOT NULL AND content <> ''")
    half = F.ceil(F.length("content") / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(0).alias("span"), F.substring("content", F.lit(1), half).alias("text"), F.when(F.col("is_bold"), "Times-DemiItalic").otherwise("Times").alias("font"), F.lit(0).alias("flags"), F.col("font_size").alias("size")),
        F.struct(F.lit(1).alias("span"), F.substring("content", half + 1, F.length("content")).alias("text"), F.lit("Times").alias("font"), F.when(F.col("pos") % 3 == 0, 16).otherwise(4).alias("flags"), (F.col("font_size") - 1).alias("size")),
    )
    s = b.select("source", "page_number", F.col("pos").alias("block"), "x0", "y0", "x1", "y1", F.explode(parts).alias("s")).select("source", "page_number", "block", "x0", "y0", "x1", "y1", "s.*")
    return layout.spans_to_blocks(s).select("source", "page_number", "pos", F.md5("content").alias("digest"), "font_size", "is_bold", "y1")


def reference_store_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """References used, looked up in a store to which the sources of ``refs`` were saved in two steps."""
    store = ReferenceStore(spark, _folder(spark, "references"))
    r = refs(spark, sf).where("content IS NOT NULL").withColumn("source", F.concat("source", F.lit(".pdf")))
    assert store.all().isEmpty() and store.get("nothing.pdf", 1) is None
    store.save(r.withColumn("content", F.lit("an old text")))
    store.save(r)
    u = once(read(spark, sf, "used_refs", ["use_id", "source", "number"]), "use_id").where("source IS NOT NULL AND number IS NOT NULL")
    return store.lookup(u.withColumn("source", F.concat(source_key(F.col("source")), F.lit(".pdf")))).select("use_id", F.col("reference"))


def score_references(spark: SparkSession, sf: str) -> DataFrame:
    """The first reference of each evidence, scored against its text where the store has it."""
    store = ReferenceStore(spark, _folder(spark, "references"))
    store.save(refs(spark, sf).where("content IS NOT NULL"))
    e = evidence(spark, sf, "reference_numbers").where("content IS NOT NULL AND source IS NOT NULL AND size(reference_numbers) > 0")
    e = e.select(F.col("ev_id").alias("ask_id"), F.col("content").alias("evidence_text"), source_key(F.col("source")).alias("source"), F.col("reference_numbers")[0].alias("number"))
    return alignment.score_references(e, store.all()).select("ask_id", "number", "score")


def _gold_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = evidence(spark, sf).where("source IS NOT NULL AND page_number IS NOT NULL AND content IS NOT NULL")
    return e.select(F.col("ev_id").cast("string").alias("id"), F.col("content").alias("question"), "source", F.col("page_number").alias("page"))


def gold_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Gold sets in both forms, written as JSON and read again."""
    g, flat, many = _gold_rows(spark, sf), _folder(spark, "gold"), _folder(spark, "gold")
    g.select("id", "question", "source", F.array("page", F.col("page") + 1).alias("relevant_pages")).write.json(flat)
    g.select("question", F.array(F.struct("source", F.array("page").alias("pages"))).alias("relevant_documents")).write.json(many)
    return files.read_gold(spark, flat, lines=True).unionByName(files.read_gold(spark, many, lines=True))


def calibration_file(spark: SparkSession, sf: str) -> DataFrame:
    """The calibration's columns written as CSV and read again."""
    path = _folder(spark, "calibration")
    e = evidence(spark, sf).where("content IS NOT NULL AND source IS NOT NULL AND page_number IS NOT NULL")
    out = e.select(F.lit("cited").alias("type"), "source", "page_number", (F.col("ev_id") % 90).alias("reference_number"), (F.col("ev_id") % 7 / 8).alias("score"), F.regexp_replace("content", r"\s+", " ").alias("evidence_text"), F.lit('a "quoted", text').alias("reference_text"))
    files.write_calibration(out, path)
    got = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return got.select("type", "source", F.col("page_number").cast("int").alias("page_number"), F.col("score").cast("double").alias("score"), F.md5("evidence_text").alias("digest"), "reference_text")


def _workbook(spark: SparkSession, sf: str) -> str:
    """A workbook of nations and regions with a blank row, an empty cell and an empty sheet."""
    path = f"{_folder(spark, 'workbook')}/driver.xlsx"
    Path(path).parent.mkdir(parents=True)
    n = read(spark, sf, "nation", ["n_nationkey", "n_name", "n_regionkey"]).orderBy("n_nationkey").collect()
    rows = [["key", " name ", "key", None, "half"]] + [[r.n_nationkey, r.n_name, r.n_regionkey, None, r.n_nationkey / 2 + 0.25] for r in n]
    rows.insert(4, [])
    r = read(spark, sf, "region", ["r_regionkey", "r_name"]).orderBy("r_regionkey").collect()
    workbook.write_workbook(path, {"nation": rows, "region": [["key", "name", "odd"]] + [[x.r_regionkey, x.r_name, x.r_regionkey % 2 == 1] for x in r], "blank": []})
    return path


def cell_search(spark: SparkSession, sf: str) -> DataFrame:
    return workbook.search_cells(workbook.read_cells(spark, _workbook(spark, sf)), " TION_1 ", 200)


def range_read(spark: SparkSession, sf: str) -> DataFrame:
    r = workbook.read_range(workbook.read_cells(spark, _workbook(spark, sf)), "nation", 1, 12)
    return r.select("row", F.posexplode("cells").alias("i", "c")).select("row", "i", "c.*")


def sheet_list(spark: SparkSession, sf: str) -> DataFrame:
    return workbook.list_sheets(workbook.read_cells(spark, _workbook(spark, sf))).select("sheet_no", "sheet", "max_row", "max_col")


def upload_status(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses of an upload: two documents, one without text, a broken one, a workbook, an unknown kind, a missing file."""
    at = _folder(spark, "inbox")
    Path(at).mkdir(parents=True)
    some = pages(spark, sf).where("source IS NOT NULL AND content IS NOT NULL").orderBy("page_id").limit(2).collect()
    for i, r in enumerate(some):
        Path(f"{at}/d{i}.pdf").write_text(json.dumps([r.content, "References\n[1] One entry."]))
    Path(f"{at}/blank.pdf").write_text(json.dumps([" "]))
    Path(f"{at}/broken.pdf").write_text("{")
    Path(f"{at}/n.txt").write_text("x")
    workbook.write_workbook(f"{at}/w.xlsx", {"a": [["x"]]})
    store, references = VectorStore(spark, f"{at}/index", 64), ReferenceStore(spark, f"{at}/references")
    service = KnowledgeService(spark, f"{at}/files", store, json.loads, references=references)
    names = ["d0.pdf", "d1.pdf", "blank.pdf", "broken.pdf", "w.xlsx", "n.txt", "missing.pdf"]
    done = service.ingest_documents([f"{at}/{n}" for n in names], "v1")["results"]
    kept = {r.stem for r in references.all().collect()}
    return spark.createDataFrame([(Path(r["path"]).name, r["status"], Path(r["path"]).stem in kept) for r in done], "name string, status string, has_references boolean")


def _answers(spark: SparkSession, sf: str) -> answering.Answers:
    points = _vectors(spark, sf).join(_contents(spark, sf).withColumn("source", F.concat(source_key(F.col("source")), F.lit(".pdf"))), "doc")
    r = refs(spark, sf).where("content IS NOT NULL").withColumnRenamed("source", "stem")
    return answering.answer(_asked(spark, sf), points, r)


def answered_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The stated questions answered by the stub model, with its citations rendered."""
    return _answers(spark, sf).answers


def answer_bibliography(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).bibliography


QUERIES = {f.__name__: f for f in (list_sources, load_pages, span_blocks, reference_store_lookup, score_references, gold_sets, calibration_file, cell_search, range_read, sheet_list, upload_status, answered_questions, answer_bibliography)}

_NATION = """c AS (SELECT n_nationkey + CASE WHEN n_nationkey < 3 THEN 2 ELSE 3 END AS row, i, kind, value FROM (SELECT n_nationkey, 1 AS i, 'number' AS kind, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT n_nationkey, 2, 'string', n_name FROM nation UNION ALL SELECT n_nationkey, 3, 'number', CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT n_nationkey, 5, 'number', CAST(n_nationkey / 2 + 0.25 AS VARCHAR) FROM nation))"""
ORACLES = {
    "list_sources": "WITH " + PAGES + " SELECT DISTINCT source AS name, lower(regexp_extract(source, '[.]([^.]+)$', 1)) AS kind FROM pg WHERE source IS NOT NULL",
    "load_pages": "WITH " + PAGES + "," + s_nfkc("pg", "page_id", "nf") + f" SELECT source, page_number, md5({s_clean('nf.content')}) AS digest FROM nf JOIN pg USING (page_id) WHERE source IS NOT NULL AND {s_clean('nf.content')} <> ''",
    "span_blocks": "WITH " + BLOCKS + " SELECT source, page_number, pos, md5(content) AS digest, font_size, CASE WHEN pos % 3 = 0 AND coalesce(is_bold, false) THEN true WHEN pos % 3 = 0 THEN length(content) // 2 >= length(content) * 0.5 ELSE coalesce(is_bold, false) END AS is_bold, y1 FROM bl WHERE source IS NOT NULL AND page_number IS NOT NULL AND content <> ''",
    "reference_store_lookup": "WITH " + REFS + f", u AS (SELECT DISTINCT use_id, {s_key('source')} AS source, number FROM used_refs WHERE use_id IS NOT NULL AND source IS NOT NULL AND number IS NOT NULL) SELECT use_id, rf.content AS reference FROM u LEFT JOIN rf ON regexp_replace(rf.source || '.pdf', '[.][^.]*$', '') = regexp_replace(u.source || '.pdf', '[.][^.]*$', '') AND rf.number = u.number",
    "score_references": "WITH " + EVIDENCE + "," + REFS + f", a AS (SELECT ev_id AS ask_id, content AS t, {s_key('source')} AS source, reference_numbers[1] AS number FROM ev WHERE content IS NOT NULL AND source IS NOT NULL AND len(reference_numbers) > 0) SELECT ask_id, a.number, CASE WHEN rf.content IS NOT NULL THEN CAST({share_of_tokens('a.t', 'rf.content')} AS DOUBLE) END AS score FROM a LEFT JOIN rf ON rf.source = a.source AND rf.number = a.number AND rf.content <> ''",
    "gold_sets": "WITH " + EVIDENCE + " SELECT content AS question, source, page_number + d AS page_number FROM ev, (VALUES (0), (1), (0)) v(d) WHERE source IS NOT NULL AND page_number IS NOT NULL AND content IS NOT NULL",
    "calibration_file": "WITH " + EVIDENCE + r" SELECT 'cited' AS type, source, page_number, (ev_id % 7) / 8.0 AS score, CASE WHEN regexp_replace(content, '[\t-\r ]+', ' ', 'g') <> '' THEN md5(regexp_replace(content, '[\t-\r ]+', ' ', 'g')) END AS digest, 'a " + '"quoted"' + ", text' AS reference_text FROM ev WHERE content IS NOT NULL AND source IS NOT NULL AND page_number IS NOT NULL",
    "cell_search": "WITH " + _NATION + " SELECT 'driver.xlsx' AS workbook, 'nation' AS sheet, CAST(row AS INTEGER) AS row, i AS col, kind, value FROM c WHERE contains(lower(value), 'tion_1')",
    "range_read": "WITH " + _NATION + " SELECT CAST(r AS INTEGER) AS row, CAST(h.i - 1 AS INTEGER) AS i, h.header, c.kind, c.value FROM range(2, 13) t(r) CROSS JOIN (VALUES (1, 'key'), (2, 'name'), (3, 'key_2'), (4, 'column_4'), (5, 'half')) h(i, header) LEFT JOIN c ON c.row = r AND c.i = h.i",
    "sheet_list": "SELECT 0 AS sheet_no, 'nation' AS sheet, CAST(count(*) + 2 AS INTEGER) AS max_row, CAST(5 AS INTEGER) AS max_col FROM nation UNION ALL SELECT 1, 'region', CAST(count(*) + 1 AS INTEGER), 3 FROM region UNION ALL SELECT 2, 'blank', NULL, NULL",
    "upload_status": "SELECT * FROM (VALUES ('d0.pdf', 'indexed', true), ('d1.pdf', 'indexed', true), ('blank.pdf', 'skipped', false), ('broken.pdf', 'error', false), ('w.xlsx', 'stored', false), ('n.txt', 'error', false), ('missing.pdf', 'error', false)) v(name, status, has_references)",
}
