"""The six tool functions over one session: plain Python in, plain Python out."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marginalia import plugins
from marginalia.functions.text import text_to_embed
from marginalia.operators import dense, layout, ranking
from marginalia.pipelines import IngestionResult
from marginalia.sources import files, workbook
from marginalia.sources.store import ReferenceStore, VectorStore

CANDIDATES = 12


class KnowledgeService:
    """Sources, search, ingestion and workbooks of one folder.

    ``extract`` gives the pages of a document's bytes, ``extract_spans`` its spans (for layout); ``scorer`` makes a
    pair scorer for reranking, without it the lexical one counts.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        store: VectorStore | None,
        extract: Callable[[bytes], list[str]] | None = None,
        embedder: Callable[[], plugins.Embedder] = plugins.HashedWords,
        *,
        references: ReferenceStore | None = None,
        extract_spans: Callable | None = None,
        scorer: Callable[[], plugins.PairScorer] | None = None,
    ) -> None:
        self.spark, self.folder, self.store, self.embedder, self.references = spark, folder, store, embedder, references
        self.extract, self.extract_spans, self.scorer = extract, extract_spans, scorer

    def list_sources(self) -> dict:
        rows = files.list_files(self.spark, self.folder).collect() if Path(self.folder).is_dir() else []
        of = lambda kinds, name: [{"name": r.name, "path": r.path, "type": name} for r in rows if r.kind in kinds]
        return {"pdfs": of(("pdf",), "pdf"), "excel": of(("xlsx", "xlsm"), "excel"), "count": len(rows)}

    def candidates(self, query: str, k: int = CANDIDATES):  # noqa: ANN201
        """Points for one query: query_id, rank, doc, score, text, content, source, page_number, chunk_index; None without points."""
        points = self.store.scan(vectors=True) if self.store else None
        if points is None:
            return None
        docs = points.withColumn("doc", F.xxhash64("point_id"))
        vector = [float(x) for x in self.embedder().embed([query.strip()])[0]]
        q = self.spark.createDataFrame([(0, query.strip(), vector)], "query_id bigint, text string, vector array<double>")
        found = dense.dense_retrieve(docs.select("doc", "vector"), q, docs.select("doc", "content"), k, 3 * k)
        return found.join(docs.drop("vector"), "doc").join(q.select("query_id", "text"), "query_id")

    def score(self):  # noqa: ANN201
        return (lambda a, b: plugins.score_column(a, b, self.scorer)) if self.scorer else None

    def search_knowledge(self, query: str, top_k: int = 5, source: str | None = None) -> dict:
        if not query or not query.strip():
            raise ValueError("the query is blank")
        c = self.candidates(query)
        if c is None:
            return {"query": query.strip(), "count": 0, "results": []}
        best = ranking.search(c, top_k, source, CANDIDATES, self.score())
        rows = ranking.shape_results(best, c.drop("score", "rank")).orderBy("rank").drop("query_id").collect()
        return {"query": query.strip(), "count": len(rows), "results": [r.asDict() for r in rows]}

    def ingest_documents(self, paths: list[str], pipeline: str | None = None) -> dict:
        """A status for each path: stored (workbook), indexed, skipped (no chunks) or error; one document's failure
        is no other's. References go to their store before the chunks are indexed."""
        if not paths:
            raise ValueError("no paths")
        name = plugins.select(self.spark, pipeline)
        way = plugins.create(name)
        out = []
        for path in paths:
            suffix = Path(path).suffix.lower()
            try:
                if not Path(path).is_file():
                    raise FileNotFoundError(f"no such file: {path}")
                if suffix in workbook.SUFFIXES:
                    out.append({"path": path, "status": "stored", "type": "excel", "destination": str(files.copy_in(path, self.folder))})
                elif suffix == ".pdf":
                    done = self._ingested(path, way)
                    n = self._index(done)
                    if n:
                        target = files.copy_in(path, self.folder)
                        out.append({"path": path, "status": "indexed", "type": "pdf", "pipeline": name, "pages": done.pages.count(), "main_pages": done.main_pages.count(), "references": done.references.count(), "chunks": n, "destination": str(target)})
                    else:
                        out.append({"path": path, "status": "skipped", "type": "pdf", "reason": "no chunks"})
                else:
                    raise ValueError(f"unknown kind of file: {suffix or path}")
            except Exception as e:  # noqa: BLE001  whatever a parser or a model throws concerns one document only
                out.append({"path": path, "status": "error", "error": str(e)})
        return {"count": len(out), "results": out}

    def _ingested(self, path: str, way: plugins.Pipeline) -> IngestionResult:
        if self.extract is None and self.extract_spans is None:
            raise ValueError("no parser for documents was given")
        pages = files.read_pages(self.spark, path, self.extract) if self.extract else None
        blocks = layout.spans_to_blocks(files.read_spans(self.spark, path, self.extract_spans)) if self.extract_spans else None
        return way.ingest(pages, blocks)

    def _index(self, done: IngestionResult) -> int:
        if self.references is not None:
            self.references.save(done.references)
        texts = text_to_embed(F.col("embedding_text"), F.col("content"))
        points = done.chunks.where("content <> ''").withColumn("vector", plugins.embed_column(texts, self.embedder))
        return self.store.upsert(points) if self.store else 0

    def excel_list_sheets(self, path: str) -> dict:
        at = workbook.resolve(path)
        rows = workbook.list_sheets(workbook.read_cells(self.spark, str(at))).orderBy("sheet_no").collect()
        return {"file": str(at), "sheets": [{"name": r.sheet, "rows": r.max_row, "columns": r.max_col} for r in rows]}

    def excel_read(self, path: str, sheet: str, start_row: int = 2, end_row: int = 50, header_row: int = 1) -> dict:
        workbook.check_range(start_row, end_row, header_row)
        at = workbook.resolve(path)
        cells = workbook.read_cells(self.spark, str(at))
        names, last = workbook.headers_of(cells, sheet, header_row)
        got = workbook.read_range(cells, sheet, start_row, end_row, header_row).orderBy("row").collect()
        rows = [{c.header: workbook.typed(c.kind, c.value) for c in r.cells} | {"_row": r.row} for r in got]
        return {"file": str(at), "sheet": sheet, "header_row": header_row, "start_row": max(start_row, header_row + 1), "end_row": min(end_row, last), "headers": names, "rows": rows, "count": len(rows)}

    def excel_search(self, path: str, query: str, sheet: str | None = None, max_results: int = 50) -> dict:
        if not query.strip():
            raise ValueError("the query is blank")
        at = workbook.resolve(path)
        cells = workbook.read_cells(self.spark, str(at))
        if sheet is not None:
            workbook.headers_of(cells, sheet)
        rows = workbook.search_cells(cells, query, max_results, sheet).collect()
        return {"file": str(at), "query": query.strip(), "count": len(rows), "matches": [{"sheet": r.sheet, "row": r.row, "column": r.col, "value": workbook.typed(r.kind, r.value)} for r in rows]}
