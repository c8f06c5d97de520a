import json
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia import answering, plugins
from marginalia.server import serve
from marginalia.service import KnowledgeService
from marginalia.sources import files, store, workbook
from marginalia.streaming.ingest import ingest_stream


def make_workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>sample</t></si><si><t>Steel A</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>2.5</v></c><c r="C2" s="1"><v>45292</v></c></row><row r="3"><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="4"><c r="AB4" t="inlineStr"><is><t>steel</t></is></c></row></sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    make_workbook(path)
    s = KnowledgeService(spark, str(tmp_path), None)
    assert s.excel_list_sheets(path)["sheets"] == [{"name": "One", "rows": 3, "columns": 3}, {"name": "Two", "rows": 4, "columns": 28}]
    got = s.excel_read(path, "One")
    assert got["rows"] == [{"_row": 2, "sample": "Steel A", "column_2": 2.5, "sample_2": "2024-01-01T00:00:00"}, {"_row": 3, "sample": None, "column_2": True, "sample_2": None}]
    assert got["headers"] == ["sample", "column_2", "sample_2"] and (got["start_row"], got["end_row"], got["count"]) == (2, 3, 2)
    assert s.excel_read(path, "Two", 1, 3)["rows"][0]["column_28"] is None and s.excel_read(path, "One", 40, 50)["rows"] == []
    assert [(r["sheet"], r["row"], r["column"]) for r in s.excel_search(path, "STEEL")["matches"]] == [("One", 2, 1), ("Two", 4, 28)]
    assert [r["value"] for r in s.excel_search(path, "2024-01-01 00", "One")["matches"]] == ["2024-01-01T00:00:00"] and s.excel_search(path, "steel", "Two")["count"] == 1
    for wrong in (lambda: s.excel_read(path, "None"), lambda: s.excel_search(path, " ")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(ValueError):
        workbook.check_range(2, 503, 1)
    workbook.check_range(2, 502, 1)


def test_workbook_written_and_read(spark, tmp_path):
    path = str(tmp_path / "o.xlsx")
    workbook.write_workbook(path, {"a & b": [["x", 1, 2.5, True, None, "<y>"], [], [None, "z"]], "empty": []})
    cells = list(workbook.cells_of(open(path, "rb").read()))
    assert cells == [("a & b", 0, 1, 1, "string", "x"), ("a & b", 0, 1, 2, "number", "1"), ("a & b", 0, 1, 3, "number", "2.5"), ("a & b", 0, 1, 4, "boolean", "true"), ("a & b", 0, 1, 6, "string", "<y>"), ("a & b", 0, 3, 2, "string", "z"), ("a & b", 0, 3, 6, "sheet", None), ("empty", 1, None, None, "sheet", None)]
    assert [workbook.typed(k, v) for *_, k, v in cells[:4]] == ["x", 1, 2.5, True]


def test_headers_never_collide(spark):
    df = spark.createDataFrame([(["a", "a_2", "a", "", None, "a"],)], "h array<string>")
    assert df.select(workbook.normalize_headers("h").alias("n")).first().n == ["a", "a_2", "a_3", "column_4", "column_5", "a_4"]


def test_vector_store_merges_by_key(spark, tmp_path):
    v = store.VectorStore(spark, str(tmp_path / "index"), 2)
    assert v.scan() is None
    point = "source string, page_number int, chunk_index int, content string, vector array<double>"
    v.upsert(spark.createDataFrame([("a", 1, 0, "x", [1.0, 0.0]), ("a", 1, 1, "y", [0.0, 1.0])], point))
    v.upsert(spark.createDataFrame([("a", 1, 0, "new", [1.0, 1.0]), ("b", 1, 0, "z", [1.0, 0.0])], point))
    assert sorted(r.content for r in v.scan().collect()) == ["new", "y", "z"] and "vector" not in v.scan().columns
    v.upsert(spark.createDataFrame([("a", 1, 0, "only", [1.0, 1.0])], point), replace_source=True)
    assert sorted(r.content for r in v.scan().collect()) == ["only", "z"]
    with pytest.raises(Exception, match="size"):
        v.upsert(spark.createDataFrame([("c", 1, 0, "x", [1.0])], point))
    # Untouched buckets keep their files, and a second writer of the same version fails.
    before = v._manifest(v._version())["at"]
    v.upsert(spark.createDataFrame([("d", 1, 0, "more", [1.0, 1.0]), ("d", 1, 0, "a copy", [1.0, 1.0])], point))
    after = v._manifest(v._version())["at"]
    assert sum(before.get(b) != p for b, p in after.items()) == 1 and v.count() == 3
    with pytest.raises(RuntimeError):
        v._commit(v._version(), {})
    assert v.vacuum() > 0 and sorted(r.content for r in v.scan(vectors=True).collect()) == ["more", "only", "z"]
    with pytest.raises(ValueError):
        store.VectorStore(spark, v.path, 3).ensure()
    with pytest.raises(ValueError):
        store.VectorStore(spark, v.path, 2, "dot")


def test_reference_store(spark, tmp_path):
    keep = store.ReferenceStore(spark, str(tmp_path / "refs"))
    assert keep.load("a.pdf") == {} and keep.get("a.pdf", 1) is None and keep.all().count() == 0
    refs = spark.createDataFrame([("a.pdf", 1, "old", 1), ("a.pdf", 1, "new", 2), ("b.pdf", 2, "x", 1)], "source string, number int, content string, ord int")
    keep.save(refs, "ord")
    keep.save(refs.where("source = 'b.pdf'").withColumn("content", F.lit("y")))
    assert sorted(tuple(r) for r in keep.all().collect()) == [("a", 1, "new"), ("b", 2, "y")]
    assert keep.load("a.pdf") == {1: "new"} and keep.get("b.pdf", 2) == "y" and keep.get("b.pdf", 3) is None
    asked = spark.createDataFrame([("a.pdf", 1, "q"), ("a.pdf", 9, "r"), (None, 1, "s")], "source string, number int, content string")
    assert {r.content: r.reference for r in keep.lookup(asked).collect()} == {"q": "new", "r": None, "s": None}


def test_stream_and_search(spark, tmp_path):
    chunk = "source string, page_number int, chunk_index int, content string, embedding_text string"
    inbox, v = str(tmp_path / "in"), store.VectorStore(spark, str(tmp_path / "index"), 64)
    rows = [("a.pdf", 1, 0, "steel creep at high temperature", None), ("a.pdf", 1, 1, "", None), ("b.pdf", 2, 0, "soil water content", None)]
    spark.createDataFrame(rows, chunk).write.parquet(inbox)
    ingest_stream(spark, inbox, chunk, v, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("b.pdf", 2, 0, "soil water content and clay", None)], chunk).write.mode("append").parquet(inbox)
    ingest_stream(spark, inbox, chunk, v, str(tmp_path / "cp")).awaitTermination()
    assert v.scan().count() == 2
    s = KnowledgeService(spark, str(tmp_path), v)
    r = s.search_knowledge("soil water", 3)
    assert r["results"][0]["content"] == "soil water content and clay" and r["results"][0]["rank"] == 1
    assert s.search_knowledge("soil water", 3, "A.pdf")["count"] == 1
    with pytest.raises(ValueError):
        s.search_knowledge("  ")


def test_upload_statuses(spark, tmp_path):
    (tmp_path / "d.pdf").write_bytes(b"first page\x0c\x0csecond page")
    (tmp_path / "n.txt").write_text("x")
    make_workbook(tmp_path / "w.xlsx")
    managed = tmp_path / "managed"
    v = store.VectorStore(spark, str(tmp_path / "index"), 64)
    s = KnowledgeService(spark, str(managed), v, extract=lambda b: b.decode().split("\x0c"))
    got = s.ingest_documents([str(tmp_path / x) for x in ("d.pdf", "w.xlsx", "n.txt", "missing.pdf")], "v1")["results"]
    assert [r["status"] for r in got] == ["indexed", "stored", "error", "error"]
    assert sorted((r.page_number, r.content) for r in v.scan().collect()) == [(1, "first page"), (3, "second page")]
    kinds = s.list_sources()
    assert ([x["name"] for x in kinds["pdfs"]], [x["name"] for x in kinds["excel"]], kinds["count"]) == (["d.pdf"], ["w.xlsx"], 2)
    with pytest.raises(ValueError):
        s.ingest_documents([])


def test_gold_sets(spark, tmp_path):
    flat, many = tmp_path / "f.json", tmp_path / "m.json"
    flat.write_text(json.dumps([{"id": "1", "question": "q", "source": "a", "relevant_pages": [1, 2]}]))
    many.write_text(json.dumps([{"question": "q", "relevant_documents": [{"source": "a", "pages": [1]}, {"source": "b", "pages": [2]}]}]))
    assert [tuple(r) for r in files.read_gold(spark, str(flat)).collect()] == [("q", "a", 1), ("q", "a", 2)]
    assert [tuple(r) for r in files.read_gold(spark, str(many)).collect()] == [("q", "a", 1), ("q", "b", 2)]
    assert files.inline_gold(spark, [("1", "q", [3])]).count() == 1
    with pytest.raises(ValueError):
        files.validate(str(flat))


def test_clients(spark):
    assert plugins.client_for("Stub").generate("", "E1\nx").text.endswith("[E1].")
    assert plugins.Usage(1, 2).total_tokens == 3 and plugins.Usage(1).total_tokens is None
    with pytest.raises(ValueError):
        plugins.client_for("other")
    with pytest.raises(ValueError):
        plugins.KeyedClient(lambda *a: None, None)
    p = spark.createDataFrame([(1, "E1\ntext")], "query_id bigint, prompt string")
    assert plugins.answers(p).first().answer == "See the evidence [E1]."


def test_tools_over_lines(spark, tmp_path):
    import io

    make_workbook(tmp_path / "w.xlsx")
    s = KnowledgeService(spark, str(tmp_path), None)
    calls = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "excel_list_sheets", "arguments": {"path": str(tmp_path / "w.xlsx")}}}, {"id": 4, "method": "tools/call", "params": {"name": "excel_read", "arguments": {"path": "nothing.xlsx", "sheet": "a"}}}, {"id": 5, "method": "other"}, {"id": 6, "method": "tools/call", "params": {"name": "other"}}]
    out = io.StringIO()
    serve(s, io.StringIO("\n".join([json.dumps(c) for c in calls] + ["{", ""])), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5, 6, None]
    tools = {t["name"]: t["inputSchema"] for t in got[1]["result"]["tools"]}
    assert len(tools) == 6 and tools["excel_read"]["required"] == ["path", "sheet"] and tools["search_knowledge"]["properties"]["top_k"] == {"type": "integer"}
    assert got[2]["result"]["structuredContent"]["sheets"][0]["name"] == "One" and got[3]["result"]["isError"] and "error" in got[4] and "error" in got[5]


def test_questions_to_cited_answers(spark):
    point = "doc bigint, content string, source string, page_number int, chunk_index int"
    points = spark.createDataFrame([(1, "Steel creeps at high temperature [1]. It is known.", "a.pdf", 3, 0), (2, "Soil holds water.", "b.pdf", 1, 0)], point).withColumn("vector", plugins.embed_column(F.col("content")))
    refs = spark.createDataFrame([("a", 1, "Creep of steel, 2001")], "stem string, number int, content string")
    q = spark.createDataFrame([(1, " steel creeps at high temperature "), (2, " "), (3, None), (None, "x")], "query_id bigint, text string")
    done = answering.answer(q, points, refs, top_k=1)
    assert [(r.query_id, r.rendered) for r in done.answers.collect()] == [(1, "See the evidence [a.pdf, ref 1].")]
    assert [tuple(r) for r in done.bibliography.collect()] == [(1, 0, "a.pdf", 1, "Creep of steel, 2001")]
    assert [(r.content, r.page, r["rank"]) for r in done.results.collect()] == [("Steel creeps at high temperature [1]. It is known.", 3, 1)]

    class Longest:
        def score(self, pairs):
            return [len(b) for _, b in pairs]

    assert answering.answer(q, points, refs, scorer=Longest, top_k=2).results.count() == 2
