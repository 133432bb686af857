"""Packages and ledgers."""

import zipfile

from palimpsest.sources import docx, ledger

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {NS}><w:body>{body}</w:body></w:document>')
        z.writestr("[Content_Types].xml", "<Types/>")


def test_docx(spark, tmp_path):
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    gone = "<w:p><w:pPr><w:rPr><w:del/></w:rPr></w:pPr>" + run("one ") + "<w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:ins>" + run("new") + "</w:ins></w:p>"
    package(tmp_path / "a.docx", gone + f"<w:p>{run(' two')}</w:p><w:p><w:moveTo>{run('moved')}</w:moveTo></w:p>")
    (tmp_path / "b.docx").write_bytes(b"no package")
    assert {r["part_name"] for r in docx.read_parts(spark, str(tmp_path)).collect()} == {"/word/document.xml", "/[Content_Types].xml", docx.BROKEN}
    p = docx.read_paragraphs(spark, str(tmp_path))
    text = lambda accept: [r["text"] for r in docx.resolved_text(p, accept).orderBy("para_no").collect()]
    assert text(True) == ["one new two", "moved"]
    assert text(False) == ["one old", " two", ""]


def test_docx_strict_names_main_part_and_text_boxes(spark, tmp_path):
    strict = NS.replace("http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://purl.oclc.org/ooxml/wordprocessingml/main")
    rels = "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'><Relationship Id='r1' Type='{}' Target='{}'/></Relationships>"
    box = "<w:p><w:r><w:t>outer</w:t></w:r><w:r><w:pict><w:txbxContent><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:txbxContent></w:pict></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "s.docx", "w") as z:
        z.writestr("_rels/.rels", rels.format(docx.MAIN_TYPES[1], "word/../main/doc2.xml"))
        z.writestr("main/doc2.xml", f"<w:document {strict}><w:body>{box}</w:body></w:document>")
        z.writestr("main/_rels/doc2.xml.rels", rels.format("http://a/header", "../word/h1.xml"))
        z.writestr("word/h1.xml", f"<w:hdr {strict}><w:p><w:ins><w:r><w:t>head</w:t></w:r></w:ins></w:p></w:hdr>")
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", "<no xml")
    rows = docx.read_paragraphs(spark, str(tmp_path)).orderBy("path", "para_no").collect()
    assert [(r["path"][-6:], r["para_no"], r["text"]) for r in rows] == [("s.docx", 0, "outer"), ("s.docx", 1, "inner"), ("x.docx", -1, None)]
    found = docx.read_relationships(docx.read_parts(spark, str(tmp_path))).collect()
    assert {(r["source_part"], r["target_part"]) for r in found} == {("/", "/main/doc2.xml"), ("/main/doc2.xml", "/word/h1.xml")}


    whole = docx.read_paragraphs(spark, str(tmp_path), stories=True)
    assert {(r["part_name"], r["text"]) for r in docx.resolved_text(whole, False).where("text <> ''").collect()} == {("/main/doc2.xml", "outer"), ("/main/doc2.xml", "inner")}
    assert ("/word/h1.xml", "head") in {(r["part_name"], r["text"]) for r in docx.resolved_text(whole, True).collect()}
    assert {r["name"] for r in docx.list_files(spark, str(tmp_path)).where("size > 0").collect()} == {"s.docx", "x.docx"}


def test_corrupt_members_and_content_types(spark, tmp_path):
    types = (
        "<Types xmlns='http://schemas.openxmlformats.org/package/2006/content-types'><Default Extension='XML' ContentType='application/xml'/>"
        "<Default Extension='png' ContentType='image/png'/><Override PartName='/word/document.xml' ContentType='main'/></Types>"
    )
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("[Content_Types].xml", types)
        z.writestr("word/document.xml", f"<w:document {NS}><w:body><w:p><w:r><w:t>fine</w:t></w:r></w:p></w:body></w:document>")
        z.writestr("word/a.xml", "spoilt content")
        z.writestr("word/b.PNG", "x")
        z.writestr("word/none", "x")
        z.writestr("word/_rels/document.xml.rels", "<no xml")
    spoilt = (tmp_path / "c.docx").read_bytes().replace(b"spoilt content", b"spoilt kontent")
    (tmp_path / "c.docx").write_bytes(spoilt)
    parts = docx.read_parts(spark, str(tmp_path))
    held = {r["part_name"]: r["bytes"] for r in parts.collect()}
    assert held["/word/a.xml"] is None and held["/word/b.PNG"] == b"x" and len(held) == 6
    got = {r["part_name"]: r["content_type"] for r in docx.part_types(parts).collect()}
    assert got == {"/word/document.xml": "main", "/word/a.xml": "application/xml", "/word/b.PNG": "image/png", "/word/none": None, "/word/_rels/document.xml.rels": None}
    assert [r["target_mode"] for r in docx.read_relationships(parts).collect()] == [docx.BROKEN]
    assert [r["text"] for r in docx.read_paragraphs(spark, str(tmp_path)).collect()] == ["fine"]


def test_ledgers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("pair\tscore\na\t1.5\nb\t2\n")
    (tmp_path / "a.csv").write_text("a,1.5\nb,2\n")
    (tmp_path / "a.jsonl").write_text('{"pair": "a", "score": 1.5}\n{"pair": "b", "score": 2}\n')
    (tmp_path / "a.json").write_text('{"a": 1.5,\n "b": 2}')
    for kind in ("tsv", "csv", "jsonl", "json"):
        got = ledger.read_ledger(spark, str(tmp_path / f"a.{kind}"), kind).orderBy("pair").collect()
        assert [(r["pair"], r["score"]) for r in got] == [("a", 1.5), ("b", 2.0)]
    (tmp_path / "t.tsv").write_text("round\tfixture\ttag\treal\tuser\tsys\tmaxrss\n1\tf\tA\t0.5\t0.4\t0.1\t9\n2\tf\tB\tFAIL\t\t\t\n")
    assert [r["real"] for r in ledger.read_trials(spark, str(tmp_path / "t.tsv")).collect()] == [0.5]
