from __future__ import annotations

import io
import zipfile

from doclathe.sources import files, html, office, sinks


def test_text_encodings():
    assert files.parse_txt("a\r\n\r\nb\n\n c ".encode())["paragraphs"] == ["a", "b", "c"]
    assert files.parse_txt("中文".encode("gbk"))["text"] == "中文"
    assert files.parse_txt(b"")["paragraphs"] == []
    about = files.parse_txt(b"1\n\n2\n3")["metadata"]
    assert (about["total_lines"], about["non_empty_lines"]) == ("4", "3")


PAGE = """<html><head><title>T</title><meta name="author" content="me"><style>p {}</style></head>
<body><nav>skip</nav><p>One<p>Two   words<!-- no --><script>x()</script>
<table><tr><th>a</th><td>b</td></tr><tr><td>c</td><td> d </td></tr><tr></tr></table><img src="/i.png" alt="i"></body></html>"""


def test_html():
    out = html.parse(PAGE, "http://h/x/", with_images=True)
    assert out["text"] == "One\nTwo words\na\nb\nc\nd"
    assert out["tables"] == [[["a", "b"], ["c", "d"]]]
    assert out["metadata"]["title"] == "T" and out["metadata"]["author"] == "me"
    assert out["images"] == [{"src": "http://h/i.png", "alt": "i"}]
    assert html.parse("<p>no body &amp; more", drop=("b",))["text"] == "no body & more"
    assert html.parse("<div id=a><i>x</i></div><div class='c d'>y</div>", selector="div.d")["text"] == "y"
    assert html.parse("<form>open <p>all gone")["text"] == ""
    assert html.parse("")["paragraphs"] == []


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = f"<w:document {w}><w:body>{p('First')}{p(' ')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('Last')}</w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/header1.xml", f"<w:hdr {w}>{p('Top')}</w:hdr>")
        z.writestr("docProps/core.xml", '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>me</dc:creator></c>')
    return out.getvalue()


def test_docx():
    out = office.parse_docx(docx(), headers=True)
    assert out["paragraphs"] == ["[页眉] Top", "First", "Last"]
    assert out["tables"] == [[["a", "b"]]] and out["metadata"]["author"] == "me"


def test_registry():
    r = files.ParserRegistry()
    assert [r.parser_for(p).name for p in ("a.TXT", "b.pdf", "c.docx", "d.html", "http://e/f.pdf", "g.xyz")] == ["txt", "pdf", "docx", "html", "html", "txt"]
    r.register(files.CSV_PLUGIN)
    assert r.parser_for("a.tsv").name == "csv_table" and r.unregister(".tsv") and not r.unregister("tsv")
    assert "csv" in r.extensions()


def test_files_as_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny")
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.html").write_text(PAGE)
    out = {r["file_path"].rpartition("/")[2]: r for r in files.parse_files(files.read_files(spark, str(tmp_path))).collect()}
    assert out["a.txt"]["paragraphs"] == ["x", "y"] and out["a.txt"]["file_size"] == 4
    assert out["d.html"]["success"] and out["d.html"]["tables"] == [[["a", "b"], ["c", "d"]]]
    assert not out["b.docx"]["success"] and "BadZipFile" in out["b.docx"]["error"]
    assert not out["c.pdf"]["success"]
    own = files.parse_files(files.read_files(spark, str(tmp_path), "*.txt"))
    assert files.summary(own).first()["paragraphs_count"] == 2
    assert files.preview(own).first()["text_length"] == 4


def test_json_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "n int, s string")
    sinks.save_jsonl(df, str(tmp_path / "j"))
    assert spark.read.schema("n int, s string").json(str(tmp_path / "j")).orderBy("n").collect() == df.orderBy("n").collect()
    sinks.save_json(df, str(tmp_path / "one"))
    text = next((tmp_path / "one").glob("part-*")).read_text()
    assert '"s" : null' in text or '"s":null' in text
    (tmp_path / "t.csv").write_text('name,age\n"x, y",3\nz,4\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [("x, y", "3"), ("z", "4")]
    (tmp_path / "l.txt").write_text("a\n\n b \n")
    assert [r[0] for r in files.read_file_list(spark, str(tmp_path / "l.txt")).collect()] == ["a", "b"]
    (tmp_path / "r.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_json_records(spark, str(tmp_path / "r.json")).count() == 2
    assert files.parse_csv(b"")["metadata"] == {"rows": "0"}
