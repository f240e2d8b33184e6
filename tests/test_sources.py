"""Sources and sinks on files made here."""

import io
import zipfile

from textloom.sources import archives as A
from textloom.sources import records as R


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.txt", "two")
        z.writestr("a.txt", "one")
        z.writestr("../up.txt", "no")
        z.writestr("__MACOSX/x", "no")
    rows = A.zip_members(spark, str(tmp_path)).collect()
    assert [(r.member, r.skipped) for r in rows] == [("../up.txt", "escapes"), ("__MACOSX/x", "junk"), ("a.txt", None), ("b.txt", None)]
    assert A.zip_members(spark, str(tmp_path), limit=3).filter("skipped = 'too large'").count() == 1


def test_docx(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a </w:t></w:r><w:r><w:rPr><w:b/><w:u w:val="none"/></w:rPr><w:t>bold</w:t></w:r></w:p></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "x.docx").write_bytes(data.getvalue())
    rows = A.docx_paragraphs(spark, str(tmp_path)).collect()
    assert [(r.style, r.text, [(s.start, s.end, s.style) for s in r.runs]) for r in rows] == [("Heading1", "Top", []), (None, "a bold", [(2, 6, "bold")])]


def test_bad_lines_are_named(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    good, bad = R.checked_jsonl(spark, str(tmp_path), "a long")
    assert sorted(r.a for r in good.collect()) == [1, 2]
    assert [r._bad for r in bad.collect()] == ["not json"]
