import zlib

import pytest

from lectern.operators import pdf, providers


def made(contents, extra=b"", packed=False, fonts=b"<< /F1 4 0 R >>"):
    """A PDF of these pages."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(contents)))
    out = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [" + kids + b"] /Resources << /Font " + fonts + b" >> /Count 1 >> endobj\n"
    out += b"4 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> endobj\n" + extra
    for k, x in enumerate(contents):
        data = zlib.compress(x) if packed else x
        out += b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj\n" % (10 + 2 * k, 11 + 2 * k)
        out += b"%d 0 obj << /Length %d %s >> stream\n" % (11 + 2 * k, len(data), b"/Filter /FlateDecode" if packed else b"") + data + b"\nendstream endobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGE = rb"BT /F1 12 Tf 72 700 Td (One \(a\) \101\222s) Tj 0 -14 Td [(spl) -20 (it) -300 (words)] TJ T* <48 69> Tj 0 -30 Td (New para) Tj ET"
TEXT = "One (a) A’s\nsplit words\nHi\n\nNew para"


@pytest.mark.parametrize("packed", [False, True])
def test_text_of_pages(packed):
    assert pdf.PdfText().parse(made([PAGE, b"BT (two) Tj ET"], packed=packed)) == TEXT + "\ftwo"


def test_fonts_with_a_map():
    cmap = b"1 beginbfchar <0001> <4F60> endbfchar 2 beginbfrange <0002> <0003> <597D> <0004> <0005> [<0041> <00420043>] endbfrange"
    extra = b"5 0 obj << /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >> endobj\n6 0 obj << /Length 8 0 R >> stream\n" + cmap + b"\nendstream endobj\n8 0 obj %d endobj\n" % len(cmap)
    assert pdf.PdfText().parse(made([b"BT /F2 9 Tf <00010002000400050009> Tj ET"], extra, fonts=b"<< /F1 4 0 R /F2 5 0 R >>")) == "你好ABC�"


def test_objects_in_streams():
    inner = b"1 0 2 37 << /Type /Catalog /Pages 2 0 R >>     << /Type /Pages /Kids [3 0 R] >>"
    first = inner.index(b"<<")
    data = zlib.compress(inner)
    out = b"%PDF-1.5\n7 0 obj << /Type /ObjStm /N 2 /First " + b"%d" % first + b" /Filter /FlateDecode /Length " + b"%d" % len(data) + b" >> stream\r\n" + data + b"\r\nendstream endobj\n"
    out += b"3 0 obj << /Type /Page /Contents [9 0 R] >> endobj\n9 0 obj << /Length 99999 >> stream\nBT (deep) Tj ET\nendstream endobj\n"
    assert pdf.PdfText().parse(out) == "deep"


@pytest.mark.parametrize("content", [b"", b"plain text", b"%PDF-1.4 nothing", made([PAGE]).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"), made([PAGE]).replace(b"/Length 126 ", b"/Filter /LZWDecode /Length 126 ")])
def test_what_cannot_be_read_is_an_error(content):
    if b"LZW" in content or b"/Page" not in content or b"Encrypt" in content:
        with pytest.raises(pdf.Unreadable):
            pdf.PdfText().parse(content)


def test_files_are_parsed(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made([PAGE]))
    (tmp_path / "b.pdf").write_bytes(b"no")
    from lectern.sources import files

    rows = providers.parse_pdfs(files.read_pdfs(spark, str(tmp_path)).select("path", "content"), pdf.PdfText()).collect()
    assert {(x.text, x.error) for x in rows} == {(TEXT, None), (None, "Unreadable: no PDF header")}
