"""PDF files written by the test: tables and streams of cross-references, object streams, filters, fonts, broken pages and files."""

import base64
import zlib

import pytest

from quillmill.sources import ingest, pdf


def stream(body, extra="", flate=True):
    raw = zlib.compress(body) if flate else body
    return f"<< /Length {len(raw)} {'/Filter /FlateDecode' if flate else ''} {extra} >>\nstream\n".encode() + raw + b"\nendstream"


def classic(objects, trailer="/Root 1 0 R", junk=b""):
    """A file with a cross-reference table; objects by number from 1."""
    out, places = b"%PDF-1.4\n" + junk, []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + (body if isinstance(body, bytes) else body.encode()) + b"\nendobj\n"
    table = f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n" + "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + table.encode() + f"trailer\n<< /Size {len(objects) + 1} {trailer} >>\nstartxref\n{len(out)}\n%%EOF".encode()


def simple(*pages, font="<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>", trailer="/Root 1 0 R"):
    n = len(pages)
    kids = " ".join(f"{4 + i} 0 R" for i in range(n))
    head = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {n} /Resources << /Font << /F1 3 0 R >> >> >>", font]
    return classic(head + [f"<< /Type /Page /Parent 2 0 R /Contents {4 + n + i} 0 R >>" for i in range(n)] + [p if isinstance(p, bytes) and b"stream" in p else stream(p) for p in pages], trailer)


def test_pages_strings_and_lines():
    first = rb"BT /F1 12 Tf 72 700 Td (Chapter 1) Tj 0 -14 Td (John \(the \351lder\) \101rrives) Tj T* [(in) -300 (19) 20 (99.)] TJ ET"
    second = rb"BT /F1 9 Tf 1 0 0 1 72 500 Tm <48656C6C6F> Tj 1 0 0 1 120 500 Tm (wor\
ld) Tj (next) ' ET % a comment (not shown)"
    got = pdf.pages(simple(first, second))
    assert [" ".join(p.split(" ")).strip() for p in got] == ["Chapter 1\nJohn (the élder) Arrives\nin 1999.", "Hello world\nnext"]


def test_unicode_maps_object_streams_and_predictors():
    cmap = b"/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0004> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<4E2D> <D83DDE00>] endbfrange endcmap"
    inner = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: "<< /Type /Page /Contents [6 0 R 7 0 R] /Resources << /Font << /F0 4 0 R >> >> >>", 4: "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 8 0 R >>"}
    body, heads = "", []
    for number, text in inner.items():
        heads.append(f"{number} {len(body)}")
        body += text + " "
    head = " ".join(heads) + " "
    parts = {5: stream((head + body).encode(), f"/Type /ObjStm /N {len(inner)} /First {len(head)}"), 6: stream(b"BT /F0 10 Tf <00100011"), 7: stream(b"00120003> Tj <000400200021> Tj ET", flate=False), 8: stream(cmap)}
    out, places = b"%PDF-1.5\n", {}
    for number, raw in parts.items():
        places[number] = len(out)
        out += f"{number} 0 obj\n".encode() + raw + b"\nendobj\n"
    rows = [bytes([0, 0, 0, 0])] + [bytes([2, 0, 5, list(inner).index(i)]) for i in inner] + [bytes([1]) + places[i].to_bytes(2, "big") + b"\0" for i in parts] + [bytes([1]) + len(out).to_bytes(2, "big") + b"\0"]
    up, coded = bytes(4), b""
    for row in rows:  # every row as differences to the one above
        coded += b"\2" + bytes((a - b) & 255 for a, b in zip(row, up))
        up = row
    table = stream(coded, f"/Type /XRef /Size {len(rows)} /W [1 2 1] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 4 >>")
    whole = out + b"9 0 obj\n" + table + b"\nendobj\nstartxref\n" + str(len(out)).encode() + b"\n%%EOF"
    assert pdf.pages(whole) == ["ABC fi中😀"]
    assert pdf.pages(whole[: whole.rindex(b"startxref")] + b"startxref\n7\n%%EOF") == ["ABC fi中😀"]  # found by search


def test_encodings_filters_and_forms():
    font = "<< /Type /Font /Encoding << /Differences [65 /eacute /quotedblleft 70 /uni4E2D /seven /A.alt] >> >>"
    coded = base64.a85encode(b"BT /F1 1 Tf (ABFGHz) Tj ET") + b"~>"
    page = f"<< /Length {len(coded)} /Filter /ASCII85Decode >>\nstream\n".encode() + coded + b"\nendstream"
    hexes = b"42 54 28 68 65 78 29 54 6A 20 45 54>"
    other = f"<< /Length {len(hexes)} /Filter [/ASCIIHexDecode] >>\nstream\n".encode() + hexes + b"\nendstream"
    assert pdf.pages(simple(page, other, font=font)) == ["é“中7Az", "hex"]
    form = classic(["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] >>", "<< /Type /Page /Contents 4 0 R /Resources << /XObject << /X 5 0 R >> >> >>", stream(b"q /X Do Q BI /W 1 ID \x00(( EI (after) Tj"), stream(b"(inside) Tj /X Do", "/Subtype /Form")])
    assert "inside" in pdf.pages(form)[0] and pdf.pages(form)[0].endswith("after")
    for name, want in (("zero", "0"), ("germandbls", "ß"), ("Adieresis", "Ä"), ("nosuch", ""), ("u1F600", "😀"), ("xring", "")):
        assert pdf.glyph(name) == want


def test_bad_pages_are_skipped_and_bad_files_refused():
    bad = b"<< /Length 4 /Filter /JBIG2Decode >>\nstream\nabcd\nendstream"
    assert pdf.pages(simple(b"(one) Tj", bad, b"(three) Tj")) == ["one", None, "three"]
    good = simple(b"(kept) Tj")
    assert pdf.pages(good.replace(b"xref\n0", b"xxxx\n0")) == ["kept"] and pdf.pages(good[:-60]) == ["kept"]
    with pytest.raises(ValueError, match="encrypted"):
        pdf.pages(simple(b"(secret) Tj", trailer="/Root 1 0 R /Encrypt << /V 1 >>"))
    for broken in (b"", b"%PDF", b"%PDF-1.4 startxref 0", good[:40]):
        with pytest.raises((ValueError, IndexError)):
            pdf.pages(broken)
    loop = classic(["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [2 0 R 3 0 R] >>", "<< /Type /Page /Contents 3 0 R >>"])
    assert len(pdf.pages(loop)) == 1


def test_pdf_files_are_rows(spark, tmp_path):
    many = [f"(Page {i} of the book, John arrives.) Tj".encode() for i in range(12)]
    (tmp_path / "book.PDF").write_bytes(simple(*many))
    (tmp_path / "part.pdf").write_bytes(simple(b"(one) Tj", b"<< /Length 1 /Filter /X >>\nstream\na\nendstream", b"(three) Tj"))
    (tmp_path / "scan.pdf").write_bytes(simple(b"q 1 0 0 1 0 0 cm Q"))
    (tmp_path / "cut.pdf").write_bytes(b"%PDF-1.7 and no more")
    got = {r.title: r for r in ingest.read_files(spark, str(tmp_path)).collect()}
    assert got["book"].text == "\n".join(f"Page {i} of the book, John arrives." for i in range(12)) and got["book"].error is None
    assert got["part"].text == "one\nthree" and got["part"].error is None
    assert (got["scan"].text, got["scan"].error) == ("", "no text") and got["cut"].error and got["cut"].text == ""
    pages = ingest.read_pages(spark, str(tmp_path)).where("title = 'part'").orderBy("page").collect()
    assert [(r.page, r.text) for r in pages] == [(1, "one"), (2, None), (3, "three")]


def test_books_take_their_metadata(spark, tmp_path):
    for book in ("red_sky", "blue_sea"):
        folder = tmp_path / f"{book}_chapters"
        folder.mkdir()
        for i in (1, 2, 10):
            (folder / f"chapter_{i:03d}.txt").write_text(f"{book} {i}\n\nsecond line {i}")
    (tmp_path / "red_sky.meta.json").write_text('{\n "title": "The Red Sky",\n "genre": "thriller",\n "total_words": 12,\n "other": [1]\n}')
    (tmp_path / "green.meta.json").write_text("{ broken")
    told = {r.book: r for r in ingest.read_metadata(spark, str(tmp_path)).collect()}
    assert told["red_sky"].total_words == 12 and told["green"].title is None
    got = {r.book: r for r in ingest.read_books(spark, str(tmp_path)).collect()}
    assert (got["red_sky"].title, got["red_sky"].genre, got["red_sky"].text) == ("The Red Sky", "thriller", "\n\n".join(f"red_sky {i}\n\nsecond line {i}" for i in (1, 2, 10)))
    assert (got["blue_sea"].title, got["blue_sea"].genre) == ("Blue sea", None)
    (tmp_path / "plain.txt").write_text("one\n\ntwo\n")
    assert [r.text for r in ingest.read_text(spark, str(tmp_path / "plain.txt")).collect()] == ["one\n\ntwo\n"]
