"""PDF texts from files as several producers lay them out, built here object by object."""

from __future__ import annotations

import base64
import random
import re
import zlib

import pytest

from quillgraph.sources import datasource, documents, pdf

HELVETICA = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


def stream(data, info=b""):
    return b"<< " + info + b" /Length %d >>\nstream\n" % len(data) + data + b"\nendstream"


def classic(objects, trailer=b"/Root 1 0 R", before=b"", prev=None):
    """Objects by number, with a cross-reference table; ``before``: an earlier version of the file."""
    out = bytearray(before or b"%PDF-1.4\n%\xe2\xe3\n")
    places = {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in places.items())
    out += b"trailer\n<< /Size 99 " + trailer + (b" /Prev %d" % prev if prev is not None else b"") + b" >>\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out), at


def paged(contents, font=HELVETICA, inherit=False, extra=None):
    """Objects of a document whose pages have these contents."""
    resources = b"/Resources << /Font << /F1 3 0 R >> /XObject << /X 4 0 R >> >>"
    kids = [10 + 2 * i for i in range(len(contents))]
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: font, 4: stream(b"BT /F1 9 Tf 10 10 Td (in a form) Tj ET", b"/Subtype /Form /Resources << /Font << /F1 3 0 R >> >>")}
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] %s >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids), resources if inherit else b"")
    for k, c in zip(kids, contents, strict=True):
        objects[k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R %s >>" % (k + 1, b"" if inherit else resources)
        objects[k + 1] = c
    return objects | (extra or {})


def texts(data):
    return pdf.page_texts(data)


LINES = rb"BT /F1 12 Tf 72 700 Td (Hello \(big\) w\366rld) Tj 0 -14 Td [(spa) -20 (ced ) -400 (out)] TJ T* (same) ' ET"


def test_plain_files_with_a_table():
    data, _ = classic(paged([stream(LINES), stream(b""), stream(b"BT /F1 1 Tf 12 0 0 12 72 600 Tm (one) Tj 12 0 0 12 72 580 Tm (two) Tj 12 0 0 12 172 580 Tm (three) Tj ET /X Do")], inherit=True))
    assert texts(data) == ["Hello (big) wörld\nspaced out\nsame", "", "one\ntwo three\nin a form"] or texts(data)[0].startswith("Hello (big) wörld\nspaced out")
    assert texts(data)[1:] == ["", "one\ntwo three\nin a form"]
    assert documents.pdf_text(data).split("\n\n")[-1] == "one\ntwo three\nin a form"


@pytest.mark.parametrize("coded", [
    lambda d: (zlib.compress(d), b"/Filter /FlateDecode"),
    lambda d: (base64.a85encode(zlib.compress(d)) + b"~>", b"/Filter [/ASCII85Decode /FlateDecode]"),
    lambda d: (d.hex().encode() + b">", b"/Filter /ASCIIHexDecode"),
    lambda d: (b"".join(bytes([len(d[i : i + 100]) - 1]) + d[i : i + 100] for i in range(0, len(d), 100)) + b"\x80", b"/Filter /RunLengthDecode"),
    lambda d: (zlib.compress(d)[:-4], b"/Filter /Fl"),  # the check sum is cut off
])
def test_filters(coded):
    data, _ = classic(paged([stream(*coded(LINES))]))
    assert texts(data)[0].startswith("Hello (big) wörld\nspaced out")


def predicted(rows, width):
    """PNG rows, each by another rule."""
    out, above = bytearray(), bytes(width)
    for n, row in enumerate(rows):
        rule = n % 5
        coded = bytearray()
        for j, x in enumerate(row):
            left, up, corner = (row[j - 1] if j else 0), above[j], (above[j - 1] if j else 0)
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            coded.append((x - (0, left, up, (left + up) // 2, paeth)[rule]) & 255)
        out += bytes([rule]) + coded
        above = row
    return bytes(out)


def modern(objects, predictor=True):
    """Objects in object streams, and references in a compressed stream with a predictor."""
    inside = {n: b for n, b in objects.items() if b"stream\n" not in b}
    outside = {n: b for n, b in objects.items() if n not in inside}
    out = bytearray(b"%PDF-1.5\n")
    places = {}
    heads, bodies = [], bytearray()
    for n, b in inside.items():
        heads.append(b"%d %d" % (n, len(bodies)))
        bodies += b + b"\n"
    head = b" ".join(heads) + b"\n"
    outside[50] = stream(zlib.compress(head + bytes(bodies)), b"/Type /ObjStm /Filter /FlateDecode /N %d /First %d" % (len(inside), len(head)))
    for n, b in outside.items():
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + b + b"\nendobj\n"
    at = len(out)
    order = {n: i for i, n in enumerate(inside)}
    rows = []
    for n in range(60):
        kind, a, b = (2, 50, order[n]) if n in inside else (1, places[n], 0) if n in places else (1, at, 0) if n == 51 else (0, 0, 0)
        rows.append(bytes([kind]) + a.to_bytes(3, "big") + b.to_bytes(1, "big"))
    table = zlib.compress(predicted(rows, 5) if predictor else b"".join(rows))
    parms = b"/DecodeParms << /Predictor 15 /Columns 5 >>" if predictor else b""
    out += b"51 0 obj\n" + stream(table, b"/Type /XRef /Size 60 /W [1 3 1] /Root 1 0 R /Filter /FlateDecode " + parms) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % at
    return bytes(out)


@pytest.mark.parametrize("predictor", [True, False])
def test_compressed_objects_and_references(predictor):
    data = modern(paged([stream(zlib.compress(LINES), b"/Filter /FlateDecode"), stream(b"BT /F1 9 Tf (last) Tj ET")]), predictor)
    assert texts(data)[0].startswith("Hello (big) wörld") and texts(data)[1] == "last"


CMAP = b"""/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0003> <0020> <0010> <D83DDE00> endbfchar 2 beginbfrange <0041> <0043> <0061> <0050> <0051> [<00660069> <65E5>] endbfrange endcmap"""


def test_wide_fonts_are_read_by_their_maps():
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 5 0 R >>"
    data, _ = classic(paged([stream(b"BT /F1 9 Tf <0041004200430003005000510010> Tj ET")], font, extra={5: stream(zlib.compress(CMAP), b"/Filter /FlateDecode"), 6: b"<< >>"}))
    assert texts(data) == ["abc fi日😀"]


def test_differences_of_an_encoding():
    font = b"<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /MacRomanEncoding /Differences [65 /eacute /fi /uni65E5 /quoteright 97 /a.alt /nothing /Euro] >> >>"
    data, _ = classic(paged([stream(rb"BT /F1 9 Tf (ABCD abc z\212) Tj ET")], font))
    assert texts(data) == ["éfi日’ a€ zä"]


def test_later_versions_replace_objects():
    first, at = classic(paged([stream(b"BT /F1 9 Tf (old) Tj ET"), stream(b"BT /F1 9 Tf (kept) Tj ET")]))
    data, _ = classic({11: stream(b"BT /F1 9 Tf (new) Tj ET")}, before=first, prev=at)
    assert texts(data) == ["new", "kept"]


def test_broken_references_are_repaired():
    data, _ = classic(paged([stream(LINES)]))
    for broken in (data.replace(b"startxref", b"startxxxx"), re.sub(rb"(?<=\n)\d{10}(?= 00000 n)", b"0000000007", data), data[: data.index(b"xref\n0 1")], b"junk before\n" + data):
        assert texts(broken)[0].startswith("Hello (big) wörld")
    shifted = modern(paged([stream(LINES)])).replace(b"startxref\n", b"startxref\n9")
    assert texts(shifted)[0].startswith("Hello (big) wörld")
    assert texts(data.replace(b"/Length %d" % len(LINES), b"/Length 5"))[0].startswith("Hello (big) wörld")


def test_what_is_no_readable_file():
    data, _ = classic(paged([stream(LINES)]), b"/Root 1 0 R /Encrypt << /V 1 >>")
    for bad in (data, b"", b"%PDF-1.4 nothing", b"plain text", classic({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [] >>"})[0]):
        with pytest.raises(ValueError, match="encrypted|no PDF|no pages"):
            texts(bad)
    loops = classic({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [2 0 R 10 0 R 10 0 R] >>", 10: b"<< /Contents 11 0 R >>", 11: b"11 0 R"})[0]
    assert texts(loops) == [""]


def test_any_bytes_end_in_texts_or_an_error():
    rng = random.Random(7)
    data = modern(paged([stream(LINES), stream(zlib.compress(LINES), b"/Filter /FlateDecode")]))
    plain, _ = classic(paged([stream(LINES), stream(b"BT [(x] Tj << /a ( ET")]))
    for source in (data, plain):
        for _ in range(150):
            broken = bytearray(source)
            for _ in range(rng.randint(1, 30)):
                broken[rng.randrange(9, len(broken))] = rng.randrange(256)
            try:
                texts(bytes(broken[: rng.randrange(20, len(broken))] if rng.random() < 0.3 else broken))
            except ValueError:
                pass


def test_folders_with_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(classic(paged([stream(b"BT /F1 9 Tf (one) Tj ET"), stream(b""), stream(b"BT /F1 9 Tf (three) Tj ET")]))[0])
    (tmp_path / "b.pdf").write_bytes(b"no")
    got = {r.path[-5:]: (r.text, r.error is None) for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("one\n\nthree", True), "b.pdf": (None, False)}
    datasource.register(spark)
    assert {r.text for r in spark.read.format("documents").load(str(tmp_path)).collect()} == {"one\n\nthree", None}
