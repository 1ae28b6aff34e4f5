import re

from darkroom.operators import pdf


def minimal(own_box=True, stream=b"q 1 0 0 1 0 0 cm Q " * 40):
    box = b"/MediaBox [0 0 612 792]"
    found = {
        1: (0, b"\n<< /Type /Catalog /Pages 2 0 R >>\n"),
        2: (0, b"\n<< /Type /Pages /Kids [3 0 R] /Count 1 " + (b"" if own_box else b"/MediaBox [0 0 200 100]") + b" >>\n"),
        3: (0, b"\n<< /Type /Page /Parent 2 0 R " + (box if own_box else b"") + b" /Contents 4 0 R >>\n"),
        4: (0, b"\n<< /Length %d >>\nstream\n" % len(stream) + stream + b"\nendstream\n"),
    }
    return pdf.written(b"%PDF-1.4\n/Root 1 0 R", found)


def test_crop_on_and_off(spark):
    files = spark.createDataFrame([("a.pdf", minimal()), ("b.pdf", minimal(False)), ("c.pdf", b"x"), ("d.pdf", None)], "path string, content binary")
    got = {r["path"]: r for r in pdf.edited(files, pdf.with_crop, (16.0, 9.0)).collect()}
    assert b"/CropBox [0 223.875 612 568.125]" in bytes(got["a.pdf"]["content"])
    assert b"/CropBox [11.1111 0 188.889 100]" in bytes(got["b.pdf"]["content"])
    assert got["c.pdf"]["error"] and got["d.pdf"]["error"]
    off = pdf.with_crop(bytes(got["a.pdf"]["content"]), None)
    assert b"CropBox" not in off and pdf.media_box(pdf.objects(off), 3) == (0, 0, 612, 792)


def test_places_in_the_table_are_right():
    data = pdf.with_crop(minimal(), (1.0, 1.0))
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    rows = data[start:].split(b"\n")[3:7]
    for n, row in enumerate(rows, 1):
        assert data[int(row[:10]) :].startswith(b"%d 0 obj" % n)


def test_pages(spark):
    files = spark.createDataFrame([("a.pdf", minimal(False)), ("b.pdf", b"x")], "path string, content binary")
    got = {r["path"]: (r["page"], r["box"]) for r in pdf.pages(files).collect()}
    assert got == {"a.pdf": (1, [0.0, 0.0, 200.0, 100.0]), "b.pdf": (None, None)}


def test_recompress():
    data = minimal()
    small = pdf.recompressed(data)
    assert len(small) < len(data) and b"/FlateDecode" in small
    assert pdf.recompressed(small) == small or len(pdf.recompressed(small)) <= len(small)
    assert pdf.crop_box((0, 0, 0, 5), 1, 1) == (0, 0, 0, 5)
