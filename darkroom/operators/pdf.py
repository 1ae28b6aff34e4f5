"""PDF work on bytes, inside tasks: crop boxes on and off, and recompressed streams.

For files whose objects stand in the open; a file that keeps its pages in object streams or is encrypted gives an
error row.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import inherited, reachable

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
NUMBER = rb"[-+]?\d*\.?\d+"
LETTER = (0.0, 0.0, 612.0, 792.0)  # fixed value: the page size if no parent has one
MOST_PARENTS = 32


class PdfError(ValueError):
    pass


def objects(data: bytes) -> dict[int, tuple[int, bytes]]:
    """Number -> (generation, body); the last of a number counts, as updates are appended."""
    if not data.startswith(b"%PDF-") or b"/Encrypt" in data:
        raise PdfError("not a PDF file that can be read here")
    found = {int(m[1]): (int(m[2]), m[3]) for m in OBJECT.finditer(data)}
    if not any(_is_page(body) for _, body in found.values()):
        raise PdfError("no pages in the open")
    return found


def _is_page(body: bytes) -> bool:
    return bool(re.search(rb"/Type\s*/Page(?![A-Za-z])", body))


def _box(body: bytes, name: bytes) -> tuple | None:
    m = re.search(rb"/" + name + rb"\s*\[\s*(" + rb"\s+".join([NUMBER] * 4) + rb")\s*\]", body)
    return tuple(map(float, m[1].split())) if m else None


def media_box(found: dict, number: int) -> tuple:
    """A page's own box, else its nearest parent's."""
    for _ in range(MOST_PARENTS):
        body = found[number][1]
        if box := _box(body, b"MediaBox"):
            return box
        parent = re.search(rb"/Parent\s+(\d+)\s+\d+\s+R", body)
        if not parent or int(parent[1]) not in found:
            break
        number = int(parent[1])
    return LETTER


def crop_box(media: tuple, w: float, h: float) -> tuple:
    """As ``functions.geometry.pdf_crop_box``."""
    x0, y0, x1, y1 = media
    bw, bh = x1 - x0, y1 - y0
    if min(bw, bh, w, h) <= 0:
        return media
    r = w / h
    if bw / bh > r:
        x0 += (bw - bh * r) / 2
        return x0, y0, x0 + bh * r, y1
    y0 += (bh - bw / r) / 2
    return x0, y0, x1, y0 + bw / r


def written(data: bytes, found: dict) -> bytes:
    """A file of the objects, with a table of their places."""
    root = re.findall(rb"/Root\s+(\d+\s+\d+\s+R)", data)
    if not root:
        raise PdfError("no catalogue")
    out, places = data[: data.find(b"\n") + 1] or b"%PDF-1.4\n", {}
    for number in sorted(found):
        generation, body = found[number]
        places[number] = len(out), generation
        out += b"%d %d obj" % (number, generation) + body + b"endobj\n"
    start, size = len(out), max(found) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for n in range(1, size):
        at, generation = places.get(n, (0, 65535))
        out += b"%010d %05d %s \n" % (at, generation, b"n" if n in places else b"f")
    return out + b"trailer\n<< /Size %d /Root %s >>\nstartxref\n%d\n%%%%EOF\n" % (size, root[-1], start)


def with_crop(data: bytes, ratio: tuple[float, float] | None) -> bytes:
    """Every page's crop box set to a ratio, or taken off."""
    found = objects(data)
    for number, (generation, body) in list(found.items()):
        if _is_page(body):
            body = re.sub(rb"/CropBox\s*\[[^\]]*\]\s*", b"", body)
            if ratio is not None:
                box = b" ".join(b"%g" % round(v, 4) for v in crop_box(media_box(found, number), *ratio))
                body = re.sub(rb"/Type\s*/Page(?![A-Za-z])", lambda m: m[0] + b" /CropBox [" + box + b"]", body, count=1)
            found[number] = generation, body
    return written(data, found)


def is_dct_image(head: bytes) -> bool:
    """Whether an object's dictionary is that of a picture with a DCT filter, alone or in a list."""
    if not re.search(rb"/Subtype\s*/Image(?![A-Za-z])", head):
        return False
    return bool(re.search(rb"/Filter\s*(/DCTDecode(?![A-Za-z])|\[[^\]]*/DCTDecode(?![A-Za-z])[^\]]*\])", head))


def _refs(body: bytes) -> list[int]:
    """The objects that an object names, outside its stream."""
    dictionary = body.split(b"stream", 1)[0] if b">>" in body else body
    return [int(n) for n in re.findall(rb"(?<!\d)(\d+)\s+\d+\s+R(?![A-Za-z])", dictionary)]


def pruned(data: bytes, found: dict) -> dict:
    """The objects that the catalogue leads to."""
    root = re.findall(rb"/Root\s+(\d+)\s+\d+\s+R", data)
    open_, kept = [int(root[-1])] if root else list(found), {}
    while open_:
        number = open_.pop()
        if number in found and number not in kept:
            kept[number] = found[number]
            open_ += _refs(found[number][1])
    return kept


def recompressed(data: bytes, jpeg=None) -> bytes:
    """Flate streams at the best level and bare ones compressed, where that is smaller, without objects that nothing leads to.

    ``jpeg``: a function from a JPEG's bytes to smaller ones for pictures with a DCT filter; without it these stay as they are.
    """
    found = pruned(data, objects(data))
    for number, (generation, body) in list(found.items()):
        m = re.search(rb"^(.*?>>)\s*stream\r?\n(.*?)\r?\n?endstream(.*)$", body, re.S)
        if not m or re.search(rb"/Length\s+\d+\s+\d+\s+R|/DecodeParms|/F\s", m[1]):
            continue
        head, raw = m[1], m[2]
        if is_dct_image(head):
            new = jpeg(raw) if jpeg is not None and re.search(rb"/Filter\s*(/DCTDecode|\[\s*/DCTDecode\s*\])", head) else raw
        elif re.search(rb"/Filter\s*/FlateDecode", head):
            try:
                new = zlib.compress(zlib.decompressobj().decompress(raw), 9)
            except zlib.error:
                continue
        elif b"/Filter" not in head:
            new, head = zlib.compress(raw, 9), head[:-2] + b" /Filter /FlateDecode >>"
        else:
            continue
        if len(new) + len(head) < len(raw) + len(m[1]):
            head = re.sub(rb"/Length\s+\d+", b"/Length %d" % len(new), head)
            found[number] = generation, head + b"\nstream\n" + new + b"\nendstream" + m[3]
    out = written(data, found)
    return out if len(out) < len(data) else data


def object_table(files: DataFrame) -> DataFrame:
    """(file, object, parent, box, is_page, is_root, refs) of each object of ``files`` (path, content); none of those that can't be read."""
    schema = "file string, object long, parent long, box array<double>, is_page boolean, is_root boolean, refs array<long>"

    def each(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = objects(content or b"")
                except PdfError:
                    continue
                root = re.findall(rb"/Root\s+(\d+)\s+\d+\s+R", content)
                rows = []
                for number, (_, body) in found.items():
                    above = re.search(rb"/Parent\s+(\d+)\s+\d+\s+R", body)
                    rows.append((path, number, int(above[1]) if above else None, _box(body, b"MediaBox"), _is_page(body), bool(root) and number == int(root[-1]), _refs(body)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.bool_(), pa.bool_(), pa.list_(pa.int64())))], [c.split()[0] for c in schema.split(", ")])

    return files.select("path", "content").mapInArrow(each, schema)


def page_boxes(table: DataFrame) -> DataFrame:
    """(file, object, box) of each page of an ``object_table``: its own box, else its nearest parent's, by rounds over the whole table."""
    boxes = inherited(table.select("file", "object", "parent", F.col("box").alias("value")))
    letter = F.array(*map(F.lit, LETTER))
    return boxes.join(table.where("is_page").select("file", "object"), ["file", "object"], "left_semi").select("file", "object", F.coalesce("value", letter).alias("box"))


def kept_objects(table: DataFrame) -> DataFrame:
    """(file, object): what the catalogues lead to, of all files at once."""
    edges = table.select("file", F.col("object").alias("from"), F.explode("refs").alias("to"))
    return reachable(edges, table.where("is_root")).join(table.select("file", "object"), ["file", "object"], "left_semi")


def edited(files: DataFrame, edit, *args) -> DataFrame:
    """(path, old_size, new_size, content, error) of ``files`` (path, content) after ``with_crop`` or ``recompressed``."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, error = None, None
                try:
                    data = edit(content or b"", *args)
                except (PdfError, ValueError, KeyError) as e:
                    error = f"{path}: {e}"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path], pa.string()), pa.array([None if content is None else len(content)], pa.int64()), pa.array([None if data is None else len(data)], pa.int64()), pa.array([data], pa.binary()), pa.array([error], pa.string())],
                    ["path", "old_size", "new_size", "content", "error"],
                )

    return files.select("path", "content").mapInArrow(run, "path string, old_size long, new_size long, content binary, error string")


def pages(files: DataFrame) -> DataFrame:
    """(path, page, box) of each page of ``files`` (path, content): one row in, one row a page out. A file that can't be
    read gives one row without a page."""

    def each(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = objects(content or b"")
                    boxes = [list(media_box(found, n)) for n in sorted(found) if _is_page(found[n][1])]
                except (PdfError, ValueError):
                    boxes = [None]
                numbers = [None if b is None else i for i, b in enumerate(boxes, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(boxes), pa.string()), pa.array(numbers, pa.int32()), pa.array(boxes, pa.list_(pa.float64()))], ["path", "page", "box"])

    return files.select("path", "content").mapInArrow(each, "path string, page int, box array<double>")
