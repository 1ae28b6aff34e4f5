"""PNG work that needs no external encoder, inside tasks: decode, encode, scale, crop, quantise, drop metadata.

``run_steps`` folds a parsed pipeline over a column of bytes; every other format gives an error row that says so.
"""

from __future__ import annotations

import heapq
import itertools
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.dims import BUDGET_FACTORS
from ..plans.dsl import Step

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


class Unsupported(ValueError):
    pass


def chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise Unsupported("not a PNG file")
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _lines(raw: np.ndarray, w: int, n: int) -> np.ndarray:
    """Lines as they were before each was told by its own kind of difference."""
    out = np.zeros((len(raw), w * n), np.uint8)
    above = np.zeros(w * n, np.uint8)
    for y in range(len(raw)):
        line = raw[y, 1:].copy()
        kind = raw[y, 0]
        if kind == 2:
            line += above
        elif kind == 1:
            line = np.add.accumulate(line.reshape(w, n), axis=0, dtype=np.uint8).reshape(-1)
        elif kind in (3, 4):
            line = np.array(_unfiltered(line.tolist(), above.tolist(), n, kind == 3), np.uint8)
        out[y] = above = line
    return out


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels) of an 8-bit PNG that isn't interlaced."""
    parts: dict[bytes, bytes] = {}
    for kind, body in chunks(data):
        parts[kind] = parts.get(kind, b"") + body
    w, h, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if depth != 8 or interlaced or (color != 3 and color not in CHANNELS):
        raise Unsupported("this kind of PNG needs an external decoder")
    n = 1 if color == 3 else CHANNELS[color]
    raw = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, w * n + 1)
    kinds = raw[:, 0]
    if not kinds.any():
        out = raw[:, 1:].copy()
    elif (kinds == 2).all():
        out = np.add.accumulate(raw[:, 1:], axis=0, dtype=np.uint8)
    else:
        out = _lines(raw, w, n)
    image = out.reshape(h, w, n)
    if color == 3:
        table = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
        alpha = np.full(len(table), 255, np.uint8)
        alpha[: len(parts.get(b"tRNS", b""))] = np.frombuffer(parts.get(b"tRNS", b""), np.uint8)
        full = np.column_stack([table, alpha])[image[:, :, 0]]
        return full if b"tRNS" in parts else full[:, :, :3]
    return image


def _unfiltered(line: list[int], up: list[int], n: int, mean: bool) -> list[int]:
    """A line whose bytes were told by the mean of the bytes before and above, or by the nearest of three."""
    a = c = [0] * n
    for x in range(0, len(line), n):
        here = []
        for k in range(n):
            left, b, corner = a[k], up[x + k], c[k]
            if mean:
                near = (left + b) >> 1
            else:
                p, q = b - corner, left - corner
                p, q, r = abs(p), abs(q), abs(p + q)
                near = left if p <= q and p <= r else b if q <= r else corner
            here.append((line[x + k] + near) & 255)
        a, c = here, up[x : x + n]
        line[x : x + n] = here
    return line


def _deflated(rows: np.ndarray) -> bytes:
    """The smallest of the unfiltered rows and their differences to the row above."""
    plain = np.hstack([np.zeros((len(rows), 1), np.uint8), rows])
    up = np.hstack([np.full((len(rows), 1), 2, np.uint8), rows - np.vstack([np.zeros((1, rows.shape[1]), np.uint8), rows[:-1]])])
    return min((zlib.compress(x.tobytes(), 9) for x in (plain, up)), key=len)


def encode(image: np.ndarray) -> bytes:
    h, w, n = image.shape
    color = {v: k for k, v in CHANNELS.items()}[n]
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + _chunk(b"IDAT", _deflated(image.reshape(h, w * n))) + _chunk(b"IEND", b"")


SMALL_BOX = 64  # colours: boxes of fewer are cut faster as lists than as arrays, and most are


def _distinct(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(colours in rising order, each pixel's place among them, pixels of each): a pixel's channels are sorted as one number."""
    n = image.shape[2]
    code = np.zeros(image.shape[0] * image.shape[1], np.uint32)
    for k in range(n):
        code = code << np.uint32(8) | image[:, :, k].reshape(-1)
    codes, place, count = np.unique(code, return_inverse=True, return_counts=True)
    return np.stack([codes >> np.uint32(8 * (n - 1 - k)) & np.uint32(255) for k in range(n)], 1).astype(np.uint8), place.reshape(-1), count


def median_cut(colours: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` colours: the box of colours with the most spread is cut at its median until there are so many."""
    boxes, at = [], itertools.count()

    def add(own: np.ndarray | list):
        if len(own) < SMALL_BOX:
            own = own if isinstance(own, list) else [(i, c, w) for i, c, w in zip(own.tolist(), colours[own].tolist(), count[own].tolist())]
            spans = [max(c) - min(c) for c in zip(*(c for _, c, _ in own))]
            span, total = max(spans), sum(w for *_, w in own)
            axis = spans.index(span)
        else:
            spans = np.ptp(colours[own].astype(int), axis=0)
            span, total, axis = int(spans.max()), int(count[own].sum()), int(spans.argmax())
        heapq.heappush(boxes, (-float(span) * math.sqrt(total), next(at), axis, own, total))

    add(np.arange(len(colours)))
    while len(boxes) < most and boxes[0][0] < 0:
        _, _, axis, own, total = heapq.heappop(boxes)
        if isinstance(own, list):
            own = sorted(own, key=lambda x: x[1][axis])
            middle = 1 + next(i for i, below in enumerate(itertools.accumulate(w for *_, w in own)) if below >= total / 2)
        else:
            own = own[np.argsort(colours[own, axis], kind="stable")]
            middle = int(np.searchsorted(np.cumsum(count[own]), total / 2)) + 1
        middle = min(max(middle, 1), len(own) - 1)
        add(own[:middle])
        add(own[middle:])
    members = [np.array([i for i, *_ in own]) if isinstance(own, list) else own for *_, own, _ in boxes]
    order, starts = np.concatenate(members), np.cumsum([0, *map(len, members[:-1])])
    sums = np.add.reduceat(colours[order].astype(np.int64) * count[order, None], starts, axis=0)
    return (sums / np.array([total for *_, total in boxes])[:, None]).round().astype(np.uint8)


def _nearest(flat: np.ndarray, palette: np.ndarray) -> np.ndarray:
    p = palette.astype(np.float32)
    return np.concatenate([(-2 * (flat[lo : lo + 16384].astype(np.float32) @ p.T) + (p * p).sum(1)).argmin(1) for lo in range(0, len(flat), 16384)])


#: An ordered dither's thresholds, each of 0 .. 63 once, from the rule that doubles a smaller one.
def _thresholds(size: int = 8) -> np.ndarray:
    out = np.zeros((1, 1))
    while len(out) < size:
        out = np.block([[4 * out, 4 * out + 2], [4 * out + 3, 4 * out + 1]])
    return (out + 0.5) / size**2 - 0.5


def encode_palette(image: np.ndarray, most: int = 256) -> bytes:
    """With at most ``most`` colours. A picture of no more keeps its own; for others colours are found by median cut, and
    pixels take the nearest after an ordered dither of about the distance between colours."""
    h, w, n = image.shape
    colours, place, count = _distinct(image)
    means = colours
    if len(colours) > most:
        means = median_cut(colours, count, most)
        step = 255 / len(means) ** (1 / max(1, n - n % 2 if n == 2 else min(n, 3))) / 2
        noise = np.tile(_thresholds(), (-(-h // 8), -(-w // 8)))[:h, :w, None] * step
        told = image + noise if n in (1, 3) else image + np.concatenate([np.repeat(noise, n - 1, 2), np.zeros((h, w, 1))], 2)
        place = _nearest(np.clip(told, 0, 255).reshape(-1, n), means)
    rgb = means[:, :3] if n >= 3 else np.repeat(means[:, :1], 3, 1)
    alpha = _chunk(b"tRNS", means[:, -1].tobytes()) if n in (2, 4) else b""
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 3, 0, 0, 0)) + _chunk(b"PLTE", rgb.tobytes()) + alpha + _chunk(b"IDAT", _deflated(place.astype(np.uint8).reshape(h, w))) + _chunk(b"IEND", b"")


def stripped(data: bytes) -> bytes:
    """Without chunks that carry no picture."""
    keep = {b"IHDR", b"PLTE", b"tRNS", b"IDAT", b"IEND"}
    return SIGNATURE + b"".join(_chunk(k, body) for k, body in chunks(data) if k in keep)


def _weights(old: int, new: int) -> np.ndarray:
    """Lanczos weights (new x old) with three lobes, wider when scaling down."""
    scale = max(1.0, old / new)
    x = (np.arange(new)[:, None] + 0.5) * old / new - 0.5 - np.arange(old)[None, :]
    x = x / scale
    k = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    return k / k.sum(1, keepdims=True)


def resized(image: np.ndarray, w: int, h: int) -> np.ndarray:
    rows = np.tensordot(_weights(image.shape[0], h), image.astype(float), 1)
    return np.clip(np.einsum("wo,hoc->hwc", _weights(image.shape[1], w), rows).round(), 0, 255).astype(np.uint8)


def _even(n: int) -> int:
    return n if n % 2 == 0 else max(n - 1, 2)


def cropped(image: np.ndarray, args: dict) -> np.ndarray:
    """As ``functions.geometry.crop_plan`` plans it."""
    h, w = image.shape[:2]

    def at(x: float) -> int:
        return int(np.floor(x + 0.5))

    if "longEdge" in args:
        n = args["longEdge"]
        return resized(image, n, _even(at(n * h / w))) if w >= h else resized(image, _even(at(n * w / h)), n)
    if "ratio" in args:
        a, b = map(int, args["ratio"].split(":"))
        cw, ch = (at(h * a / b), h) if w / h > a / b else (w, at(w / (a / b)))
        cw, ch = max(min(cw, w), 2), max(min(ch, h), 2)
        x, y = (w - cw) // 2, (h - ch) // 2
        return image[y : y + ch, x : x + cw]
    cw, ch = args.get("width"), args.get("height")
    if cw and ch:
        scale = max(cw / w, ch / h)
        big = resized(image, max(int(np.ceil(w * scale)), cw), max(int(np.ceil(h * scale)), ch))
        x, y = (big.shape[1] - cw) // 2, (big.shape[0] - ch) // 2
        return big[y : y + ch, x : x + cw]
    return resized(image, cw, _even(at(cw * h / w))) if cw else resized(image, _even(at(ch * w / h)), ch)


def decode_bmp(data: bytes) -> np.ndarray:
    """(height, width, 3 or 4) of an uncompressed BMP of 24 or 32 bits."""
    if data[:2] != b"BM" or len(data) < 54:
        raise Unsupported("not a BMP file")
    at, _, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if bits not in (24, 32) or packed != 0 or w <= 0 or h == 0:
        raise Unsupported("this kind of BMP needs an external decoder")
    n, line = bits // 8, -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * line, at).reshape(abs(h), line)[:, : w * n].reshape(abs(h), w, n)
    rows = rows[::-1] if h > 0 else rows
    return np.concatenate([rows[:, :, 2::-1], rows[:, :, 3:]], 2)


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits, or 32 with an alpha channel; rows from the bottom up."""
    h, w, n = image.shape
    image = image if n >= 3 else np.concatenate([np.repeat(image[:, :, :1], 3, 2), image[:, :, 1:]], 2)
    n = image.shape[2]
    line = -(-w * n // 4) * 4
    rows = np.zeros((h, line), np.uint8)
    rows[:, : w * n] = np.concatenate([image[::-1, :, 2::-1], image[::-1, :, 3:]], 2).reshape(h, w * n)
    return b"BM" + struct.pack("<IHHI", 54 + h * line, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 * n, 0, h * line, 2835, 2835, 0, 0) + rows.tobytes()


def pixels(data: bytes) -> np.ndarray:
    """Of a PNG or a BMP."""
    return decode_bmp(data) if data[:2] == b"BM" else decode(data)


def rectangle(image: np.ndarray, x: float, y: float, w: float, h: float) -> np.ndarray:
    """The part that ``functions.geometry.rect_pixels`` plans, of a rectangle in parts of the picture."""
    high, wide = image.shape[:2]
    x, y = min(max(x, 0.0), 1.0), min(max(y, 0.0), 1.0)
    if x > 0.99 or y > 0.99:
        raise Unsupported("the rectangle starts at the far edge")
    w, h = max(min(w, 1 - x), 0.01), max(min(h, 1 - y), 0.01)
    left, top = int(np.floor(x * wide + 0.5)), int(np.floor(y * high + 0.5))
    w, h = min(max(int(np.floor(w * wide + 0.5)), 1), wide - left), min(max(int(np.floor(h * high + 0.5)), 1), high - top)
    return image[top : top + h, left : left + w]


def palette_size(factor: int) -> int:
    """How many colours a factor leaves: all 256 up to 30, fewer beyond."""
    return max(2, min(256, round(256 * (100 - (factor - 30) * 75 / 70) / 100)))


def optimised(data: bytes, factor: int = 30) -> bytes:
    """The smallest of a plain, a stripped and a palette encoding; a BMP is written anew."""
    if data[:2] == b"BM":
        return encode_bmp(decode_bmp(data))
    image = decode(data)
    return min((encode(image), stripped(data), encode_palette(image, palette_size(factor))), key=len)


def adapted(data: bytes, factor: int = 30, encoders: dict | None = None) -> tuple[str, bytes]:
    """(format, bytes): the smallest of the same format, jpeg (never with an alpha channel) and png, or the source.

    ``encoders``: functions of (pixels, factor) by format; jpeg has none here. A try that fails or is empty is skipped, the
    first of equals wins, and a winner that isn't smaller leaves the source.
    """
    own = "bmp" if data[:2] == b"BM" else "png"
    image = pixels(data)
    tries = {"same": lambda: optimised(data, factor), "jpeg": lambda: (encoders or {})["jpeg"](image, factor), "png": lambda: optimised(encode(image), factor)}
    best = None
    for name, make in tries.items():
        if name == "jpeg" and image.shape[2] in (2, 4):
            continue
        try:
            made = make()
        except (ValueError, KeyError):
            continue
        if made and (best is None or len(made) < len(best[1])):
            best = own if name == "same" else name, made
    return best if best is not None and len(best[1]) < len(data) else (own, data)


def within(data: bytes, budget: int) -> bytes:
    """The first factor's encoding that fits the budget, else the smallest; each try costs an encode, so it stops there."""
    best = None
    for factor in BUDGET_FACTORS:
        tried = optimised(data, factor)
        best = tried if best is None or len(tried) < len(best) else best
        if len(tried) <= budget:
            break
    return best


def watermarked(data: bytes, overlay: bytes, position: str, opacity: float, scale: float) -> bytes:
    """A PNG blended over another, its width a part of the picture's, ten pixels from the edges or in the middle."""
    base, mark = decode(data), decode(overlay)
    w = max(1, int(base.shape[1] * max(0.01, min(1.0, scale)) + 0.5))
    mark = resized(mark, w, max(1, int(mark.shape[0] * w / mark.shape[1] + 0.5)))
    mark = mark if mark.shape[2] >= 3 else np.concatenate([np.repeat(mark[:, :, :1], 3, 2), mark[:, :, 1:]], 2)
    base = base if base.shape[2] >= 3 else np.concatenate([np.repeat(base[:, :, :1], 3, 2), base[:, :, 1:]], 2)
    where = position.lower().replace("-", "").replace("_", "")
    free_x, free_y = base.shape[1] - mark.shape[1], base.shape[0] - mark.shape[0]
    x = free_x // 2 if where in ("center", "centre") else 10 if where.endswith("left") else free_x - 10
    y = free_y // 2 if where in ("center", "centre") else 10 if where.startswith("top") else free_y - 10
    x, y = max(0, x), max(0, y)
    mark = mark[: base.shape[0] - y, : base.shape[1] - x]
    alpha = (mark[:, :, 3:4] / 255 if mark.shape[2] == 4 else 1.0) * max(0.0, min(1.0, opacity))
    out = base.astype(float)
    part = out[y : y + mark.shape[0], x : x + mark.shape[1], :3]
    part[:] = part * (1 - alpha) + mark[:, :, :3] * alpha
    return encode(out.round().astype(np.uint8))


def apply_step(data: bytes, step: Step, overlays: dict[str, bytes], scripts: dict) -> bytes:
    """``overlays``: pictures by the name that a watermark step gives. ``scripts``: functions of bytes by the code or path
    of a runScript step, which leaves the file as it is; no shell is ever started."""
    if step.op == "optimise":
        return optimised(data)
    if step.op == "adaptive":
        return adapted(data)[1]
    if step.op == "targetSize":
        return within(data, step.args["bytes"])
    if step.op == "downscale":
        image, f = pixels(data), max(0.05, min(1.0, step.args["factor"]))
        return encode(resized(image, max(1, int(image.shape[1] * f + 0.5)), max(1, int(image.shape[0] * f + 0.5))))
    if step.op == "crop":
        return encode(cropped(pixels(data), step.args))
    if step.op == "stripExif":
        return stripped(data)
    if step.op == "convert" and step.args["to"].lower() == "png":
        return encode(pixels(data))
    if step.op == "copyToClipboard":
        return data
    if step.op == "watermark" and step.args["image"] in overlays:
        return watermarked(data, overlays[step.args["image"]], step.args["position"], step.args["opacity"], step.args["scale"])
    if step.op == "runScript":
        name = step.args.get("path", step.args.get("code"))
        if name not in scripts:
            raise Unsupported(f"no function stands for the script {name!r}")
        scripts[name](data)
        return data
    raise Unsupported(f"{step.op} needs an external encoder")


def run_steps(files: DataFrame, steps: list[Step], overlays: dict[str, bytes] | None = None, scripts: dict | None = None) -> DataFrame:
    """(path, old_size, new_size, content, error) of ``files`` (path, content) after all steps; the first error ends a file's run."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, error = content, None
                try:
                    for step in steps:
                        data = apply_step(data, step, overlays or {}, scripts or {})
                except (ValueError, KeyError, zlib.error, struct.error, TypeError) as e:
                    data, error = None, f"{path}: {e}"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path], pa.string()), pa.array([None if content is None else len(content)], pa.int64()), pa.array([None if data is None else len(data)], pa.int64()), pa.array([data], pa.binary()), pa.array([error], pa.string())],
                    ["path", "old_size", "new_size", "content", "error"],
                )

    return files.select("path", "content").mapInArrow(run, "path string, old_size long, new_size long, content binary, error string")
