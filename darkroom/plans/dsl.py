"""The step language: ``crop(width: 1600) -> convert(to: webp)``. Parsed once on the driver, then used as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dial, dims
from ..functions.paths import kind_of_extension


class DslError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    op: str
    args: dict = field(default_factory=dict)


def _number(kind, text: str, what: str):
    plain = {int: r"[+-]?\d+", float: r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)"}[kind]
    if not re.fullmatch(plain, text, re.I) or kind is int and not -(2**31) <= int(text) < 2**31:
        raise DslError(what)
    return kind(text)


def _unsigned(text: str, what: str) -> int:
    if not re.fullmatch(r"\+?\d+", text) or int(text) > 2**32 - 1:
        raise DslError(what)
    return int(text)


def read_factor(text: str) -> float:
    if text.endswith("%"):
        return _number(float, text[:-1].strip(), f"bad percent '{text}'") / 100
    return _number(float, text, f"bad factor '{text}'")


def read_ratio(text: str) -> str:
    a, colon, b = text.partition(":")
    if not colon:
        raise DslError(f"bad ratio '{text}'")
    return f"{_unsigned(a.strip(), 'bad ratio')}:{_unsigned(b.strip(), 'bad ratio')}"


def read_size(text: str) -> int:
    found = re.fullmatch(r"(.*?)\s*(mb|kb|b)?", text.strip().lower(), re.S)
    value = _number(float, found[1], f"bad size '{text}'")
    return max(0, int(value * {"mb": 1e6, "kb": 1e3}.get(found[2], 1.0)))


def shown(value) -> str:
    """A number as the language prints it: no trailing zeros."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


# The steps, each with its names, then its arguments as (names, reader, default); REQUIRED has no default, OPTIONAL may be left out.
REQUIRED, OPTIONAL = object(), None
_text = str
STEPS = {
    "optimise": (("optimise", "optimize"), ()),
    "downscale": (("downscale",), ((("factor",), read_factor, REQUIRED),)),
    "crop": (
        ("crop",),
        (
            (("width",), lambda t: _unsigned(t, "bad width"), OPTIONAL),
            (("height",), lambda t: _unsigned(t, "bad height"), OPTIONAL),
            (("longEdge", "long_edge"), lambda t: _unsigned(t, "bad longEdge"), OPTIONAL),
            (("ratio", "aspect"), read_ratio, OPTIONAL),
            (("smart",), lambda t: t == "true" or None, OPTIONAL),
        ),
    ),
    "convert": (("convert",), ((("to",), _text, REQUIRED),)),
    "stripExif": (("stripExif", "stripexif", "strip_exif"), ()),
    "removeAudio": (("removeAudio", "removeaudio", "remove_audio"), ()),
    "changeSpeed": (("changeSpeed", "change_speed"), ((("factor",), read_factor, REQUIRED),)),
    "capFps": (("capFps", "cap_fps"), ((("fps",), lambda t: _number(int, t, "bad fps"), REQUIRED),)),
    "lowerBitrate": (("lowerBitrate", "lower_bitrate"), ((("kbps",), lambda t: _number(int, t, "bad kbps"), REQUIRED),)),
    "targetSize": (("targetSize", "target_size"), ((("bytes", "kb"), read_size, REQUIRED),)),
    "adaptive": (("adaptive",), ()),
    "normalize": (("normalize", "normalise"), ((("lufs",), lambda t: _number(float, t, "bad lufs"), -16.0),)),
    "watermark": (
        ("watermark",),
        (
            (("image",), _text, REQUIRED),
            (("position",), _text, "bottomRight"),
            (("opacity",), lambda t: _number(float, t, "bad opacity"), 1.0),
            (("scale",), lambda t: _number(float, t, "bad scale"), 0.15),
        ),
    ),
    "copyToClipboard": (("copyToClipboard", "copy_to_clipboard"), ()),
    "runScript": (("runScript", "run_script"), ((("code",), _text, OPTIONAL), (("path",), _text, OPTIONAL))),
}
OP_OF_NAME = {name: op for op, (names, _) in STEPS.items() for name in names}
KINDS_OF_OP = {
    "downscale": ("image", "video"), "crop": ("image", "video"), "convert": ("image", "video", "audio"), "removeAudio": ("video",),
    "changeSpeed": ("video",), "capFps": ("video",), "lowerBitrate": ("audio",), "normalize": ("audio",), "watermark": ("image", "video"),
}


def _read_args(text: str) -> dict[str, str]:
    given: dict[str, str] = {}
    for part in filter(None, map(str.strip, text.split(","))):
        key, colon, value = part.partition(":")
        if not colon:
            raise DslError(f"expected 'key: value' in '{part}'")
        given.setdefault(key.strip(), value.strip().strip('"').strip("'"))  # the first of a name counts
    return given


def parse_step(text: str) -> Step:
    name, bracket, rest = text.partition("(")
    if bracket and not rest.rstrip().endswith(")"):
        raise DslError(f"missing ')' in step '{text}'")
    given = _read_args(rest.rstrip()[:-1] if bracket else "")
    op = OP_OF_NAME.get(name.strip())
    if op is None:
        raise DslError(f"unknown step '{name.strip()}'")
    args = {}
    for names, reader, default in STEPS[op][1]:
        raw = next((given[n] for n in names if n in given), None)
        if raw is None and default is REQUIRED:
            raise DslError(f"{op} requires " + " or ".join(f"{n}:" for n in names))
        value = default if raw is None else reader(raw)
        if value is not None:
            args[names[0]] = value
    if op == "crop" and not set(args) & {"width", "height", "longEdge", "ratio"}:
        raise DslError("crop requires width:, height:, longEdge: or ratio:")
    return Step(op, args)


def parse(text: str) -> list[Step]:
    """The steps of a chain; an empty chain has none. Commas and arrows split even inside quotes."""
    return [parse_step(part) for part in map(str.strip, text.split("->")) if part]


def to_dsl(steps: list[Step]) -> str:
    """The canonical text, which parses to the same steps."""

    def one(step: Step) -> str:
        args = step.args
        if step.op == "runScript":
            key = "path" if "path" in args else "code"
            return f'runScript({key}: "{args.get(key, "")}")'
        quoted = {"image"} if step.op == "watermark" else set()
        inner = ", ".join(f'{k}: "{v}"' if k in quoted else f"{k}: {shown(v)}" for k, v in args.items())
        return f"{step.op}({inner})" if inner else step.op

    return " -> ".join(map(one, steps))


# Column forms, for tables of pipelines.


def step_texts(dsl: Column) -> Column:
    """array<string> of the steps' texts."""
    return F.filter(F.transform(F.split(dsl, "->"), lambda s: F.trim(s)), lambda s: s != "")


def step_structs(dsl: Column) -> Column:
    """array<struct<op, target>>: canonical names (null if unknown) and what a convert step names, lower-cased."""

    def one(s: Column) -> Column:
        name = F.trim(F.regexp_extract(s, r"^([^(]*)", 1))
        return F.struct(dims.looked_up(name, OP_OF_NAME).alias("op"), F.lower(F.regexp_extract(s, r"""\bto\s*:\s*["']?([A-Za-z0-9]+)""", 1)).alias("target"))

    return F.transform(step_texts(dsl), one)


def output_extension(ext: Column, steps: Column) -> Column:
    """The extension after all steps (array<struct<op, target>>); ``bin`` for none at the start."""

    def after(current: Column, step: Column) -> Column:
        is_video = F.coalesce(kind_of_extension(current) == "video", F.lit(False))
        op, to = step["op"], step["target"]
        container = dims.looked_up(dial.video_target(to), dims.VIDEO_CONTAINERS)
        converted = (
            F.when(to == "gif", "gif").when(is_video, F.coalesce(container, current))
            .otherwise(F.coalesce(dial.image_target(to), dims.looked_up(dial.audio_target(to), dims.AUDIO_EXTENSION), current))
        )
        to_mp4 = op.isin("optimise", "downscale", "removeAudio", "changeSpeed", "capFps") & is_video
        return F.when(op == "convert", converted).when(to_mp4, "mp4").otherwise(current)

    return F.aggregate(steps, F.when(ext == "", "bin").otherwise(ext), after)


def valid_for(kind: Column, steps: Column) -> Column:
    """Whether every step takes the kind of file it starts with."""
    return F.forall(steps, lambda s: _takes(s["op"], kind))


def _takes(op: Column, kind: Column) -> Column:
    out = op.isNotNull()
    for name, kinds in KINDS_OF_OP.items():
        out = out & ((op != name) | kind.isin(*kinds))
    return F.coalesce(out, F.lit(False))


def resolve(requests: DataFrame, pipelines: DataFrame) -> DataFrame:
    """``requests`` (.., spec) with ``dsl``: the saved pipeline of that name, else the text itself. One pipeline a name."""
    saved = pipelines.select(F.col("name").alias("spec"), F.col("dsl").alias("_saved"))
    return requests.join(saved, "spec", "left").withColumn("dsl", F.coalesce("_saved", "spec")).drop("_saved")
