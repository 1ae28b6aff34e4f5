"""The step language over tables of chains: steps with their arguments, errors and the canonical print, as columns.

The same language as ``plans.dsl`` reads on the driver, from the same table of steps. A chain's first error counts, as it
does there; a chain with one has no steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dims
from .dsl import OP_OF_NAME, REQUIRED, STEPS

FLOAT = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"


def _none() -> Column:
    return F.lit(None).cast("string")



def trimmed(text: Column) -> Column:
    """Without white space at its ends, that of any alphabet."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def number_text(value: Column) -> Column:
    """A double as the language prints it: no exponent and no zeros at its end."""
    plain = F.regexp_replace(value.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(value == 0, "0").otherwise(F.coalesce(plain, value.cast("string")))


def _read(text: Column, fits: Column, shown: Column, error: Column) -> Column:
    """struct(text, error) of an argument that is there."""
    ok = F.coalesce(fits, F.lit(False))
    return F.struct(F.when(ok, shown).alias("text"), F.when(~ok, error).alias("error"))


def _float(text: Column, error: Column) -> Column:
    return _read(text, text.rlike(FLOAT), number_text(text.try_cast("double")), error)


def _signed(text: Column, error: str) -> Column:
    value = text.try_cast("int")
    return _read(text, text.rlike(r"^[+-]?\d+$") & value.isNotNull(), value.cast("string"), F.lit(error))


def _whole(text: Column) -> Column:
    """An unsigned number of 32 bits, or null."""
    value = text.try_cast("decimal(38,0)")
    return F.when(text.rlike(r"^\+?\d+$") & (value < 2**32), value.cast("string"))


def _unsigned(text: Column, error: str) -> Column:
    return _read(text, _whole(text).isNotNull(), _whole(text), F.lit(error))


def _factor(text: Column) -> Column:
    part = trimmed(F.regexp_replace(text, "%$", ""))
    percent = _read(text, part.rlike(FLOAT), number_text(part.try_cast("double") / 100), F.concat(F.lit("bad percent '"), text, F.lit("'")))
    return F.when(text.endswith("%"), percent).otherwise(_float(text, F.concat(F.lit("bad factor '"), text, F.lit("'"))))


def _ratio(text: Column) -> Column:
    at = F.instr(text, ":")
    a, b = (_whole(trimmed(x)) for x in (F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text))))
    both = _read(text, a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(":"), b), F.lit("bad ratio"))
    return F.when(at > 0, both).otherwise(F.struct(_none().alias("text"), F.concat(F.lit("bad ratio '"), text, F.lit("'")).alias("error")))


def _size(text: Column) -> Column:
    low = F.lower(trimmed(text))
    unit = F.regexp_extract(low, r"(?s)^.*?\s*(mb|kb|b)?$", 1)
    value = F.regexp_extract(low, r"(?s)^(.*?)\s*(mb|kb|b)?$", 1)
    bytes_ = F.greatest(F.lit(0.0), value.try_cast("double") * F.when(unit == "mb", 1e6).when(unit == "kb", 1e3).otherwise(1.0))
    return _read(text, value.rlike(FLOAT), F.floor(bytes_).cast("string"), F.concat(F.lit("bad size '"), text, F.lit("'")))


def _text(text: Column) -> Column:
    return F.struct(text.alias("text"), _none().alias("error"))


def _true(text: Column) -> Column:
    return F.struct(F.when(text == "true", text).alias("text"), _none().alias("error"))


# How the columns read each argument of STEPS.
READERS = {
    ("downscale", "factor"): _factor, ("changeSpeed", "factor"): _factor, ("crop", "width"): lambda t: _unsigned(t, "bad width"), ("crop", "height"): lambda t: _unsigned(t, "bad height"),
    ("crop", "longEdge"): lambda t: _unsigned(t, "bad longEdge"), ("crop", "ratio"): _ratio, ("crop", "smart"): _true, ("capFps", "fps"): lambda t: _signed(t, "bad fps"),
    ("lowerBitrate", "kbps"): lambda t: _signed(t, "bad kbps"), ("targetSize", "bytes"): _size, ("normalize", "lufs"): lambda t: _float(t, F.lit("bad lufs")),
    ("watermark", "opacity"): lambda t: _float(t, F.lit("bad opacity")), ("watermark", "scale"): lambda t: _float(t, F.lit("bad scale")),
}
QUOTED = {("watermark", "image"), ("runScript", "code"), ("runScript", "path")}


def given(text: Column) -> Column:
    """map<string,string> of what stands in a step's brackets; of a name that comes twice the first counts. Parts without a colon are left out."""
    parts = F.filter(F.transform(F.split(text, ","), trimmed), lambda p: p.contains(":"))
    key = lambda p: trimmed(F.regexp_extract(p, r"(?s)^([^:]*):", 1))
    value = lambda p: F.regexp_replace(F.regexp_replace(trimmed(F.regexp_extract(p, r"(?s)^[^:]*:(.*)$", 1)), '^"+|"+$', ""), "^'+|'+$", "")
    pairs = F.transform(parts, lambda p: F.struct(key(p).alias("k"), value(p).alias("v")))
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(pairs, empty, lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))


def _opened(step: Column) -> Column:
    """struct(op, given, error) of a step's text."""
    bracket = step.contains("(")
    rest = F.regexp_replace(F.regexp_extract(step, r"(?s)^[^(]*\((.*)$", 1), r"(?U)\s+$", "")
    inner = F.when(bracket & rest.endswith(")"), F.regexp_replace(rest, r"\)$", "")).otherwise("")
    name = trimmed(F.regexp_extract(step, r"(?s)^([^(]*)", 1))
    op = dims.looked_up(name, OP_OF_NAME)
    odd = F.get(F.filter(F.transform(F.split(inner, ","), trimmed), lambda p: (p != "") & ~p.contains(":")), F.lit(0))
    error = (
        F.when(bracket & ~rest.endswith(")"), F.concat(F.lit("missing ')' in step '"), step, F.lit("'"))).when(odd.isNotNull(), F.concat(F.lit("expected 'key: value' in '"), odd, F.lit("'")))
        .when(op.isNull(), F.concat(F.lit("unknown step '"), name, F.lit("'")))
    )
    return F.struct(op.alias("op"), given(inner).alias("given"), error.alias("error"))


def _args(op: str, have: Column) -> tuple[Column, Column, Column]:
    """(map of the arguments, error, canonical text) of a step ``op`` whose brackets hold ``have``."""
    names, texts, errors = [], [], []
    for keys, _, default in STEPS[op][1]:
        raw = F.coalesce(*[F.try_element_at(have, F.lit(k)) for k in keys])
        read = READERS.get((op, keys[0]), _text)(raw)
        there = raw.isNotNull()
        missing = F.lit(f"{op} requires " + " or ".join(f"{k}:" for k in keys)) if default is REQUIRED else _none()
        other = number_text(F.lit(default)) if isinstance(default, float) else F.lit(default).cast("string") if isinstance(default, str) else _none()
        names.append(keys[0])
        texts.append(F.when(there, read["text"]).otherwise(other))
        errors.append(F.when(there, read["error"]).otherwise(missing))
    if op == "crop":
        errors.append(F.when(F.coalesce(*texts[:4]).isNull(), "crop requires width:, height:, longEdge: or ratio:"))
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), t.alias("v")) for n, t in zip(names, texts)]), lambda p: p["v"].isNotNull()) if names else None
    shown = [F.when(t.isNotNull(), F.concat(F.lit(f"{n}: "), F.concat(F.lit('"'), t, F.lit('"')) if (op, n) in QUOTED else t)) for n, t in zip(names, texts)]
    if op == "runScript":
        shown = [F.coalesce(shown[1], shown[0], F.lit('code: ""'))]
    inner = F.concat_ws(", ", *shown) if shown else F.lit("")
    text = F.when(inner == "", op).otherwise(F.concat(F.lit(f"{op}("), inner, F.lit(")")))
    empty = F.create_map().cast("map<string,string>")
    return F.map_from_entries(pairs) if names else empty, F.coalesce(*errors) if errors else _none(), text


def _closed(step: Column) -> Column:
    """struct(op, args, text, error) of what ``_opened`` gives."""
    own = {op: _args(op, step["given"]) for op in STEPS}
    pick = lambda k: reduce(lambda c, op: c.when(step["op"] == op, own[op][k]), STEPS, F.when(F.lit(False), own["crop"][k]))
    return F.struct(step["op"].alias("op"), pick(0).alias("args"), pick(2).alias("text"), F.coalesce(step["error"], pick(1)).alias("error"))


def parsed(dsl: Column) -> Column:
    """struct(steps array<struct<op, args map, text>>, error) of a chain; null for null."""
    texts = F.filter(F.transform(F.split(dsl, "->"), trimmed), lambda s: s != "")
    steps = F.transform(F.transform(texts, _opened), _closed)
    error = lambda all_: F.get(F.filter(F.transform(all_, lambda s: s["error"]), lambda e: e.isNotNull()), F.lit(0))
    bare = lambda s: F.struct(s["op"].alias("op"), s["args"].alias("args"), s["text"].alias("text"))
    # the steps are found once, and named by a lambda's variable from there on
    both = F.transform(F.array(steps), lambda all_: F.struct(F.when(error(all_).isNull(), F.transform(all_, bare)).alias("steps"), error(all_).alias("error")))
    return F.when(dsl.isNotNull(), F.get(both, F.lit(0)))


def canonical(steps: Column) -> Column:
    """The text that parses to the same steps, of what ``parsed`` gives."""
    return F.array_join(F.transform(steps, lambda s: s["text"]), " -> ")
