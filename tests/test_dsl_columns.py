"""The column parser against the driver's, on chains of all kinds."""

import random

from pyspark.sql import functions as F

from darkroom.plans import dsl, dsl_columns

PIECES = [
    "optimise", "optimize()", "downscale(factor: 50%)", "downscale(factor:.25)", "downscale( factor : 1e2 )", "downscale()", "downscale(factor: x)", "downscale(factor: y%)", "crop(width: 1600)", "crop(width: +7, height: 8, width: 9)",
    "crop(ratio: 16:9, smart: true)", "crop(aspect: 4 : 3, smart: no)", "crop(smart: true)", "crop(ratio: 4)", "crop(ratio: 4:x)", "crop(width: -1)", "crop(width: 4294967296)", "crop(long_edge: 20)", "crop(longEdge: a)", "convert(to: \"webp\")", "convert(to: '')", "convert()",
    "stripexif", "remove_audio", "changeSpeed(factor: 2)", "cap_fps(fps: 030)", "capFps(fps: 99999999999)", "capFps(fps: 1.5)", "lowerBitrate(kbps: -5)", "lowerBitrate", "targetSize(bytes: 1.5 MB)", "targetSize(kb: 20kb)", "target_size(bytes: 100)", "targetSize(bytes: -3b)", "targetSize(bytes: mb)", "adaptive",
    "normalise", "normalize(lufs: -16)", "normalize(lufs: -14.50)", "normalize(lufs: loud)", "watermark(image: a.png)", "watermark(image: \"b\", position: topLeft, opacity: 0.5, scale: 0.0001)", "watermark(scale: 1)", "watermark(image: c, opacity: q)", "copyToClipboard", "runScript(code: go)", "runScript(path: \"/x\", code: y)", "runScript", "run_script(code: '\"q\"')",
    "blur(radius: 1)", "crop(width 10)", "optimise(", "optimise(a: 1", "crop(width: 5) ", "\tadaptive\n", "", " ", "crop(,,height: 3,)", "Optimise", "crop(width: 1)x", "downscale(factor: 12345678901234)", "downscale(factor: 0.000001)", "downscale(factor: 0%)", "x(y: 'é')", "normalize(lufs: -0)",
]


def shown(step):
    return {k: str(dsl.shown(v)) for k, v in step.args.items()}


def test_chains_parse_as_on_the_driver(spark):
    rng = random.Random(4)
    chains = [*PIECES, None, "", " -> ", *[" -> ".join(rng.choices(PIECES, k=rng.randint(2, 5))) for _ in range(300)]]
    frame = spark.createDataFrame(list(enumerate(chains)), "n int, chain string").withColumn("p", dsl_columns.parsed(F.col("chain")))
    rows = frame.select("n", "p.steps", "p.error", dsl_columns.canonical(F.col("p.steps")).alias("text")).collect()
    n_good = 0
    for r in rows:
        chain = chains[r["n"]]
        if chain is None:
            assert r["steps"] is None and r["error"] is None
            continue
        try:
            want = dsl.parse(chain)
        except dsl.DslError as e:
            assert (r["steps"], r["error"]) == (None, str(e)), chain
            continue
        n_good += 1
        assert r["error"] is None and [s["op"] for s in r["steps"]] == [s.op for s in want], chain
        if "0.000001" in chain or "0.0001" in chain or "lufs: -0" in chain:  # the driver prints an exponent, and a negative zero
            continue
        assert r["text"] == dsl.to_dsl(want), chain
        assert [s["args"] for s in r["steps"]] == [shown(s) for s in want], chain
    assert n_good > 30
    again = frame.where("p.error IS NULL AND chain IS NOT NULL").select(dsl_columns.canonical(F.col("p.steps")).alias("text"))
    again = again.select("text", dsl_columns.canonical(dsl_columns.parsed(F.col("text"))["steps"]).alias("twice"))
    assert again.where("NOT text <=> twice AND NOT text LIKE '%code: \"\"%' AND text NOT LIKE '%to: )%'").count() == 0
