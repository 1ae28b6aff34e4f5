import pytest
from pyspark.sql import functions as F

from darkroom.plans import dsl


def ops(text):
    return [s.op for s in dsl.parse(text)]


def test_parse_and_print_round_trip():
    for text in (
        "crop(width: 1600) -> convert(to: webp) -> downscale(factor: 0.5)",
        "crop(width: 1200, height: 630) -> optimise",
        "crop(longEdge: 1920, ratio: 16:9, smart: true)",
        "normalize(lufs: -16)",
        'watermark(image: "a.png", position: topLeft, opacity: 0.5, scale: 0.15)',
        'runScript(code: "echo hi")',
        'runScript(path: "x.sh") -> targetSize(bytes: 1500000) -> adaptive -> stripExif -> capFps(fps: 30)',
    ):
        steps = dsl.parse(text)
        assert dsl.to_dsl(steps) == text
        assert dsl.parse(dsl.to_dsl(steps)) == steps


def test_names_defaults_and_sizes():
    assert ops("optimize -> strip_exif -> lower_bitrate(kbps: 96) -> normalise") == ["optimise", "stripExif", "lowerBitrate", "normalize"]
    assert dsl.parse("normalize")[0].args == {"lufs": -16.0}
    assert dsl.parse("downscale(factor: 50%)")[0].args == {"factor": 0.5}
    assert dsl.parse("targetSize(kb: 500)")[0].args == {"bytes": 500}  # a bare number is bytes
    assert dsl.parse("targetSize(bytes: 1.5mb)")[0].args == {"bytes": 1_500_000}
    assert dsl.parse("crop(width: 1, width: 2)")[0].args == {"width": 1}
    assert dsl.parse("watermark(image: x)")[0].args == {"image": "x", "position": "bottomRight", "opacity": 1.0, "scale": 0.15}
    assert dsl.parse("") == dsl.parse(" -> ") == []


@pytest.mark.parametrize(
    "text, message",
    [
        ("blur", "unknown step 'blur'"),
        ("crop(width: 5", "missing ')'"),
        ("crop()", "crop requires"),
        ("convert", "convert requires to:"),
        ("downscale(factor: x)", "bad factor 'x'"),
        ("crop(width: -5)", "bad width"),
        ("convert(webp)", "expected 'key: value' in 'webp'"),
        ("capFps(fps: 2.5)", "bad fps"),
        ("targetSize(bytes: big)", "bad size 'big'"),
    ],
)
def test_errors(text, message):
    with pytest.raises(dsl.DslError, match="^" + message.replace("(", r"\(").replace(")", r"\)")):
        dsl.parse(text)


def test_output_extension_and_validity(spark):
    rows = [("mov", "removeAudio", "mp4"), ("png", "crop(width: 5) -> convert(to: WEBP)", "webp"), ("mp4", "convert(to: vp9)", "webm"), ("wav", "convert(to: opus)", "ogg"), ("", "adaptive", "bin"), ("png", "convert(to: gif)", "gif")]
    df = spark.createDataFrame(rows, "ext string, dsl string, want string").withColumn("got", dsl.output_extension(F.col("ext"), dsl.step_structs(F.col("dsl"))))
    assert df.where("got != want OR got IS NULL").count() == 0
    kinds = spark.createDataFrame([("image", "capFps(fps: 3)", False), ("video", "capFps(fps: 3) -> optimise", True), ("audio", "blur", False)], "kind string, dsl string, want boolean")
    assert kinds.where(dsl.valid_for(F.col("kind"), dsl.step_structs(F.col("dsl"))) != F.col("want")).count() == 0
