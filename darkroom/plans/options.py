"""Options of a run: flags before the saved configuration before defaults; and the table of saved pipelines."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dial import AGGRESSIVE, NORMAL
from . import dsl, dsl_columns


@dataclass(frozen=True)
class Config:
    compression: int = NORMAL
    aggressive: bool = False
    backup: bool = True
    strip_metadata: bool = False
    preserve_dates: bool = True


def load_config(text: str | None) -> Config:
    """From JSON; a missing or unreadable text gives the defaults, a missing key its own."""
    try:
        given = json.loads(text or "")
    except ValueError:
        return Config()
    known = {f.name: type(f.default) for f in fields(Config)}
    return Config(**{k: v for k, v in given.items() if k in known and type(v) is known[k]}) if isinstance(given, dict) else Config()


def resolve(config: Config, compression: int | None = None, aggressive: bool = False, no_backup: bool = False, strip_metadata: bool = False, no_dates: bool = False, allow_larger: bool = False) -> dict:
    """What a run uses. Aggressive, from a flag or saved, beats a compression that is named; backup and dates need
    both, stripping either."""
    wanted = AGGRESSIVE if aggressive or config.aggressive else config.compression if compression is None else compression
    return {
        "tier": "custom", "factor": max(0, min(100, wanted)), "backup": config.backup and not no_backup, "strip_metadata": config.strip_metadata or strip_metadata,
        "preserve_dates": config.preserve_dates and not no_dates, "allow_larger": allow_larger,
    }


def resolved(saved: dict[str, Column], flags: dict[str, Column]) -> dict[str, Column]:
    """``resolve`` for tables: options as columns, from saved ones and flags as columns (compression, aggressive, no_backup, strip_metadata, no_dates)."""
    wanted = F.when(flags["aggressive"] | saved["aggressive"], AGGRESSIVE).otherwise(F.coalesce(flags["compression"], saved["compression"]))
    return {
        "factor": F.greatest(F.lit(0), F.least(F.lit(100), wanted)), "backup": saved["backup"] & ~flags["no_backup"],
        "strip_metadata": saved["strip_metadata"] | flags["strip_metadata"], "preserve_dates": saved["preserve_dates"] & ~flags["no_dates"],
    }


def target_table(automations: DataFrame, pipelines: DataFrame, there: DataFrame) -> DataFrame:
    """(target, folder, file_type, pipeline, error) for ``streaming.routing.routed_by_table``, a row for each automation (i, source, file_type,
    pipeline) whose folder is among ``there`` (folder). ``pipeline`` is canonical; where a text can't be read it is null, and ``error`` says why."""
    wanted = automations.select(F.col("i").alias("target"), F.col("source").alias("folder"), "file_type", F.col("pipeline").alias("spec"))
    found = dsl.resolve(wanted.join(there.select("folder"), "folder", "left_semi"), pipelines).withColumn("_p", dsl_columns.parsed(F.col("dsl")))
    return found.select("target", "folder", "file_type", dsl_columns.canonical(F.col("_p.steps")).alias("pipeline"), F.col("_p.error").alias("error"))


def to_json(config: Config) -> str:
    return json.dumps(asdict(config))


def _upsert(table: DataFrame, key: str, row: dict) -> DataFrame:
    new = table.sparkSession.createDataFrame([tuple(row[c] for c in table.columns)], table.schema)
    return table.join(new.select(key), key, "left_anti").select(table.columns).unionByName(new)


def add_pipeline(pipelines: DataFrame, name: str, text: str) -> DataFrame:
    """``pipelines`` (name, dsl) with one more or another; the text is parsed first."""
    dsl.parse(text)
    return _upsert(pipelines, "name", {"name": name, "dsl": text})


def delete_pipeline(pipelines: DataFrame, name: str) -> DataFrame:
    return pipelines.where(F.col("name") != name)


def attach(automations: DataFrame, source: str, pipeline: str, file_type: str = "all") -> DataFrame:
    """``automations`` (source, file_type, pipeline) with the source's own replaced."""
    return _upsert(automations, "source", {"source": source, "file_type": file_type, "pipeline": pipeline})


def detach(automations: DataFrame, source: str) -> DataFrame:
    return automations.where(F.col("source") != source)


def targets(automations: DataFrame, pipelines: DataFrame, folders: list[str] = (), pipeline: str | None = None, exists=None) -> list[tuple[str, str, str]]:
    """(folder, type, dsl) for ``streaming.watch.routed``: named folders replace saved automations. A short list.

    ``exists`` says of a folder whether it is there; one that isn't is left out with a warning. None: all count.
    """
    spark = pipelines.sparkSession
    rows = [(i, f, "all", pipeline or "optimise") for i, f in enumerate(folders)]
    wanted = spark.createDataFrame(rows, "i int, source string, file_type string, spec string") if rows else automations.select(F.monotonically_increasing_id().alias("i"), "source", "file_type", F.col("pipeline").alias("spec"))
    found = [(r["source"], r["file_type"], r["dsl"]) for r in dsl.resolve(wanted, pipelines).orderBy("i").collect()]
    for folder, *_ in found:
        if exists is not None and not exists(folder):
            warnings.warn(f"{folder} is not there and isn't watched", stacklevel=2)
    return [t for t in found if exists is None or exists(t[0])]
