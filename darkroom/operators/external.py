"""Running external encoders on executors: found tools only, with a time limit, and an error row rather than a failed task."""

from __future__ import annotations

import os
import platform
import shutil
import subprocess
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dims import TOOLS

RETRIED = ("heif-enc", "cjxl")  # fixed values: encoders that are tried twice; a time-out never is


def found(tool: str, folder: str | None = None) -> str | None:
    """A tool's path: a named folder, then the variable DARKROOM_<TOOL>, then PATH."""
    own = os.path.join(folder, tool) if folder else None
    if own and os.access(own, os.X_OK):
        return own
    named = os.environ.get("DARKROOM_" + tool.upper().replace("-", "_"))
    return named if named and os.access(named, os.X_OK) else shutil.which(tool)


def run_tool(tool: str, args: list[str], timeout: float | None = None, folder: str | None = None) -> str | None:
    """Runs a tool; None if all went well, else what went wrong."""
    path = found(tool, folder)
    if path is None:
        return f"{tool} was not found"
    for left in range(1 if tool in RETRIED else 0, -1, -1):
        try:
            done = subprocess.run([path, *args], stdin=subprocess.DEVNULL, capture_output=True, timeout=timeout)
        except subprocess.TimeoutExpired:
            return f"{tool} took more than {timeout:g} s"
        except OSError as e:
            return f"{tool} could not be started: {e}"
        if done.returncode == 0:
            return None
        if not left:
            return f"{tool} ended with {done.returncode}: {done.stderr.decode(errors='replace').strip()[-500:]}"
    return None


def capped(files: DataFrame, jobs: int | None) -> DataFrame:
    """``files`` in at most ``jobs`` parts, so that no more run at once; None: as many as the cluster takes. What comes before keeps its own parts."""
    return files if jobs is None else files.repartition(max(1, jobs))


def run_commands(plans: DataFrame, tool: str, timeout: float | None = None, folder: str | None = None) -> DataFrame:
    """``plans`` (source, dest, args) with new_size and error. ``args`` is a command's, or an array of several tries', of which the next runs
    when one has failed; the last one's error is told. Each command writes a new path, so that a task that is run
    again only writes it anew; nothing is moved or deleted."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                tries = row["args"] if row["args"] and isinstance(row["args"][0], list) else [row["args"]]
                for args in tries:
                    row["error"] = run_tool(tool, args, timeout, folder)
                    if row["error"] is None:
                        break
                if row["error"] is None and not os.path.exists(row["dest"]):
                    row["error"] = f"{tool} wrote no output"
                row["new_size"] = os.path.getsize(row["dest"]) if row["error"] is None else None
            yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in (("source", pa.string()), ("dest", pa.string()), ("new_size", pa.int64()), ("error", pa.string()))})

    return plans.select("source", "dest", "args").mapInArrow(run, "source string, dest string, new_size long, error string")


def doctor(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """(tool, path, arch, cpus): which tools an executor finds, and what machine it is."""

    def look(batches):
        arch = "arm64" if platform.machine().lower() in ("arm64", "aarch64") else "x86_64"
        for batch in batches:
            names = batch.column(0).to_pylist()
            k = len(names)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([found(n, folder) for n in names], pa.string()), pa.array([arch] * k), pa.array([os.cpu_count()] * k, pa.int32())], ["tool", "path", "arch", "cpus"])

    return spark.range(1).select(F.explode(F.array(*map(F.lit, TOOLS))).alias("tool")).mapInArrow(look, "tool string, path string, arch string, cpus int")


def run_gifs(plans: DataFrame, timeout: float | None = None, folder: str | None = None) -> DataFrame:
    """(source, dest, new_size, error) of ``plans`` (source, dest, frames, assemble, one_pass): GIFs of videos.

    Where gifski is found, ``frames`` writes numbered pictures into a folder beside ``dest``, in whose name a ``{}`` stands for a text of the
    task's own, and ``assemble`` is run with these behind it; else ``one_pass`` does all. Commands are as ``plans.commands`` gives them.
    """

    def gif(row) -> str | None:
        if found("gifski", folder) is None:
            return run_tool("ffmpeg", row["one_pass"], timeout, folder)
        own = uuid.uuid4().hex
        args = [a.replace("{}", own) for a in row["frames"]]
        place = os.path.dirname(args[-1])
        os.makedirs(place)
        try:
            error = run_tool("ffmpeg", args, timeout, folder)
            names = sorted(os.path.join(place, n) for n in os.listdir(place))
            if error is None and not names:
                error = "no frames were extracted"
            return error or run_tool("gifski", [*row["assemble"], *names], timeout, folder)
        finally:
            shutil.rmtree(place, ignore_errors=True)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                error = gif(row)
                if error is None and not os.path.exists(row["dest"]):
                    error = "no output was written"
                size = os.path.getsize(row["dest"]) if error is None else None
                yield pa.RecordBatch.from_arrays([pa.array([row["source"]], pa.string()), pa.array([row["dest"]], pa.string()), pa.array([size], pa.int64()), pa.array([error], pa.string())], ["source", "dest", "new_size", "error"])

    return plans.select("source", "dest", "frames", "assemble", "one_pass").mapInArrow(run, "source string, dest string, new_size long, error string")
