"""A sink for files in two phases: tasks write beside the places where files will be, and the commit moves them there.

    spark.dataSource.register(FileSink)
    rows.write.format("darkroom_sink").mode("append").option("staging", folder).save()

``rows`` is (action, source, dest, content):

* ``write``: ``content`` becomes ``dest``, with the times of ``source`` if that isn't null;
* ``backup``: a copy of ``source`` becomes ``dest``, unless ``dest`` is there: the first original stays;
* ``restore``: ``source``, a backup, is moved over ``dest``;
* ``clean``: ``source`` is removed.

Nothing that was there changes before all tasks are done. A task notes in a list of its own, in ``staging``, what it is about to write; the driver gets
the lists' names. When the job commits, the lists of the tasks that count are carried out, and what tried-again tasks left is removed; when it
aborts, all that was written is removed. A commit that is broken off can be carried out again by ``finish``: what is done is found done.
Paths are such as executors and driver can open, a mounted share for instance.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "action string, source string, dest string, content binary"


@dataclass
class Listed(WriterCommitMessage):
    name: str
    rows: int


class FileSink(DataSource):
    """Options: ``staging``, a folder for the tasks' lists."""

    @classmethod
    def name(cls):
        return "darkroom_sink"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return Writer(self.options["staging"].removeprefix("file://"))


class Writer(DataSourceWriter):
    def __init__(self, staging: str):
        self.folder = f"{staging.rstrip('/')}/job-{uuid.uuid4().hex}"

    def write(self, iterator):
        os.makedirs(self.folder, exist_ok=True)
        name, rows = f"{self.folder}/{uuid.uuid4().hex}.list", 0
        with open(name, "w") as listed:
            for row in iterator:
                part = None
                if row.action in ("write", "backup"):
                    part = f"{os.path.dirname(row.dest)}/.{os.path.basename(row.dest)}.{uuid.uuid4().hex}.part"
                # noted before it is written, so that what a lost task leaves is known
                listed.write(json.dumps([row.action, row.source, row.dest, part]) + "\n")
                listed.flush()
                if row.action == "write":
                    with open(part, "wb") as f:
                        f.write(row.content or b"")
                    if row.source is not None and os.path.exists(row.source):
                        shutil.copystat(row.source, part)
                elif row.action == "backup" and not os.path.exists(row.dest):
                    shutil.copy2(row.source, part)
                elif row.action not in ("backup", "restore", "clean"):
                    raise ValueError(f"unknown action: {row.action}")
                rows += 1
        return Listed(name, rows)

    def commit(self, messages):
        finish(self.folder, {m.name for m in messages if m is not None})

    def abort(self, messages):
        finish(self.folder, set())


def _lines(name: str):
    with open(name) as f:
        for line in f:
            with contextlib.suppress(ValueError):  # of a task that was lost in the middle of a line
                yield json.loads(line)


def finish(folder: str, counting: set[str]) -> None:
    """Carries out the lists in ``folder`` whose names are in ``counting``, removes what the others name, and then the folder."""
    names = [f"{folder}/{n}" for n in sorted(os.listdir(folder))] if os.path.isdir(folder) else []
    for name in sorted(names, key=lambda n: n in counting):  # first what goes away
        for action, source, dest, part in _lines(name):
            if name in counting:
                _carry_out(action, source, dest, part)
            if part is not None:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(part)
    shutil.rmtree(folder, ignore_errors=True)


def _carry_out(action: str, source: str | None, dest: str | None, part: str | None) -> None:
    with contextlib.suppress(FileNotFoundError):  # done before
        if action == "write":
            os.replace(part, dest)
        elif action == "backup":
            if not os.path.exists(dest):
                os.replace(part, dest)
        elif action == "restore":
            os.replace(source, dest)
        elif action == "clean":
            os.remove(source)
