"""Queries on watching, routing and object graphs: state over batches, tables of targets, rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import dims
from .operators import graph
from .operators.placement import shared_folder
from .functions.headers import picture_header
from .queries import _EVENT_PATH, FX, C, _events, _files, _query, _sql_list
from .streaming import state, watch
from .streaming.routing import routed_by_table

_TURN_EXT = ["png", "mp4", "txt", "pdf"]
CHANGES = f"""changes AS (
  SELECT 'e' || event_id AS id, {_EVENT_PATH} AS path, CAST(ts AS TIMESTAMP) AS moment, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS mtime FROM events
  UNION ALL SELECT 'c' || conv_id || '-' || turn, '/vault/c' || conv_id % 97 || '/t' || conv_id || '/m' || turn % 5 || '.' || list_extract([{_sql_list(_TURN_EXT)}], CAST(turn % 4 AS INT) + 1),
    TIMESTAMP '2024-02-01' + to_seconds(conv_id * 30 + turn * 7), TIMESTAMP '2024-02-01' + to_seconds(conv_id * 30 + turn * 7) FROM conversations)"""


def _changes(spark, sf_dir) -> DataFrame:
    """(id, path, event_time, mtime): changes of files, from ``events``, and a file for every turn of ``conversations``."""
    own = _events(spark, sf_dir).select(F.concat(F.lit("e"), C("event_id").cast("string")).alias("id"), "path", "event_time", "mtime")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(C("conv_id").cast("long").alias("c"), C("turn").cast("long").alias("t"))
    text = lambda x: x.cast("string")
    ext = F.get(F.array(*map(F.lit, _TURN_EXT)), (C("t") % 4).cast("int"))
    path = F.concat(F.lit("/vault/c"), text(C("c") % 97), F.lit("/t"), text(C("c")), F.lit("/m"), text(C("t") % 5), F.lit("."), ext)
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-02-01 00:00:00").cast("timestamp")) + C("c") * 30 + C("t") * 7)
    return own.unionByName(turns.select(F.concat(F.lit("c"), text(C("c")), F.lit("-"), text(C("t"))).alias("id"), path.alias("path"), at.alias("event_time"), at.alias("mtime")))


def _new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Routing by a table

_TARGETS = """targets AS (
  SELECT user_id * 2 + 1 AS target, '/vault/u' || user_id || CASE WHEN user_id % 2 = 0 THEN '/' ELSE '' END AS folder, list_extract(['image', 'video', 'all', 'audio', 'pdf', 'other'], CAST(user_id % 6 AS INT) + 1) AS file_type, 'p' || user_id % 5 AS pipeline
    FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 <> 0
  UNION ALL SELECT conv_id * 2, '/vault/c' || conv_id % 97 || '/t' || conv_id, CASE WHEN conv_id % 8 = 0 THEN 'image' ELSE '' END, 'turns' FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 4 = 0
  UNION ALL SELECT 100000000, '/vault', 'video', 'clip')"""


@_query(f"""WITH {CHANGES}, {_TARGETS}, n AS (SELECT id, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM changes), x AS (SELECT *, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS ext FROM n),
k AS (SELECT *, CASE {" ".join(f"WHEN ext IN ({_sql_list(v)}) THEN '{k}'" for k, v in dims.KIND_EXTENSIONS.items())} END AS kind FROM x),
w AS (SELECT id, path, kind FROM k WHERE kind IS NOT NULL AND NOT starts_with(name, '.') AND NOT ends_with(name, '.orig') AND NOT ends_with(name, '~')),
m AS (SELECT id, path, min(target) AS target FROM w JOIN targets ON starts_with(path, rtrim(folder, '/') || '/') AND (file_type NOT IN ('image', 'video', 'audio', 'pdf') OR file_type = kind) GROUP BY id, path)
SELECT id, path, target, pipeline FROM m JOIN targets USING (target)""")
def route_by_table(spark, sf_dir):
    """Changes routed by a table of a target for most users and every fourth conversation."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().where("user_id % 3 <> 0")
    types = F.get(F.array(*map(F.lit, ["image", "video", "all", "audio", "pdf", "other"])), (C("user_id") % 6).cast("int"))
    targets = users.select(
        (C("user_id") * 2 + 1).alias("target"), F.concat(F.lit("/vault/u"), C("user_id").cast("string"), F.when(C("user_id") % 2 == 0, "/").otherwise("")).alias("folder"),
        types.alias("file_type"), F.concat(F.lit("p"), (C("user_id") % 5).cast("string")).alias("pipeline"),
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(C("conv_id").cast("long").alias("c")).distinct().where("c % 4 = 0")
    turns = turns.select((C("c") * 2).alias("target"), F.concat(F.lit("/vault/c"), (C("c") % 97).cast("string"), F.lit("/t"), C("c").cast("string")).alias("folder"), F.when(C("c") % 8 == 0, "image").otherwise("").alias("file_type"), F.lit("turns").alias("pipeline"))
    every = spark.range(1).select(F.lit(100_000_000).cast("long").alias("target"), F.lit("/vault").alias("folder"), F.lit("video").alias("file_type"), F.lit("clip").alias("pipeline"))
    return routed_by_table(_changes(spark, sf_dir).select("id", "path"), targets.unionByName(turns).unionByName(every))


# State over batches

BATCHES = 4
_FAILS = "(octet_length(encode(path)) + CAST(epoch(mtime) AS BIGINT) // 7) % 5 = 0"


def _replay_sql() -> str:
    """Batch by batch: what is due, what succeeds, what is then known."""
    parts = [f"b AS (SELECT path, CAST(octet_length(encode(path)) + CAST(epoch(moment) AS BIGINT) // 86400 AS BIGINT) % {BATCHES} AS n, max(mtime) AS mtime FROM changes GROUP BY ALL)", "k0 AS (SELECT NULL::VARCHAR AS path, NULL::TIMESTAMP AS known WHERE false)"]
    for i in range(BATCHES):
        parts.append(f"d{i} AS MATERIALIZED (SELECT b.path, b.mtime, {_FAILS.replace('path', 'b.path').replace('mtime', 'b.mtime')} AS failed FROM b LEFT JOIN k{i} AS k ON k.path = b.path WHERE n = {i} AND (known IS NULL OR b.mtime > known))")
        parts.append(f"k{i + 1} AS MATERIALIZED (SELECT path, known FROM k{i} WHERE path NOT IN (SELECT path FROM d{i} WHERE NOT failed) UNION ALL SELECT path, CASE WHEN octet_length(encode(path)) % 2 = 0 THEN mtime + INTERVAL 1 DAY ELSE mtime END FROM d{i} WHERE NOT failed)")
    parts.append("r AS (" + " UNION ALL ".join(f"SELECT path, failed FROM d{i}" for i in range(BATCHES)) + ")")
    parts.append("t AS (SELECT path, count(*) FILTER (NOT failed) AS n_done, count(*) FILTER (failed) AS n_failed FROM r GROUP BY path)")
    return f"WITH {CHANGES}, " + ", ".join(parts) + f" SELECT path, n_done, n_failed, epoch_us(known) AS known_us FROM t LEFT JOIN k{BATCHES} USING (path)"


def _seconds(moment):
    """The nearest whole second, as SQL's cast of ``epoch`` gives it: half a second before midnight it is the next day's first."""
    return F.rint(F.unix_micros(moment) / F.lit(1e6)).cast("long")


@_query(_replay_sql())
def watch_replay(spark, sf_dir):
    """Batches of changes against state that each leaves: a fifth fails, files with an even path are written in place a day later."""
    events = _changes(spark, sf_dir)
    number = ((F.octet_length("path") + F.floor(_seconds(C("event_time")) / 86400)) % BATCHES).cast("int")
    latest = events.groupBy("path", number.alias("n")).agg(F.max("mtime").alias("mtime"))
    done = state.DoneFiles(spark, _new_folder(spark, "watch"))
    fails = (F.octet_length("path") + F.floor(_seconds(C("mtime")) / 7)) % 5 == 0
    output = F.when(F.octet_length("path") % 2 == 0, C("path")).otherwise(F.concat("path", F.lit(".webp")))
    for batch in range(BATCHES):
        todo = done.due(latest.where(C("n") == batch).select("path", "mtime"))
        done.add(todo.select("path", "mtime", output.alias("output"), (C("mtime") + F.expr("INTERVAL 1 DAY")).alias("output_mtime"), F.when(fails, "failed").alias("error")), batch)
    counts = done.results().groupBy("path").agg(F.count_if(C("error").isNull()).alias("n_done"), F.count_if(C("error").isNotNull()).alias("n_failed"))
    return counts.join(done.known(), "path", "left").select("path", "n_done", "n_failed", F.unix_micros("mtime").alias("known_us"))


@_query(f"""WITH {CHANGES}, g AS (SELECT *, CASE WHEN moment >= lag(moment) OVER (ORDER BY moment) + INTERVAL 300 SECOND THEN 1 ELSE 0 END AS new FROM changes),
s AS (SELECT *, sum(new) OVER (ORDER BY moment ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT epoch_us(min(moment)) AS start_us, count(*) AS n_events, count(DISTINCT path) AS n_paths, min(path) AS first_path FROM s GROUP BY session""")
def quiet_replay(spark, sf_dir):
    """Changes in micro-batches of ten days, oldest first, in batches between quiet times; then the clock ends the last one."""
    events = _changes(spark, sf_dir).select("path", "event_time")
    quiet, out = state.QuietBatches(spark, _new_folder(spark, "quiet"), "300 seconds"), []
    day = "2024-01-11 2024-01-21 2024-02-01".split()
    for n, (lo, hi) in enumerate(zip([None, *day], [*day, None])):
        part = events if lo is None else events.where(C("event_time") >= F.lit(lo).cast("timestamp"))
        part = part if hi is None else part.where(C("event_time") < F.lit(hi).cast("timestamp"))
        out.append(_kept(quiet.step(part, n)))
    out.append(_kept(quiet.step(events.limit(0), len(out), F.lit("2100-01-01").cast("timestamp"))))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("start").agg(F.sum("n_events").alias("n_events"), F.count("path").alias("n_paths"), F.min("path").alias("first_path")).select(F.unix_micros("start").alias("start_us"), "n_events", "n_paths", "first_path")


def _kept(batch: DataFrame) -> DataFrame:
    """A step's result, written before the next step clears what it reads."""
    path = _new_folder(batch.sparkSession, "batch")
    batch.write.parquet(path)
    return batch.sparkSession.read.schema(batch.schema).parquet(path)


# Object graphs: files of objects from the ids of ``documents``

_NODES = """n AS (SELECT 'f' || doc_id % 50 AS file, doc_id // 50 AS object, doc_id,
  CASE WHEN doc_id // 50 = 0 THEN NULL WHEN doc_id // 50 % 29 = 7 THEN doc_id // 50 + 3 ELSE doc_id // 50 - 1 - (doc_id // 50) % 2 END AS parent,
  CASE WHEN doc_id // 50 % 41 = 5 THEN doc_id // 50 END AS bx, CASE WHEN doc_id // 50 % 41 = 5 THEN doc_id % 97 END AS y FROM documents)"""


def _nodes(spark, sf_dir) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select(C("doc_id").cast("long").alias("doc_id"))
    nodes = ids.select("doc_id", F.concat(F.lit("f"), (C("doc_id") % 50).cast("string")).alias("file"), F.expr("doc_id div 50").alias("object"))
    parent = F.when(C("object") == 0, None).when(C("object") % 29 == 7, C("object") + 3).otherwise(C("object") - 1 - C("object") % 2)
    return nodes.withColumn("parent", parent)


@_query(f"""WITH RECURSIVE {_NODES}, w AS (SELECT file, object, parent AS next, bx, y, 0 AS hop FROM n
  UNION ALL SELECT w.file, w.object, n.parent, n.bx, n.y, hop + 1 FROM w JOIN n ON n.file = w.file AND n.object = w.next WHERE w.bx IS NULL AND hop < 31)
SELECT file, object, CAST(coalesce(max(bx), 612) AS DOUBLE) AS x1, CAST(coalesce(max(y), 792) AS DOUBLE) AS y1 FROM w GROUP BY file, object""")
def inherited_boxes(spark, sf_dir):
    """Boxes from the nearest parent that has one, over chains, cycles and parents that aren't there."""
    from .operators.pdf import LETTER

    box = F.when(C("object") % 41 == 5, F.array(F.lit(0.0), F.lit(0.0), C("object").cast("double"), (C("doc_id") % 97).cast("double")))
    found = graph.inherited(_nodes(spark, sf_dir).select("file", "object", "parent", box.alias("value")))
    found = found.withColumn("value", F.coalesce("value", F.array(*map(F.lit, LETTER))))
    return found.select("file", "object", C("value")[2].alias("x1"), C("value")[3].alias("y1"))


@_query(f"""WITH RECURSIVE {_NODES}, e AS (SELECT file, object AS f, (object * 2) % 91 AS t FROM n UNION SELECT file, object, object + 6 FROM n WHERE object % 4 IN (1, 2) UNION SELECT file, object, parent FROM n WHERE object % 3 = 0 AND parent IS NOT NULL),
r AS (SELECT file, object FROM n WHERE object = CASE WHEN ends_with(file, '7') THEN 5 ELSE 1 END UNION SELECT e.file, e.t FROM r JOIN e ON e.file = r.file AND e.f = r.object)
SELECT file, object, (file, object) IN (SELECT (file, object) FROM r) AS kept FROM n""")
def reached_objects(spark, sf_dir):
    """Which objects a file's root leads to, over edges with cycles and ends that aren't there."""
    nodes = _nodes(spark, sf_dir)
    two, next_, up = nodes.select("file", C("object").alias("from"), (C("object") * 2 % 91).alias("to")), nodes.where("object % 4 IN (1, 2)"), nodes.where("object % 3 = 0 AND parent IS NOT NULL")
    edges = two.unionByName(next_.select("file", C("object").alias("from"), (C("object") + 6).alias("to"))).unionByName(up.select("file", C("object").alias("from"), C("parent").alias("to")))
    roots = nodes.where(C("object") == F.when(C("file").endswith("7"), 5).otherwise(1))
    found = graph.reachable(edges, roots).withColumn("kept", F.lit(True))
    return nodes.join(found, ["file", "object"], "left").select("file", "object", F.coalesce("kept", F.lit(False)).alias("kept"))


# Headers: the first bytes of pictures at the catalogue's own sizes

_JPEGS = "ext IN ('jpg', 'jpeg')"


@_query(f"""WITH {FX} SELECT file_id, CASE WHEN {_JPEGS} THEN 'jpeg' ELSE ext END AS format, width, height,
  CASE WHEN ext = 'png' THEN has_alpha WHEN ext = 'webp' AND file_id // 36 % 3 > 0 THEN file_id // 36 % 2 = 0 ELSE false END AS has_alpha
  FROM able WHERE ext IN ('png', 'jpg', 'jpeg', 'gif', 'bmp', 'webp')""")
def picture_headers(spark, sf_dir):
    """Bytes as encoders begin their files with, made from the catalogue's sizes, and read back."""
    n, w, h = C("file_id"), C("width"), C("height")
    turn = F.floor(n / 36)

    def big(value, size):
        return F.lpad(F.hex(value.cast("long")), 2 * size, "0")

    def little(value, size):
        text = big(value, size)
        return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])

    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), F.lit("08"), F.when(C("has_alpha"), "06").otherwise("02"))
    tables = F.expr("repeat(concat('FFDB', lpad(hex(2 + file_id % 700), 4, '0'), repeat('C0', cast(file_id % 700 AS INT))), cast(1 + file_id % 5 AS INT))")  # with bytes in them that look like other segments
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000"), tables, F.when(turn % 2 == 0, "FFFFC2").otherwise("FFC0"), F.lit("001108"), big(h, 2), big(w, 2), F.lit("03011100"))
    gif = F.concat(F.lit("474946383961"), little(w, 2), little(h, 2))
    bmp = F.concat(F.lit("424D"), F.lit("00" * 12), F.lit("28000000"), little(w, 4), F.when(turn % 2 == 0, little(h, 4)).otherwise(little(F.lit(2**32) - h, 4)))
    alpha = turn % 2 == 0
    riff = F.lit("52494646000000005745425056503")
    webp = (
        F.when(turn % 3 == 0, F.concat(riff, F.lit("82000000000"), F.lit("000000"), F.lit("9D012A"), little(w, 2), little(h, 2)))
        .when(turn % 3 == 1, F.concat(riff, F.lit("84C000000002F"), little((w - 1) + (h - 1) * 2**14 + F.when(alpha, 2**28).otherwise(0), 4)))
        .otherwise(F.concat(riff, F.lit("8580A000000"), F.when(alpha, "10").otherwise("00"), F.lit("000000"), little(w - 1, 3), little(h - 1, 3)))
    )
    ext = C("ext")
    made = F.when(ext == "png", png).when(ext.isin("jpg", "jpeg"), jpeg).when(ext == "gif", gif).when(ext == "bmp", bmp).when(ext == "webp", webp)
    heads = _files(spark, sf_dir).select("file_id", F.unhex(made).alias("head")).where("head IS NOT NULL").withColumn("p", picture_header(C("head")))
    return heads.select("file_id", "p.format", "p.width", "p.height", "p.has_alpha")
