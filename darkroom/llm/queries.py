"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import work_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes token files, reads them back, and digests what was read."""
    from .token_files import read_token_files, write_token_files

    out = work_path(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), out, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, out).select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod
    from .lm_scoring import score_texts

    held_out = crc_mod(F.col("doc_id"), 7) == 2
    scored = score_texts(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7, held_out=(4, 2))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=5, percent=75)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1, seq_len=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


#: (action, host/path) as the contract states them.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the row of ``labels`` with its id: good if of quality and not toxic. ``rate`` and ``p_low`` are rounded."""
    from .url_reputation import judge_urls

    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr("CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 WHEN quality IS NOT NULL THEN 0 END").alias("good"))
    return judge_urls(_table(spark, sf_dir, "pages"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("rate", 6).alias("rate"), F.round("p_low", 6).alias("p_low"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    placed = shard(_table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"), components=32, scale=64, shift=1_000_000)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents"), held_out=(4, 2))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(_table(spark, sf_dir, "embeddings"), k=40, dims=64, rounds=5, scale=256, seed=2)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_files": op2_token_files,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_near_dedup": op6_near_dedup,
    "op7_packing": op7_packing,
    "op8_url_reputation": op8_url_reputation,
    "op9_sharding": op9_sharding,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_language_id": op12_language_id,
    "op13_centroids": op13_centroids,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_ADDRESS = "^(?:\\d{1,3}(?:\\.\\d{1,3}){3}|\\[.*\\])$"
_STRENGTH = """1e0 / least(0.5e0, greatest(1e0 / 1001, coalesce(
    (sum(n * pow(good / n - prior, 2) / (prior * (1 - prior))) FILTER (n > 0 AND prior > 0 AND prior < 1) - count(*) FILTER (n > 0 AND prior > 0 AND prior < 1))
    / nullif(sum(n - 1) FILTER (n > 0 AND prior > 0 AND prior < 1), 0), 0))) - 1"""


def _rounds(rounds: int, k: int, scale: int, seed: int, dims: int) -> str:
    """SQL of Lloyd's rounds: c0 holds the first centroids (c, j, z), a1 assigns, c1 has the next ones, and so on."""
    parts = [f"""
x AS MATERIALIZED (
  SELECT vec_id, unnest(range(1, {dims + 1})) AS j, unnest(list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT))) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
f AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS c FROM (SELECT DISTINCT vec_id FROM x) QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, j, v AS z FROM f JOIN x USING (vec_id))"""]
    for r in range(1, rounds + 2):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, c, distance FROM (SELECT vec_id, c, CAST(sum((v - z) * (v - z)) AS BIGINT) AS distance FROM x JOIN c{r - 1} USING (j) GROUP BY vec_id, c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1)""")
        if r <= rounds:
            parts.append(f"""
s{r} AS (SELECT c, j, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN x USING (vec_id) GROUP BY c, j),
c{r} AS MATERIALIZED (SELECT o.c, o.j, CASE WHEN n IS NULL THEN o.z ELSE CAST((s - ((s % n) + n) % n) / n AS BIGINT) END AS z FROM c{r - 1} AS o LEFT JOIN s{r} USING (c, j))""")
    return ",".join(parts)


ORACLES: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0 AND item IS NOT NULL),
place AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM d, unnest(range(1, len(w) + 1)) AS t(i), (SELECT DISTINCT n FROM win) AS s WHERE i + n - 1 <= len(w)),
hit AS (SELECT doc_id, i, n, item FROM place JOIN win USING (n, win)),
cover AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM hit) AS h, unnest(range(0, n)) AS u(k) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op6_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept
FROM reach JOIN documents ON doc_id = a LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op13_centroids": f"""
WITH {_rounds(5, 40, 256, 2, 64).strip()},
i AS (SELECT c, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a6 GROUP BY c),
h AS (SELECT c, sha256(string_agg(CAST(z AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c5 GROUP BY c)
SELECT vec_id, c AS cluster, distance, cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM a6) AS inertia, centroid_sha256
FROM a6 JOIN i USING (c) JOIN h USING (c)""",
    "op8_url_reputation": f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT *, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':\\d*$', ''), '.') AS name FROM u),
d AS (
  SELECT *, regexp_matches(name, '{_ADDRESS}') AS address,
    CASE WHEN regexp_matches(name, '{_ADDRESS}') THEN name
      ELSE coalesce(nullif(regexp_extract(name, '([^.]+\\.(?:(?:ac|co|com|edu|gov|net|org)\\.[a-z][a-z]|[^.]+))$', 1), ''), name) END AS domain FROM m),
f AS (SELECT *, CASE WHEN address THEN '' ELSE regexp_extract(domain, '^[^.]*\\.(.*)$', 1) END AS suffix FROM d),
o AS (
  SELECT doc_id AS page_id, CAST(sum(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS good, CAST(count(*) AS DOUBLE) AS n
  FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT name, domain, suffix, coalesce(sum(good), 0) AS good, coalesce(sum(n), 0) AS n FROM f LEFT JOIN o USING (page_id) GROUP BY ALL),
g AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(g.good) AS good, sum(g.n) AS n, (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM h) AS prior FROM g GROUP BY suffix),
ss AS (SELECT {_STRENGTH} AS m FROM s),
g2 AS (SELECT g.*, (ss.m * s.prior + s.good) / (ss.m + s.n) AS prior FROM g JOIN s USING (suffix), ss),
gs AS (SELECT {_STRENGTH} AS m FROM g2),
h2 AS (SELECT h.*, (gs.m * g2.prior + g2.good) / (gs.m + g2.n) AS prior FROM h JOIN g2 USING (domain, suffix), gs),
hs AS (SELECT {_STRENGTH} AS m FROM h2),
ab AS (SELECT name, hs.m * prior + good AS a, hs.m * (1 - prior) + n - good AS b FROM h2, hs),
z AS (SELECT name, a, b, (0.5e0 - a / (a + b)) / sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS z FROM ab),
t AS (
  SELECT name, a, b, z, exp(sum(ln(0.5e0 * (a + b + k) / (a + 1 + k))) OVER w) AS below, exp(sum(ln(0.5e0 * (a + b + k) / (b + 1 + k))) OVER w) AS above
  FROM z, unnest(range(0, 400)) AS s(k) WINDOW w AS (PARTITION BY name ORDER BY k)),
up AS (
  SELECT name, a / (a + b) AS rate, CASE WHEN a + b <= 500 THEN (1 + sum(below)) / a / ((1 + sum(below)) / a + (1 + sum(above)) / b)
    ELSE 1 / (1 + exp(-(1.5976e0 * z + 0.07056e0 * pow(z, 3)))) END AS p_low FROM t GROUP BY name, a, b, z),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM m)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN p_low > 0.95 THEN 'block' ELSE 'allow' END AS verdict,
  round(rate, 6) AS rate, round(p_low, 6) AS p_low
FROM r LEFT JOIN up USING (name)""",
}
