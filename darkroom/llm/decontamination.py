"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations only.

A window of an item is contained in a document only if all its shingles are, so that its rarest shingle is all
of the prefix that the join needs (containment 1 leaves a prefix of one). Shingles are ranked by how often
they occur in all documents. A document's words are matched with those prefixes, positions and lengths bound
where a window can lie, and the words there are compared with the window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, gathered, spread_join, written

#: Fixed value: what separates words, as the contract states it.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
SHINGLE = 3  # words; windows of fewer words are shingles themselves


def words_of(text: Column) -> Column:
    """Lower-cased words; none for null. Splitting leaves empty strings at the ends alone."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), lambda w: w != "")


def _raw_words(text: Column) -> Column:
    """The words as written, without a lambda, so that it compiles with what follows: separators go from the ends first."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, NO_WORD))


def _shingle(words: str, at: str, size: int) -> Column:
    """A hash that shingles with the same lower-cased words share; ``lower`` takes in all of Unicode, so that more may share it."""
    return F.expr(f"xxhash64({', '.join(f'lower(get({words}, {at} + {i}))' for i in range(size))})")


def windows_of(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window_id, words, length, size) and (window_id, item): the items that hold each.

    An item with a null id or without words has no windows; items with one id count as one item.
    """
    items = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.col("item").isNotNull() & (F.size("words") > 0))
    starts = items.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("start"))
    cut = starts.select("item", F.slice("words", F.col("start") + 1, window).alias("words"))
    cut = cut.withColumn("window_id", F.md5(F.concat_ws(" ", "words"))).withColumn("length", F.size("words"))
    return cut.select("window_id", "words", "length", F.least("length", F.lit(SHINGLE)).alias("size")).dropDuplicates(["window_id"]), cut.select("window_id", "item").distinct()


def _places(docs: DataFrame, keep: list, sizes: list[int]) -> DataFrame:
    """``keep``, words, n_words, at and the shingle's hash for each shingle of each document."""
    words = docs.select(*keep, _raw_words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    each = words.select(*keep, "words", "n_words", F.posexplode("words").alias("at", "word"))
    frames = [each.withColumn("shingle", _shingle("words", "at", k)).where(F.col("at") <= F.col("n_words") - k).withColumn("size", F.lit(k)) for k in sizes]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def contained_windows(docs: DataFrame, windows: DataFrame, keep: list[str], most_broadcast: int = 100_000) -> DataFrame:
    """(keep, start, length, window_id): each place of a document where a window's words stand.

    Up to ``most_broadcast`` shingles of windows are broadcast, and documents are never shuffled. Beyond that their
    shingles are counted and joined by a shuffle, and only places that a rarest shingle gives meet the texts again, so
    that the passes over the documents don't grow with the windows. ``keep`` names one document.
    """
    shingles = windows.select("window_id", "words", "length", "size", F.posexplode(F.expr("sequence(0, length - size)")).alias("i", "offset"))
    hashed = F.coalesce(*[F.when(F.col("size") == k, _shingle("words", "offset", k)) for k in range(1, SHINGLE + 1)])
    shingles = written(gathered(shingles.select("window_id", F.concat_ws(" ", "words").alias("window"), "length", "size", "offset", hashed.alias("shingle"))), "shingles")
    sizes = sorted(r[0] for r in shingles.select("size").distinct().collect())  # SHINGLE rows at most
    if not sizes:
        return docs.select(*keep, F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("window_id")).limit(0)
    few = shingles.count() <= most_broadcast
    names = shingles.select("shingle", "size").distinct()
    places = _places(docs, [], sizes).select("shingle", "size")
    if few:
        counts = places.join(F.broadcast(names), ["shingle", "size"]).groupBy("shingle", "size").count()
    else:
        counts = places.groupBy("shingle", "size").count().join(names, ["shingle", "size"])
    counts = written(gathered(counts) if few else counts, "shingle-counts")
    rarity = Window.partitionBy("window_id").orderBy(F.coalesce("count", F.lit(0)), "shingle", "offset")
    ranked = shingles.join(counts, ["shingle", "size"], "left").withColumn("rank", F.row_number().over(rarity))
    # a window whose rarest shingle is in no document is in none either
    prefixes = written(gathered(ranked.where("rank = 1 AND count > 0").select("window_id", "window", "length", "offset", "shingle", "size")), "prefixes")
    bounds = F.expr("at >= offset AND at - offset + length <= n_words")
    start = (F.col("at") - F.col("offset")).alias("start")
    same = ascii_lower(F.concat_ws(" ", F.slice("words", F.col("start") + 1, F.col("length")))) == F.col("window")
    if few:
        places = _places(docs, keep, sizes).join(F.broadcast(prefixes), ["shingle", "size"]).where(bounds)
        return places.select(*keep, "words", start, "length", "window", "window_id").where(same).select(*keep, "start", "length", "window_id")
    asked = prefixes.select("shingle").distinct().join(counts.groupBy("shingle").agg(F.sum("count").alias("n")), "shingle")
    places = _places(docs, keep, sizes).select(*keep, "n_words", "at", F.col("size").alias("words_in"), "shingle")
    met = spread_join(places, prefixes, "shingle", "at", sizes=written(asked, "asked")).where(bounds & (F.col("size") == F.col("words_in")))
    met = written(met.select(*keep, start, "length", "window", "window_id"), "places")
    texts = docs.select(*keep, _raw_words(F.col("text")).alias("words")).join(met.select(*keep).distinct(), keep, "left_semi")
    return met.join(texts.dropDuplicates(keep), keep).where(same).select(*keep, "start", "length", "window_id")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    A window is ``window`` consecutive words of an item, or all of a shorter item. Null and empty texts have no
    words and no hits. Hits are found for each distinct pair of id and text, so rows that repeat, and rows
    that share an id with other texts or none, each have their own result. Without items nothing is hit, and an empty
    table gives no rows. Items with one id count once; those with a null id or no words have no windows.
    Very long texts are split into words whole. Other columns, whatever their names, play no part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64("doc_id", "text").alias("hash")))
    windows, holders = windows_of(items, window, item_id_col, item_text_col)
    hits = written(contained_windows(keyed, windows, ["key"]).distinct(), "hits")
    lengths = hits.groupBy("key", "start").agg(F.max("length").alias("length"))
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    n_hit = lengths.withColumn("new", new).groupBy("key").agg(F.sum("new").cast("long").alias("n_hit"))
    found = spread_join(hits.select("key", "window_id").distinct(), holders, "window_id", "key").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    base = keyed.select("doc_id", "key", F.size(_raw_words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(n_hit, "key", "left").join(found, "key", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
