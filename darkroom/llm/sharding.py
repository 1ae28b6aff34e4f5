"""Shards of near-equal size by best-fit-decreasing bin packing of groups that stay together."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, written


class CapacityTree:
    """Bins by remaining capacity in a binary tree over its bits: balanced by construction, O(bits) for each call."""

    def __init__(self, most: int):
        self.bits = max(1, most.bit_length())
        self.count: dict[tuple[int, int], int] = {}  # (level, prefix) -> bins below
        self.bins: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        for level in range(self.bits + 1):
            key = level, room >> (self.bits - level)
            self.count[key] = self.count.get(key, 0) + by

    def put(self, room: int, bin_no: int) -> None:
        self._add(room, 1)
        self.bins.setdefault(room, []).append(bin_no)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (room, bin) with the least room that holds ``size``, else None."""
        room = self._least_from(size)
        if room is None:
            return None
        self._add(room, -1)
        return room, self.bins[room].pop()

    def _least_from(self, size: int) -> int | None:
        if size >> self.bits:
            return None
        if self.count.get((self.bits, size)):
            return size
        for level in range(self.bits, 0, -1):  # climb until there is a bin in the right-hand neighbour
            prefix = size >> (self.bits - level)
            if not prefix & 1 and self.count.get((level, prefix + 1)):
                at = prefix + 1
                for below in range(level + 1, self.bits + 1):
                    at = 2 * at + (not self.count.get((below, 2 * at)))
                return at
        return None


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, n_bins: int | None = None) -> list[list[tuple[int, int]]] | None:
    """For each (size, items) of falling size: (bin, items) in the order in which the bins are filled.

    This is what item by item gives: the tightest bin that holds an item is still the tightest for the next item of the
    same size, until none fits. New bins open as needed, up to ``n_bins``; None if that isn't enough.
    """
    tree, opened, out = CapacityTree(capacity), 0, []
    if n_bins is not None:
        for b in range(n_bins):
            tree.put(capacity, b)
    for size, left in sizes:
        dealt = []
        while left:
            found = tree.take_tightest(size)
            if found is None:
                if n_bins is not None or size > capacity:
                    return None
                found, opened = (capacity, opened), opened + 1
            room, bin_no = found
            k = min(left, room // size)
            tree.put(room - k * size, bin_no)
            dealt.append((bin_no, k))
            left -= k
        out.append(dealt)
    return out


def smallest_capacity(sizes: list[tuple[int, int]], n_bins: int, tolerance: float = 1e-6) -> list[list[tuple[int, int]]]:
    """The packing of (size, items) into ``n_bins`` at about the least capacity that is enough.

    The mean comes first, then steps that double, then bisection down to ``tolerance`` of the mean.
    """
    total = sum(s * n for s, n in sizes)
    low = max(-(-total // n_bins), sizes[0][0] if sizes else 1, 1)
    best = best_fit_decreasing(sizes, low, n_bins)
    if best is not None:
        return best
    step = max(1, int(low * tolerance))
    high = low + step
    while (best := best_fit_decreasing(sizes, high, n_bins)) is None:  # the largest size more is always enough
        low, step = high, 2 * step
        high = low + step
    finest = max(1, int(low * tolerance))
    while high - low > finest:
        middle = (low + high) // 2
        found = best_fit_decreasing(sizes, middle, n_bins)
        low, high, best = (low, middle, found) if found is not None else (middle, high, best)
    return best


def shard(docs: DataFrame, n_shards: int = 24, parts: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; sizes of shards are near equal, equal texts stay together.

    Size: UTF-8 bytes plus 8; a null text is empty. Rows with equal texts are a group, which is packed as one item by best
    fit decreasing at about the least capacity. The driver gets the sizes of items and how many there are of each: sizes
    that differ and add up to no more than all bytes are at most the square root of twice these, however many groups
    there are. A group of more than all bytes / ``n_shards`` can't be whole, for no law of near-equal sizes could hold: it is
    cut into the fewest items of whole rows that each fit in a shard. Slots count from 0 in each shard. Ties between
    groups of a size go by a hash of their text. Null and repeated ids are rows as others are, and an empty table gives no rows.
    Very long texts are groups as others are. Other columns, whatever their names, play no part.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("key"), F.monotonically_increasing_id().alias("seq")),
        "shard-rows",
    )
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.max("size").alias("row"), F.count(F.lit(1)).alias("n")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    fair = max(1, -(-total // n_shards))
    # an item: a group, or as many of its rows as fit in a shard, one row at least
    groups = groups.withColumn("most", F.expr(f"greatest(1L, {fair}L div row)")).withColumn("pieces", F.expr(f"CASE WHEN bytes > {fair}L THEN (n + most - 1) div most ELSE 1L END"))
    large = groups.where("pieces > 1").select("key", "pieces", "n", "row")  # fewer than n_shards, and each counts for a shard or more
    seq_part = F.pmod(F.xxhash64("seq"), F.lit(parts)).cast("int").alias("part")
    whole = groups.where("pieces = 1").select("key", F.lit(0).cast("long").alias("piece"), F.col("bytes").alias("item"))
    each = large.select("key", "row", "n", "pieces", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    cuts = each.select("key", "piece", F.expr("((piece + 1) * n div pieces - piece * n div pieces) * row").alias("item"))
    items = written(whole.union(cuts).withColumn("part", F.pmod(F.xxhash64("key", "piece"), F.lit(parts)).cast("int")), "shard-items")

    counts = written(items.groupBy("item", "part").agg(F.count(F.lit(1)).alias("n")), "shard-counts")
    sizes = sorted(((r["item"], r["n"]) for r in counts.groupBy("item").agg(F.sum("n").alias("n")).toLocalIterator()), reverse=True)  # a row for each size
    dealt = [] if not sizes else smallest_capacity(sizes, n_shards)
    plan = [(size, list(itertools.accumulate(k for _, k in runs)), [b for b, _ in runs]) for (size, _), runs in zip(sizes, dealt)]
    plan = docs.sparkSession.createDataFrame(plan, "item long, ends array<long>, bins array<int>")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("item").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("item", "part", before.alias("before")).join(plan, "item")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("item", "part").orderBy("key", "piece")) - 1
    bin_of = F.expr("bins[size(filter(ends, e -> e <= rank))]").alias("shard")
    placed = items.join(firsts, ["item", "part"]).withColumn("rank", rank).select("key", "piece", bin_of)

    # rows of a group that is cut are dealt to its pieces by their number in it
    in_large = rows.join(F.broadcast(large), "key")
    at_first = in_large.groupBy("key", seq_part).agg(F.count(F.lit(1)).alias("k"))
    at_first = at_first.select("key", "part", F.coalesce(F.sum("k").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    number = F.col("base") + F.row_number().over(Window.partitionBy("key", "part").orderBy("seq")) - 1
    numbered = in_large.withColumn("part", seq_part).join(F.broadcast(at_first), ["key", "part"]).withColumn("number", number)
    # piece i holds the numbers from floor(i * n / pieces) on
    piece = F.expr("((number + 1) * pieces - 1) div n").alias("piece")
    columns = ["doc_id", "size", "text_crc32", "seq"]
    of_large = numbered.select(*columns, "key", piece).join(F.broadcast(placed.join(F.broadcast(large.select("key")), "key", "left_semi")), ["key", "piece"]).select(*columns, "shard")
    small = rows.join(F.broadcast(large.select("key")), "key", "left_anti")
    of_small = spread_join(small, placed.where("piece = 0").select("key", "shard"), "key", "seq", sizes=groups.where("pieces = 1").select("key", "n")).select(*columns, "shard")

    dealt_rows = written(of_large.union(of_small).withColumn("part", seq_part), "shard-dealt")
    counts = dealt_rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))  # n_shards * parts rows
    slots = dealt_rows.withColumn("at", F.row_number().over(Window.partitionBy("shard", "part").orderBy("seq")) - 1).join(F.broadcast(first), ["shard", "part"])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"))
