"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

Documents with equal shingle sets form a class, and its smallest id stands for it. Classes whose signatures
agree in a band share a bucket. No bucket is expanded into its pairs: its members are compared with one
leader, links are grouped, and only members of different groups are compared further. Those that still stand
apart, mostly because a common passage brought them together, are joined on the rarest quarter of their
shingles, of which two sets that are similar enough share one at least.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_TABLE, gathered, id_and_text, kept, per_salt, salted, slices, spread_join, written

U = np.uint64
_STEP, _MIX1, _MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_ODD = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], U)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit function of 64 bits."""
    x = (x ^ (x >> U(30))) * _MIX1
    x = (x ^ (x >> U(27))) * _MIX2
    return x ^ (x >> U(31))


class Shingler:
    """Sets of hashed word shingles; words are hashed once while they stay in a cache of bounded size, in bytes."""

    def __init__(self, width: int = 5, most_bytes: int = 16 << 20):
        self.width, self.most, self.hashes, self.held = width, most_bytes, {}, 0

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct hashes for each text; a shorter text is one shingle, one without words none."""
        import xxhash

        kept, digest, width, out = self.hashes, xxhash.xxh3_64_intdigest, self.width, []
        for text in texts:
            words = text.encode().translate(LOWER_TABLE).split()
            for w in set(words).difference(kept):
                kept[w] = digest(w)
                self.held += len(w) + 64
            h = np.fromiter(map(kept.__getitem__, words), U, len(words))
            if self.held > self.most:
                kept.clear()
                self.held = 0
            if not len(h):
                out.append(h)
                continue
            k = min(width, len(h))
            n = len(h) - k + 1
            total = np.full(n, k, U) * _STEP
            for i in range(k):
                total += mixed(h[i : i + n] + U(i)) * _ODD[i]
            out.append(np.unique(mixed(total)))
        return out


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (sets x m) as unsigned 32-bit integers.

    Each element gives slot p(j) the value j + r(j), for j = 0, 1, .. with p a random permutation of its own, so
    that an element's ranks over the slots are correlated. A set stops at the first j that no slot exceeds.
    The high byte holds j, the rest r(j). The permutation is not stored: its j-th entry follows from the swaps.
    """
    counts = np.array([len(s) for s in sets])
    best = np.full((len(sets), m), 0xFFFFFFFF, np.uint32)
    x = np.concatenate(sets) if len(sets) else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), counts)
    flat, swaps = best.reshape(-1), []
    for j in range(m):
        if not len(x):
            break
        draw = mixed(x + U((j + 1) * int(_STEP) % 2**64))
        k = (U(j) + (((draw >> U(40)) * U(m - j)) >> U(24))).astype(np.int16)
        slot = k.copy()
        for t in range(j - 1, -1, -1):
            slot[slot == swaps[t]] = t
        swaps.append(k)
        value = (U(j << 24) | (draw & U(0xFFFFFF))).astype(np.uint32)
        np.minimum.at(flat, owner * m + slot, value)
        members = np.flatnonzero(np.bincount(owner, minlength=len(sets)))
        unfinished = np.zeros(len(sets), bool)
        unfinished[members] = best[members].max(1) >= np.uint32(min((j + 1) << 24, 0xFFFFFFFF))
        go = unfinished[owner]
        if not go.all():
            x, owner, swaps = x[go], owner[go], [s[go] for s in swaps]
    return best


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets x bands) bucket keys; the band's number is part of a key."""
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(U)
    total = np.arange(bands, dtype=U) * _STEP
    for i in range(rows):
        total = mixed(total + parts[:, :, i] * _ODD[i % len(_ODD)] + U(i))
    return total.view(np.int64)


def _shingler(width: int) -> Shingler:
    return kept(("shingler", width), lambda: Shingler(width))


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of (doc_id, text)."""

    def sign(batches):
        import xxhash

        for batch in batches:
            for ids, texts in slices(batch, 4 << 20):
                sets = _shingler(width).sets(texts)
                keys = band_keys(super_minhash(sets, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))],
                    ["doc_id", "n_shingles", "set_key", "bands"],
                )

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, most_broadcast: int) -> DataFrame:
    """(a, b, linked) of pairs (a, b), by the full shingle sets of their texts; an id with several texts has them all."""

    def verify(batches):
        import xxhash

        last: dict[tuple, np.ndarray] = {}  # by id and text: rows of an id with several texts are each compared with their own
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                a, b, texts_a = (rows.column(i).to_pylist() for i in range(3))
                keys = [(i, xxhash.xxh3_128_digest(t)) for i, t in zip(a, texts_a)]
                if len(last) > 512:
                    last.clear()
                missing = {k: t for k, t in zip(keys, texts_a) if k not in last}
                last.update(zip(missing, _shingler(width).sets(list(missing.values()))))
                linked = []
                for k, y in zip(keys, _shingler(width).sets(rows.column(3).to_pylist())):
                    x = last[k]
                    shared = np.intersect1d(x, y, assume_unique=True).size
                    linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked)], ["a", "b", "linked"])

    own = only(texts, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), most_broadcast)
    with_b = spread_join(pairs, own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b", "a")
    with_both = spread_join(with_b, own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a", "b", sizes=pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    return written(with_both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long, linked boolean"), "verified")


def only(texts: DataFrame, ids: DataFrame, most_broadcast: int) -> DataFrame:
    """Rows of ``texts`` with one of the ``ids``; these are broadcast up to a number of them, and joined by a shuffle beyond."""
    ids = written(gathered(ids), "ids")
    return texts.join(F.broadcast(ids) if ids.count() <= most_broadcast else ids, "id", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the edges (a, b), the smallest node that it is connected with.

    A union-find in each task turns its edges into stars; then stars are hooked onto smaller roots and flattened
    across tasks until nothing changes.
    """

    def unite(batches):
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
            if len(parent) > 1_000_000:
                yield _stars(parent, find)
                parent.clear()
        if parent:
            yield _stars(parent, find)

    stars = written(gathered(edges.select("a", "b").mapInArrow(unite, "a long, b long").distinct()), "stars")  # a > b
    seen = None
    while True:
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
        large = spread_join(both.where("b > a"), least, "a", "b").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(low, "a").where("b > root").select(F.col("b").alias("a"), F.col("root").alias("b"))
        stars = written(gathered(small.union(low.select("a", F.col("root").alias("b"))).distinct()), "stars")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(now)


def _stars(parent: dict, find) -> pa.RecordBatch:
    rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], ["a", "b"])


def _grouped(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``groups`` (node, root) after the roots that ``edges`` (a, b of nodes) connect have become one."""
    a, b = groups.select(F.col("node").alias("a"), F.col("root").alias("ra")), groups.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    between = spread_join(spread_join(edges, a, "a", "b"), b, "b", "a").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    joined = components(between).select(F.col("node").alias("root"), F.col("root").alias("new"))
    return written(gathered(spread_join(groups, joined, "root", "node", "left").select("node", F.coalesce("new", "root").alias("root"))), "groups")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, bands: int = 36, rows: int = 5, leaders: int = 2, most_broadcast: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Two documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more are linked. With 36
    bands of 5 rows, a pair at 0.75 shares no bucket with a probability of 6e-5, one at 0.8 of 6e-7. Null and empty
    texts have no shingles and no links. Rows with one id are one document, linked by any of its texts. A row
    with a null id has no links, a null component, and is kept. A similarity of exactly ``percent`` / 100 is a link. Very long texts have all
    their shingles. An empty table gives no rows. Other columns, whatever their names, play no part.
    """
    rows_in = id_and_text(docs, id_col, text_col)
    signatures = written(signed(rows_in, width, bands, rows), "signatures")
    usable = signatures.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    own_rep = spread_join(usable, classes.select("set_key", "rep"), "set_key", "doc_id", sizes=classes.select("set_key", "n"))
    members = written(own_rep.select("doc_id", "rep", F.when(F.col("doc_id") == F.col("rep"), F.struct("n_shingles", "bands")).alias("own")), "members")
    entries = members.where("own IS NOT NULL").select("rep", F.col("own.n_shingles").alias("size"), F.explode("own.bands").alias("bucket"))
    shared = written(gathered(entries.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").select("bucket", "n")), "buckets")
    dealt, hot = salted(entries, "bucket", "rep", shared)
    entries = written(dealt.join(per_salt(shared, "bucket", hot), ["bucket", "_salt"]).distinct(), "entries")

    one = members.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id", "low")
    same_id = members.join(one, "doc_id").where("rep != low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    groups = entries.select(F.col("rep").alias("node")).union(same_id.select("a")).union(same_id.select("b")).distinct()
    groups = _grouped(written(gathered(groups.select("node", F.col("node").alias("root"))), "groups"), written(gathered(same_id.distinct()), "same-id"))
    texts = written(only(rows_in.select(F.col("doc_id").alias("id"), "text"), entries.select(F.col("rep").alias("id")).distinct(), most_broadcast), "texts")

    # a class that meets many others is near the middle of a family of copies, and leads
    middle = entries.groupBy("rep").agg((-F.sum("n")).alias("order"))
    entries = written(entries.drop("n").join(middle, "rep"), "ordered")

    tried = None
    for turn in range(leaders + 1):
        open_ = _open(entries, groups, hot)
        if turn < leaders:
            lead = open_.groupBy("bucket").agg(F.min(F.struct("order", "rep", "root", "size")).alias("lead"))
            met = open_.join(per_salt(lead, "bucket", hot), ["bucket", "_salt"]).where("root != lead.root").select(F.col("lead.rep").alias("lead"), F.col("rep").alias("member"), F.col("lead.size").alias("size_a"), F.col("size").alias("size_b"))
            # sets whose sizes differ more can't be similar enough
            met = met.where(F.expr(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)")).groupBy("lead", "member").agg(F.count(F.lit(1)).alias("n"))
            if turn == 0:  # the first comparison: with the leader that a class meets in most buckets
                met = met.groupBy("member").agg(F.max(F.struct("n", (-F.col("lead")).alias("minus"))).alias("best")).select((-F.col("best.minus")).alias("lead"), "member")
            pairs = met.select(F.least("lead", "member").alias("a"), F.greatest("lead", "member").alias("b")).distinct()
        else:
            pairs = _sharing_rare(open_.select("rep", "root").distinct(), texts, width, percent, most_broadcast)
        pairs = written(gathered(pairs), "met")
        pairs = pairs if tried is None else written(gathered(pairs.join(tried, ["a", "b"], "left_anti")), "pairs")
        if pairs.isEmpty():
            continue
        done = verified(pairs, texts, width, percent, most_broadcast)
        groups = _grouped(groups, done.where("linked").select("a", "b"))
        tried = pairs if tried is None else tried.union(pairs)

    found = spread_join(members.select("doc_id", "rep"), groups.withColumnRenamed("node", "rep"), "rep", "doc_id", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component"))
    out = signatures.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _open(entries: DataFrame, groups: DataFrame, hot: DataFrame) -> DataFrame:
    """Entries, with their groups, of buckets in which more than one group meets."""
    labelled = entries.join(groups.withColumnRenamed("node", "rep"), "rep")
    mixed_ = labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    return written(labelled.join(per_salt(mixed_, "bucket", hot), ["bucket", "_salt"]), "open")


def _sharing_rare(apart: DataFrame, texts: DataFrame, width: int, percent: int, most_broadcast: int) -> DataFrame:
    """(a, b): classes (rep, root) of different groups that may be similar enough by their rarest shingles.

    Of a set of n, the n - ceil(n * percent / 100) + 1 rarest are taken, in an order that is the same for all sets: sets
    that are similar enough share one of these. How rare a shingle is, is counted over all these sets. At the
    first that two share, what comes before it in either is not shared, so that the rest of either one must be as
    large as the overlap that the similarity asks for. For the smaller of the two this leaves fewer of its rarest
    ones, its head, so that shingles are joined only from heads to sets that aren't smaller.
    """
    own = only(texts, apart.select(F.col("rep").alias("id")), most_broadcast)

    def split(batches):
        import xxhash

        for batch in batches:
            for ids, part in slices(batch, 2 << 20):
                sets = _shingler(width).sets(part)
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], U).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(np.repeat(keys, sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))], ["rep", "set", "size", "shingle"])

    shingles = written(own.select("id", "text").mapInArrow(split, "rep long, set long, size long, shingle long").distinct(), "shingles")
    counts = written(shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "rarity")
    place = (F.row_number().over(Window.partitionBy("rep", "set").orderBy(F.coalesce("n", F.lit(1)), "shingle")) - 1).alias("place")
    ranked = spread_join(shingles, counts, "shingle", "rep", "left", sizes=counts).select("rep", "set", "size", "shingle", "n", place)
    rare = ranked.where(F.expr(f"n > 1 AND place <= size - ceil({percent} * size / 100)")).withColumn("head", F.expr(f"{100 + percent} * (size - place) >= {2 * percent} * size"))
    rare = written(rare.join(apart, "rep"), "rare")
    several = rare.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("head").alias("any_head"), F.count(F.lit(1)).alias("n")).where("low < high AND any_head").select("shingle", "n")
    several = written(gathered(several), "several")
    dealt, hot = salted(rare.drop("n"), "shingle", "rep", several)
    met = written(dealt.join(per_salt(several.select("shingle"), "shingle", hot), ["shingle", "_salt"]), "rare-shared")
    rest = (F.col("size") - F.col("place")).alias
    x = met.select("shingle", "_salt", F.col("rep").alias("x"), F.col("root").alias("root_x"), F.col("size").alias("size_x"), rest("rest_x"))
    y = per_salt(met.where("head").select("shingle", F.col("rep").alias("y"), F.col("root").alias("root_y"), F.col("size").alias("size_y"), rest("rest_y")), "shingle", hot)
    bounds = F.expr(f"root_x != root_y AND size_y <= size_x AND 100 * size_y >= {percent} * size_x AND {100 + percent} * least(rest_x, rest_y) >= {percent} * (size_x + size_y)")
    y = y.select(F.col("shingle").alias("same"), F.col("_salt").alias("salt_y"), "y", "root_y", "size_y", "rest_y")
    both = x.join(y, (F.col("shingle") == F.col("same")) & (F.col("_salt") == F.col("salt_y")) & bounds)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
