"""Similarity joins and clusters over shingles, vectors and hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import scalars as S
from siltstone.operators import overlaps as O
from siltstone.operators import tiles as TL
from siltstone.operators.places import placed
from siltstone.sources.shared import written


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k lower-case words (letters, digits, underscore); all words where there are fewer, none without."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), 0)

    def runs(w: Column) -> Column:
        n = F.size(w) - k + 1
        many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(k))))
        return F.array_distinct(F.when(n > 0, many).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))

    return F.element_at(F.transform(F.array(words), runs), 1)


def shingle_sets(df: DataFrame, id_col: str, text_col: str, k: int = 5) -> DataFrame:
    """(id, s array<long>): the sorted 64-bit hashes of each text's shingles, as shingles() has them.

    Words are hashed once, and runs are hashes of those, so no run is ever put together as text.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"(?U)\w+"), 0)

    def runs(w: Column) -> Column:
        n = F.size(w) - k + 1
        many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
        return F.when(n > 0, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    s = F.element_at(F.transform(F.array(hashed), runs), 1)  # bound to a variable, so that words are split once
    return df.select(F.col(id_col).alias("id"), F.sort_array(F.array_distinct(s)).alias("s"))


def jaccard_pairs(df: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(a, b, jaccard) of all pairs of at least that likeness, a < b, by prefix filtering.

    Texts with equal sets meet once: pairs are between the least ids of equal sets, and
    representatives() has the others. In an order that puts rare shingles first, two sets of
    that likeness share one among their first few, so only those are compared, within
    blocks of sets that hold nothing but shingles of several texts. Sets are made once.
    """
    return jaccard_pairs_of(written(shingle_sets(df, id_col, text_col, k)), least)


def jaccard_pairs_of(every: DataFrame, least: float) -> DataFrame:
    """jaccard_pairs() of a written table of shingle_sets()."""
    return O.jaccard_pairs(every, least)


def jaccard_components(every: DataFrame, least: float) -> DataFrame:
    """(id, component) of the pairs of jaccard_pairs_of() and of equal sets, from as few links as keep connected what these connect.

    Sets that aren't written are made twice: for their digests and for their hashes.
    """
    known = written(O.digests(every))
    same = representatives_among(known).filter("id > rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return components(O.jaccard_links(every, least, known).unionByName(same))


def representatives(df: DataFrame, id_col: str, text_col: str, k: int = 5) -> DataFrame:
    """(id, rep): the least id whose text has the same shingle set; texts without words are left out."""
    return representatives_of(written(shingle_sets(df, id_col, text_col, k)))


def representatives_of(sets: DataFrame) -> DataFrame:
    """representatives() of a written table of shingle_sets()."""
    return representatives_among(O.digests(sets))


def representatives_among(d: DataFrame) -> DataFrame:
    """representatives() of a table of digests().

    The keys of the minima are sums, so that the join has a shuffle of its own, in which
    a set that very many texts have is split.
    """
    first = d.groupBy("d1", "d2").agg(F.min("id").alias("rep")).select((F.col("d1") + F.lit(0)).alias("d1"), (F.col("d2") + F.lit(0)).alias("d2"), "rep")
    return d.join(first, ["d1", "d2"]).select("id", "rep")


def minhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", perms: int = 128, k: int = 5) -> DataFrame:
    """(id, n, signature array<long>): minima of ``perms`` hash functions; null for texts without words."""
    rows = shingle_sets(df, id_col, text_col, k)
    multipliers = (np.arange(1, perms + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            have, flat = np.flatnonzero(sizes), batch.column(1).flatten().to_numpy().view(np.uint64)
            least = np.zeros((len(sizes), perms), dtype=np.int64)
            starts = (np.cumsum(sizes) - sizes)[have]
            for j, a in enumerate(multipliers if len(have) else ()):
                least[have, j] = np.minimum.reduceat(((flat ^ (a >> np.uint64(9))) * a) >> np.uint64(32), starts).view(np.int64)
            edges = np.arange(len(sizes) + 1, dtype=np.int32) * perms
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(least.reshape(-1)), mask=pa.array(sizes == 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), lists], names=["id", "n", "signature"])

    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, n int, signature array<long>")


def signature_likeness(a: Column, b: Column) -> Column:
    """The share of equal slots; signatures of different length are an error."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("signatures differ in length")).cast("double")).otherwise(same / F.size(a))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the vertices of (a, b): the least vertex reachable, by label passing with pointer jumps.

    Labels are written to the shared folder each round, which cuts the plan; rounds grow
    with the logarithm of the longest path in usual graphs. Both sides of each join are
    written tables, so a hub's or a large component's rows are split in its shuffle; none
    of them grows a broadcast.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "c").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        low = labels.join(near.hint("merge"), "id").select("id", F.least("c", "m").alias("c"))
        jump = low.join(labels.select(F.col("id").alias("c"), F.col("c").alias("up")).hint("merge"), "c", "left").select("id", F.least("c", F.coalesce("up", "c")).alias("c"))
        new = written(jump)
        if new.join(labels.hint("merge"), ["id", "c"], "left_anti").isEmpty():
            return new.select("id", F.col("c").alias("component"))
        labels = new


def hash_classes(df: DataFrame, id_col: str, hash_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, h) of the least id of each hash, written, and the links (a, b) of all others to it."""
    first = written(df.filter(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("id")))
    rows = df.select(F.col(id_col).alias("b"), F.col(hash_col).alias("h"))
    return first, rows.join(first.select("h", F.col("id").alias("a")).hint("merge"), "h").filter("b > a").select("a", "b")


def near_values(value: Column, width: int, errors: int) -> Column:
    """All values that differ from one of ``width`` bits in at most that many bits, as an array."""
    flips = [sum(1 << i for i in bits) for n in range(errors + 1) for bits in combinations(range(width), n)]
    return F.transform(F.array(*(F.lit(x).cast("long") for x in flips)), lambda x: value.bitwiseXOR(x))


def hamming_pairs(df: DataFrame, most: int, id_col: str = "id", hash_col: str = "hash", chunks: int | None = None, block: int = TL.BLOCK) -> DataFrame:
    """(a, b, distance) of 64-bit hashes within ``most`` bits, a < b.

    Equal hashes meet once: the least id of each stands for it, and the others pair with
    that one. By default hashes meet in tiles, whose strips pass on their near pairs: bits
    cut into chunks tell little apart at ten bits and more, while a hash is in few tiles.
    ``chunks`` cuts bits all the same. Two hashes so near differ in at most most // chunks
    bits of some chunk, so one of them meets the other under that chunk with the
    allowed errors put in; this suits few errors among very many hashes.
    """
    first, copies = hash_classes(df, id_col, hash_col)
    copies = copies.select("a", "b", F.lit(0).alias("distance"))
    if chunks is None:
        kind = df.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = TL.whole(batches)
            ids, h = t.column("id").to_numpy(), t.column("h").to_numpy().view(np.uint64)
            one, two = TL.sides(t)
            same = len(one) == len(ids) == len(two)
            for x in TL.strips(one, two):
                distance = np.bitwise_count(h[x][:, None] ^ h[two][None, :])
                r, c = TL.where(distance <= most)
                a, b, d = ids[x[r]], ids[two[c]], distance[r, c].astype(np.int32)
                if same:
                    a, b, d = a[a < b], b[a < b], d[a < b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)], names=["a", "b", "distance"])

        met = TL.tiles(first, TL.n_blocks(first.count(), block)).groupBy("i", "j")
        return met.applyInArrow(run, f"a {kind}, b {kind}, distance int").unionByName(copies)
    n = chunks
    edges = [64 * k // n for k in range(n + 1)]
    widths = [edges[k + 1] - edges[k] for k in range(n)]
    part = lambda k: F.shiftrightunsigned(F.shiftleft(F.col("h"), 64 - edges[k + 1]), 64 - widths[k])
    named = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    exact = F.array(*(named(k, part(k)) for k in range(n)))
    with_errors = F.flatten(F.array(*(F.transform(near_values(part(k), widths[k], most // n), partial(named, k)) for k in range(n))))
    x = first.select(F.explode(exact).alias("c"), F.col("id").alias("a"), F.col("h").alias("ha"))
    y = first.select(F.explode(with_errors).alias("c"), F.col("id").alias("b"), F.col("h").alias("hb"))
    pairs = x.hint("merge").join(y, "c").filter("a < b").withColumn("distance", S.hamming(F.col("ha"), F.col("hb"))).filter(F.col("distance") <= most)
    return pairs.select("a", "b", "distance").distinct().unionByName(copies)


def hamming_links(df: DataFrame, most: int, id_col: str = "id", hash_col: str = "hash", block: int = TL.BLOCK) -> DataFrame:
    """(a, b) of 64-bit hashes: of the pairs within ``most`` bits, enough to keep connected what they connect; fewer for each tile than it has rows."""
    first, copies = hash_classes(df, id_col, hash_col)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = TL.whole(batches)
        ids, h = t.column("id").to_numpy(), t.column("h").to_numpy().view(np.uint64)
        one, two = TL.sides(t)
        label = np.arange(len(ids))
        for x in TL.strips(one, two):
            r, c = TL.where(np.bitwise_count(h[x][:, None] ^ h[two][None, :]) <= most)
            label = TL.hooked(label, x[r], two[c])
        at = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[label[at]]), pa.array(ids[at])], names=["a", "b"])

    met = TL.tiles(first, TL.n_blocks(first.count(), block)).groupBy("i", "j")
    return met.applyInArrow(run, f"a {kind}, b {kind}").unionByName(copies)


def sign_hash(vector: Column) -> Column:
    """The signs of the first 64 elements as bits: a stand-in for a perceptual hash."""
    bits = F.transform(F.slice(vector, 1, 64), lambda v, i: F.when(v > 0, F.expr("1L")).otherwise(F.expr("0L")))
    text = F.array_join(F.transform(bits, lambda b: b.cast("string")), "")
    return F.conv(text, 2, -10).cast("long")


def knn(df: DataFrame, k: int, least: float, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = TL.BLOCK) -> DataFrame:
    """(a, b, cosine): the k nearest other vectors of each, of at least that cosine; exact, in blocks.

    Of equally near ones, the least ids count first. Equal vectors stand as one class
    under their least id. Classes meet in tiles, each of which passes on k + 1 classes for
    each of its own at most, itself among them, and multiplies a strip at a time. The first
    k + 1 rows of these serve all rows of the class. Rows without a vector have no neighbours.
    """
    every = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("v IS NOT NULL")
    classes = written(every.groupBy("v").agg(F.min("id").alias("id")))
    members = written(every.join(classes.select("v", F.col("id").alias("c")).hint("merge"), "v").select("id", "c"))
    kind = members.schema["id"].dataType.simpleString()

    def nearest(m: np.ndarray, x: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest rows of ``two`` to each row of a strip: (row, other, cosine)."""
        sims = m[x] @ m[two].T
        same = np.searchsorted(two, x)
        own = np.flatnonzero((same < len(two)) & (two[np.minimum(same, len(two) - 1)] == x))
        sims[own, same[own]] = np.where(sims[own, same[own]] > 0.5, 1.0, 0.0)
        take = min(k + 1, len(two))
        ok = sims >= least
        many = np.flatnonzero(ok.sum(axis=1) > 16 * take)
        if len(many):
            ok[many] &= sims[many] >= np.partition(sims[many], len(two) - take, axis=1)[:, -take][:, None]
        r, c = TL.where(ok)
        s = sims[r, c]
        order = np.lexsort((c, -s, r))  # rows of a tile ascend by id
        r, c, s = r[order], c[order], s[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < take
        return x[r[first]], two[c[first]], s[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = TL.whole(batches)
        ids, m = t.column("id").to_numpy(), TL.unit_rows(t.column("v"))
        one, two = TL.sides(t)
        for p, q in ((one, two),) if len(one) == len(ids) == len(two) else ((one, two), (two, one)):
            for x in TL.strips(p, q):
                a, b, s = nearest(m, x, q)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(s)], names=["a", "b", "cosine"])

    near = TL.tiles(classes, TL.n_blocks(classes.count(), block_rows)).groupBy("i", "j").applyInArrow(run, f"a {kind}, b {kind}, cosine double")
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    first = lambda pairs, most: pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most).drop("r")
    low = members.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("id"))).filter(F.col("r") <= k + 1)
    shown = first(near, k + 1).join(low.select(F.col("c").alias("b"), F.col("id").alias("m")).hint("merge"), "b").select("a", F.col("m").alias("b"), "cosine")
    pairs = members.join(first(shown, k + 1).withColumnRenamed("a", "c").hint("merge"), "c").filter("id <> b").select(F.col("id").alias("a"), "b", "cosine")
    return first(pairs, k)


def semantic_groups(near: DataFrame) -> DataFrame:
    """(id, group, distance): components of near pairs; distance is 1 less the least likeness among the group's own pairs."""
    c = components(near.select("a", "b"))
    worst = near.join(c.select(F.col("id").alias("a"), "component").hint("merge"), "a").groupBy("component").agg((1 - F.min("cosine")).alias("distance"))
    return c.join(worst, "component").select("id", F.col("component").alias("group"), "distance")


def document_keep(members: DataFrame) -> DataFrame:
    """Members (component, id, size, mtime) with the one to keep: the largest, then newest, then first."""
    best = members.groupBy("component").agg(F.max_by("id", F.struct("size", "mtime", -F.col("id"))).alias("keep_id"))
    return members.join(best, "component").withColumn("is_keep", F.col("id") == F.col("keep_id"))


def bursts(shots: DataFrame, group: list[str], time_col: str, gap: float, id_col: str = "id") -> DataFrame:
    """Rows with burst: runs of one group in which neighbours are at most ``gap`` seconds apart.

    Neighbours in time link a run, so no pairs are made. Groups are cut into stretches of
    time; what a stretch begins with follows from the last time of the one before, so a
    group of very many rows is no one task's work. Rows without time are bursts of their own.
    """
    cut = shots.withColumn("_x", F.coalesce(F.floor(F.col(time_col) / (256 * gap)), F.lit(-(2**62))))
    key = [*group, "_x"]
    order = Window.partitionBy(*key).orderBy(time_col, id_col)
    new = F.when(F.row_number().over(order) == 1, 0).when(F.col(time_col) - F.lag(time_col).over(order) <= gap, 0).otherwise(1)
    rows = cut.withColumn("_n", new).withColumn("_i", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = cut.withColumn("_n", new).groupBy(*key).agg(F.min(time_col).alias("_a"), F.max(time_col).alias("_z"), F.sum("_n").alias("_m"))
    by_x = Window.partitionBy(*group).orderBy("_x")
    first = F.when(F.col("_a") - F.lag("_z").over(by_x) <= gap, 0).otherwise(1)
    ends = ends.withColumn("_f", first)
    ends = ends.withColumn("_o", F.sum(F.col("_f") + F.col("_m")).over(by_x.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"e.{c}")) for c in key]
    both = rows.alias("l").join(ends.select(*key, "_o").alias("e"), same)
    return both.select(*(F.col(f"l.{c}") for c in shots.columns), (F.col("_o") + F.col("_i")).alias("burst"))


def alike_bursts(shots: DataFrame, group: list[str], time_col: str, hash_col: str, gap: float, most: int, id_col: str = "id") -> DataFrame:
    """(id, burst): components of links between rows of one group at most ``gap`` seconds and ``most`` bits apart.

    Equal hashes of one group and time bucket of ``gap`` seconds are linked anyway and
    stand as one class; classes of one bucket are linked by their bits alone, those of
    neighbouring buckets if the last time of one and the first of the next are near
    enough. Classes meet on a chunk of bits that near hashes share, in shuffles, as their
    small files say too little of what a broadcast would hold. A row without time
    or hash is a burst of its own; ``burst`` is the least id.
    """
    alone = F.when(F.col(time_col).isNull() | F.col(hash_col).isNull(), F.col(id_col))
    rows = shots.select(F.struct(*group).alias("g"), F.floor(F.col(time_col) / gap).alias("t"), F.col(hash_col).alias("h"), alone.alias("x"), F.col(time_col).alias("at"), F.col(id_col).alias("id"))
    key = ["g", "t", "h", "x"]
    every = written(rows.groupBy(*key).agg(F.min("id").alias("r"), F.min("at").alias("lo"), F.max("at").alias("hi")))
    classes = every.filter("x IS NULL")
    edges = [64 * k // (most + 1) for k in range(most + 2)]
    cut = [F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(F.shiftleft(F.col("h"), 64 - edges[k + 1]), 64 - (edges[k + 1] - edges[k])).alias("v")) for k in range(most + 1)]
    keyed = written(classes.withColumn("c", F.explode(F.array(*cut))))
    x = keyed.select("g", "t", "c", F.col("r").alias("a"), F.col("h").alias("ha"), "hi")
    y = keyed.withColumn("later", F.explode(F.array(F.lit(0), F.lit(1)))).select("g", (F.col("t") - F.col("later")).alias("t"), "c", "later", F.col("r").alias("b"), F.col("h").alias("hb"), "lo")
    near = F.when(F.col("later") == 0, F.col("a") < F.col("b")).otherwise(F.col("lo") - F.col("hi") <= gap)
    links = x.hint("merge").join(y, ["g", "t", "c"]).filter(near & (S.hamming(F.col("ha"), F.col("hb")) <= most)).select("a", "b").distinct()
    found = components(links.unionByName(every.select(F.col("r").alias("a"), F.col("r").alias("b"))))
    named = every.join(found.select(F.col("id").alias("r"), F.col("component").alias("burst")).hint("merge"), "r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key]
    return rows.alias("l").join(named.alias("n").hint("merge"), same).select("l.id", "n.burst")


def version_chain(members: DataFrame, chain: str = "chain_id", stem: str = "stem", time_col: str = "mtime", id_col: str = "id") -> DataFrame:
    """Members with rank, position (oldest first), whether the chain's signals agree, and the one to keep if so.

    Signals disagree if a higher rank is older than some lower one; equal ranks or times don't count.
    """
    w = members.withColumn("version_rank", S.version_rank(F.col(stem)))
    w = placed(w, chain, (F.coalesce("version_rank", F.lit(-1.0)), F.col(time_col), F.col(id_col)), "_n").withColumn("position", F.col("at").cast("int"))
    by_rank = w.filter("version_rank IS NOT NULL").groupBy(chain, "version_rank").agg(F.min(time_col).alias("lo"), F.max(time_col).alias("hi"))
    lower = Window.partitionBy(chain).orderBy("version_rank").rowsBetween(Window.unboundedPreceding, -1)
    agree = by_rank.withColumn("before", F.max("hi").over(lower)).groupBy(chain).agg(F.bool_and(F.coalesce(F.col("lo") >= F.col("before"), F.lit(True))).alias("agree"))
    out = w.join(agree, chain, "left").withColumn("signals_agree", F.coalesce("agree", F.lit(True))).drop("agree")
    return out.withColumn("is_keep", F.col("signals_agree") & (F.col("at") == F.col("_n") - 1)).drop("at", "_n")
