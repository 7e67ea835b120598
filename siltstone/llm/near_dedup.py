"""Near-duplicate documents: b-bit MinHash signatures, a multi-index Hamming join, and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._blocks import BLOCK_BYTES, blocks, mix, own_shuffle, release, text_batches, texts_of, word_codes, word_hashes, written

#: Signature: CHUNKS chunks of WIDTH minima, each cut to BITS bits. A chunk may have one
#: error, so all pairs that differ in at most 2 * CHUNKS - 1 minima share a key.
CHUNKS, WIDTH, BITS = 15, 7, 16
#: Rounds of links to leaders before pairs that are still apart are compared.
ROUNDS = 2
#: Bits of a set's bitmap for each of its members, about, and the least bits.
BITMAP_EACH, LEAST_BITS = 8, 512
#: Text bytes of a block whose sets are passed on whole.
SET_BLOCK = 3 << 20
#: Signatures whose keys are passed on at once.
KEY_ROWS = 1024
#: Rows of one key that meet in one task at most; larger groups are cut into blocks against blocks.
BLOCK_ROWS = 4096
GOLD = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIERS = mix(np.arange(1, CHUNKS * WIDTH + 1, dtype=np.uint64) * GOLD) | np.uint64(1)


def shingle_sets(column: pa.Array, words_each: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles, with A-Z in lower case.

    A text of fewer words than a shingle has its whole sequence as the one shingle;
    texts without words have none.
    """
    codes, offsets, words = word_codes(pc.ascii_lower(texts_of(column)))
    h = word_hashes(words)[codes] if len(codes) else np.empty(0, dtype=np.uint64)
    n = max(0, len(h) - words_each + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(words_each):
        rolled = rolled * GOLD + h[k : k + n]
    rolled = mix(rolled)
    out = []
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        count = high - low
        if count >= words_each:
            out.append(np.unique(rolled[low : high - words_each + 1]))
        elif count:
            whole = np.uint64(count)
            with np.errstate(over="ignore"):
                for x in h[low:high]:
                    whole = whole * GOLD + x
            out.append(mix(np.array([whole])))
        else:
            out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The low BITS bits of the minima of each non-empty set under CHUNKS * WIDTH hash functions."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), CHUNKS * WIDTH), dtype=np.uint16)
    for j, a in enumerate(MULTIPLIERS):
        least = np.minimum.reduceat(((flat ^ (a >> np.uint64(7))) * a) >> np.uint64(24), starts)
        out[:, j] = mix(least) & np.uint64((1 << BITS) - 1)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """The keys of each signature: each chunk with each one of its minima left out."""
    n = len(signature)
    place = mix(np.arange(1, CHUNKS * WIDTH + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    parts = mix(signature.astype(np.uint64) * GOLD + place).reshape(n, CHUNKS, WIDTH)
    return mix(parts.sum(axis=2, dtype=np.uint64)[:, :, None] - parts + place.reshape(CHUNKS, WIDTH)).reshape(n, CHUNKS * WIDTH)


def document_signatures(df: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, d1, d2, signature): set size, 128-bit digest of the set, b-bit signature; nulls without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK_BYTES):
            sets = shingle_sets(block.column(1), shingle)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            have = np.flatnonzero(sizes)
            sig: list = [None] * len(sets)
            d = np.zeros((2, len(sets)), dtype=np.int64)
            if len(have):
                for i, row in zip(have, signatures([sets[i] for i in have]), strict=True):
                    sig[i] = row.tobytes()
                    d[0, i] = mix(sets[i]).sum(dtype=np.uint64).view(np.int64)
                    d[1, i] = mix(sets[i] ^ GOLD).sum(dtype=np.uint64).view(np.int64)
            none = sizes == 0
            columns = [block.column(0), pa.array(sizes), pa.array(d[0], mask=none), pa.array(d[1], mask=none), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "d1", "d2", "signature"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_shingles long, d1 long, d2 long, signature binary")


def keys_of(signed: DataFrame) -> DataFrame:
    """(id, key, at): all chunk keys of each signature, with the chunk and the minimum left out as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1)
                ids = batch.column(0).to_numpy()
                for low in range(0, len(ids), KEY_ROWS):
                    keys = chunk_keys(sig[low : low + KEY_ROWS])
                    n, m = keys.shape
                    columns = [np.repeat(ids[low : low + n], m), keys.reshape(-1).view(np.int64), np.tile(np.arange(m, dtype=np.int16), n)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "key", "at"])

    return signed.select("id", "signature").mapInArrow(run, "id long, key long, at short")


def bitmap(members: np.ndarray) -> bytes:
    """A bitmap of hashes whose length is a power of two that grows with the set; longer ones fold onto shorter ones."""
    bits = LEAST_BITS
    while bits < BITMAP_EACH * len(members):
        bits *= 2
    out = np.zeros(bits, dtype=bool)
    out[(members & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def set_table(df: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, signature, bits, shingles array<long>): the full set of each document, its bitmap and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=SET_BLOCK):
            sets = shingle_sets(block.column(1), shingle)
            have = [i for i, s in enumerate(sets) if len(s)]
            if not have:
                continue
            sets = [sets[i] for i in have]
            edges = np.cumsum([0, *map(len, sets)])
            shingles = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            columns = [block.column(0).take(pa.array(have)), pa.array(np.diff(edges)), pa.array([r.tobytes() for r in signatures(sets)]), pa.array([bitmap(x) for x in sets]), shingles]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "signature", "bits", "shingles"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, signature binary, bits binary, shingles array<bigint>")


def may_link(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows (x down, y across) their bitmaps allow to be linked; never misses a link.

    A bit of one set alone stands for at least one member that the other lacks.
    """
    only_x = np.bitwise_count(x[:, None, :] & ~y[None, :, :]).sum(axis=2, dtype=np.int64)
    only_y = np.bitwise_count(y[None, :, :] & ~x[:, None, :]).sum(axis=2, dtype=np.int64)
    common = np.minimum(nx[:, None] - only_x, ny[None, :] - only_y)
    return 100 * common >= percent * (nx[:, None] + ny[None, :] - common)


def folded(rows: list[bytes], words: int) -> np.ndarray:
    """Bitmaps of one length as rows of 64-bit words, folded onto ``words`` words."""
    m = np.frombuffer(b"".join(rows), dtype="<u8").reshape(len(rows), -1)
    while m.shape[1] > words:
        m = m[:, : m.shape[1] // 2] | m[:, m.shape[1] // 2 :]
    return m


def first_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of the first key that the signatures of each pair share, -1 for none."""
    differ = (a != b).reshape(len(a), CHUNKS, WIDTH)
    errors = differ.sum(axis=2)
    chunk = (errors <= 1).argmax(axis=1)
    rows = np.arange(len(a))
    return np.where(errors[rows, chunk] <= 1, chunk * WIDTH + differ[rows, chunk].argmax(axis=1), -1)


def apart_pairs(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a key's rows in different components that may be linked, at the first key that they share."""
    ids, comp, n, at = (table[c].to_numpy() for c in ("id", "component", "n", "at"))
    side = table["side"].to_numpy()  # 1: to be compared with all, 2: one of all, 3: both
    sig = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint16).reshape(len(ids), -1)
    raw = table["bits"].to_pylist()
    length = np.array([len(r) // 8 for r in raw])
    out_a, out_b = [], []
    mine, all_ = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    lone = np.isin(ids, ids[mine])
    for la in np.unique(length[mine]):
        for lb in np.unique(length[all_]):
            i, j = mine[length[mine] == la], all_[length[all_] == lb]
            if not len(i) or not len(j) or max(la, lb) * percent > 200 * min(la, lb):
                continue  # sets of such different sizes can't be linked
            words = int(min(la, lb))
            x, y = folded([raw[k] for k in i], words), folded([raw[k] for k in j], words)
            step_j = max(1, (1 << 21) // words // 16)
            for p in range(0, len(i), 16):
                for q in range(0, len(j), step_j):
                    ii, jj = i[p : p + 16], j[q : q + step_j]
                    ok = may_link(x[p : p + 16], y[q : q + step_j], n[ii], n[jj], percent) & (comp[ii][:, None] != comp[jj][None, :])
                    ok &= ~(lone[jj][None, :] & (ids[jj][None, :] < ids[ii][:, None]))  # two such rows meet once
                    r, c = np.nonzero(ok)
                    if len(r):
                        r, c = ii[r], jj[c]
                        keep = first_keys(sig[r], sig[c]) == at[r]
                        out_a.append(ids[r[keep]])
                        out_b.append(ids[c[keep]])
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): each vertex of (a, b) with the least vertex that it is connected to.

    Alternates linking all larger and all smaller neighbours to the least one until
    nothing changes; each step is written to the shared folder. Minima of neighbours
    combine before they travel, and go back to the neighbours by a join of its own
    shuffle, in which a hub's neighbours are split among tasks.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        # every vertex's neighbours, large ones linked to the least of all
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(own_shuffle(least, "u"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # then, with each vertex's smaller neighbours, linked to the least of those
        large = large.filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(own_shuffle(small, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = written(linked.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(now):
            break
        before = tuple(now)
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id").unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have ``percent`` of their union in common."""
    b = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = b.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("c", common).filter(F.col("c") * 100 >= percent * (F.size("sa") + F.size("sb") - F.col("c"))).select("a", "b")


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of each row: near-duplicate components.

    Documents are linked if 100 * common >= percent * union of their shingle sets.
    Equal sets are one class from the start. Classes that share a chunk key are
    candidates; each is first compared with the most central member of its keys, and
    links found join components. Pairs of one key that are still apart after the last
    round are ruled out by bitmaps of their sets, which never miss a link, or compared. ``component_id`` is
    the smallest id reachable. Null, empty and blank texts have empty sets and only
    themselves. Rows without an id get no component. Rows of one id are one document.
    An empty table gives no rows; other columns are ignored.
    """
    name = df.select(id_col, text_col)
    with text_batches(df.sparkSession):
        signed = written(document_signatures(name, shingle, id_col, text_col))
    first = signed.filter("n_shingles > 0 AND id IS NOT NULL").groupBy("d1", "d2").agg(F.min(F.struct("id", "signature")).alias("f"))
    classes = written(first.select("d1", "d2", F.col("f.id").alias("class"), F.col("f.signature").alias("signature")))
    labels = class_components(classes.select(F.col("class").alias("id"), "signature"), name, shingle, percent, id_col, text_col)
    named = classes.select("d1", "d2", "class").join(labels.select(F.col("id").alias("class"), "component"), "class", "left")
    named = named.select("d1", "d2", F.coalesce("component", "class").alias("component"))
    # rows without words have nothing to join by
    alone = signed.filter("d1 IS NULL").select("id", "n_shingles", F.col("id").alias("component"))
    out = signed.filter("d1 IS NOT NULL").join(named, ["d1", "d2"], "left").select("id", "n_shingles", "component").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def class_components(reps: DataFrame, docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, component) of the classes (id, signature) with candidates, from links confirmed on full sets."""
    keys = keys_of(reps)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    weighed = written(keys.join(own_shuffle(shared, "key"), "key"))
    # a document whose keys many others have is central among them
    weight = weighed.groupBy("id").agg(F.sum("n").alias("weight"))
    keyed = written(weighed.join(weight, "id").select("id", "key", "at", "weight"))
    ids = keyed.select("id").distinct()
    candidates = docs.join(ids, F.col(id_col) == F.col("id"), "left_semi")
    with text_batches(docs.sparkSession):
        sets = written(set_table(candidates, shingle, id_col, text_col))
    labels = written(ids.select("id", F.col("id").alias("component")))
    tested = None
    for step in range(ROUNDS + 1):
        rows = keyed.join(labels, "id")
        lead = F.struct(F.col("weight") if not step else F.xxhash64("id", F.lit(step)), F.col("id"), F.col("component"))
        span = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(lead).alias("lead"), F.count(F.lit(1)).alias("n_rows"))
        mixed = span.filter("low <> high").select("key", F.col("lead.id").alias("a"), F.col("lead.component").alias("ca"), "n_rows")
        if step < ROUNDS:
            pairs = rows.join(own_shuffle(mixed, "key"), "key").filter("component <> ca").groupBy("a", F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("n"))
            pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
            pairs = pairs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select("best.a", "b")
        else:
            pairs = pairs_apart(rows, mixed, sets, percent).join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs)
        if pairs.isEmpty():
            if step < ROUNDS:
                tested = pairs if tested is None else tested
                continue
            break
        links = confirmed(pairs, sets, percent)
        # by b first: a join on a right behind the one of confirmed() would keep both from being split where a is hot
        links = links.join(labels.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b").join(labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a")
        links = written(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tested = both if tested is None else tested.unionByName(both)
        if not links.isEmpty():
            joined = components(links)
            labels = written(labels.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
    return labels


def pairs_apart(rows: DataFrame, mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of one key in different components that bitmaps of their sets allow to be linked, each once.

    Rows outside a key's most common component meet all its rows. A key of more than
    BLOCK_ROWS rows is cut, block against block.
    """
    main = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"))
    of_key = mixed.select("key", "n_rows").join(main.select("key", F.col("m.component").alias("main")), "key")
    rows = rows.join(own_shuffle(of_key, "key"), "key")
    cut = F.ceil(F.col("n_rows") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(7)), cut).cast("int")
    lone = F.col("component") != F.col("main")
    every = F.sequence(F.lit(0), cut - 1)
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    one = F.array(F.when(lone, place(F.lit(0), F.lit(0), 3)).otherwise(place(F.lit(0), F.lit(0), 2)))
    right = F.transform(every, lambda i: place(i, own, 2))
    left = F.when(lone, F.transform(every, lambda j: place(own, j, 1))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    spread = rows.select("key", "at", "id", "component", F.explode(F.when(cut == 1, one).otherwise(F.concat(left, right))).alias("p"))
    full = spread.join(sets.select("id", "n", "signature", "bits"), "id").select("key", "p.i", "p.j", "p.side", "at", "id", "component", "n", "signature", "bits")

    def compare(table: pa.Table) -> pa.Table:
        a, b = apart_pairs(table, percent)
        release()
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return full.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in near-duplicate components over 2-word shingles."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
