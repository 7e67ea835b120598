"""Review of clusters: what is suggested, what stands beside it as text, samples for labels, tracks run side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.operators import eventlog as E
from siltstone.operators import rules as R
from siltstone.operators import similarity as N
from siltstone.operators import tiles as TL
from siltstone.operators.places import placed
from siltstone.sources.shared import written


def clusters(members: DataFrame) -> DataFrame:
    """One row a cluster of members (cluster_id, track, id, path, size_bytes, quality, is_keep, position, raw_score, score_kind).

    Besides track, score and totals it has the kept member (the first by id), whether
    deletion is suggested (a kept member on a track that may suggest any), the member that
    stands for the cluster (the kept one, else the first), and the best quality of the
    others with the number of others that have none. All are combining aggregates.
    """
    keep = members.groupBy("cluster_id").agg(F.min(F.when(F.col("is_keep"), F.col("id"))).alias("keep_id"))
    m = members.join(keep.select(F.concat("cluster_id", F.lit("")).alias("cluster_id"), "keep_id"), "cluster_id")
    own, other = F.col("id") == F.col("keep_id"), ~F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False))
    out = m.groupBy("cluster_id").agg(
        F.first("track").alias("track"),
        F.first("raw_score").alias("raw_score"),
        F.first("score_kind").alias("score_kind"),
        F.count(F.lit(1)).alias("n_members"),
        F.sum("size_bytes").alias("bytes"),
        F.max("keep_id").alias("keep_id"),
        F.min("id").alias("first_id"),
        F.max(F.when(own, F.col("path"))).alias("keep_path"),
        F.max(F.when(own, F.col("quality"))).alias("keep_quality"),
        F.max(F.when(other, F.col("quality"))).alias("best_other"),
        F.sum((other & F.col("quality").isNull()).cast("long")).alias("n_unscored"),
    )
    may = F.col("track").isin(*R.SUGGESTING_TRACKS)
    return out.withColumn("suggests_deletion", may & F.col("keep_id").isNotNull()).withColumn("representative_id", F.coalesce("keep_id", "first_id"))


def queued(rows: DataFrame) -> DataFrame:
    """clusters() with the queue they go to: deletion_suggestions or browse_only."""
    return rows.withColumn("queue", F.when(F.col("suggests_deletion"), "deletion_suggestions").otherwise("browse_only"))


def technical_detail(kind: Column, raw: Column) -> Column:
    """The one text that has the measured number, with its unit and direction."""
    shown = F.format_string("%.3f", raw)
    out = F.concat(kind, F.lit(": "), shown, F.lit(" (a raw measured value, not a percentage)"))
    for name, (before, after) in R.SCORE_TEXTS.items():
        value = raw.cast("int").cast("string") if name == "max_pairwise_hamming_distance" else shown
        out = F.when(kind == name, F.concat(F.lit(before), value, F.lit(after))).otherwise(out)
    return out


def quality_reason(rows: Column, keep: Column, best_other: Column, unscored: Column) -> Column:
    """Why a copy is kept; with both scores where all others have one."""
    others = rows - 1
    scores = F.when(keep.isNotNull() & (others > 0) & (unscored == 0), F.format_string(R.QUALITY_SCORES, keep, best_other)).otherwise("")
    return F.concat(F.lit(R.QUALITY_REASON), F.when(others == 1, "copy").otherwise("copies"), F.lit("."), scores)


def presented(rows: DataFrame) -> DataFrame:
    """clusters() with headline, detail, browse_note and technical_detail as a reader sees them.

    ``detail`` holds the lines that are one for a cluster; chain_lines() has those of
    single members.
    """
    track, keep = F.col("track"), F.col("keep_path")
    headline = F.lit(None).cast("string")
    for name, text in R.HEADLINES.items():
        headline = F.when(track == name, text).otherwise(headline)
    headline = F.when(track == "semantic_image", F.concat(F.col("n_members").cast("string"), F.lit(R.SCENE_HEADLINE))).otherwise(headline)
    scored, burst, image, chain = track.isin("near_identical_image", "screenshot_burst"), track == "screenshot_burst", track == "near_identical_image", track == "version_chain"
    content = F.when(burst, F.when(F.col("suggests_deletion"), R.BURST_DISPOSABLE).otherwise(R.BURST_MEANINGFUL))
    reason = F.when(scored & keep.isNotNull(), quality_reason(F.col("n_members"), F.col("keep_quality"), F.col("best_other"), F.col("n_unscored")))
    newest = F.when((track == "near_dup_document") & keep.isNotNull(), R.DOCUMENT_KEEP)
    clutter = F.when(track == "ranked_clutter", R.CLUTTER_NOTE)
    note = (
        F.when(track == "semantic_image", R.BROWSE_NOTE)
        .when(image & keep.isNull(), R.UNSCORED_NOTE)
        .when(chain & ~F.col("suggests_deletion"), R.VERSION_NOTE)
        .when(track == "ranked_clutter", R.CLUTTER_NOTE)
    )
    lines = F.concat_ws("\n", content, reason, newest, clutter)
    shown = F.when(track.isin("semantic_image", "ranked_clutter") | (chain & ~F.col("suggests_deletion")), F.lit(None)).otherwise(keep)
    return rows.withColumns({"headline": headline, "detail": lines, "browse_note": note, "shown_keep": shown, "technical_detail": technical_detail(F.col("score_kind"), F.col("raw_score"))})


def chain_lines(members: DataFrame) -> DataFrame:
    """(cluster_id, id, line): "i of n" for members of version chains with a keeper, oldest first."""
    chain = members.filter(F.col("track") == "version_chain")
    kept = chain.filter("is_keep").select("cluster_id").distinct()
    rows = placed(chain.join(kept, "cluster_id", "left_semi"), "cluster_id", (F.coalesce("position", F.lit(0)), "id"), "_n")
    return rows.select("cluster_id", "id", F.concat((F.col("at") + 1).cast("string"), F.lit(" of "), F.col("_n").cast("string"), F.when(F.col("is_keep"), R.CHAIN_KEEP).otherwise("")).alias("line"))


def burst_review(shots: DataFrame) -> DataFrame:
    """Members of bursts (burst, id, tag, quality, hash) with is_keep, and their burst's verdict and widest distance.

    Only where every member is transient and two or more have a quality, the best one
    (the least id on ties) is kept; else nobody is.
    """
    scored = F.col("quality").isNotNull()
    best = shots.groupBy("burst").agg(
        F.bool_and(F.coalesce(F.col("tag") == "transient_ui", F.lit(False))).alias("all_transient"),
        F.sum(scored.cast("long")).alias("n_scored"),
        F.max_by(F.when(scored, F.col("id")), F.when(scored, F.struct("quality", -F.col("id")))).alias("best"),
    )
    verdict = F.when(F.col("all_transient") & (F.col("n_scored") >= 2), "keeper").when(F.col("all_transient"), "too_few_scored").otherwise("meaningful_content")
    best = best.withColumn("verdict", verdict).join(extremes(shots.select(F.col("burst").alias("grp"), "id", F.array(F.col("hash")).alias("v")), widest_bits).withColumnRenamed("grp", "burst"), "burst", "left")
    rows = shots.join(best.select((F.col("burst") + F.lit(0)).alias("burst"), "verdict", "best", F.col("extreme").alias("widest")), "burst")
    return rows.withColumn("is_keep", F.coalesce((F.col("verdict") == "keeper") & (F.col("id") == F.col("best")), F.lit(False))).drop("best")


def widest_bits(a: np.ndarray, b: np.ndarray) -> float:
    """The greatest number of bits in which a hash of one block differs from one of another."""
    x, y = a[:, 0].astype(np.int64).view(np.uint64), b[:, 0].astype(np.int64).view(np.uint64)
    return float(np.bitwise_count(x[:, None] ^ y[None, :]).max())


def least_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The least cosine between a vector of one block and one of another, as a negative."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return float(-(unit(a) @ unit(b).T).min())


def block_pairs(rows: DataFrame, block: int, spread: int = 1) -> DataFrame:
    """Rows (grp, id, v) for each pair of blocks (i <= j) of their group that they take part in, with ``side`` (1: i, 2: j, 3: both).

    A group is cut into blocks of about ``block`` rows, so that no task holds a group;
    ``spread`` is the number of blocks up to which large groups are cut for the sake of more tasks.
    """
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    blocks = F.greatest(F.ceil(F.col("_n") / block), F.least(F.lit(spread).cast("long"), F.ceil(F.col("_n") / TL.LEAST))).cast("int")
    cut = rows.join(sizes.select((F.col("grp") + F.lit(0)).alias("grp"), blocks.alias("_c")), "grp")
    own = F.pmod(F.xxhash64("id"), F.col("_c")).cast("int")
    every = F.sequence(F.lit(0), F.col("_c") - 1)
    place = F.transform(every, lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j"), F.when(k == own, 3).when(own < k, 1).otherwise(2).alias("side")))
    return cut.withColumn("_p", F.explode(place)).select("grp", "id", "v", "_p.i", "_p.j", "_p.side")


def tile_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(grp, ids, sides, values) of each tile, from rows of block_pairs() in which those of a tile follow each other."""
    key, held = None, []
    whole = lambda: (key[0], *(x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*held, strict=True)))
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.column_stack([batch.column(c).to_numpy() for c in ("grp", "i", "j")])
        lists = batch.column("v")
        if len(pc.unique(pc.list_value_length(lists))) > 1:
            raise ValueError("values of one group differ in length")
        ids, side, values = batch.column("id").to_numpy(), batch.column("side").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]).any(axis=1))))
        for lo, hi, k in zip(new.tolist(), [*new[1:].tolist(), len(ids)], map(tuple, at[new].tolist()), strict=True):
            if k != key:
                if held:
                    yield whole()
                key, held = k, []
            held.append((ids[lo:hi], side[lo:hi], values[lo:hi]))
    if held:
        yield whole()


def of_tiles(pairs: DataFrame, run: Callable[..., tuple[np.ndarray, ...]], schema: str) -> DataFrame:
    """The columns that ``run`` makes of each tile of block_pairs().

    Tiles are dealt over all shuffle partitions, whose number adaptive execution doesn't
    lower: their bytes say little of the work. A task goes through its tiles one by one,
    so that very many small groups cost no call from Spark each.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for tile in tile_runs(batches):
            out.append(run(*tile))
            size += 1 + len(out[-1][0])
            if size > TL.BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, "grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(every, schema)


def extremes(rows: DataFrame, measure: Callable[[np.ndarray, np.ndarray], float], block: int = TL.BLOCK) -> DataFrame:
    """(grp, extreme): the greatest ``measure`` of pairs of blocks of each group of two or more rows.

    Each pair of blocks is compared a strip at a time and passes on one number.
    """

    def run(grp: int, ids: np.ndarray, side: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        if not len(a) or not len(b):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        other = values[b]
        return np.array([grp]), np.array([max(measure(values[x], other) for x in TL.strips(a, b))])

    found = of_tiles(block_pairs(rows, block, TL.SPREAD), run, "grp long, extreme double")
    return found.groupBy("grp").agg(F.max("extreme").alias("extreme"))


def near_edges(rows: DataFrame, least: float, block: int = TL.BLOCK) -> DataFrame:
    """(a, b) of one group (grp, id, v): links of at least that cosine, as few as keep the same rows connected in each pair of blocks."""

    def run(grp: int, ids: np.ndarray, side: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(ids, kind="stable")
        ids, side, m = ids[order], side[order], values[order].astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        one, two = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        other, label = m[two].T, np.arange(len(ids))  # least row that each can reach
        for x in TL.strips(one, two):
            r, c = TL.where(m[x] @ other >= least)
            label = TL.hooked(label, x[r], two[c])
        at = np.flatnonzero(label != np.arange(len(ids)))
        return ids[label[at]], ids[at]

    return of_tiles(block_pairs(rows, block, TL.SPREAD), run, "a long, b long").distinct()


def two_stage_clusters(sets: DataFrame, vectors: DataFrame, least_jaccard: float = 0.1, least_cosine_: float = 0.95) -> DataFrame:
    """(id, cluster, raw_score): documents alike in shingles, then in vectors within each group of those.

    ``sets`` are shingle_sets(), made twice and never written, ``vectors`` has (id, v). Groups of the
    first stage are components of shingle likeness; within one, components of vector
    likeness with two members or more are clusters, named by their least id, with the
    least cosine of any two members as score.
    """
    first = N.jaccard_components(sets, least_jaccard).select("id", F.col("component").alias("grp"))
    rows = written(vectors.filter("v IS NOT NULL").join(first, "id").select("grp", "id", "v"))
    found = written(N.components(near_edges(rows, least_cosine_)))
    kept = rows.drop("grp").join(found.select("id", F.col("component").alias("grp")), "id")
    worst = extremes(kept.select("grp", "id", "v"), least_cosine).select("grp", (-F.col("extreme")).alias("raw_score"))
    return kept.select("id", F.col("grp").alias("cluster")).join(worst.withColumnRenamed("grp", "cluster"), "cluster").select("id", "cluster", "raw_score")


def common_resolution(width: Column, height: Column) -> Column:
    """Whether an image has the size of a usual screen, either way round."""
    sizes = [*R.SCREEN_SIZES, *((h, w) for w, h in R.SCREEN_SIZES)]
    return F.coalesce(F.concat_ws("x", width, height).isin(*(f"{w}x{h}" for w, h in sizes)), F.lit(False))


def ranked_entries(scored: DataFrame) -> DataFrame:
    """Scored files (id, path, size_bytes, score) as clusters of one member that never suggest deletion."""
    return scored.select(
        F.concat(F.lit("ranked-clutter-"), F.col("id").cast("string")).alias("cluster_id"), F.lit("ranked_clutter").alias("track"), "id", "path", "size_bytes",
        F.lit(False).alias("is_keep"), F.col("score").alias("raw_score"), F.lit("clutter_likelihood_lambdamart").alias("score_kind"),
    )


def plain_category(group: Column) -> Column:
    """struct(name, reason) of a category for readers; others show their label or their id in title case, without a reason."""
    title = F.initcap(F.replace(group, F.lit("_"), F.lit(" ")))
    for name, label in R.CATEGORY_LABELS.items():
        title = F.when(group == name, label).otherwise(title)
    out = F.struct(title.alias("name"), F.lit(None).cast("string").alias("reason"))
    for name, (label, reason) in R.PLAIN_CATEGORIES.items():
        out = F.when(group == name, F.struct(F.lit(label).alias("name"), F.lit(reason).cast("string").alias("reason"))).otherwise(out)
    return out


def descriptor_fingerprint(group: Column, files: Column, size: Column, tier: Column, days: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of the descriptor as JSON with sorted keys; names shown don't count."""
    text = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    parts = [("category_group", text(group)), ("file_count", number(files)), ("retention_days", number(days)), ("tier", text(tier)), ("total_size_bytes", number(size))]
    body = F.concat(F.lit("{"), *(x for k, (name, v) in enumerate(parts) for x in (F.lit(f'{", " if k else ""}"{name}": '), v)), F.lit("}"))
    return F.substring(F.sha2(body, 256), 1, 32)


def explained(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Descriptors with the explanation that the cache of (fingerprint, body) holds; a body that isn't whole counts as a miss."""
    body = F.from_json("body", "category_group string, explanation string")
    good = cache.select("fingerprint", body.alias("_b")).filter("_b.category_group IS NOT NULL AND _b.explanation IS NOT NULL")
    good = good.groupBy("fingerprint").agg(F.min("_b.explanation").alias("explanation"))
    return rows.join(good, "fingerprint", "left").withColumn("hit", F.col("explanation").isNotNull())


def scan_id(generation: Column) -> Column:
    """The name of a scan generation."""
    return F.concat(F.lit("scan-"), generation.cast("string"))


def stale(made: Column, now: Column) -> Column:
    """Whether suggestions of one generation are out of date; unknown ones are."""
    return ~F.coalesce(made == now, F.lit(False))


def scan_rollup(stats: DataFrame, counts: tuple[str, ...]) -> DataFrame:
    """One row from those of the roots: their number, summed counts, summed time, cancelled if any was."""
    out = stats.agg(F.count(F.lit(1)).alias("n_roots"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts), F.coalesce(F.bool_or("cancelled"), F.lit(False)).alias("cancelled"))
    return out.withColumn("status", F.when(F.col("cancelled"), "cancelled").otherwise("completed")).drop("cancelled")


def keep_rationale(path: Column, git_root: Column, ctime: Column) -> Column:
    """Why a copy is the one kept, in words: where it is, since when, and how deep."""
    downloads = P.in_downloads_or_temp(path)
    where = F.when(git_root.isNotNull(), F.concat(F.lit("inside git repository '"), git_root, F.lit("'"))).when(downloads, R.KEPT_RISKY).otherwise(R.KEPT_ELSEWHERE)
    created = F.date_format(F.timestamp_micros((ctime * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss")
    found = F.concat(F.lit("Exact duplicate of '"), path, F.lit("' (byte-identical, full-hash match); kept copy is "))
    return F.concat(found, where, F.lit(", created "), created, F.lit("+00:00, path depth "), P.depth_of(path).cast("string"), F.lit(R.KEPT_BY))


def restorable(plan: DataFrame) -> DataFrame:
    """Per batch of restore_plan(): items to restore, and the error that refuses the whole batch, if any."""
    n = lambda *steps: F.sum(F.col("step").isin(*steps).cast("long"))
    out = plan.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_items"), n("restore", "destination_occupied").alias("n_restorable"), n("outside_vault").alias("n_outside"), n("already_restored").alias("n_restored"))
    error = F.when(F.col("n_outside") > 0, "outside_vault").when(F.col("n_restorable") > 0, F.lit(None)).when(F.col("n_restored") > 0, "already_restored").otherwise("nothing_restorable")
    return out.select("batch_id", "n_items", F.when(error.isNull(), F.col("n_restorable")).otherwise(0).alias("n_restorable"), error.alias("error"))


def guarded_hashes(rows: DataFrame, value: Column, error: Column) -> tuple[DataFrame, DataFrame]:
    """Hashes (path, hash) of the rows that could be read, and (path, reason) of the others."""
    both = rows.withColumn("_h", F.when(error.isNull(), value)).withColumn("_e", error)
    return both.filter("_e IS NULL").select("path", F.col("_h").alias("hash")), both.filter("_e IS NOT NULL").select("path", F.col("_e").alias("reason"))


def skip_report(skips: DataFrame, shown: int = 10) -> DataFrame:
    """The first skips by path, each with the number of all and of those not shown."""
    n = skips.agg(F.count(F.lit(1)).alias("n_all"))
    first = skips.orderBy("path", "reason").limit(shown)
    return first.crossJoin(F.broadcast(n)).withColumn("n_more", F.greatest(F.col("n_all") - shown, F.lit(0)))


def label_rows(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """A label a decision (cluster_id, decision, keep_id, seq): with the score of its cluster; unknown clusters give none."""
    info = members.groupBy("cluster_id").agg(F.first("track").alias("track"), F.first("raw_score").alias("raw_score"), F.first("score_kind").alias("score_kind"), F.count(F.lit(1)).alias("n_members"))
    return decisions.join(info, "cluster_id")


def with_variants(images: DataFrame) -> DataFrame:
    """(block, original, n_variants) of the blocks (block, id, is_original) that have just one original and a variant."""
    g = images.groupBy("block").agg(F.sum(F.col("is_original").cast("long")).alias("_o"), F.max(F.when(F.col("is_original"), F.col("id"))).alias("original"), F.sum((~F.col("is_original")).cast("long")).alias("n_variants"))
    return g.filter("_o = 1 AND n_variants > 0").select("block", "original", "n_variants")


def promotable(shares: DataFrame) -> DataFrame:
    """Evaluation sets (name, realistic, synthetic, tail counts) with why their numbers can't count as measured, null if they can."""
    total = F.col("realistic") + F.col("synthetic") + F.col("tail")
    why = F.when(total == F.col("tail"), "adversarial_tail_only").when(total == F.col("synthetic"), "synthetic_only")
    return shares.select("name", why.alias("refused"))


def without_long_prefix(path: Column) -> Column:
    r"""A path without a leading ``\\?\``; network paths keep theirs."""
    long = F.startswith(path, F.lit("\\\\?\\")) & ~F.startswith(F.lower(path), F.lit("\\\\?\\unc\\"))
    return F.when(long, F.substr(path, F.lit(5))).otherwise(path)


def vault_name(vault: str, batch: Column, path: Column, salt: Column) -> Column:
    """Where an item of a batch goes: a name that its path and salt determine, so a task run again gives the same."""
    return F.concat(F.lit(f"{vault}/"), batch, F.lit("/"), F.substring(F.sha2(F.concat_ws("|", batch, path, salt.cast("string")), 256), 1, 32), F.lit("_"), P.name_of(path))


def sampled_pairs(items: DataFrame, distance: Callable[[Column, Column], Column], draws: int, seed: int = 42, each: int = 60) -> DataFrame:
    """(stratum, draw, a, b, distance): the first ``each`` pairs of each stratum in a seeded row of draws from all pairs of (id, h).

    Each draw names two ids between the least and the greatest; draws that meet no two
    rows, or a pair drawn before, are passed over. So all pairs can be drawn, and none
    but the drawn ones are made.
    """
    low, high = items.agg(F.min("id"), F.max("id")).first()
    spark = items.sparkSession
    pick = lambda k: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"), F.lit(k))), 1, 12), 16, 10).cast("long"), F.lit(int(high) - int(low) + 1)) + F.lit(int(low))
    drawn = spark.range(draws).select(F.col("id").alias("draw"), pick("a").alias("x"), pick("b").alias("y")) if low is not None else spark.range(0).select(F.col("id").alias("draw"), F.col("id").alias("x"), F.col("id").alias("y"))
    drawn = drawn.filter("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("draw").alias("draw"))
    pairs = drawn.join(items.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(items.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    pairs = pairs.select("draw", "a", "b", distance(F.col("ha"), F.col("hb")).alias("distance"))
    stratum = F.when(F.col("distance") <= 10, "near_duplicate").when(F.col("distance") <= 25, "boundary").otherwise("negative_control")
    rows = pairs.withColumn("stratum", stratum).filter("stratum <> 'near_duplicate'")
    order = Window.partitionBy("stratum").orderBy("draw")
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= each).select("stratum", "draw", "a", "b", "distance")


def run_tracks(spark: SparkSession, tracks: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The rows (track, cluster, id) of all tracks that ran, and (track, state, reason, n_rows) of each track.

    A track is planned, run and written on its own, so one that fails is skipped with its
    reason and the others stand.
    """
    done, states = None, []
    for name, make in tracks.items():
        try:
            rows = written(make().select(F.lit(name).alias("track"), F.col("cluster").cast("long").alias("cluster"), F.col("id").cast("long").alias("id")))
            states.append((name, "run", None, rows.count()))
            done = rows if done is None else done.unionByName(rows)
        except Exception as e:  # noqa: BLE001 - whatever stops one track must not stop the others
            states.append((name, "skipped", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:200], 0))
    empty = spark.createDataFrame([], "track string, cluster long, id long")
    return (empty if done is None else done), spark.createDataFrame(states, "track string, state string, reason string, n_rows long")


def selected_totals(cands: DataFrame, chosen: DataFrame, failed: DataFrame) -> DataFrame:
    """(n_items, bytes) of the chosen paths that didn't fail."""
    rows = cands.join(chosen.select("path").distinct(), "path", "left_semi").join(failed.select("path"), "path", "left_anti")
    return rows.agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


# ---- images ----


def image_features(images: DataFrame, pixels: str, width: int, height: int) -> DataFrame:
    """Rows with dhash, phash, sharpness and spread of grey images (``pixels``: values row by row).

    ``dhash`` has a bit for each pair of neighbours in a row, ``phash`` one for each of
    the 64 lowest cosine frequencies that is above their median; sharpness is the variance
    of the Laplacian over inner pixels, spread the deviation of all. Rows without
    the right number of pixels have nulls.
    """
    k = np.arange(min(8, height, width))
    basis = lambda n: np.cos(np.pi * k[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))

    def run(batches):
        for part in batches:
            values = part[pixels]
            ok = np.array([v is not None and len(v) == width * height for v in values], dtype=bool)
            out = {"dhash": [None] * len(part), "phash": [None] * len(part), "sharpness": [None] * len(part), "spread": [None] * len(part)}
            if ok.any():
                m = np.stack(values[ok].to_list()).astype(np.float64).reshape(-1, height, width)
                text = lambda bits: ["".join(row) for row in np.where(bits.reshape(len(m), -1), "1", "0")]
                waves = np.einsum("ah,nhw,bw->nab", basis(height), m, basis(width)).reshape(len(m), -1)
                inner = m[:, :-2, 1:-1] + m[:, 2:, 1:-1] + m[:, 1:-1, :-2] + m[:, 1:-1, 2:] - 4 * m[:, 1:-1, 1:-1]
                found = (text(m[:, :, 1:] > m[:, :, :-1]), text(waves > np.median(waves, axis=1, keepdims=True)), inner.reshape(len(m), -1).var(axis=1).tolist(), m.reshape(len(m), -1).std(axis=1).tolist())
                for name, new in zip(out, found, strict=True):
                    for i, x in zip(np.flatnonzero(ok), new, strict=True):
                        out[name][i] = x
            yield part.drop(columns=[pixels]).assign(**out)

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if f.name != pixels]
    return images.mapInPandas(run, ", ".join([*rest, "dhash string", "phash string", "sharpness double", "spread double"]))


# ---- more of the state of items, logs and settings ----


def category_label(group: Column) -> Column:
    """The short label of a category; an unknown id in title case."""
    out = F.initcap(F.replace(group, F.lit("_"), F.lit(" ")))
    for name, label in R.CATEGORY_LABELS.items():
        out = F.when(group == name, label).otherwise(out)
    return out


def settings(spark: SparkSession, mode: str) -> DataFrame:
    """A row a category: its flag, retention, label, and whether the mode forces it off."""
    rows = [(g, on, days, mode == "safe" and g in R.OFF_IN_SAFE_MODE) for g, (on, days, _) in R.CATEGORIES.items()]
    return spark.createDataFrame(rows, "category_group string, enabled boolean, retention_days int, forced_off boolean").withColumn("label", category_label(F.col("category_group")))


def batch_estimates(events: DataFrame, warn: float = 10.0) -> DataFrame:
    """Per batch the seconds that writing its items takes, and whether that is worth a warning."""
    n = events.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_items"))
    seconds = F.col("n_items") * R.SECONDS_PER_ITEM
    return n.withColumn("seconds", seconds).withColumn("warn", F.col("seconds") >= warn)


def shown_reconciliation(scans: DataFrame) -> DataFrame:
    """Scans with delta_bytes and delta_percent only where a scan was completed over just one root, a volume's."""
    whole = F.coalesce((F.col("status") == "completed") & (F.col("n_roots") == 1) & P.is_volume_root(F.col("root")), F.lit(False))
    return scans.withColumns({c: F.when(whole, F.col(c)) for c in ("delta_bytes", "delta_percent")})


def eligible_paths(asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The asked paths that exist and are eligible."""
    return asked.select("path").distinct().join(verdicts.filter(F.col("verdict") == "eligible").select("path"), "path", "left_semi")


def cache_object_root(path: Column) -> Column:
    """The folder of one cached object (``models--x``, ``datasets--x``, ``spaces--x`` above blobs or snapshots); null elsewhere."""
    found = F.regexp_extract(path, r"(?i)^(.*/(?:models|datasets|spaces)--[^/]+)/(?:blobs|snapshots|refs)(?:/|$)", 1)
    return F.when(found != "", found)


def protected_root(path: Column, protected: tuple[str, ...] = R.PROTECTED_ROOTS) -> Column:
    """Whether a path alone, whatever else is known of it, is never to be written to."""
    return P.is_network_path(path) | P.matches_any(path, protected) | P.matches_any(path, R.CONTAINER_ROOTS)


def restore_violations(items: DataFrame, vault_dir: str, protected: tuple[str, ...] = R.PROTECTED_ROOTS) -> DataFrame:
    """(original_path, why): items whose vault path lies elsewhere, and items that would go to a protected place; one can be both."""
    inside = (F.col("vault_path") == vault_dir) | F.col("vault_path").startswith(vault_dir + "/")
    out = items.filter(F.col("vault_path").isNotNull() & ~inside).select("original_path", F.lit("outside_vault").alias("why"))
    return out.unionByName(items.filter(protected_root(F.col("original_path"), protected)).select("original_path", F.lit("protected_root").alias("why")))


def purge_records(items: DataFrame) -> DataFrame:
    """Items of the log as rows for the safety rules, from what the log has: no repository, no attributes."""
    name = P.name_of(F.col("original_path"))
    return items.select(
        F.col("original_path").alias("path"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"), F.col("size_bytes").alias("size"),
        F.when(F.coalesce("is_dir", F.lit(False)), "").otherwise(P.ext_of(name)).alias("ext"), F.lit(None).cast("string").alias("git_repo_root"), F.lit(False).alias("git_repo_clean"), F.lit(False).alias("is_cloud_placeholder"),
    )


def notification_state(log: DataFrame) -> DataFrame:
    """Per volume of (volume, seq, at, kind, days): when last notified and snoozed until when; each kind leaves the other as it was."""
    last = lambda kind, v: F.max_by(F.when(F.col("kind") == kind, v), F.when(F.col("kind") == kind, F.col("seq")))
    return log.groupBy("volume").agg(last("notified", F.col("at")).alias("last_notified"), last("snooze", F.col("at") + F.col("days") * R.DAY).alias("snoozed_until"))


def listed_bytes(dirs: DataFrame, children: DataFrame) -> DataFrame:
    """Directories that couldn't be read with the bytes of the children that were listed, a lower bound; null without any."""
    known = children.groupBy(F.col("parent").alias("path")).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size_estimate_bytes"), F.count(F.lit(1)).alias("n_listed"))
    return dirs.select("path").join(known, "path", "left").withColumn("partial", F.col("n_listed").isNotNull()).drop("n_listed")


def still_there(members: DataFrame, present: DataFrame) -> DataFrame:
    """Members of groups that still exist, of the groups with two such or more."""
    left = members.join(present.select("id").distinct(), "id", "left_semi")
    sizes = left.groupBy("group").agg(F.count(F.lit(1)).alias("n_members")).filter("n_members > 1")
    return left.join(sizes, "group")


def ranking_rows(members: DataFrame, records: DataFrame) -> DataFrame:
    """Members with size, times and placeholder flag of their record; zeros and false for those without one."""
    out = members.join(records.select("path", "mtime", "ctime", "is_cloud_placeholder"), "path", "left")
    return out.withColumns({"mtime": F.coalesce("mtime", F.lit(0.0)), "ctime": F.coalesce("ctime", F.lit(0.0)), "is_cloud_placeholder": F.coalesce("is_cloud_placeholder", F.lit(False))})


# ---- feedback, and texts and pairs for evaluations ----

FEEDBACK = (
    "cluster_id string, id long, path string, seq long, decision string, track string, size_bytes long, ext string, is_keep boolean, position long, raw_score double, score_kind string, "
    "cluster_size long, n_accepted long, n_rejected long, n_kept long"
)
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def feedback_rows(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """A row for each decision (cluster_id, id, seq, decision) on a member, with what the ranking looks at.

    That is the member's and its cluster's features and the decisions made before in the
    cluster. Decisions on members that aren't there give no row.
    """
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    before = E.sibling_context(decisions).select("cluster_id", "seq", *(F.col(f"n_{d}_before").alias(f"n_{d}") for d in ("accepted", "rejected", "kept")))
    rows = decisions.join(members, ["cluster_id", "id"]).join(before, ["cluster_id", "seq"])
    rows = rows.join(sizes.select(F.concat("cluster_id", F.lit("")).alias("cluster_id"), "cluster_size"), "cluster_id")
    names = [f.split()[0] for f in FEEDBACK.split(", ")]
    return rows.withColumn("ext", P.ext_of(P.name_of(F.col("path")))).select(*names)


def reordered(text: Column) -> Column:
    """A text without its last paragraph (a line with something in it), and two of the others swapped, which ones following from the text."""
    rest = lambda w: F.when(F.size(w) > 1, F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(1)))).otherwise(w)
    digits = lambda start: F.conv(F.substring(F.md5(text), start, 8), 16, 10).cast("long")

    def swapped(w: Column) -> Column:
        n = F.size(w)
        i = F.pmod(digits(1), n)
        j = F.pmod(i + 1 + F.pmod(digits(9), n - 1), n)
        new = F.transform(w, lambda x, k: F.when(k == i, F.get(w, j.cast("int"))).when(k == j, F.get(w, i.cast("int"))).otherwise(x))
        return F.array_join(F.when(n > 2, new).otherwise(w), "\n")

    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, BLANKS, "") != "")
    bound = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731 - so that the lines are made once
    return bound(rest(lines), swapped)


def pasted(text: Column, share: float = 0.7) -> Column:
    """A text as one line, cut after that share of its words, at least one."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    return F.element_at(F.transform(F.array(words), lambda w: F.array_join(F.slice(w, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(w) * F.lit(share)).cast("int"))), " ")), 1)


def pairs_with_truth(images: DataFrame) -> DataFrame:
    """(set, a, b, is_same) of all pairs of the images (set, id, block) of a set, as an evaluation of a small set takes them."""
    own = lambda c, block: images.select("set", F.col("id").alias(c), F.col("block").alias(block))
    return own("a", "_x").join(own("b", "_y"), "set").filter("a < b").select("set", "a", "b", F.coalesce(F.col("_x") == F.col("_y"), F.lit(False)).alias("is_same"))
