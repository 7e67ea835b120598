"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm._blocks import parts_for, text_bytes

#: Hashes that a sketch keeps, and words of a shingle.
K, SHINGLE = 128, 5
#: Bytes of text of an ordered run, about: so many, or what makes two levels of WIDEST cuts, if that is more.
RUN_BYTES, WIDEST = 2 << 20, 1024


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null for a null text."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of the runs of ``size`` words; the whole sequence where it is shorter, none without words."""

    def runs(w: Column) -> Column:
        n = F.size(w) - size + 1
        one = F.array(F.xxhash64(F.array_join(w, " ")))
        many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
        return F.when(n > 0, many).when(F.size(w) > 0, one).otherwise(F.array().cast("array<bigint>"))

    # the words are bound to a variable, so that they are split once and not for each shingle
    return F.element_at(F.transform(F.array(words), runs), 1)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The k least distinct shingle hashes of a text in order; empty for texts without words, null counts as empty."""
    hashes = shingle_hashes(words_of(F.coalesce(text, F.lit(""))), size)
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts of a document, or of two documents together, from theirs."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(df: DataFrame, id_col: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """(id_col, sketch): one sketch of all parts of each id.

    Hashes are made distinct before they meet, and only the k least of each salt go
    on, so an id with a third of all parts isn't one task's work. Shingles over the
    seams of parts are in no part. Empty and null sketches add nothing, but keep
    their id.
    """
    hashes = df.select(F.col(id_col).alias("_id"), F.explode_outer(sketch_col).alias("_h"))
    salted = hashes.distinct().withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(64)))
    least = Window.partitionBy("_id", "_salt").orderBy("_h")
    few = salted.withColumn("_r", F.row_number().over(least)).filter(F.col("_r") <= k)
    out = few.groupBy("_id").agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias("sketch"))
    return out.withColumnRenamed("_id", id_col)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1: the share of the k least hashes of both that both have. Two empty sketches are alike."""
    both = merged(a, b, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    kth = F.element_at(a, k).cast("double") + F.lit(2.0**63)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0**64) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share, 0 to 1, of a's shingles that b has too; 1 for an empty a."""
    inside = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), inside / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as a string: its hashes' bytes in base 64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """(id_col, text, sketch, n_shingles) of each row: its sketch and the estimated number of distinct shingles."""
    out = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), sketch(F.col(text_col), k, size).alias("sketch"))
    return out.withColumn("n_shingles", distinct_shingles(F.col("sketch"), k))


def quantiles(id_col: str, n: int) -> Column:
    """About the ids that cut off each n-th part of all; large ones are rounded, so they needn't be ids of the table."""
    share = ", ".join(str(i / n) for i in range(1, n)) or "0.5"
    return F.array_sort(F.array_distinct(F.expr(f"percentile_approx(`{id_col}`, array({share}), {20 * n})")))


def part_of(x: Column, cuts: Column) -> Column:
    """How many of the cuts, in order, are at most x."""
    return F.size(F.filter(cuts, lambda c: c <= x))


def in_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the number of their run of ids, and copies of each run's first rows behind the run before it.

    Ids are cut at quantiles, and each of these parts at its own quantiles, so runs hold
    about as many rows each. The driver gets the upper cuts, at most WIDEST numbers; the
    lower ones, the first id of each run, are a table of a row for each part, WIDEST *
    WIDEST numbers at most (8 MB), which goes to all tasks. Rows without an id, which are
    next to nothing, are dealt out by their texts to runs up to 0. Returns the rows with
    ``_run`` and ``_behind``, whether the row is such a copy.
    """
    wide = min(WIDEST, max(1, int((max(parts_for(df.sparkSession), text_bytes(df, text_col) / RUN_BYTES)) ** 0.5) + 1))
    ids = df.select(id_col).filter(F.col(id_col).isNotNull())
    upper = ids.agg(quantiles(id_col, wide)).first()[0]
    dealt = -F.pmod(F.xxhash64(text_col), F.lit(wide)).cast("int")
    if upper is None:
        return df.withColumn("_run", dealt).withColumn("_behind", F.lit(False))
    x, part = F.col(id_col), part_of(F.col(id_col), F.array(*map(F.lit, upper)))
    ids = ids.withColumn("_part", part)
    lower = ids.groupBy("_part").agg(quantiles(id_col, wide).alias("_c"))
    firsts = ids.join(F.broadcast(lower), "_part").groupBy("_part", part_of(x, F.col("_c")).alias("_k")).agg(F.min(id_col).alias("_f"))
    parts = firsts.groupBy("_part").agg(F.sort_array(F.collect_list("_f")).alias("_cuts"))
    before = F.sum(F.size("_cuts")).over(Window.orderBy("_part")) - F.size("_cuts")  # a row for each part, so few
    parts = parts.withColumn("_before", before).withColumn("_all", F.sum(F.size("_cuts")).over(Window.partitionBy()))
    placed = df.withColumn("_part", F.when(x.isNotNull(), part)).join(F.broadcast(parts), "_part", "left")
    at = part_of(x, F.col("_cuts"))
    placed = placed.withColumn("_run", F.when(x.isNull(), dealt).otherwise(F.col("_before") + at).cast("int"))
    # the first row of a run also follows the run before; the very first follows the last
    ahead = F.when(F.col("_run") == 1, F.col("_all")).otherwise(F.col("_run") - 1).cast("int")
    copy = F.when(x == F.get("_cuts", at - 1), ahead)
    both = F.array(F.struct(F.col("_run").alias("r"), F.lit(False).alias("b")), F.struct(copy.alias("r"), F.lit(True).alias("b")))
    spread = placed.withColumn("_at", F.explode(F.filter(both, lambda s: s["r"].isNotNull())))
    return spread.select(*df.columns, F.col("_at.r").alias("_run"), F.col("_at.b").alias("_behind"))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """(id_col, text, sketch, next_text, next_sketch): each document with the next of greater id; the first follows the last.

    One shuffle brings runs of ids together. A row without an id comes after nothing and
    has an empty next text. Of rows of one id, one of the least text order counts as next
    to the one before, and the others follow each other.
    """
    kept = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    runs = in_runs(kept, id_col, "text")
    runs = runs.repartition("_run").withColumn("sketch", sketch(F.col("text"), k, size))
    order = Window.partitionBy("_run").orderBy("_behind", id_col, "text")
    out = runs.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    out = out.filter(~F.col("_behind"))
    none, lone = F.array().cast("array<bigint>"), F.col(id_col).isNull()
    after = lambda c, without: F.when(lone, without).otherwise(F.coalesce(c, without)).alias(c)
    return out.select(id_col, "text", "sketch", after("next_text", F.lit("")), after("next_sketch", none))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts, with likeness to those and to the next document."""
    docs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut))
    docs = docs.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    docs = docs.withColumn("edited_sketch", sketch(F.col("edited")))
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in_text"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )
