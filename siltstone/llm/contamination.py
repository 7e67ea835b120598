"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

The index is sharded by documents, so nothing is shuffled to build it: a document's
postings are one sorted array of numbers, each a term's hash above a position, which
is its terms' position lists one after the other. A phrase is looked up from its
rarest term: that list gives the candidate starts, the second rarest, moved by its
offset, cuts them down, and the other lists are read in the candidates' documents
alone. What is left is held against the words themselves, since hashes may collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm._blocks import own_shuffle, quoted, written

#: What separates words, once A-Z are lower case.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Words of a phrase, and the words in a row that a proximity match looks at.
PHRASE, NEAR = 10, 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What tells a document: its id and, where rows share one, its text.
DOC = ("doc", "variant")


def words_of(text: Column) -> Column:
    """The words of a text in lower case as an array; none for a null text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def variant(text: Column) -> Column:
    """A number by which rows of one id and different texts are told apart."""
    return F.hash(F.coalesce(text, F.lit("")))


def term_hash(term: Column) -> Column:
    """The upper half of a posting: 32 bits of a term's hash, the lower half being free."""
    return F.xxhash64(term).bitwiseAND(F.lit(-1 << 32))


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written positional index (doc, variant, n_words, postings array<bigint>), a row for each row of ``df``.

    Null and empty texts have no postings. Rows without id have theirs under a null
    ``doc``. Other columns are ignored, whatever their names.
    """
    text = F.col(quoted(text_col))
    lists = F.sort_array(F.transform(words_of(text), lambda w, i: term_hash(w).bitwiseOR(i.cast("long"))))
    rows = df.select(F.col(quoted(id_col)).alias("doc"), variant(text).alias("variant"), lists.alias("postings"))
    return written(rows.select(*DOC, F.size("postings").cast("long").alias("n_words"), "postings"))


def phrases(items: DataFrame, size: int = PHRASE, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pid, item) pairs, and (pid, phrase, n) of the items' windows of ``size`` words, equal ones once. Both are written.

    An item of fewer words, but not none, is one phrase.
    """
    own = items.select(F.col(quoted(id_col)).alias("item"), words_of(F.col(quoted(text_col))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    each = written(own.withColumn("s", F.explode(starts)).select("item", F.array_join(F.slice("w", F.col("s"), size), " ").alias("phrase")).distinct())
    known = each.select("phrase").distinct().withColumn("pid", F.monotonically_increasing_id())
    known = written(known.withColumn("n", F.size(F.split("phrase", " "))))
    return written(each.join(known, "phrase").select("pid", "item")), known


def lists_of(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(tid, doc, variant, pos): the lists of some terms (h, tid)."""
    each = index.select(*DOC, F.explode("postings").alias("p"))
    each = each.select(F.col("p").bitwiseAND(F.lit(-1 << 32)).alias("h"), *DOC, F.col("p").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))
    return each.join(terms.select("h", "tid"), "h").drop("h")


def ranked(index: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pid, n, off, tid, rank) of the phrases' words, 1 for the rarest in the index, and the terms (term, h, tid). Both are written.

    Phrases with a word that the index hasn't are left out.
    """
    said = known.select("pid", "n", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
    terms = said.select("term").distinct().select("term", term_hash(F.col("term")).alias("h"), F.monotonically_increasing_id().alias("tid"))
    terms = written(terms)
    sizes = own_shuffle(lists_of(index, terms).groupBy("tid").agg(F.count(F.lit(1)).alias("cf")), "tid")
    phrase = Window.partitionBy("pid")  # at most a phrase's words
    words = said.join(terms, "term").join(sizes, "tid").withColumn("_there", F.count(F.lit(1)).over(phrase)).filter(F.col("_there") == F.col("n"))
    words = words.withColumn("rank", F.row_number().over(phrase.orderBy("cf", "off")))
    return written(words.select("pid", "n", "off", "tid", "rank")), terms


def other(side: DataFrame) -> DataFrame:
    """The rows of a side of a join under names of their own."""
    return side.select(*(F.col(c).alias(f"_{c}") for c in side.columns))


def met_on(*names: str) -> Column:
    """The condition that rows and other() ones are of one document, which may have no id, and agree in some columns."""
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("variant") == F.col("_variant"))
    for c in names:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return same


def in_documents(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows, with doc and variant, of the documents that something was found in (and few others)."""
    key = F.xxhash64(*DOC).alias("_key")
    return rows.withColumn("_key", key).join(written(found.select(key).distinct()), "_key", "left_semi").drop("_key")


def at_offsets(candidates: DataFrame, lists: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates (pid, n, doc, variant, start) once for each of some words that is where it is to be."""
    need = candidates.join(words.select("pid", "tid", "off"), "pid").withColumn("pos", F.col("start") + F.col("off"))
    return need.join(other(lists), met_on("tid", "pos"), "left_semi").select(*candidates.columns)


def within_reach(candidates: DataFrame, lists: DataFrame, words: DataFrame, within: int) -> DataFrame:
    """Anchors (pid, m, doc, variant, pos) with each occurrence (tid, there) of some words less than ``within`` words away.

    Lists meet by stretches of ``within`` words, so only neighbours are compared.
    """
    stretch = F.floor(F.col("pos") / within)
    need = candidates.join(words.select("pid", "tid"), "pid").withColumn("s", F.explode(F.array(*(stretch + k for k in (-1, 0, 1)))))
    near = met_on("tid", "s") & (F.abs(F.col("pos") - F.col("_pos")) < within)
    return need.join(other(lists.withColumn("s", stretch)), near).select(*candidates.columns, F.col("_tid").alias("tid"), F.col("_pos").alias("there")).distinct()


def matches(df: DataFrame, index: DataFrame, known: DataFrame, within: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Exact and proximity matches of phrases() in the rows that an index was built from. Both are written.

    Exact ones (pid, n, doc, variant, start): every occurrence of every phrase. Proximity
    ones (pid, doc, variant): documents where some ``within`` words in a row hold all
    words of the phrase, in any order, repeated words once.
    """
    words, terms = ranked(index, known)
    once = words.groupBy("pid", "tid").agg(F.min("rank").alias("rank"))
    phrase = Window.partitionBy("pid")
    once = written(once.withColumn("rank", F.row_number().over(phrase.orderBy("rank"))).withColumn("m", F.max("rank").over(phrase)))
    first = words.filter(F.col("rank") <= 2).select("tid").unionByName(once.filter(F.col("rank") <= 2).select("tid")).distinct()
    rare = written(lists_of(index, written(terms.join(first, "tid", "left_semi"))).distinct())

    starts = rare.join(words.filter(F.col("rank") == 1).drop("rank"), "tid").filter(F.col("pos") >= F.col("off"))
    starts = starts.select("pid", "n", *DOC, (F.col("pos") - F.col("off")).alias("start"))
    two = at_offsets(starts.filter(F.col("n") > 1), rare, words.filter(F.col("rank") == 2))
    exact = written(two.unionByName(starts.filter(F.col("n") == 1)))
    anchors = rare.join(once.filter(F.col("rank") == 1).drop("rank"), "tid").select("pid", "m", *DOC, "pos")
    near = within_reach(anchors.filter(F.col("m") > 1), rare, once.filter(F.col("rank") == 2), within).select(*anchors.columns).distinct()
    near = written(near.unionByName(anchors.filter(F.col("m") == 1)))

    found = exact.select(*DOC).unionByName(near.select(*DOC))
    rest = written(lists_of(in_documents(index, found), terms).distinct())
    whole = at_offsets(exact.filter(F.col("n") > 2), rest, words.filter(F.col("rank") > 2)).groupBy(*exact.columns).agg(F.count(F.lit(1)).alias("_met"))
    exact = exact.filter(F.col("n") <= 2).unionByName(whole.filter(F.col("_met") == F.col("n") - 2).drop("_met"))
    # an anchor's neighbours are at most 2 * within - 1 places, each with the terms of one hash
    close = within_reach(near, rest, once, within).groupBy(*near.columns).agg(F.collect_list(F.struct("there", "tid")).alias("_at"))
    held = lambda s: F.size(F.array_distinct(F.transform(F.filter("_at", lambda x: (x["there"] >= s) & (x["there"] < s + within)), lambda x: x["tid"]))) == F.col("m")
    close = close.withColumn("s", F.explode(F.filter(F.array_distinct(F.transform("_at", lambda x: x["there"])), held)))

    texts = df.select(F.col(quoted(id_col)).alias("doc"), F.col(quoted(text_col)).alias("text")).withColumn("variant", variant(F.col("text")))
    exact, close = written(exact), written(close.select("pid", *DOC, "s").distinct())
    said = in_documents(texts, exact.select(*DOC).unionByName(close.select(*DOC))).distinct()
    said = other(said.select(*DOC, words_of(F.col("text")).alias("w")))
    spoken = F.array_join(F.slice("_w", F.col("start") + 1, F.col("n")), " ")
    exact = exact.join(known.select("pid", "phrase"), "pid").join(said, met_on()).filter(spoken == F.col("phrase")).select("pid", "n", *DOC, "start")
    asked = F.array_distinct(F.split("phrase", " "))
    all_there = F.size(F.array_intersect(asked, F.slice("_w", F.col("s") + 1, within))) == F.size(asked)
    close = close.join(known.select("pid", "phrase"), "pid").join(said, met_on()).filter(all_there).select("pid", *DOC).distinct()
    return written(exact), written(close)


def contamination(df: DataFrame, items: DataFrame, size: int = PHRASE, within: int = NEAR, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, near_ids) of each row of ``df``.

    ``n_hit`` words lie in an occurrence of a phrase of an item; ``item_ids`` are the
    items with such phrases, as strings in order; ``near_ids`` those with a phrase whose
    words all lie within some ``within`` words in a row. Null and empty texts have no
    words. Items without words ask for nothing; the words of items without an id are
    hit, but the item isn't listed. Rows of ``df`` without an id are documents as
    others; rows that share one are told apart by their texts, and repeated rows get
    equal results. Other columns are ignored, whatever their names. No rows give none.
    """
    index = build_index(df, id_col, text_col)
    of_item, known = phrases(items, size, item_col, item_text_col)
    hits, close = matches(df, index, known, within, id_col, text_col)
    covered = hits.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    covered = covered.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_hit"))

    def items_of(found: DataFrame, name: str) -> DataFrame:
        own = found.select(*DOC, "pid").distinct().join(of_item, "pid").select(*DOC, F.col("item").cast("string").alias("item")).distinct()
        return own.groupBy(*DOC).agg(F.sort_array(F.collect_list("item")).alias(name))

    out = index.select(*DOC, "n_words")
    for side in (covered, items_of(hits, "item_ids"), items_of(close, "near_ids")):
        out = out.join(other(side), met_on(), "left").drop("_doc", "_variant")
    none = F.array().cast("array<string>")
    return out.select(F.col("doc").alias(id_col), "n_words", F.coalesce("_n_hit", F.lit(0)).alias("n_hit"), F.coalesce("_item_ids", none).alias("item_ids"), F.coalesce("_near_ids", none).alias("near_ids"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark phrases of ten words in documents: words hit and items, by digests."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contamination(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_ids").cast("long").alias("n_near_items"),
    )


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), s AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS st FROM i WHERE len(w) > 0
), p AS (SELECT DISTINCT item_id, array_to_string(w[st:st + 9], ' ') AS phrase, least(10, len(w)) AS n FROM s
), t AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d
), sizes AS (SELECT DISTINCT n FROM p
), g AS (
  SELECT d.doc_id, st, n, array_to_string(w[st:st + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS st FROM d, sizes WHERE len(w) >= n) d
), h AS (SELECT DISTINCT doc_id, st, n, phrase FROM g WHERE phrase IN (SELECT phrase FROM p)
), c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(st, st + n)) AS pos FROM h) GROUP BY doc_id
), o AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM (SELECT DISTINCT h.doc_id, p.item_id FROM h JOIN p ON h.phrase = p.phrase) GROUP BY doc_id
), q AS (SELECT DISTINCT phrase, unnest(string_split(phrase, ' ')) AS term FROM p
), m AS (SELECT phrase, count(*) AS m FROM q GROUP BY phrase
), e AS (
  SELECT q.phrase, t.doc_id, count(DISTINCT t.term) OVER (PARTITION BY q.phrase, t.doc_id ORDER BY t.pos RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k FROM q JOIN t ON q.term = t.term
), z AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM (SELECT DISTINCT e.phrase, doc_id FROM e JOIN m ON e.phrase = m.phrase AND e.k = m.m) x JOIN p ON x.phrase = p.phrase GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN z USING (doc_id)
"""
