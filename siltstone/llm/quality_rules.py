"""Quality rules: line labels from a linear-chain conditional random field decide what stays.

Nobody has labelled lines, so their labels are hidden: a good document is mostly content and a bad one
mostly boilerplate, and lines that recur among ever different neighbours all over the corpus are
boilerplate in whatever document. The fit starts from these and then takes, in turns, the labels that
the field itself gives and the field that those labels give.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._blocks import as_list, blocks, ddl, fields, gather, mix, plain, row_of, text_batches, texts_of, word_codes, word_hashes

#: Labelled documents of each kind that a fit uses at most.
MOST_LABELLED = 1000
#: Lines of a labelled document that a fit uses at most.
MOST_LINES = 400
#: A line recurs if it has at least so many different pairs of neighbours, and at least this share of the number of documents.
FEWEST_PLACES, RECURRING = 8, 1e-3
#: A line of so many words weighs twice as much as one of none.
WEIGHING = 4
#: Code points of a line that can recur.
LEAST_LINE = 10
#: A document stays if content lines hold at least this share of its words.
LEAST_SHARE = 0.5
#: Steps and rate of the fit, and the weight of its penalty.
STEPS, RATE, PENALTY = 120, 0.2, 1e-3
#: Rounds of labels and fit.
ROUNDS = 3
#: Text bytes measured at once.
BLOCK = 2 << 20
#: Fixed values of the rules.
SYMBOLS, FEWEST_WORDS, MOST_REPEATED = "#*$%&|<>", 50, 50
FEATURES = ("bias", "length", "letters", "capitals", "digits", "symbols", "marks", "sentence_end", "word_length", "distinct_words", "repeats_line", "repeated_words", "recurs")


def _classes(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=np.int8)
    table[list(chars.encode())] = 1
    return table


LETTER = _classes("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER[0xC0:] = 1  # the first byte of other characters
CAPITAL = _classes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _classes("0123456789")
SYMBOL = _classes(SYMBOLS)
MARK = _classes("!?.,;:'\"()[]{}=+-_/\\@^~`")
CHAR = np.ones(256, dtype=np.int8)
CHAR[0x80:0xC0] = 0
SPACE = _classes(" \t\n\v\f\r")
END = _classes(".!?")


@dataclass
class Measures:
    """What the rules and the line labels need of a block of texts."""

    base: dict[str, np.ndarray]  # by document
    edges: np.ndarray  # lines of document i: edges[i] to edges[i + 1]
    words: np.ndarray  # by line
    features: np.ndarray  # by line, greater for lines of more words, which say more of their kind


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums between edges."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.itemsize > 1 else np.int32)
    np.cumsum(values, dtype=total.dtype, out=total[1:])
    return (total[edges[1:]] - total[edges[:-1]]).astype(np.int64)


def line_hashes(lines: pa.Array) -> np.ndarray:
    """A hash of each line, stripped and with A-Z in lower case; 0 for lines of fewer than LEAST_LINE code points."""
    coded = pc.ascii_lower(pc.ascii_trim(lines, characters=" \t\n\v\f\r")).dictionary_encode()
    hashes = word_hashes(coded.dictionary)
    hashes[pc.less(pc.utf8_length(coded.dictionary), LEAST_LINE).to_numpy(zero_copy_only=False)] = 0
    return hashes[coded.indices.to_numpy(zero_copy_only=False)]


def recurring_lines(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """The sorted hashes of the lines of ``df`` that recur among different neighbours.

    Copies of a text don't make its lines recur, since those keep their neighbours. A line
    counts if it has FEWEST_PLACES pairs of neighbours and RECURRING times as many as there
    are documents, so there are at most 1 / RECURRING such lines for each line of an
    average document. Places are made distinct in the tasks before they travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK):
            lines, edges = as_list(pc.split_pattern(texts_of(block.column(0)), "\n"))
            own = line_hashes(lines)
            before, after = np.append(np.uint64(1), own[:-1]), np.append(own[1:], np.uint64(1))
            full = np.diff(edges) > 0
            before[edges[:-1][full]] = after[edges[1:][full] - 1] = 1
            found = own != 0
            places = np.unique(np.stack([own[found], mix(before[found] + mix(after[found]))], axis=1).view(np.int64), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(places[:, 0]), pa.array(places[:, 1])], names=["line", "place"])

    least = max(FEWEST_PLACES, int(RECURRING * df.count()))
    places = df.select(F.col(text_col).alias("text")).mapInArrow(run, "line long, place long").distinct()
    found = places.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("line")
    with text_batches(df.sparkSession):
        rows = found.collect()
    return np.sort(np.array([r["line"] for r in rows], dtype=np.int64).view(np.uint64))


def measured(column: pa.Array, recurring: np.ndarray | None = None) -> Measures:
    """The measures of whole texts; null counts as empty, which is one line without words."""
    texts = texts_of(column)
    lines, edges = as_list(pc.split_pattern(texts, "\n"))
    coded = lines.dictionary_encode()
    line_codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = row_of(edges)
    codes, offsets, words = word_codes(lines)
    codes = codes.astype(np.int64)
    per_line = np.diff(offsets)
    n_words = sums(per_line, edges)
    word_sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(codes) else codes
    line_chars_in_words = sums(word_sizes, offsets)
    # lines equal to an earlier line of the document
    order = np.argsort(line_codes, kind="stable")
    again = np.zeros(len(lines), dtype=bool)
    again[order[1:]] = (line_codes[order][1:] == line_codes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    again &= per_line > 0
    # words in 3-word windows found more than once in the document
    doc_words = offsets[edges]
    starts = gather(doc_words[:-1], np.maximum(np.diff(doc_words) - 2, 0))
    covered = np.zeros(len(codes) + 1, dtype=np.int64)
    if len(starts):
        if len(words) < 1 << 21:
            key = (codes[starts] << 42) | (codes[starts + 1] << 21) | codes[starts + 2]
        else:  # one very long text: pairs get numbers first
            _, pair = np.unique((codes[starts] << 31) | codes[starts + 1], return_inverse=True)
            key = (pair.reshape(-1) << 31) | codes[starts + 2]
        of_doc = np.repeat(np.arange(len(n_words)), np.maximum(np.diff(doc_words) - 2, 0))
        order = np.argsort(key, kind="stable")
        same = (key[order][1:] == key[order][:-1]) & (of_doc[order][1:] == of_doc[order][:-1])
        found = starts[order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]]
        np.add.at(covered, found, 1)
        np.add.at(covered, found + 3, -1)
    repeated = (np.cumsum(covered)[:-1] > 0).astype(np.int64)
    # distinct words of each line
    in_line = row_of(offsets)
    order = np.argsort(codes, kind="stable")
    twice = np.zeros(len(codes), dtype=np.int64)
    twice[order[1:]] = (codes[order][1:] == codes[order][:-1]) & (in_line[order][1:] == in_line[order][:-1])
    # characters by kind
    raw = np.frombuffer(b"".join(lines.cast(pa.binary()).to_pylist()), dtype=np.uint8)
    byte_edges = np.concatenate(([0], np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64))))
    of = lambda table: sums(table[raw], byte_edges)
    letters, symbols, spaces = of(LETTER), of(SYMBOL), of(SPACE)
    visible = np.maximum(of(CHAR) - spaces, 1)
    ends = pc.utf8_rtrim_whitespace(lines)
    last = pc.fill_null(pc.match_substring_regex(ends, r"[.!?]$"), False).to_numpy(zero_copy_only=False)
    many = np.maximum(per_line, 1)
    features = np.stack(
        [
            np.ones(len(lines)),
            np.log1p(visible) / 8,
            letters / visible,
            of(CAPITAL) / np.maximum(letters, 1),
            of(DIGIT) / visible,
            symbols / visible,
            of(MARK) / visible,
            last,
            line_chars_in_words / many / 10,
            1 - sums(twice, offsets) / many,
            again,
            sums(repeated, offsets) / many,
            np.zeros(len(lines)) if recurring is None or not len(recurring) else np.isin(line_hashes(lines), recurring),
        ],
        axis=1,
    ).astype(np.float64) * (1 + np.log2(1 + per_line / WEIGHING))[:, None]
    base = {
        "n_words": n_words,
        "word_chars": sums(line_chars_in_words, edges),
        "n_symbols": sums(symbols, edges),
        "n_dup_lines": sums(again.astype(np.int64), edges),
        "n_repeat_words": sums(sums(repeated, offsets), edges),
    }
    return Measures(base, edges, per_line, features)


def steps_of(edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sequences, flat places) at position 0, 1, ... of all sequences that are so long."""
    lengths = np.diff(edges)
    order = np.argsort(-lengths, kind="stable")
    falling = -lengths[order]
    for t in range(int(lengths.max(initial=0))):
        live = order[: np.searchsorted(falling, -t)]
        yield live, edges[live] + t


def viterbi(scores: np.ndarray, edges: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The best label (0 boilerplate, 1 content) of each line, for all sequences at once."""
    n = len(edges) - 1
    best = np.zeros((n, 2))
    back = np.zeros((len(scores), 2), dtype=np.int8)
    path = list(steps_of(edges))
    for t, (live, at) in enumerate(path):
        if t == 0:
            best[live] = scores[at]
            continue
        through = best[live][:, :, None] + turn[None]
        back[at] = through.argmax(axis=1)
        best[live] = through.max(axis=1) + scores[at]
    labels = np.zeros(len(scores), dtype=np.int8)
    state = best.argmax(axis=1).astype(np.int8)
    lengths = np.diff(edges)
    for t in range(len(path) - 1, -1, -1):
        live, at = path[t]
        inner = lengths[live] > t + 1
        state[live[inner]] = back[at[inner] + 1, state[live[inner]]]
        labels[at] = state[live]
    return labels


def marginals(scores: np.ndarray, edges: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each line, and the expected number of each pair of neighbouring labels."""
    n = len(edges) - 1
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    path = list(steps_of(edges))
    lengths = np.diff(edges)
    log_sum = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for t, (_, at) in enumerate(path):
        ahead[at] = scores[at] if t == 0 else scores[at] + log_sum(ahead[at - 1][:, :, None] + turn[None], 1)
    for t in range(len(path) - 1, -1, -1):
        live, at = path[t]
        inner = at[lengths[live] > t + 1]
        behind[inner] = log_sum(turn[None] + (scores[inner + 1] + behind[inner + 1])[:, None, :], 2)
    whole = np.zeros(n)
    full = lengths > 0
    whole[full] = log_sum(ahead[edges[1:][full] - 1], 1)
    z = np.repeat(whole, lengths)
    single = np.exp(ahead + behind - z[:, None])
    first = np.ones(len(scores), dtype=bool)
    first[edges[:-1][full]] = False
    at = np.flatnonzero(first)
    pair = np.exp(ahead[at - 1][:, :, None] + turn[None] + (scores[at] + behind[at])[:, None, :] - z[at][:, None, None])
    return single, pair.sum(axis=0)


@dataclass
class Field:
    """A fitted field: weights (features x 2), turns (2 x 2), and the hashes of the lines that recur."""

    weights: np.ndarray
    turn: np.ndarray
    recurring: np.ndarray | None = None

    def labels(self, m: Measures) -> np.ndarray:
        """1 for content lines."""
        return viterbi(m.features @ self.weights, m.edges, self.turn)


def fit(features: np.ndarray, edges: np.ndarray, labels: np.ndarray) -> Field:
    """A field fitted to labelled lines by gradient steps on the mean conditional likelihood."""
    weights, turn = np.zeros((features.shape[1], 2)), np.zeros((2, 2))
    truth = np.eye(2)[labels]
    first = np.ones(len(labels), dtype=bool)
    first[edges[:-1][np.diff(edges) > 0]] = False
    at = np.flatnonzero(first)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (labels[at - 1], labels[at]), 1)
    moment = [np.zeros_like(weights), np.zeros_like(turn), np.zeros_like(weights), np.zeros_like(turn)]
    for step in range(1, STEPS + 1):
        single, pairs = marginals(features @ weights, edges, turn)
        grads = [features.T @ (truth - single) / len(labels) - PENALTY * weights, (seen_pairs - pairs) / len(labels) - PENALTY * turn]
        for i, (x, g) in enumerate(zip((weights, turn), grads, strict=True)):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            moment[i + 2] = 0.99 * moment[i + 2] + 0.01 * g * g
            x += RATE * (moment[i] / (1 - 0.9**step)) / (np.sqrt(moment[i + 2] / (1 - 0.99**step)) + 1e-8)
    return Field(weights, turn)


def fit_hidden(features: np.ndarray, edges: np.ndarray, words: np.ndarray, quality: np.ndarray) -> Field:
    """A field fitted to lines whose labels are hidden, from the quality of their documents.

    Lines start with the label of their document, recurring ones as boilerplate. In each
    of ROUNDS rounds a field is fitted, and lines take the labels that it finds likely,
    as long as their document still has most of its words in lines of its own kind;
    recurring lines stay boilerplate.
    """
    recurs = features[:, FEATURES.index("recurs")] > 0
    of = row_of(edges)
    start = np.where(recurs, 0, quality[of])
    labels = start
    for _ in range(ROUNDS):
        field = fit(features, edges, labels)
        single, _ = marginals(features @ field.weights, edges, field.turn)
        new = np.where(recurs, 0, single[:, 1] > 0.5).astype(np.int64)
        own = np.bincount(of, weights=words * (new == quality[of]), minlength=len(quality))
        all_ = np.bincount(of, weights=words, minlength=len(quality))
        labels = np.where((2 * own > all_)[of], new, start)
    return fit(features, edges, labels)


def fit_field(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """The field fitted to the lines of labelled documents; None without documents of both kinds.

    ``labels`` has (id_col, quality 0/1). At most ``most`` documents of each kind count,
    the first by a hash of the id, and MOST_LINES lines of each. Their lines'
    labels are hidden (fit_hidden()). Tasks turn texts to features, so the driver gets a
    few numbers for each of these lines.
    """
    recurring = recurring_lines(docs, text_col)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").cast("long").alias("quality"))
    known = known.join(docs.filter(F.col(text_col).isNotNull()).select(id_col).distinct(), id_col, "left_semi")
    parts = [known.filter(F.col("quality") == q).orderBy(F.xxhash64(id_col), id_col).limit(most) for q in (0, 1)]
    sample = parts[0].unionByName(parts[1])  # 2 * most rows at most, so it may be broadcast
    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(sample), id_col).select("text", "quality", id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK):
            m = measured(block.column(0), recurring)
            out = []
            for i in range(block.num_rows):
                own = slice(m.edges[i], m.edges[i + 1])
                used = np.flatnonzero(m.words[own] > 0)[:MOST_LINES] + m.edges[i]
                out.append(np.column_stack([m.features[used], m.words[used]]).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([block.column(2), block.column(1), pa.array(out, pa.binary())], names=["id", "quality", "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    with text_batches(docs.sparkSession):
        rows = chosen.mapInArrow(run, f"id {kind}, quality long, features binary").collect()
    rows = sorted((r for r in rows if r["features"]), key=lambda r: (r["id"], bytes(r["features"])))
    if len({r["quality"] for r in rows}) < 2:
        return None
    matrices = [np.frombuffer(r["features"], dtype="<f4").reshape(-1, len(FEATURES) + 1).astype(np.float64) for r in rows]
    edges = np.cumsum([0, *map(len, matrices)])
    lines = np.concatenate(matrices)
    field = fit_hidden(lines[:, :-1], edges, lines[:, -1], np.array([r["quality"] for r in rows]))
    return Field(field.weights, field.turn, recurring)


def quality_rules(df: DataFrame, field: Field | None, least_share: float = LEAST_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``df`` with measures and the verdict of each document.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    line_labels array<int> (1 content, 0 boilerplate, by line), content_share (of the
    words) and kept; they stand instead of columns of the same names. Null, empty and
    blank texts fail the base rules. Without a field every line is content. Each row is
    judged alone, so repeated rows get equal results and empty tables none. Other columns
    pass through, whatever their names.
    """
    new = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "line_labels": "array<int>", "content_share": "double", "kept": "boolean"}
    names = fields(df, tuple(new))
    rows, (text,) = plain(df, names, text_col)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, BLOCK):
            m = measured(block.column(at), field.recurring if field else None)
            labels = field.labels(m) if field else np.ones(len(m.words), dtype=np.int8)
            n = m.base["n_words"]
            share = sums(m.words * labels, m.edges) / np.maximum(n, 1)
            failed = (n < FEWEST_WORDS) | (100 * m.base["n_repeat_words"] > MOST_REPEATED * n)
            lists = pa.ListArray.from_arrays(pa.array(m.edges, pa.int32()), pa.array(labels.astype(np.int32)))
            results = [*map(pa.array, m.base.values()), pa.array(failed), lists, pa.array(share), pa.array(~failed & (share >= least_share))]
            yield pa.RecordBatch.from_arrays([*block.columns, *results], names=[*block.schema.names, *new])

    return rows.mapInArrow(run, ddl(rows, rows.columns) + "".join(f", {c} {t}" for c, t in new.items())).toDF(*names, *new)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with base measures and the verdict of the labelled lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules(docs, field).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
