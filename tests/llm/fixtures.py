"""Small tables with the odd cases every operator has to stand."""

import random

from pyspark.sql import types as T

COLUMNS = "doc_id long, text string, n_words long, kept_text string, _keys long"
WORDS = "the of and to in a is that it was for on are with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly", ","]) for _ in range(n))


def texts(seed=0):
    """Nulls, blanks, a very long text, copies, near copies, shared passages and lines, odd characters."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(30, 120)) for _ in range(12)]
    passage, line = sentence(rng, 45), "  A Shared LINE of text, found often \t"
    out = [None, "", " \n\t ", "one", "two words", "tab\tand\vfeed\fmixed\r\nends \n\nx", "é́ Ünï 汉字 <|endoftext|> ▁ a  b   ", "\x00 \x1f odd\xa0space", "word " * 60]
    out += base + base[:3]
    for b in base[:5]:
        w = b.split()
        w[3] = "changed"
        out.append(" ".join(w))
    out += [f"{sentence(rng, 15)} {passage} {sentence(rng, 9)}\n{line}\n{sentence(rng, 4)}" for _ in range(6)]
    out += [f"{line.strip().upper()}\n{line}\nshort\nshort"] * 3
    out.append(" ".join(sentence(rng, 400) for _ in range(10)) + "\n" + passage)
    out.append("x" * 3000 + " " + "y" * 50)
    return out


def documents(spark, extra=True):
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts())]
    rng = random.Random(5)
    rng.shuffle(rows)
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return spark.createDataFrame([(i, t, 7, "clash", 9) for i, t in rows], COLUMNS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))


def words(text):
    return [w.decode() for w in (text or "").encode().split()]
