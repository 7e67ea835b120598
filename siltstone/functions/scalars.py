"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def format_bytes(n: Column) -> Column:
    """Bytes for people: powers of 1024, whole bytes, else one decimal rounded half to even."""
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in list(enumerate(UNITS))[1:]:
        value = F.format_string("%.1f " + unit, F.bround(n / F.lit(1024.0**k), 1))
        out = F.when(n >= 1024**k, value).otherwise(out)
    return out


def to_signed(u: Column) -> Column:
    """An unsigned 64-bit number (decimal) as the signed one of the same bits."""
    u = u.cast("decimal(20,0)")
    return F.when(u >= F.lit(str(2**63)).cast("decimal(20,0)"), u - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(u).cast("long")


def to_unsigned(s: Column) -> Column:
    """The inverse of to_signed, as decimal(20,0)."""
    d = s.cast("decimal(20,0)")
    return F.when(s < 0, d + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def version_numbers(v: Column) -> Column:
    """The numbers of a version: without a leading v, cut at a pre-release or build mark."""
    core = F.regexp_replace(F.regexp_replace(F.trim(v), "^[vV]", ""), "[-+].*$", "")
    return F.transform(F.split(core, "\\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def is_newer(a: Column, b: Column) -> Column:
    """Whether version a is above b; missing numbers are 0."""
    x, y = version_numbers(a), version_numbers(b)
    n = F.greatest(F.size(x), F.size(y))
    pad = lambda v: F.concat(v, F.array_repeat(F.lit(0), n - F.size(v)))
    return pad(x) > pad(y)


def bucket_of(value: Column, buckets: int = 256) -> Column:
    """A stable bucket of a string."""
    return (F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def label_of(group: Column) -> Column:
    """A category group as a title."""
    return F.initcap(F.replace(group, F.lit("_"), F.lit(" ")))


def keyword_hits(lowered: Column, keywords: tuple[str, ...]) -> Column:
    """How many of the keywords a lower-case text contains."""
    out = F.lit(0)
    for k in keywords:
        out = out + F.contains(lowered, F.lit(k)).cast("int")
    return out


def age_days(now: float, mtime: Column) -> Column:
    """Whole days between."""
    return F.floor((F.lit(now) - mtime) / 86400.0)


def iso_time(epoch: Column) -> Column:
    """Seconds since 1970 as ISO 8601 in UTC."""
    return F.concat(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def selection_hash(scan: Column, tier: Column, group: Column, paths: Column) -> Column:
    """The digest of a selection, whatever the order of its paths."""
    return F.sha2(F.to_json(F.struct(group.alias("id"), F.sort_array(paths).alias("paths"), scan.alias("scan_id"), tier.alias("tier"))), 256)


def version_rank(stem: Column) -> Column:
    """The rank that a file stem claims: v-number or number in parentheses, 1 for a copy, 1000 more for final; null for none."""
    v = F.regexp_extract(stem, r"(?i)(?:^|[_\-\s])v(?:ersion)?[_\-\s]?(\d+)", 1)
    paren = F.regexp_extract(stem, r"\((\d+)\)", 1)
    number = F.greatest(F.nullif(v, F.lit("")).cast("double"), F.nullif(paren, F.lit("")).cast("double"))
    mark = lambda w: stem.rlike(rf"(?i)(?:^|[_\-\s.]){w}(?:$|[_\-\s.])")
    base = F.coalesce(number, F.when(mark("copy"), F.lit(1.0)))
    return F.when(mark("final"), F.coalesce(base, F.lit(0.0)) + 1000.0).otherwise(base)
