"""Scalar functions on text, ids, time and scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(c: Column) -> Column:
    """Line ends become LF, runs of blanks one blank, three or more line ends two; white space at the ends goes."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokenize(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.transform(F.regexp_extract_all(c, F.lit("[a-zA-Z0-9]+"), F.lit(0)), lambda t: F.lower(t))


def stable_id(prefix: str, *parts: Column, digits: int = 16) -> Column:
    """A content id: the prefix and the first digits of a SHA-256 over the parts."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, digits))


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def binary_round(c: Column, digits: int) -> Column:
    """The double times a power of ten, to the nearest whole (halves away from 0), divided again: DuckDB's round(). Spark's own
    rounds the decimal text, which differs for 1.4 % of the ties."""
    up = F.abs(c) * F.lit(10.0**digits)
    # Beyond 2**52 a double is whole; a cast in floor() would cut it off.
    near = F.when(up < 2.0**52, F.floor(up) + F.when(up - F.floor(up) >= 0.5, 1).otherwise(0)).otherwise(up)
    return F.signum(c) * near / F.lit(10.0**digits)


def exact_mean(c: Column) -> Column:
    """The mean (an aggregate) of doubles from an exact sum of their decimals (ten digits behind the point), so that it does
    not depend on the order of rows; the plain mean where a value is no such decimal."""
    exact = c.try_cast("decimal(28,10)")
    return F.when(F.count(exact) == F.count(c), F.sum(exact).cast("double") / F.count(c)).otherwise(F.avg(c))


def recency(observed: Column, as_of: Column) -> Column:
    """exp(-age in days / 365); 0.5 where the time is unknown, and no age below 0."""
    seconds = lambda t: F.unix_micros(t.cast("timestamp")) / F.lit(1e6)
    age = F.greatest(F.lit(0.0), (seconds(as_of) - seconds(observed)) / F.lit(86400.0))
    return F.coalesce(F.exp(-age / 365.0), F.lit(0.5))


def strength(confidence: Column, quality: Column) -> Column:
    return F.sqrt(confidence * quality)


def grade(c: Column) -> Column:
    return F.when(c >= 0.7, "strong").when(c >= 0.4, "moderate").otherwise("weak")


def topic(event_type: Column) -> Column:
    return F.substring_index(event_type, ".", 1)


def retry_delay(attempt: Column, initial: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    """Seconds before an attempt is repeated."""
    return F.least(F.lit(initial) * F.pow(F.lit(factor), F.greatest(F.lit(0), attempt - 1)), F.lit(most))


def identity(subject: Column, predicate: Column, obj: Column) -> Column:
    """A claim's identity: case and runs of white space do not count."""
    one = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " "))
    return F.concat_ws("\x1f", one(subject), one(predicate), one(obj))


def new_id(prefix: str) -> Column:
    """A random id, another one for each row and each run; ids that must last are stable_id()."""
    return F.concat(F.lit(prefix + "_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))


def now_text() -> Column:
    """The time of the query in UTC, to the second."""
    return time_text(F.current_timestamp())


def time_text(t: Column) -> Column:
    """A time as text in UTC, to the second, with Z."""
    return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def time_of(text: Column) -> Column:
    """A time from its text; one without a zone is an error."""
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.when(text.isNull(), None).when(zoned, F.to_timestamp(text)).otherwise(F.raise_error(F.concat(F.lit("a time needs a zone: "), text)))


def span_slice(text: Column, start: Column, end: Column) -> Column:
    """The characters from start to end, 0-based and half-open."""
    return F.substring(text, start + 1, F.greatest(F.lit(0), end - start))


def checked_unit(c: Column) -> Column:
    """A number between 0 and 1; others, and null, are an error."""
    return F.when(c.between(0, 1), c).otherwise(F.raise_error(F.lit("confidence out of range")))


def embedding_id(object_id: Column, model: Column, version: Column) -> Column:
    return stable_id("emb", object_id, model, version)


def lease_valid(expires: Column, now: Column) -> Column:
    return now < expires
