"""Column functions on URLs and hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def host(url: str | Column) -> Column:
    """The host in lower case, "" where there is none."""
    return F.lower(F.regexp_extract(_col(url), r"^[a-zA-Z]+://([^/?#:]+)", 1))


def path(url: str | Column) -> Column:
    return F.regexp_extract(_col(url), r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)


def suffixes(name: str | Column) -> Column:
    """a.b.c gives a.b.c, b.c and c: keys under which rules for a host and its subdomains are found by equality."""
    labels = F.split(_col(name), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def same_site(a: Column, b: Column) -> Column:
    """Equal, or one is a subdomain of the other."""
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def url_hash(url: str | Column) -> Column:
    """SHA-256 of the trimmed lower-case URL without slashes at its end."""
    return F.sha2(F.regexp_replace(F.lower(F.trim(_col(url))), "/+$", ""), 256)


def quote_key(url: str | Column) -> Column:
    """Trimmed, lower case, without query, fragment and one slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(url))), "[#?].*$", ""), "/$", "")


# Second-level labels under which country domains register names.
SECOND_LEVEL = ("co", "com", "net", "org", "gov", "ac", "edu")


def registrable_by_pattern(name: Column) -> Column:
    """Two labels, or three below a two-letter domain's second-level label."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^www\.", ""), r":\d+$", "")
    three = F.regexp_extract(bare, rf"([^.]+\.(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$", 1)
    return F.when(three != "", three).otherwise(F.regexp_extract(bare, r"([^.]+\.[^.]+)$", 1))


def registrable_by_set(name: Column, ends: tuple[str, ...] = ("example.com", "example.org")) -> Column:
    """Two labels, or three where the last two are in a fixed set."""
    labels = F.split(name, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    return F.when(two.isin(*ends), three).otherwise(two)


def domain(value: str | Column) -> Column:
    """The host of a URL or a bare host, in lower case, without www. and a dot at its end."""
    text = F.lower(F.trim(_col(value)))
    bare = F.regexp_replace(F.regexp_replace(text, "^[a-z]+://", ""), "[/?#:].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"\.$", "")
