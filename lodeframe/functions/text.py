"""Column functions on text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import _col

# Ideographs, kana and hangul.
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
# Accented letters that tell of another language than English.
ACCENTED = "àâäáãåæçéèêëíìîïñóòôöõøœßúùûüýÿ"
# Frequent words of other languages.
FOREIGN = "der die das und ist nicht mit von für auf ein eine les des une est dans pour que qui avec sur el los las una por con para como del"


def tokens(text: str | Column, least: int = 3) -> Column:
    """Words of ASCII letters, digits and underscores of at least ``least`` characters, then the pairs of CJK runs."""
    col = F.lower(_col(text))
    plain = F.regexp_replace(F.regexp_replace(col, f"[{CJK}]+", " "), r"[^A-Za-z0-9_\s]", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) >= least)
    return F.concat(words, cjk_bigrams(col))


def cjk_bigrams(text: str | Column) -> Column:
    runs = F.regexp_extract_all(_col(text), F.lit(f"([{CJK}]+)"), F.lit(1))
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))
    return F.flatten(F.transform(runs, pairs))


def normal_quote(text: str | Column) -> Column:
    """One form of quotes, dashes and blanks; no other punctuation; blanks collapsed; lower case."""
    col = F.translate(_col(text), "‘’“”–— ", "''\"\"-- ")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(col, r"""[.,;:!?'"()\[\]]""", ""), "[ \\t\\n\\r\\f\\x0B]+", " ")))


def title_stem(title: str | Column, most: int = 8) -> Column:
    """The first words of a title without its file ending."""
    col = F.regexp_replace(F.lower(_col(title)), r"\.(pdf|html?|docx?)$", "")
    words = F.filter(F.split(F.regexp_replace(col, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.slice(words, 1, most), " ")


def years(text: str | Column, last: int, first: int = 1990) -> Column:
    """Plausible years in the text."""
    found = F.transform(F.regexp_extract_all(_col(text), F.lit(r"((?:19|20)[0-9]{2})"), F.lit(1)), lambda y: y.cast("int"))
    return F.filter(found, lambda y: (y >= first) & (y <= last))


def topic_pattern(topics: list[str]) -> str:
    """One alternation; words are bounded by characters that aren't ASCII letters, digits or underscores."""
    parts = [re.escape(x.strip()).replace(r"\ ", r"\s+") for x in sorted(set(topics), key=lambda x: (-len(x), x))]
    return rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(parts)})(?![A-Za-z0-9_])"


def share_of(text: Column, letters: str) -> Column:
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(f"[{letters}]")).cast("double"), F.length(text)), F.lit(0.0))


def non_english(text: str | Column, sample: int = 4000) -> Column:
    """A tenth of CJK or accented letters, or frequent foreign words from 12 % of at least eight words."""
    col = F.lower(F.substring(_col(text), 1, sample))
    words = F.filter(F.split(col, "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")
    foreign = F.size(F.filter(words, lambda w: w.isin(*FOREIGN.split())))
    return (share_of(col, CJK) >= 0.1) | (share_of(col, ACCENTED) >= 0.1) | ((F.size(words) >= 8) & (foreign >= 0.12 * F.size(words)))


def seed(text: str | Column) -> Column:
    """The first four bytes of the SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(_col(text), 256), 1, 8), 16, 10).cast("long")


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)
