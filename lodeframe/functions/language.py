"""Whether a text is in another language than English, and the languages of a country."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import quoted, words_of
from .text import CJK

# Latin letters with diacritics; the share of them and of CJK characters from which a text is foreign.
ACCENTED, LEAST_SHARE = "À-ɏ", 0.10
# Frequent words of French, Spanish, Italian, Portuguese, German and Dutch; their least share, and of how many words.
FREQUENT = words_of(
    "le la les des une nous notre avec pour dans est sont qui sur el los las una nuestra nuestro con para que como por "
    "il lo gli della nostro sono con per che os as uma nossa nosso com para que como und der die das ist sind unsere unser mit für von eine "
    "het een onze met voor zijn van"
)
LEAST_FREQUENT, LEAST_WORDS, SAMPLE = 0.12, 8, 4000
# The subject in other languages.
NATIVE_TERMS = ["intelligence artificielle", "intelligenza artificiale", "inteligencia artificial", "inteligência artificial", "künstliche intelligenz", "kunstmatige intelligentie", "artificiell intelligens", "tekoäly", "kunstig intelligens"]
# Languages by country.
COUNTRIES = {
    "japan": "en ja", "china": "en zh-cn", "hong kong": "en zh-tw", "taiwan": "en zh-tw", "south korea": "en ko", "korea": "en ko", "france": "en fr", "germany": "en de",
    "switzerland": "en de fr", "spain": "en es", "italy": "en it", "brazil": "en pt", "netherlands": "en nl", "sweden": "en sv", "norway": "en no", "denmark": "en da",
    "finland": "en fi", "belgium": "en nl fr", "austria": "en de", "mexico": "en es", "portugal": "en pt", "india": "en hi", "australia": "en", "united kingdom": "en",
    "united states": "en", "canada": "en fr",
}

_NO_LETTER = r"[\s\d\p{P}\p{S}]"
_EDGE = ("(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])")  # as the SQL's \b
_FREQUENT = "|".join(dict.fromkeys(FREQUENT))


def foreign_share(text: Column) -> Column:
    """CJK and accented characters over letters, of the first ``SAMPLE`` characters."""
    sample = F.substring(text, 1, SAMPLE)
    letters = F.length(F.regexp_replace(sample, _NO_LETTER, ""))
    found = F.regexp_count(sample, F.lit(f"[{CJK}{ACCENTED}]")).cast("double")
    return F.coalesce(F.try_divide(found, letters), F.lit(0.0))


def foreign_share_sql(text: str) -> str:
    sample = f"substr({text}, 1, {SAMPLE})"
    letters = f"length(regexp_replace({sample}, '{_NO_LETTER}', '', 'g'))"
    return f"coalesce(CASE WHEN {letters} = 0 THEN 0.0 ELSE len(regexp_extract_all({sample}, '[{CJK}{ACCENTED}]')) / {letters} END, 0.0)::DOUBLE"


def non_english(text: Column) -> Column:
    sample = F.substring(text, 1, SAMPLE)
    words = F.size(F.filter(F.split(sample, r"\s+"), lambda w: w != ""))
    often = F.regexp_count(sample, F.lit(f"(?i){_EDGE[0]}(?:{_FREQUENT}){_EDGE[1]}"))
    found = text.rlike(f"[{CJK}]") | text.rlike(f"(?iu)(?:{'|'.join(NATIVE_TERMS)})") | (foreign_share(text) >= LEAST_SHARE) | ((words >= LEAST_WORDS) & (often / words >= LEAST_FREQUENT))
    return F.coalesce(found, F.lit(False))


def non_english_sql(text: str) -> str:
    sample = f"substr({text}, 1, {SAMPLE})"
    words = f"len(list_filter(regexp_split_to_array({sample}, '\\s+'), lambda w: w <> ''))"
    often = f"len(regexp_extract_all({sample}, '(?i)\\b(?:{_FREQUENT})\\b'))"
    return f"coalesce(regexp_matches({text}, '[{CJK}]') OR regexp_matches({text}, '(?i)(?:{'|'.join(NATIVE_TERMS)})') OR {foreign_share_sql(text)} >= {LEAST_SHARE} OR ({words} >= {LEAST_WORDS} AND {often} / {words} >= {LEAST_FREQUENT}), FALSE)"


def languages(country: Column) -> Column:
    """By the country's name; else by the first name in the table that it is part of, or that is part of it; else English alone."""
    key = F.lower(F.trim(country))
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in COUNTRIES.items()])
    pick = lambda test: F.try_element_at(F.filter(table, test), F.lit(1))["v"]
    found = F.coalesce(pick(lambda x: x["k"] == key), pick(lambda x: key.contains(x["k"]) | x["k"].contains(key)), F.lit("en"))
    return F.split(F.when(country.isNull() | (country == ""), "en").otherwise(found), " ")


def languages_sql(country: str) -> str:
    table = "[" + ", ".join(f"{{'k': {quoted(k)}, 'v': {quoted(v)}}}" for k, v in COUNTRIES.items()) + "]"
    key = f"lower(trim({country}))"
    pick = lambda test: f"list_filter({table}, lambda x: {test})[1].v"
    found = f"coalesce({pick(f'x.k = {key}')}, {pick(f'contains({key}, x.k) OR contains(x.k, {key})')}, 'en')"
    return f"string_split(CASE WHEN {country} IS NULL OR {country} = '' THEN 'en' ELSE {found} END, ' ')"
