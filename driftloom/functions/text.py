"""Text cleaning and tokens as native column expressions (no Python per row)."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns define the token stream and must not change.
URL = r"(?U)(?:https?://|www\.)\S+"
MENTION = r"@[\p{L}\p{N}_]+"
REPEAT = r"(?d)(.)\1{2,}"
TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"
CHARREF = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"

# Code points that HTML maps to another character (the Windows-1252 block).
C1_REPLACEMENTS = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…",
    0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š",
    0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’",
    0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—",
    0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ",
    0x9E: "ž", 0x9F: "Ÿ",
}


def _literal_map(entries: dict[str, str]) -> Column:
    """A constant string map; the optimizer folds it to one literal."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _numeric_charref(code: Column) -> Column:
    hexadecimal = F.conv(F.regexp_extract(code, r"^&#[xX]([0-9a-fA-F]+)", 1), 16, 10)
    decimal = F.regexp_extract(code, r"^&#([0-9]+)", 1)
    digits = F.when(code.rlike(r"^&#[xX]"), hexadecimal).otherwise(decimal)
    # More than 9 digits cannot be a code point; keep the cast inside LONG.
    num = F.when(F.length(F.ltrim(digits, F.lit("0"))) > 9, F.lit(0x7FFFFFFF)).otherwise(digits.cast("long"))
    special = {str(k): v for k, v in C1_REPLACEMENTS.items()} | {"0": "�", "13": "\r"}
    dropped = (
        num.between(0x1, 0x8) | num.between(0xE, 0x1F) | num.between(0x7F, 0x9F)
        | num.between(0xFDD0, 0xFDEF) | (num == 0xB)
        | ((num >= 0xFFFE) & (num % 0x10000 >= 0xFFFE))
    )
    utf8 = F.decode(F.unhex(F.lpad(F.hex(num), 8, "0")), "UTF-32")
    return (
        F.when(F.element_at(_literal_map(special), num.cast("string")).isNotNull(),
               F.element_at(_literal_map(special), num.cast("string")))
        .when(num.between(0xD800, 0xDFFF) | (num > 0x10FFFF), F.lit("�"))
        .when(dropped, F.lit(""))
        .otherwise(utf8)
    )


def _named_charref(code: Column) -> Column:
    names = {f"&{k}": v for k, v in html.entities.html5.items()}
    legacy = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=len, reverse=True)
    prefix = F.regexp_extract(code, "^&(?:" + "|".join(legacy) + ")", 0)
    by_prefix = F.concat(
        F.element_at(_literal_map(names), prefix),
        F.substring(code, F.length(prefix) + 1, F.length(code)),
    )
    # The few usual names first: a lookup in the full map is a scan of 2,231 entries.
    usual = {f"&{n};": html.entities.html5[f"{n};"] for n in ("amp", "lt", "gt", "quot", "nbsp")}
    return F.coalesce(
        F.element_at(_literal_map(usual), code),
        F.element_at(_literal_map(names), code),
        F.when(prefix != "", by_prefix),
        code,
    )


def unescape_html(text: Column) -> Column:
    """HTML character references resolved in one pass (`&amp;gt;` gives `&gt;`)."""
    pieces = F.split(text, CHARREF, -1)
    codes = F.regexp_extract_all(text, F.lit(CHARREF), F.lit(0))

    def resolve(code: Column) -> Column:
        return F.when(code.startswith("&#"), _numeric_charref(code)).otherwise(_named_charref(code))

    joined = F.array_join(
        F.zip_with(pieces, F.transform(codes, resolve),
                   lambda piece, char: F.concat(piece, F.coalesce(char, F.lit("")))),
        "",
    )
    return F.when(text.contains("&"), joined).otherwise(text)


def drop_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " ")


def drop_mentions(text: Column) -> Column:
    return F.regexp_replace(text, MENTION, " ")


def open_hashtags(text: Column) -> Column:
    return F.translate(text, "#", " ")


def squeeze_repeats(text: Column) -> Column:
    return F.regexp_replace(text, REPEAT, "$1$1")


def clean(text: Column) -> Column:
    """Unescape, lowercase, drop URLs and mentions, open hashtags, squeeze repeats."""
    lowered = F.lower(unescape_html(text))
    return squeeze_repeats(open_hashtags(drop_mentions(drop_urls(lowered))))


def tokens(text: Column) -> Column:
    """Unigrams of the cleaned text, in order, duplicates kept."""
    return F.regexp_extract_all(clean(text), F.lit(TOKEN), F.lit(0))


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once.

    The optimizer may inline a column into its users; inside a higher-order function that
    would compute it again for every element. A lambda variable cannot be inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_bag(tokens_col: Column) -> Column:
    """array<struct<word, k>>: distinct tokens of a row with their counts.

    Counting is a run-length pass over the sorted tokens, so it needs no shuffle.
    """

    def starts(words: Column) -> Column:
        return F.filter(
            F.transform(words, lambda _, i: i),
            lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))

    def runs(words: Column, first: Column) -> Column:
        return F.transform(first, lambda i, j: F.struct(
            F.get(words, i).alias("word"),
            (F.coalesce(F.get(first, j + 1), F.size(words)) - i).cast("long").alias("k")))

    return _let(F.sort_array(tokens_col),
                lambda words: _let(starts(words), lambda first: runs(words, first)))


def mentions_topic(tokens_col: Column, keywords: list[str]) -> Column:
    """True where the token set meets the keyword set."""
    return F.arrays_overlap(tokens_col, F.array(*[F.lit(w) for w in sorted(keywords)]))
