"""String column builders: PII normalisation, product text parsing."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# Colour keywords, in the reference's order (equal-length keywords keep this
# order after the longest-first sort).
COLOR_KEYWORDS = [
    "black titanium", "white titanium", "desert titanium", "natural titanium",
    "black", "white", "silver", "gold", "space grey", "space gray", "midnight",
    "starlight", "pink", "blue", "green", "purple", "red", "yellow", "orange",
    "teal", "ultramarine", "clay", "guava", "cypress", "winter blue", "storm blue",
    "elderberry", "slate blue", "abyss blue", "dark cherry", "forest green", "ink",
    "umber", "lilac", "succulent", "sunglow", "olive", "soft mint", "light blue",
    "sunshine", "taupe", "mulberry", "pacific blue", "evergreen", "indigo",
    "pride edition", "bright orange", "clover", "moss green", "golden brown",
    "sequoia green", "wisteria", "marigold", "pink pomelo", "blue jay",
    "lemon zest", "eucalyptus", "nectarine", "blue fog", "english lavender",
    "marine blue", "canary yellow", "sky", "gray", "grey", "clear", "transparent",
    "blk", "gry", "pnk", "wht", "blu", "grn", "org", "ylw", "crm",
]
# Keyword -> display name where it is not simply title case.
COLOR_NAMES = {
    "blk": "Black", "black": "Black", "gry": "Gray", "gray": "Gray", "grey": "Gray",
    "pnk": "Pink", "wht": "White", "blu": "Blue", "grn": "Green", "org": "Orange",
    "ylw": "Yellow", "crm": "Cream",
}
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
SIZE_PATTERN = r"(?i)(\d{1,4})\s*(GB|TB|mm)"
NO_SIZE_CATEGORIES = r"(?i)3RD ACC|DEMO"
# ---------------------------------------------------------------------------


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sorted_color_keywords(keywords: Sequence[str] = tuple(COLOR_KEYWORDS)) -> list[str]:
    """Longest first; stable, so equal lengths keep list order."""
    return sorted(keywords, key=len, reverse=True)


def normalize_ws(c: str | Column) -> Column:
    """Lower, whitespace runs -> one space, trim."""
    return F.trim(F.regexp_replace(F.lower(_col(c).cast("string")), r"\s+", " "))


def valid_email(c: str | Column, pattern: str = EMAIL_PATTERN) -> Column:
    """The address if it looks valid, else null."""
    c = _col(c)
    return F.when(c.rlike(pattern), c)


def clean_phone(c: str | Column) -> Column:
    """Digits only, leading '84' -> '0'; then by length of that value:
    < 9 null; 9 starting with 0 null; 9 otherwise prefixed with '0';
    >= 12 null; 10-11 kept."""
    d = F.regexp_replace(F.regexp_replace(_col(c).cast("string"), r"\D", ""), "^84", "0")
    n = F.length(d)
    return (F.when(n < 9, F.lit(None).cast("string"))
            .when((n == 9) & d.startswith("0"), F.lit(None).cast("string"))
            .when(n == 9, F.concat(F.lit("0"), d))
            .when(n >= 12, F.lit(None).cast("string"))
            .otherwise(d))


def title_name(c: str | Column, missing_word: str = "unknown") -> Column:
    """The missing word -> null, then word-initial capitals."""
    c = _col(c)
    return F.initcap(F.when(c != missing_word, c))


def mask_email(c: str | Column) -> Column:
    """Keep the first character of the local part, its last character
    when it has 3 or more, and the domain; stars in between.  Null -> ''."""
    e = _col(c)
    at = F.instr(e, "@")
    local_len = at - 1
    last_local = F.substr(e, local_len, F.lit(1))
    domain = F.substr(e, at, F.length(e) - at + 1)
    masked = (F.when(local_len >= 3, F.concat(F.substring(e, 1, 1),
                                              F.repeat(F.lit("*"), local_len - 2),
                                              last_local, domain))
              .when(local_len == 2, F.concat(F.substring(e, 1, 1), F.lit("*"), domain))
              .otherwise(e))
    return F.coalesce(masked, F.lit(""))


def normalize_key(c: str | Column) -> Column:
    """Lookup key as text without a trailing '.0', trimmed."""
    return F.trim(F.regexp_replace(_col(c).cast("string"), r"\.0$", ""))


def keyword_pattern(keywords: Sequence[str]) -> str:
    """A pattern for the longest keyword at a place: the keywords as a tree of
    shared beginnings, longer ones tried first."""
    tree: dict = {}
    for keyword in keywords:
        node = tree
        for letter in keyword:
            node = node.setdefault(letter, {})
        node[""] = {}

    def of(node: dict) -> str:
        longer = [re.escape(letter) + of(below) for letter, below in node.items() if letter]
        if not longer:
            return ""
        return f"(?:{'|'.join(longer)})" + ("?" if "" in node else "")

    return of(tree)


def extract_color(name: str | Column, description: str | Column,
                  keywords: Sequence[str] = tuple(COLOR_KEYWORDS), whole_word: bool = False) -> Column:
    """First keyword (longest first) contained in name + description,
    '/' and '-' read as spaces; abbreviations mapped, others title-cased.  With
    ``whole_word`` a keyword counts only between characters that are neither
    letters nor digits ('red' is not in 'powered').

    One look-ahead pattern gives the longest keyword at each place of the text;
    the longest of those wins, of equal lengths the first in the list."""
    text = F.regexp_replace(
        F.lower(F.concat_ws(" ", F.coalesce(_col(name).cast("string"), F.lit("")),
                            F.coalesce(_col(description).cast("string"), F.lit("")))),
        "[/-]", " ")
    ordered = sorted_color_keywords(keywords)
    found = keyword_pattern(ordered)
    found = rf"(?<![\p{{L}}\p{{N}}])(?=({found})(?![\p{{L}}\p{{N}}]))" if whole_word else f"(?=({found}))"
    rank = F.create_map(*[F.lit(x) for k, keyword in enumerate(ordered, 1) for x in (keyword, k)])
    best = F.array_min(F.transform(F.regexp_extract_all(text, F.lit(found), 1), lambda k: F.try_element_at(rank, k)))
    shown = F.array(*[F.lit(COLOR_NAMES[k]) if k in COLOR_NAMES else F.initcap(F.lit(k)) for k in ordered])
    return F.try_element_at(shown, best)


def extract_size(name: str | Column, category: str | Column) -> Column:
    """X8: '256 GB' -> '256GB' (first match), null when absent or when the
    category is an accessory / demo group."""
    n = _col(name)
    size = F.concat(F.regexp_extract(n, SIZE_PATTERN, 1), F.regexp_extract(n, SIZE_PATTERN, 2))
    size = F.when(F.coalesce(size, F.lit("")) != "", size)
    return F.when(~F.coalesce(_col(category).rlike(NO_SIZE_CATEGORIES), F.lit(False)), size)


def compose_product_name(product_name: str | Column, sub_category: str | Column,
                         color: str | Column, size: str | Column,
                         own_brand: str | Column) -> Column:
    """Own-brand with colour -> 'sub colour size'; others with colour and
    sub-category -> 'sub colour'; else the original name.  Trimmed, upper."""
    pn, sub, col, sz, own = map(_col, (product_name, sub_category, color, size, own_brand))
    own_dev = own & col.isNotNull()
    name = (F.when(own_dev, F.concat(F.coalesce(sub, F.lit("")), F.lit(" "), col, F.lit(" "),
                                     F.coalesce(sz, F.lit(""))))
            .when(col.isNotNull() & sub.isNotNull(), F.concat(sub, F.lit(" "), col))
            .otherwise(pn))
    return F.upper(F.trim(name))
