"""Names and labels as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F, types as T

from ..config import BUILDER_MARKETS

#: Accented letters of Latin-1 and Latin Extended-A, beside the letters without accents.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcCcCcDdEeEeEeEeEeGgGgGgGgHhIiIiIiIiIJjKkLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzZz"
#: Letters that no decomposition reaches.
UNDECOMPOSED = "ØøĐđŁłð"
UNDECOMPOSED_PLAIN = "OoDdLld"
#: Club suffixes without meaning for a comparison.
CLUB_SUFFIXES = ("fc", "afc", "cf", "sc")


#: What a management unit's name loses or becomes, in this order.
UNIT_RULES = (
    ("^RETABET ", ""),
    ("^RETA ", ""),
    (" RETA$", ""),
    (r"^C\. LA MANCHA$", "CASTILLA LA MANCHA"),
    ("^$", "UNKNOWN"),
)


def strip_accents(text: Column) -> Column:
    """Letters without accents: precomposed ones by translation, combining marks removed."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}", "")


@F.pandas_udf(T.StringType())
def strip_accents_exact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The same over all of Unicode, by canonical decomposition."""
    import unicodedata

    for batch in batches:
        yield batch.map(
            lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
        )


def management_unit(raw: Column) -> Column:
    """A region's one name: without accents, upper case, without the brand before or after it."""
    # one chain: an expression that is used twice is evaluated twice
    name = F.trim(F.upper(strip_accents(raw)))
    for pattern, by in UNIT_RULES:
        name = F.regexp_replace(name, pattern, by)
    return F.coalesce(name, F.lit("UNKNOWN"))


def is_brand_unit(raw: Column) -> Column:
    return F.coalesce(F.upper(raw).contains("RETA"), F.lit(False))


def market(raw: Column) -> Column:
    """A market's one name: slots in braces removed, except where they are the whole name."""
    label = raw
    for pattern, by in ((r"\{[^}]*\}", ""), (r"\s+", " "), (r"^[ :-]+|[ :-]+$", ""), ("^$", "UNKNOWN")):
        label = F.regexp_replace(label, pattern, by)
    out = F.coalesce(label, F.lit("UNKNOWN"))
    for token, name in BUILDER_MARKETS.items():
        out = F.when(F.trim(raw) == token, name).otherwise(out)
    return out


def uid_format(uid: Column) -> Column:
    return F.when(uid.rlike("^[0-9]+$"), "numeric").otherwise("string")


def fold_name(text: Column) -> Column:
    """A person's or club's name for comparison: no accents, lower case, single spaces."""
    plain = F.translate(text, UNDECOMPOSED, UNDECOMPOSED_PLAIN)
    for letter, letters in (("Þ", "Th"), ("þ", "th"), ("ß", "ss")):
        plain = F.replace(plain, F.lit(letter), F.lit(letters))
    return F.trim(F.regexp_replace(F.lower(strip_accents(plain)), r"\s+", " "))


def fold_word(word: Column) -> Column:
    """fold_name of a text without white space: ASCII has only its case to lose."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(fold_name(word))


def fold_team(text: Column) -> Column:
    words = F.filter(F.split(fold_name(text), " "), lambda w: ~w.isin(*CLUB_SUFFIXES))
    return F.array_join(words, " ")


def _zip_all(a: Column, b: Column) -> Column:
    """Whether the words of a and b pair off so that one of each pair begins the other."""
    fits = F.zip_with(a, b, lambda x, y: x.startswith(y) | y.startswith(x))
    return (F.size(a) == F.size(b)) & F.forall(fits, lambda ok: F.coalesce(ok, F.lit(False)))


def team_name_tier(a: Column, b: Column) -> Column:
    """1.0 for one folded name, 0.9 where each word begins its counterpart, else 0.0."""
    x, y = fold_team(a), fold_team(b)
    return F.when(x == y, 1.0).when(_zip_all(F.split(x, " "), F.split(y, " ")), 0.9).otherwise(0.0)


def _initial_of(short: Column, full: Column) -> Column:
    """short is 'X. Surname' and full has a given name with that initial."""
    initial = F.regexp_replace(F.element_at(short, 1), r"\.+$", "")
    given = F.slice(full, 1, F.greatest(F.size(full) - 1, F.lit(0)))
    return (F.length(initial) == 1) & F.exists(given, lambda g: g.startswith(initial))


def player_name_tier(a: Column, b: Column) -> Column:
    """1.0 for one folded name, 0.9 for an initial and the surname, 0.6 for a nickname, else 0.0."""
    x, y = fold_name(a), fold_name(b)
    s, t = F.split(x, " "), F.split(y, " ")
    surname = F.element_at(s, -1) == F.element_at(t, -1)
    nickname = ((F.size(s) == 1) & F.element_at(t, 1).startswith(F.element_at(s, 1))) | (
        (F.size(t) == 1) & F.element_at(s, 1).startswith(F.element_at(t, 1))
    )
    return (
        F.when(x == y, 1.0)
        .when(surname & (_initial_of(t, s) | _initial_of(s, t)), 0.9)
        .when((x != "") & (y != "") & nickname, 0.6)
        .otherwise(0.0)
    )


def player_name_method(tier: Column) -> Column:
    return (
        F.when(tier == 1.0, "exact_after_normalization")
        .when(tier == 0.9, "initial_expansion")
        .when(tier == 0.6, "nickname_prefix")
        .otherwise("no_candidate")
    )


def looks_like_name(text: Column) -> Column:
    """Neither empty, long, a line, nor a yes or no."""
    t = F.trim(text)
    odd = t.rlike(r"\d") | t.rlike(r"(?i)\b(?:or more|or fewer|or less|over|under)\b") | F.lower(t).isin("yes", "no") | F.lower(t).startswith("no ")
    return F.coalesce((F.length(t) > 0) & (F.length(t) <= 60) & ~odd, F.lit(False))
