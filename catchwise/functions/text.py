"""Names, labels, search text and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generic river prefixes, tried in this order (fixed values)
RIVER_PREFIXES = ("Kali ", "K. ", "K ", "Sungai ", "S. ", "S ")

# Accented letters and the letter left when the accent is removed (fixed values)
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçāēīōū"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyyncaeiou"


def river_base_name(name: Column) -> Column:
    """River name without its generic prefix; NULL when nothing is left."""
    pattern = "(?i)^(?:" + "|".join(p.replace(".", r"\.") for p in RIVER_PREFIXES) + ")"
    text = F.trim(F.regexp_replace(F.trim(name), pattern, ""))
    return F.when(text != "", text)


def river_label(name: Column) -> Column:
    return F.concat(F.lit("Kali "), river_base_name(name))


def river_map_label(name: Column) -> Column:
    return F.concat(F.lit("K. "), river_base_name(name))


def search_text(value: Column) -> Column:
    """Lower-case text without accents, blanks collapsed."""
    text = F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def safe_name(value: Column, fallback: str) -> Column:
    """Text usable as a file name: river prefix shortened, other characters become '_'."""
    text = F.trim(F.coalesce(value, F.lit("")))
    text = F.when(text == "", fallback).otherwise(text)
    text = F.regexp_replace(text, r"(?i)^[KS]\.\s*", "K_")
    text = F.regexp_replace(text, r"[^0-9A-Za-zÀ-ÿ_-]+", "_")
    text = F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_+|_+$", "")
    return F.when(text != "", text).otherwise(fallback)


def translated(value: Column, pairs: dict[str, str], fallback: str) -> Column:
    """Dictionary translation; unknown text keeps its wording with a small first letter."""
    text = F.trim(F.coalesce(value, F.lit("")))
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    own = F.concat(
        F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))
    return F.when((text == "") | (text == "-"), fallback).otherwise(F.coalesce(table[text], own))


def number_text(value: Column, digits: int, decimal: str = ",") -> Column:
    """Fixed-digit number with the chosen decimal sign; a dash when missing."""
    text = F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))
    if decimal == ",":
        text = F.replace(text, F.lit("."), F.lit(","))
    return F.when(value.isNotNull() & ~F.isnan(value), text).otherwise("—")


def natural_join(items: Column) -> Column:
    """'a, b dan c'."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.element_at(items, 1)).otherwise(
        F.concat(head, F.lit(" dan "), F.element_at(items, -1)))
