"""Text functions as column expressions (P01, F07-F14, F17-F19, F24). White space is Unicode white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
#: Code-point ranges by script, in the order of the checks.
SCRIPTS = (
    ("CJK", r"\x{4E00}-\x{9FFF}\x{2E80}-\x{2EFF}\x{3000}-\x{30FF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}"),
    ("Hangul", r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}"),
    ("Arabic", r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}"),
    ("Hebrew", r"\x{0590}-\x{05FF}"), ("Devanagari", r"\x{0900}-\x{097F}"), ("Bengali", r"\x{0980}-\x{09FF}"), ("Tamil", r"\x{0B80}-\x{0BFF}"), ("Telugu", r"\x{0C00}-\x{0C7F}"),
    ("Kannada", r"\x{0C80}-\x{0CFF}"), ("Malayalam", r"\x{0D00}-\x{0D7F}"), ("Thai", r"\x{0E00}-\x{0E7F}"),
)
OTHER = r"\x{0A00}-\x{0AFF}\x{0B00}-\x{0B7F}\x{3100}-\x{4DFF}\x{A000}-\x{A4CF}"
FALLBACK = "".join(r for _, r in SCRIPTS) + OTHER
CJK = r"\x{1100}-\x{11FF}\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}"
RTL = r"\x{0590}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}"
RTL_LANGS = ("ar", "ur", "fa", "he", "ps", "sd", "ug")


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once for a row."""
    return F.element_at(F.transform(F.array(value), of), 1)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """Trimmed, runs of white space as one blank."""
    return trimmed(F.regexp_replace(c, SPACES, " "))


def loose(c: Column) -> Column:
    return collapsed(F.lower(c))


def words(c: Column) -> Column:
    return F.filter(F.split(collapsed(c), " "), lambda w: w != "")


def normalize_text(c: Column) -> Column:
    parts = F.transform(F.split(trimmed(c), "\n\n"), collapsed)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def is_rtl_lang(c: Column) -> Column:
    return F.lower(trimmed(F.coalesce(c, F.lit("")))).isin(*RTL_LANGS)


def _share(c: Column, chars: str) -> tuple[Column, Column]:
    bare = F.regexp_replace(c, SPACES, "")
    return F.length(bare), F.length(F.regexp_replace(bare, f"[^{chars}]", ""))


def is_rtl_text(c: Column) -> Column:
    total, hit = _share(c, RTL)
    return (total > 0) & (hit * 2 >= total)


def has_rtl(c: Column) -> Column:
    return c.rlike(r"[\x{0590}-\x{08FF}]")


def detect_scripts(c: Column) -> Column:
    names = [F.when(c.rlike(f"[{r}]"), F.lit(n)) for n, r in SCRIPTS] + [F.when(F.regexp_replace(c, f"[{''.join(r for _, r in SCRIPTS)}]", "").rlike(f"[{OTHER}]"), F.lit("other-non-Latin"))]
    return F.array_sort(F.array_compact(F.array(*names)))


def script_segments(c: Column) -> Column:
    """Maximal runs of characters that need a fallback font or don't: array<struct<text, fallback>>."""
    runs = F.regexp_extract_all(c, F.lit(f"([{FALLBACK}]+|[^{FALLBACK}]+)"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(r.alias("text"), r.rlike(f"^[{FALLBACK}]").alias("fallback")))


def is_vertical(c: Column, width: Column, height: Column) -> Column:
    total, cjk = _share(c, CJK)
    return (width > 0) & (height > 0) & (height / width >= 2.2) & (cjk >= 2) & (cjk / total >= 0.8)


def cjk_tokens(c: Column) -> Column:
    split = lambda w: F.when(w.rlike(f"^[{CJK}]+$"), F.filter(F.split(w, ""), lambda x: x != "")).otherwise(F.array(w))
    return F.flatten(F.transform(words(c), split))


def mixed_direction(c: Column) -> Column:
    return c.rlike(f"[{RTL}]") & F.regexp_replace(c, f"[{RTL}]", "").rlike(r"\p{L}")


def changed_chars(a: Column, b: Column) -> Column:
    """Length difference plus mismatches over the shorter text's length."""
    n = F.least(F.length(a), F.length(b))
    chars = lambda c: F.slice(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(1), n)
    return F.abs(F.length(a) - F.length(b)) + F.size(F.filter(F.zip_with(chars(a), chars(b), lambda x, y: x != y), lambda x: x))


def content_key(*parts: Column) -> Column:
    """SHA-256 over the parts with NUL between them."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def split_pages(c: Column) -> Column:
    """Parts between page marks; an empty first part goes."""
    parts = F.transform(F.split(c, "(?i)<PAGE>"), trimmed)
    kept = F.when((F.size(parts) > 1) & (F.element_at(parts, 1) == ""), F.slice(parts, 2, F.size(parts))).otherwise(parts)
    return F.when((F.size(kept) == 1) & (F.element_at(kept, 1) == ""), F.array().cast("array<string>")).otherwise(kept)


def first_path(c: Column, *paths: str) -> Column:
    """The first JSON path that exists."""
    return F.coalesce(*(F.get_json_object(c, p) for p in paths))
