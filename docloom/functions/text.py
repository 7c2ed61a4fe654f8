"""Text functions: white space, tokenisers, estimators, names and labels.

Unicode white space is meant wherever the semantics say white space: ``(?U)\\s``.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: token patterns and stop words
TOKEN = "[0-9A-Za-zㄱ-ㆎ가-힣]+"
GATE_TOKEN = "[0-9A-Za-z가-힣]+"
PACK_TOKEN = "[0-9A-Za-z_]+"
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "what", "how", "when", "where", "which", "guide", "manual", "summary", "document", "upload")
SPACE = r"(?U)\s+"


def let(c: Column, use) -> Column:
    """use(v) with v bound to c: evaluated once for each row, however often it is used."""
    return F.element_at(F.transform(F.array(c), use), 1)


def runs(c, use) -> Column:
    """use(v, n) for each distinct value v of an array without nulls and the number n of its occurrences, by ascending value."""
    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: use(F.get(s, i), F.coalesce(F.get(at, k + 1), F.size(s)) - i)))

    c = F.col(c) if isinstance(c, str) else c
    none = F.transform(F.slice(c, 1, 0), lambda t: use(t, F.lit(0)))
    return F.when(F.size(c) > 0, let(F.sort_array(c), counted)).otherwise(none)


def strip(c) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text(c) -> Column:
    """Null is the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def extract_all(c, pattern: str) -> Column:
    return F.regexp_extract_all(text(c), F.lit(pattern), F.lit(0))


def collapse(c) -> Column:
    """Trim, and one space for each run of white space."""
    return F.trim(F.regexp_replace(text(c), SPACE, " "))


def compact(c) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text(c), SPACE, ""))


def tokens(c, pattern: str = TOKEN) -> Column:
    """Lower-case tokens of two characters or more."""
    return F.filter(F.transform(extract_all(c, pattern), F.lower), lambda t: F.length(t) >= 2)


def keywords(c) -> Column:
    """Distinct tokens that aren't stop words, in order."""
    return F.array_distinct(F.filter(tokens(c), lambda t: ~t.isin(*STOP_WORDS)))


def _folds() -> tuple[str, str]:
    """For translate(): letters with marks to their base letters, and the marks that are dropped, by the rule of canonical decomposition."""
    letters, bases, marks = [], [], []
    for c in map(chr, (*range(0xC0, 0xAC00), *range(0xF900, 0xFB50))):
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif c.isalpha() and len(parts := unicodedata.normalize("NFD", c)) > 1 and parts[0].isalpha() and all(unicodedata.category(x) == "Mn" for x in parts[1:]):
            letters.append(c)
            bases.append(parts[0])
    return "".join(letters + marks), "".join(bases)


FOLDS = _folds()


def fold(c) -> Column:
    """Lower case, diacritics off."""
    low = F.lower(text(c))
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, *FOLDS)).otherwise(low)


def fts_tokens(c) -> Column:
    """Full-text tokens: lower case, diacritics off, runs of letters and digits."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fts_length(c) -> Column:
    """Number of full-text tokens, without making them."""
    return F.regexp_count(text(c), F.lit(r"(?:[\p{L}\p{N}]\p{Mn}*+)+"))


def chunk_tokens(c) -> Column:
    """Estimate for chunking: 1.08 per token, at least 1; 0 for no text."""
    n = F.size(extract_all(c, TOKEN))
    return F.when(text(c) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(1.08)))).cast("int")


def packing_tokens(c) -> Column:
    """Estimate for packing: 1.05 per ASCII word, at least 1."""
    return F.when(text(c) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.size(extract_all(c, PACK_TOKEN)) * F.lit(1.05)))).cast("int")


def mixed_parts(c) -> list[Column]:
    """Numbers of ASCII words, Korean syllables and other symbols."""
    return [F.size(extract_all(c, p)) for p in ("[A-Za-z0-9_]+", "[가-힣]", r"(?U)[^\w\s가-힣]")]


def mixed_tokens(c, up: bool = True) -> Column:
    """Mixed estimate: 1.1 per word, 0.65 per syllable, 0.3 per symbol; rounded up, or down."""
    w, k, s = mixed_parts(c)
    est = w * F.lit(1.1) + k * F.lit(0.65) + s * F.lit(0.3)
    return F.when(text(c) == "", 0).otherwise(F.greatest(F.lit(1), F.ceil(est) if up else F.floor(est))).cast("int")


def server_tokens(c) -> Column:
    """Embedding server's estimate: the larger of words and a quarter of the characters, at least 1."""
    words = F.size(F.filter(F.split(collapse(c), " "), lambda w: w != ""))
    return F.greatest(F.lit(1), words, F.ceil(F.length(text(c)) / 4)).cast("int")


def ellipsis(c: Column, limit: int) -> Column:
    """Cut to ``limit`` characters with three dots counted in."""
    v = F.trim(c)
    return F.when(F.length(v) <= limit, v).otherwise(F.concat(F.rtrim(F.substring(v, 1, limit - 3)), F.lit("...")))


def basename(c) -> Column:
    return F.element_at(F.split(F.replace(text(c), F.lit("\\"), F.lit("/")), "/"), -1)


def identity_key(c) -> Column:
    """Same logical document: the base name without case."""
    return F.lower(basename(F.trim(text(c))))


def column_letters(n: Column, places: int = 3) -> Column:
    """Spreadsheet letters of a column number from 1: base 26 without a zero."""
    digits, rest = [], n
    for _ in range(places):
        digits.append(F.when(rest > 0, F.char(F.pmod(rest - 1, F.lit(26)) + 65)).otherwise(""))
        rest = F.floor((rest - 1) / 26)
    return F.concat(*reversed(digits))


def slug(c) -> Column:
    """Lower case, other characters than letters, digits and Korean to single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text(c))), "[^0-9a-z가-힣]+", "-"), "^-+|-+$", "")


def stamp(seconds: Column) -> Column:
    """Unix seconds as YYYY-MM-DD HH:MM:SS, '' for none."""
    return F.when(F.coalesce(seconds, F.lit(0)) <= 0, "").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"))


def scoped_id(user: Column, name: Column) -> Column:
    """Twelve hex digits of SHA-256 over user, NUL, name."""
    return F.substring(F.sha2(F.concat(user, F.lit("\0"), name), 256), 1, 12)


# fixed values: line patterns
SECTION = r"^(#{1,6}\s+.+|(?:\d+(?:\.\d+){0,3}|[가-힣A-Za-z]\))\s+.+|제\s*\d+\s*(장|절|항|조).+)$"
CHROME = (r"(?i)^page\s*\d+\s*(of\s*\d+)?$", r"^\d+\s*/\s*\d+$", r"^[-_=]{3,}$")


def is_section(c) -> Column:
    return text(c).rlike(SECTION)


def is_page_line(c) -> Column:
    """Page header or footer, or empty."""
    v = text(c)
    return (v == "") | v.rlike(CHROME[0]) | v.rlike(CHROME[1]) | v.rlike(CHROME[2])


def alias_key(c) -> Column:
    """Lower case without white space, separators, brackets and quotes."""
    return F.regexp_replace(F.lower(text(c)), "(?U)[\\s·ㆍ/\\\\,()\\[\\]{}<>「」『』'\"`_\\-]+", "")


def any_in(haystack: Column, needles: tuple[str, ...]) -> Column:
    """Does any of the fixed needles occur? One pattern, so that the haystack is made and read once."""
    return haystack.rlike("|".join(re.escape(n) for n in needles))


def hits_in(haystack: Column, needles: tuple[str, ...]) -> Column:
    """How many of the fixed needles occur."""
    return sum((haystack.contains(n).cast("int") for n in needles), F.lit(0))
