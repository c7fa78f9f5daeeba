"""Text expressions (B1, B6) as built-in Column expressions.

Java regexes need ``(?U)`` so that ``\\w``/``\\s`` are Unicode-aware
(otherwise ``ñ`` and accented letters would be stripped).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.constants import STOP_WORDS

NON_WORD = r"(?U)[^\p{L}\p{N}_\s]"  # Python str \w = letters, numbers, "_"
SPACES = r"(?U)\s+"
# "Replace each non-word, non-blank character by a blank, then collapse
# blank runs" leaves exactly one blank per maximal run of non-word
# characters, so one pass of this pattern does both steps.
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"
# Every character str.strip() / str.split() treat as whitespace.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
              + "\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Python-style strip (every kind of leading/trailing blank), no regex."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_description(c: Column, null_as_text: bool = True) -> Column:
    """B1: str -> trim -> lower -> non-word chars to blank -> collapse blanks.

    Trim happens before punctuation removal, so ``abc!!`` ends in a blank.
    A missing description becomes the text ``nan`` (string conversion of
    a missing value) unless ``null_as_text`` is off.
    """
    base = F.coalesce(c, F.lit("nan")) if null_as_text else c
    return F.regexp_replace(F.lower(strip(base)), NON_WORD_RUN, " ")


def normalize_for_matching(c: Column, stop_words: list[str] | None = None) -> Column:
    """Lower, punctuation -> blank, drop stop words; NULL -> ''."""
    stop = F.array(*[F.lit(w) for w in (stop_words or STOP_WORDS)])
    words = F.split(F.trim(F.regexp_replace(F.lower(c), NON_WORD_RUN, " ")), " ")
    kept = F.filter(words, lambda w: (F.length(w) > 0) & ~F.array_contains(stop, w))
    return F.coalesce(F.array_join(kept, " "), F.lit(""))


def cache_key(c: Column) -> Column:
    """The key the prediction cache uses (lower + strip)."""
    return F.lower(strip(c))
