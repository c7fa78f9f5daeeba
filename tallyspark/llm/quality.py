"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Words are runs of characters other than blank and \\x09-\\x0D.  Every number covers the whole text.
Cost: one pass of built-in expressions; nothing is shuffled.  The words, their hashes and the
8-word window hashes are each computed once per row; the sort of windows runs only for texts that
hold a repeated window.

Defined results: a null text has no words and counts as empty (all counts 0, ``base_failed`` true,
``kept`` false); repeated rows and ties get equal results; an empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrow import once

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that with for on it was as at by from or an be this are "
    "de la le et les des un une en est du que qui dans pour sur par au avec "
    "der die und ist das ein zu von den mit sich auf im dem nicht eine "
    "el los las y se del con por su no lo como al es"
).split()


@dataclass(frozen=True)
class Rule:
    """numerator / denominator must lie in [low, high]; texts with an empty denominator pass."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 25.0),
    Rule("symbol_ratio", "n_symbols", "n_words", high=0.25),
    Rule("exclamation_ratio", "n_exclaim", "n_words", high=0.5),
    Rule("stop_word_ratio", "n_stop", "stop_base", low=0.02),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", high=0.5),
)


def _repeat_words() -> Column:
    """Words inside windows that occur twice or more, from the window hashes ``_win``."""

    def covered(rows: Column) -> Column:
        # rows: (hash, position) sorted; keep positions whose hash equals a neighbour's
        def twin(row: Column, k: Column) -> Column:
            same = lambda other: F.coalesce(F.get(rows, other)["h"] == row["h"], F.lit(False))
            return F.when(same(k - 1) | same(k + 1), row["i"])

        found = F.sort_array(F.array_compact(F.transform(rows, twin)))
        return F.transform(F.array(found), spread_out)[0]

    def spread_out(found: Column) -> Column:
        step = F.transform(found, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(found, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    any_twice = F.size(F.array_distinct("_win")) < F.size("_win")
    return F.when(any_twice, F.transform(F.array(pairs), covered)[0]).otherwise(F.lit(0))


def quality_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that rules and base use, one row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = once(docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")),
                _words=F.array_remove(F.split("_text", SPACE), ""),
                _lines=F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0))
    base = once(base, n_words=F.size("_words").cast("long"), _hash=F.transform("_words", lambda w: F.xxhash64(w)))
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("_hash", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    base = once(base, _win=windows)
    return base.select(
        "doc_id", "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_exclaim"),
        F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop"),
        # the share of stop words means something only in texts of some length
        F.when(F.col("n_words") >= 50, F.col("n_words")).otherwise(0).alias("stop_base"))


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of counts breaks, as one array expression."""
    broken = []
    for r in rules:
        low = F.col(r.numerator) < r.low * F.col(r.denominator) if r.low is not None else F.lit(False)
        high = F.col(r.numerator) > r.high * F.col(r.denominator) if r.high is not None else F.lit(False)
        broken.append(F.when((F.col(r.denominator) > 0) & (low | high), F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the broken rules, one row per document."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counted = once(quality_counts(docs, id_col, text_col), base_failed=failed, broken_rules=compile_rules(rules))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                          (~F.col("base_failed") & (F.size("broken_rules") == 0)).alias("kept"),
                          "n_lines", "n_exclaim", "n_stop", "broken_rules")


def oracle() -> str:
    """DuckDB twin of ``quality_rules`` over ``documents``."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)

    def test(r: Rule) -> str:
        bounds = [f"{r.numerator} < {r.low} * {r.denominator}"] * (r.low is not None) + [f"{r.numerator} > {r.high} * {r.denominator}"] * (r.high is not None)
        return f"case when {r.denominator} > 0 and ({' or '.join(bounds)}) then '{r.name}' end"

    broken = "list_filter([" + ", ".join(map(test, RULES)) + "], lambda x: x is not null)"
    return rf"""
with w as (
  select doc_id, row_number() over () as rid, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') as ls
  from documents),
pos as (select rid, ws, unnest(range(1, len(ws) + 1)) as i from w),
win as (select rid, i, case when i + {WINDOW - 1} <= len(ws) then array_to_string(ws[i:i + {WINDOW - 1}], ' ') end as win from pos),
rep as (select rid, i, win is not null and count(*) over (partition by rid, win) > 1 as twice from win),
cov as (select rid, max(twice::int) over (partition by rid order by i rows between {WINDOW - 1} preceding and current row) as c from rep),
n as (select rid, sum(c)::bigint as n_repeat_words from cov group by rid),
c as (
  select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    len(regexp_extract_all(t, '{SYMBOLS}'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, len(ls)::bigint as n_lines,
    len(regexp_extract_all(t, '!'))::bigint as n_exclaim,
    len(list_filter(ws, lambda x: x in ({stops})))::bigint as n_stop, case when len(ws) >= 50 then len(ws) else 0 end as stop_base
  from w left join n using (rid)),
b as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed, {broken} as broken_rules from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and len(broken_rules) = 0 as kept, n_lines, n_exclaim, n_stop, broken_rules from b"""
