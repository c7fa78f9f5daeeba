"""Money expressions (B2, B9, B10, B11, B20) as built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.constants import CURRENCY_SYMBOL

# A plain decimal/scientific number or an infinity, as a numeric parser
# accepts it; anything else ("1.5d", "1.234.50", "n/a") is not a number.
NUMBER_RX = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(?i)[+-]?(inf|infinity)$"


def _to_double(s: Column) -> Column:
    """Text -> double; anything that is not a plain number (or NaN) -> NULL.

    Written so that ``s`` is referenced once: the extract yields '' for a
    non-number, which ``try_cast`` turns into NULL, and ``nanvl`` maps NaN
    to NULL without repeating its input.
    """
    num = F.regexp_extract(s, NUMBER_RX, 0).try_cast("double")
    return F.nanvl(num, F.lit(None).cast("double"))


def clean_amount(c: Column, symbol: str = CURRENCY_SYMBOL) -> Column:
    """B2: drop symbol, ',' -> '.', drop blanks, to number (else NULL), abs."""
    s = F.replace(c.cast("string"), F.lit(symbol), F.lit(""))
    s = F.replace(s, F.lit(","), F.lit("."))
    s = F.replace(s, F.lit(" "), F.lit(""))
    return F.abs(_to_double(s))


def parse_amount(c: Column, symbol: str = CURRENCY_SYMBOL) -> Column:
    """B9: ',' is a thousands separator here; failures and NULL -> 0.0."""
    s = F.trim(F.replace(c.cast("string"), F.lit(symbol), F.lit("")))
    s = F.replace(F.replace(s, F.lit(","), F.lit("")), F.lit(" "), F.lit(""))
    return F.coalesce(_to_double(s), F.lit(0.0))


def format_amount(c: Column, decimals: int = 2, symbol: str = CURRENCY_SYMBOL) -> Column:
    """``$1,234.57`` (half-even like Python); NULL -> ``$0.00``."""
    return F.when(c.isNull() | F.isnan(c), F.lit(f"{symbol}0.00")).otherwise(
        F.concat(F.lit(symbol), F.format_number(c, decimals)))


def format_amount_short(c: Column, symbol: str = CURRENCY_SYMBOL) -> Column:
    """``$1.5M`` / ``$2.8K`` / ``$650``; NULL -> ``$0``."""
    def plain(x: Column, d: int) -> Column:
        return F.replace(F.format_number(x, d), F.lit(","), F.lit(""))
    body = (F.when(c >= 1_000_000, F.concat(plain(c / 1_000_000, 1), F.lit("M")))
             .when(c >= 1_000, F.concat(plain(c / 1_000, 1), F.lit("K")))
             .otherwise(plain(c, 0)))
    return F.when(c.isNull() | F.isnan(c), F.lit(f"{symbol}0")).otherwise(
        F.concat(F.lit(symbol), body))


def format_percent(c: Column, decimals: int = 1) -> Column:
    """Ratio 0.975 -> ``97.5%``."""
    return F.concat(F.format_number(c * 100, decimals), F.lit("%"))
