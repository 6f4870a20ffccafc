"""Column expressions on text: tokens, counts, prompts and display forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
DELIMITER = "--- --- \n --- --- "
SHORT_DATE = "dd MMM, yyyy"
LONG_DATE = "MMMM d, yyyy"
PREVIEW_CHARS = 70


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def length_statistics(df: DataFrame, text_col: str, by: list[str] | None = None) -> DataFrame:
    """Median, mean, longest and shortest token length of the non-null texts."""
    lengths = df.where(F.col(text_col).isNotNull()).select(
        *(by or []), token_count(text_col).alias("n_tokens")
    )
    return lengths.groupBy(*(by or [])).agg(
        F.median("n_tokens").alias("median_tokens"),
        F.avg("n_tokens").alias("mean_tokens"),
        F.max("n_tokens").alias("max_tokens"),
        F.min("n_tokens").alias("min_tokens"),
    )


def percent_change(delta: Column | str, base: Column | str, digits: int = 2) -> Column:
    """``delta`` as a signed percentage of ``base``; null when base is zero."""
    return F.round(F.try_divide(_col(delta), _col(base)) * 100, digits)


def short_date(ts: Column | str) -> Column:
    return F.date_format(_col(ts), SHORT_DATE)


def long_date(ts: Column | str) -> Column:
    return F.date_format(_col(ts), LONG_DATE)


def preview(text: Column | str, chars: int = PREVIEW_CHARS) -> Column:
    return F.concat(F.substring(_col(text), 1, chars), F.lit("..."))


def dollars(amount: Column | str) -> Column:
    """``$1,234.50`` with a minus sign in front of the symbol."""
    amount = _col(amount)
    sign = F.when(F.round(amount, 2) < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lit("$"), F.format_number(F.abs(amount), 2))


def hex_text(text: Column | str) -> Column:
    """The UTF-8 bytes of a text as lower-case hexadecimal digits."""
    return F.lower(F.hex(F.encode(_col(text), "UTF-8")))


def description_prompt(columns: Column | str) -> Column:
    """Ask a model to describe a table from its column list."""
    return F.concat(
        F.lit("Describe this database table and what it is likely used for.\nColumns:\n"),
        _col(columns),
    )


def sql_prompt(card: Column | str, question: Column | str, catalog: str) -> Column:
    """Ask a model for one query that answers a question from one table card."""
    return F.concat(
        F.lit("Table card:\n"),
        _col(card),
        F.lit("\nQuestion: "),
        _col(question),
        F.lit(f"\nWrite one SQL query and nothing else. Prefix every schema with {catalog}."),
    )


def answer_prompt(
    card: Column | str, question: Column | str, query: Column | str, response: Column | str
) -> Column:
    """Ask a model to phrase the rows of a query as an answer."""
    return F.concat(
        F.lit("Table card:\n"),
        _col(card),
        F.lit("\nQuestion: "),
        _col(question),
        F.lit("\nQuery: "),
        _col(query),
        F.lit("\nRows: "),
        _col(response),
        F.lit("\nAnswer in plain words."),
    )


def summary_prompt(context: Column | str) -> Column:
    """Ask a model for a detailed summary of joined passages."""
    return F.concat(F.lit("Summarise these passages in detail.\n\n"), _col(context))
