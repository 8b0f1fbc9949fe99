"""Map, filter, split: what stands before the windows. Each is a function from DataFrame to DataFrame for df.transform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_rows(**columns: Column):
    """One row out for each row in, with these columns."""
    return lambda df: df.select(*[c.alias(n) for n, c in columns.items()])


def drop_where(predicate: Column):
    """Leaves out rows for which the predicate is true; unknown is not true."""
    return lambda df: df.where(~F.coalesce(predicate, F.lit(False)))


def words_of(line: Column) -> Column:
    """Split at single spaces; empty words at the end go, others stay; an empty line is one empty word, a line of spaces none."""
    bare = F.regexp_replace(line, " +$", "")
    return F.when(line == "", F.array(F.lit(""))).when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def split_words(line: str, word: str = "word"):
    """A row for each word of a line; null lines have none."""
    return lambda df: df.withColumn(word, F.explode(words_of(F.col(line))))


def drop_words(column: str, stop_words) -> Column:
    """A filter for drop_where: exact, case-sensitive members of the stop list."""
    return F.col(column).isin(*stop_words) if stop_words else F.lit(False)


def split_then_filter(line: str, stop_words, word: str = "word"):
    return lambda df: df.transform(split_words(line, word)).transform(drop_where(drop_words(word, stop_words)))


def filter_then_split(line: str, stop_words, word: str = "word"):
    """Drops whole lines that equal a stop word, then splits the others."""
    return lambda df: df.transform(drop_where(drop_words(line, stop_words))).transform(split_words(line, word))


def dispatch(parts: int, *keys: str):
    """Spreads rows over parts, by key if keys are given; order isn't kept."""
    return lambda df: df.repartition(parts, *keys)


def logged(name: str = "values", rows: int = 20):
    """Prints the first rows and passes the DataFrame on."""

    def show(df: DataFrame) -> DataFrame:
        print(f"{name}:")
        df.show(rows, truncate=False)
        return df

    return show
