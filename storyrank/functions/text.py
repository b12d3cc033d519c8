"""Text expressions: tokens, cleaning, formatting and time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four information separators, and its complement.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
_INK = r"[^\s\x1c-\x1f]"

# Tokens that carry no news: mentions, tags, links and the repost marker, whole and lower-cased.
_MARKUP = rf"(?<!{_INK})(?:[@#]{_INK}*|http{_INK}*|rt(?!{_INK}))"


def tokens(text: Column) -> Column:
    """Split on any run of white space, without empty tokens."""
    return F.filter(F.split(text, WHITESPACE), lambda t: t != "")


def plain_words(text: Column, min_length: int = 1) -> Column:
    """Lower-cased letter runs of a post outside its markup tokens, short runs left out.

    One pass of one pattern: a markup token matches whole and captures nothing, a letter run
    is captured.
    """
    pattern = rf"(?U){_MARKUP}|([a-z]{{{min_length},}})"
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))
    return F.filter(found, lambda w: w != "")


def long_enough(words: Column, min_length: int) -> Column:
    return F.filter(words, lambda w: F.length(w) >= min_length)


def without(words: Column, stop_words: Sequence[str]) -> Column:
    stops = list(stop_words)
    return F.filter(words, lambda w: ~w.isin(stops))


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def split_words(clean: Column) -> Column:
    """Inverse of `joined`; an empty text gives no words."""
    return F.filter(F.split(clean, " "), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body`, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def term_counts(words: Column) -> Column:
    """array<struct<term,tf>> of one text: sort the words, then measure each run of equals.

    Linear after the sort and row-local, so a document-term table needs no shuffle.
    """

    def run_starts(ordered: Column) -> Column:
        first = F.transform(
            ordered, lambda w, i: F.when((i == 0) | (w != F.get(ordered, i - 1)), i)
        )
        return F.array_compact(first)

    def runs(ordered: Column) -> Column:
        return let(
            run_starts(ordered),
            lambda starts: F.zip_with(
                starts,
                F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(ordered))),
                lambda s, e: F.struct(F.get(ordered, s).alias("term"), (e - s).alias("tf")),
            ),
        )

    counts = let(F.sort_array(F.array_compact(words)), runs)
    return F.filter(counts, lambda c: c["term"].isNotNull())


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def fixed3(number: Column) -> Column:
    """Three-decimal text of a number."""
    return F.format_string("%.3f", number)


def report_line(*fields: Column) -> Column:
    return F.concat_ws(", ", *fields)


def status_time(ctime: Column) -> Column:
    """`Sat Jan 14 03:25:04 +0000 2017` as a timestamp, NULL when it does not parse.

    The weekday is redundant and Spark's parser rejects it, so it is cut off first.
    """
    return F.try_to_timestamp(F.substring(ctime, 5, 26), F.lit("MMM dd HH:mm:ss Z yyyy"))
