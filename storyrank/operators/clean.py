"""Cleaning: from a post to its bag of content words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank.config import CleanConfig, LookupConfig
from storyrank.functions import text
from storyrank.operators import lexicon as lex


def clean_words(post: Column, cfg: CleanConfig = CleanConfig()) -> Column:
    """array<string> of the words kept before any lexicon pass."""
    if not cfg.remove_stop:
        return text.plain_words(post)
    return text.without(text.plain_words(post, cfg.min_word_length), cfg.stop_words)


def clean_posts(
    posts: DataFrame,
    cfg: CleanConfig = CleanConfig(),
    stems: DataFrame | None = None,
    lemmas: DataFrame | None = None,
    post: str = "tweet",
    lookup_cfg: LookupConfig = LookupConfig(),
) -> DataFrame:
    """Replace column `post` by `words` (array) and `clean` (text).

    `stems` holds (token, stem) and `lemmas` holds (token, pos, lemma) with pos `n` or `v`; a
    token missing from a table maps to itself. Both passes belong to stop word removal, as does
    the length filter that follows each of them. A pass that is asked for needs its table.
    """
    for name, wanted, table in (("stem", cfg.stem, stems), ("lemmatise", cfg.lemmatise, lemmas)):
        if cfg.remove_stop and wanted and table is None:
            raise ValueError(f"`{name}` is on, but its table is missing")
    words = F.coalesce(clean_words(F.col(post), cfg), F.array().cast("array<string>"))
    out = posts.withColumn("words", words).drop(post)
    if cfg.remove_stop and cfg.stem:
        out = lex.replace_words(out, lex.stem_table(stems), lookup_cfg)
        out = out.withColumn("words", text.long_enough(F.col("words"), cfg.min_word_length))
    if cfg.remove_stop and cfg.lemmatise:
        out = lex.replace_words(out, lex.lemma_table(lemmas), lookup_cfg)
        out = out.withColumn("words", text.long_enough(F.col("words"), cfg.min_word_length))
    return out.withColumn("clean", text.joined(F.col("words")))
