"""Word look-ups: stems, lemmas and part-of-speech tags, each an input table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank.config import LookupConfig
from storyrank.operators.lookup import lookup
from storyrank.sources.scratch import stored


def stem_table(stems: DataFrame) -> DataFrame:
    """(token, replacement) with one row per token."""
    return stems.groupBy("token").agg(F.min("stem").alias("replacement"))


def lemma_table(lemmas: DataFrame) -> DataFrame:
    """Noun pass, then verb pass, folded into one (token, replacement) table."""
    noun = lemmas.filter(F.col("pos") == "n").groupBy("token").agg(F.min("lemma").alias("noun"))
    verb = lemmas.filter(F.col("pos") == "v").groupBy("token").agg(F.min("lemma").alias("verb"))
    after_noun = noun.join(
        verb.select(F.col("token").alias("noun"), F.col("verb").alias("then")), "noun", "left"
    ).select("token", F.coalesce("then", "noun").alias("replacement"))
    only_verb = verb.join(noun, "token", "left_anti").select(
        "token", F.col("verb").alias("replacement")
    )
    return after_noun.unionByName(only_verb)


def tag_table(tags: DataFrame) -> DataFrame:
    """(token, tag) with one row per token."""
    return tags.groupBy("token").agg(F.min("tag").alias("tag"))


def replace_words(docs: DataFrame, table: DataFrame, cfg: LookupConfig = LookupConfig()) -> DataFrame:
    """Map each element of array column `words` through `table`, keeping order and repeats.

    A table of proven size travels to the executors once and each Arrow batch is mapped in
    place: no shuffle. A larger table is joined by shuffle instead. Both give the same rows,
    whatever ids the documents have.
    """
    rows = table.limit(cfg.max_broadcast_rows + 1).toArrow()
    if rows.num_rows <= cfg.max_broadcast_rows:
        return _replace_in_place(docs, rows)
    return _replace_by_join(docs, table, cfg)


def _replace_in_place(docs: DataFrame, rows: pa.Table) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(
        (rows["token"].combine_chunks(), rows["replacement"].combine_chunks())
    )

    @F.arrow_udf("array<string>")
    def mapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, replacements = shipped.value
        for words in batches:
            coded = words.flatten().dictionary_encode()
            names = coded.dictionary.cast(pa.string())
            at = pc.index_in(names, value_set=tokens.cast(pa.string()))
            own = replacements.cast(pa.string()).take(at)
            new = pc.if_else(at.is_valid(), own, names).take(coded.indices)
            sizes = pc.fill_null(pc.list_value_length(words), 0)
            ends = pc.cumulative_sum(sizes).cast(pa.int32())
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            yield pa.ListArray.from_arrays(offsets, new)

    return docs.withColumn("words", mapped(F.col("words")))


def _replace_by_join(docs: DataFrame, table: DataFrame, cfg: LookupConfig) -> DataFrame:
    # stored with its own key of a row: ids may repeat or be null
    docs = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "unmapped")
    long = docs.select("_row", F.posexplode("words").alias("_pos", "token"))
    placed = F.struct("_pos", F.coalesce("replacement", "token").alias("w"))
    words = (
        lookup(long, stored(table, "lexicon"), ["token"], cfg, "left", small=False)
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(placed)).alias("_placed"))
        .select("_row", F.transform("_placed", lambda s: s["w"]).alias("_words"))
    )
    new = F.coalesce("_words", F.array().cast("array<string>")).alias("words")
    kept = [c for c in docs.columns if c not in ("_row", "words")]
    return docs.drop("words").join(words, "_row", "left").select(*kept, new)
