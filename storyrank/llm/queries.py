"""Registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyrank.llm import (
    config_packing,
    grace_dedup,
    hilbert_shards,
    linked_secrets,
    pfair_mix,
    pstable_neighbours,
    segment_resampling,
    simhash_gray,
    spectral_whitening,
    string_kernels,
    token_files,
    toxic_segments,
    warc_derive,
)
from storyrank.llm.common import table
from storyrank.llm.tokens import TokenizerSpec
from storyrank.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.duplicate_classes(table(spark, sf_dir, "documents"))


ORACLES["op4_grace_dedup"] = """
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(body) AS text_sha256
FROM normal
WINDOW same AS (PARTITION BY body)
"""


@query
def op10_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gray.simhash_components(table(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> TokenizerSpec:
    return TokenizerSpec.read(public_tokenizers.path(name))


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    tokenizer = _tokenizer("word_bpe_49k.json")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer, end_id=1)
    return token_files.read_token_files(spark, folder)


@query
def op9_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = _tokenizer("byte_bpe_50k.json")
    return config_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer, end_id=2)


@query
def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxic_segments.score_texts(docs, labels)
    return scored.select("row.doc_id", "held_out", "score", "predicted", "passages")


@query
def op5_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked_secrets.find_secrets(table(spark, sf_dir, "documents"))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    text = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    return found.select(
        "doc_id", *[number(k) for k in ("assign", "access", "hex")], "base_sha256",
        F.array_join(text, ",").alias("spans"),
    )


@query
def op2_pstable_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable_neighbours.embedding_links(table(spark, sf_dir, "embeddings"))


ORACLES["op2_pstable_neighbours"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE list_sum(list_transform(embedding, lambda x: x * x)) > 0
),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
),
reach AS (
  SELECT vec_id AS u, vec_id AS r FROM embeddings
  UNION
  SELECT reach.u, links.w AS r FROM reach JOIN links ON links.u = reach.r
),
component AS (SELECT u, min(r) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component ON component.u = vec_id LEFT JOIN n ON n.u = vec_id
"""


@query
def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the 40 shards differ by one at most; equal texts lie side by side in a cell."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "n_chars",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = hilbert_shards.hilbert_shards(
        docs, ["source", "lang", "n_chars", "doc_id"], ["text_crc32", "doc_id"]
    )
    return placed.select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


@query
def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed with weights that grow with the root of a source's size."""
    return pfair_mix.mix_sources(table(spark, sf_dir, "documents"))


@query
def op1_warc_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc_derive.derive_records(warc_derive.page_responses(table(spark, sf_dir, "pages")))
    named = {
        "warc_date": "WARC-Date",
        "target_uri": "WARC-Target-URI",
        "refers_to": "WARC-Refers-To",
        "refers_to_date": "WARC-Refers-To-Date",
        "payload_digest": "WARC-Payload-Digest",
        "block_digest": "WARC-Block-Digest",
        "content_type": "Content-Type",
        "content_length": "Content-Length",
    }
    return made.select(
        "row.page_id", "record_type", "record_id",
        *[warc_derive.header(made, h).alias(c) for c, h in named.items()], "block",
    )


def _warc_oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def strip(text: str, pattern: str, to: str = "''") -> str:
        return f"regexp_replace({text}, {quoted(pattern)}, {to}, 'g')"

    def urn(seed: str) -> str:
        cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
        parts = ", ".join(f"substr(sha256({seed}), {a}, {n})" for a, n in cuts)
        return f"'<urn:uuid:' || concat_ws('-', {parts}) || '>'"

    page = "coalesce(html, '')"
    for pattern in warc_derive.HIDDEN:
        page = strip(page, pattern)
    text = strip("page", "[ \\t\\r\\n\\f]+", "' '")
    text = strip(strip(text, warc_derive.BREAK, "chr(10)"), warc_derive.TAG)
    title = f"regexp_extract(page, {quoted(warc_derive.TITLE)}, 1)"
    # the character references that the pages of these tables have
    for name, sign in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"),
                       ("nbsp", " "), ("#39", "'"), ("amp", "&")):
        text = f"replace({text}, '&{name};', {quoted(sign)})"
        title = f"replace({title}, '&{name};', {quoted(sign)})"
    text = strip(strip(text, "[ \\t\\r\\f ]+", "' '"), " ?\\n[ \\n]*", "chr(10)")
    title = f"trim({strip(title, '[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n' + chr(92) + 'f]+', quoted(' '))})"
    lines = f"""list_concat(
        list_filter(['source-digest: ' || source, 'title: ' || {title},
            'language: ' || lower(regexp_extract(page, {quoted(warc_derive.LANGUAGE)}, 1))],
            lambda x: x NOT LIKE '%: '),
        list_transform(string_split(http, crlf), lambda x: 'http-header: ' || x),
        list_transform(regexp_extract_all(page, {quoted(warc_derive.LINK)}, 1),
            lambda x: 'outlink: ' || replace({strip('x', warc_derive.NOT_LINK)}, '&amp;', '&')), [''])"""
    return f"""
WITH pages_in AS (
  SELECT page_id, url, {page} AS page, 'sha256:' || sha256(coalesce(html, '')) AS source,
    chr(13) || chr(10) AS crlf,
    {urn("concat_ws(' ', 'response', CAST(page_id AS VARCHAR), url)")} AS response_id,
    strftime(to_timestamp(1577836800 + coalesce(page_id, 0)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS date,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(coalesce(html, '')) AS http
  FROM pages
),
made AS (
  SELECT *, 'metadata' AS kind, 'application/warc-fields' AS media, list_reduce({lines}, lambda a, b: a || chr(13) || chr(10) || b) AS block
  FROM pages_in
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', trim({text}, ' ' || chr(10)) FROM pages_in
)
SELECT page_id, kind AS record_type, {urn("concat_ws(' ', kind, response_id)")} AS record_id, date AS warc_date,
  url AS target_uri, response_id AS refers_to, date AS refers_to_date, source AS payload_digest,
  'sha256:' || sha256(block) AS block_digest, media AS content_type,
  CAST(strlen(block) AS VARCHAR) AS content_length, block
FROM made
"""


ORACLES["op1_warc_derive"] = _warc_oracle()


@query
def op11_string_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = string_kernels.identify_languages(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "held_out", "lang_pred", "score")


@query
def op12_segment_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    drawn = segment_resampling.resample(docs, target)
    return drawn.select("row.doc_id", "n_features", "weight", "score", "rank")


@query
def op13_spectral_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector and component."""
    rows = spectral_whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return rows.select("row.vec_id", "n", "deviation", "identity_error", parts).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error",
    )
