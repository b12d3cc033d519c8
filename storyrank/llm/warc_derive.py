"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Each response gives a metadata record (application/warc-fields: source headers, title, language,
links) and a conversion record (text/plain). Both refer to the response by its identifier, keep
its target, date and payload digest, and carry a digest of their own block. Identifiers are
derived from that of the response, so a task that runs again makes the same records.
"""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyrank.llm.common import row_of, small_batches

# fixed values: elements that end a line of text
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    "h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|"
    "th|thead|title|tr|ul"
)
HIDDEN = (
    r"(?s)<!--.*?(?:-->|\z)",
    r"(?is)<script\b[^>]*>.*?(?:</script[^>]*>|\z)",
    r"(?is)<style\b[^>]*>.*?(?:</style[^>]*>|\z)",
)


def _by_first_letter(words: str) -> str:
    """The same alternatives, tried by their first letter."""
    groups: dict[str, list[str]] = {}
    for word in words.split("|"):
        groups.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())


BREAK = rf"(?i)</?(?:{_by_first_letter(BLOCK_TAGS)})\b[^>]*>"
TAG = r"<[!/?a-zA-Z][^>]*>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title"
LANGUAGE = r"""(?i)<html\b[^>]*\blang[ ]*=[ ]*["']?([a-z-]+)"""
LINK = (
    r"""(?i)<a(?:[ \t\r\n][^>]*?)?[ \t\r\n]href[ \t\r\n]*=[ \t\r\n]*("[^"]*"|'[^']*'|[^ \t\r\n"'>]+)"""
)
# what an address does not hold: its quotes, tabs and line ends
NOT_LINK = """^["']|["']$|[\t\r\n]+"""
CRLF = "\r\n"


@F.arrow_udf(T.StringType())
def unescaped(texts: pa.Array) -> pa.Array:
    """Character references of HTML replaced by their characters."""
    return pa.array(
        [t if t is None or "&" not in t else html.unescape(t) for t in texts.to_pylist()], pa.string()
    )


def visible(page: Column) -> Column:
    """Page without comments, scripts and styles."""
    for pattern in HIDDEN:
        page = F.regexp_replace(page, pattern, "")
    return page


def plain_text(page: Column) -> Column:
    """Text of a page whose hidden parts are gone: one line per block, single blanks. Line ends of
    the source are blanks."""
    text = F.regexp_replace(page, "[\t\r\n\f]", " ")
    text = F.regexp_replace(F.regexp_replace(text, BREAK, "\n"), TAG, "")
    # single blanks, which are most, are not touched
    text = F.regexp_replace(unescaped(text), "[ \t\r\f\u00a0]{2,}|[\t\r\f\u00a0]", " ")
    return F.trim(F.regexp_replace(text, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def record_urn(seed: Column) -> Column:
    """Identifier made from a text."""
    h = F.sha2(seed.cast("binary"), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def page_responses(pages: DataFrame) -> DataFrame:
    """Response records of a table of crawled pages (page_id, url, html), `row` being the page.

    The table has no capture time; a page gets one second after another from a fixed day on.
    """
    body = F.coalesce("html", F.lit(""))
    key = F.concat_ws(" ", F.lit("response"), F.col("page_id").cast("string"), "url")
    return pages.select(
        row_of(pages).alias("row"),
        record_urn(key).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.date_format(
            F.timestamp_seconds(F.lit(1_577_836_800) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'"
        ).alias("date"),
        F.concat(
            F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
            F.octet_length(body).cast("string"),
        ).alias("http_headers"),
        body.alias("payload"),
    )


def derive_records(responses: DataFrame) -> DataFrame:
    """Two records per response: row, record_type, record_id, headers (name, value), block.

    `responses`: row, record_id, target_uri, date, http_headers (lines ended by CRLF, without the
    last end), payload (text). A null payload or header text counts as empty; a header whose value
    is null is left out; repeated responses give repeated records. An empty table gives none.
    """
    small_batches(responses.sparkSession)
    payload, http = F.coalesce("payload", F.lit("")), F.coalesce("http_headers", F.lit(""))
    page = responses.select(
        "row", "record_id", "target_uri", "date", http.alias("http"), digest(payload).alias("source"),
        visible(payload).alias("page"),
    )
    title = F.trim(F.regexp_replace(unescaped(F.regexp_extract("page", TITLE, 1)), "[ \t\r\n\f]+", " "))
    links = F.regexp_extract_all("page", F.lit(LINK), F.lit(1))
    fields = F.concat(
        F.filter(
            F.array(
                _field("source-digest", F.col("source")),
                _field("title", title),
                _field("language", F.lower(F.regexp_extract("page", LANGUAGE, 1))),
            ),
            lambda f: ~f.endswith(": "),
        ),
        F.transform(F.split("http", CRLF), lambda h: F.concat(F.lit("http-header: "), h)),
        F.transform(links, lambda h: F.concat(
            F.lit("outlink: "), F.replace(F.regexp_replace(h, NOT_LINK, ""), F.lit("&amp;"), F.lit("&"))
        )),
    )
    record = lambda kind, media, block: F.struct(
        F.lit(kind).alias("kind"), F.lit(media).alias("media"), block.alias("block")
    )
    both = page.select(
        "row", "record_id", "target_uri", "date", "source",
        F.explode(F.array(
            record("metadata", "application/warc-fields", F.array_join(F.concat(fields, F.array(F.lit(""))), CRLF)),
            record("conversion", "text/plain; charset=utf-8", plain_text(F.col("page"))),
        )).alias("made"),
    )
    urn = record_urn(F.concat_ws(" ", "made.kind", "record_id"))
    block = F.col("made.block")
    headers = {
        "WARC-Type": F.col("made.kind"),
        "WARC-Record-ID": urn,
        "WARC-Date": F.col("date"),
        "WARC-Target-URI": F.col("target_uri"),
        "WARC-Refers-To": F.col("record_id"),
        "WARC-Refers-To-Target-URI": F.col("target_uri"),
        "WARC-Refers-To-Date": F.col("date"),
        "WARC-Payload-Digest": F.col("source"),
        "WARC-Block-Digest": digest(block),
        "Content-Type": F.col("made.media"),
        "Content-Length": F.octet_length(block).cast("string"),
    }
    listed = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in headers.items()])
    return both.select(
        "row", F.col("made.kind").alias("record_type"), urn.alias("record_id"),
        F.filter(listed, lambda h: h["value"].isNotNull()).alias("headers"), block.alias("block"),
    )


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def header(records: DataFrame, name: str) -> Column:
    """Value of a named header of `derive_records`."""
    found = F.filter("headers", lambda h: h["name"] == name)
    return F.get(found, F.lit(0))["value"]


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC 1.1 text, one file per task, through Spark's own committed writer."""
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), F.array_join(lines, CRLF))
    # the writer ends each value with one more CRLF, the second that ends a record
    whole = F.concat(head, F.lit(CRLF * 2), "block", F.lit(CRLF))
    records.select(whole.alias("value")).write.option("lineSep", CRLF).option(
        "compression", compression
    ).mode("overwrite").text(path)
