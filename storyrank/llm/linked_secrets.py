"""Secret scan with multipart credential linking.

Each text is searched once. Strong parts (assignments, access identifiers, long hex runs) are
reported as they are. Weak parts (short identifiers, key-like strings, endpoints) say little
alone; an interval join within a text pairs them with parts of another role near by and in the
same section, and only those that have such a partner are reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank.llm.common import small_batches
from storyrank.sources.scratch import stored

# fixed values: patterns and least lengths of the strong kinds, in the order of their ties
ASSIGN = re.compile(
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 and more are the runs that pass
LEAST = {"assign": 6, "access": 20, "hex": 24}

# weak kinds
IDENT = re.compile(
    r"(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?|tenant)"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,64})""",
    re.IGNORECASE | re.ASCII,
)
NAME = re.compile(r"[A-Za-z0-9_.-]*\Z")  # what stands before IDENT in the same name
# '=' and ':' may stand before a key: NAME=key, NAME: key
KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])")
ADDRESS = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~%@:\[\]-]{3,253}", re.ASCII)
SERVER = re.compile(
    r"""(?<![A-Za-z0-9])(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{3,253}""",
    re.IGNORECASE | re.ASCII,
)
SECTION = re.compile(r"\n\s*\n")

KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
# what a part can be to another: an identifier, a secret or an endpoint
ROLES = {"assign": "secret", "access": "ident", "hex": "secret",
         "ident": "ident", "key": "secret", "endpoint": "endpoint"}


@dataclass(frozen=True)
class LinkConfig:
    """`reach`: code points between the ends of two parts that belong together; `entropy`: least
    bits for each character of a weak key."""

    reach: int = 256
    entropy: float = 3.5


# ------------------------------------------------------------------------- one text


def strong_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the strong kinds by start, then kind."""
    found = []
    if _has(text.lower(), ("passw", "secret", "token", "apikey", "api_key")):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        matches = (m.span() for m in ACCESS.finditer(text))
        found += [("access", *s) for s in matches if s[1] - s[0] >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=_place)


def _has(text: str, marks: tuple[str, ...]) -> bool:
    """Whether a pattern that needs one of the marks can match at all."""
    return any(m in text for m in marks)


def _place(span: tuple[str, int, int]) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def weak_spans(text: str, strong: list[tuple[str, int, int]], cfg: LinkConfig) -> list[tuple[str, int, int]]:
    """Weak candidates that do not lie within a strong span."""
    lower = text.lower()
    found = [("key", *m.span()) for m in KEY.finditer(text) if _dense(m[0], cfg.entropy)]
    if _has(lower, ("user", "login", "account", "client", "accesskey", "access_key", "tenant")):
        found += [("ident", *m.span()) for m in IDENT.finditer(text) if not _names_secret(text, m.start())]
    addresses = [m.span() for m in ADDRESS.finditer(text)] if "://" in text else []
    if _has(lower, ("host", "endpoint", "server")):
        begins = [a for a, _ in addresses]
        servers = [m.span() for m in SERVER.finditer(text)]
        # addresses follow each other: only the last that begins before can reach over
        inside = [i >= 0 and s[0] < addresses[i][1] for s in servers for i in [bisect_right(begins, s[0]) - 1]]
        addresses += [s for s, hidden in zip(servers, inside) if not hidden]
    found += [("endpoint", *s) for s in addresses]
    begins = [a for _, a, _ in strong]
    reach = list(accumulate((b for _, _, b in strong), max))
    covered = lambda s: (i := bisect_right(begins, s[1]) - 1) >= 0 and reach[i] >= s[2]
    return [s for s in found if not covered(s)]


def _names_secret(text: str, at: int) -> bool:
    """Whether the name that goes on at `at` says secret, as SECRET_ACCESS_KEY does."""
    return "secret" in NAME.search(text[max(at - 64, 0) : at])[0].lower()


def _dense(value: str, least: float) -> bool:
    """Digits, both cases and enough entropy: words and paths have not."""
    if not (re.search("[0-9]", value) and re.search("[a-z]", value) and re.search("[A-Z]", value)):
        return False
    shares = (n / len(value) for n in Counter(value).values())
    return -sum(p * math.log2(p) for p in shares) >= least


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


PARTS = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()),
    ("section", pa.int32()), ("strong", pa.bool_()),
]))


def _scan(batches: Iterator[pa.RecordBatch], cfg: LinkConfig) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 33
    for batch in batches:
        digests, parts = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            strong = strong_spans(text)
            weak = weak_spans(text, strong, cfg)
            breaks = [m.start() for m in SECTION.finditer(text)] if weak else []
            digests.append(hashlib.sha256(joined(strong).encode()).hexdigest())
            parts.append([
                {"kind": kind, "start": start, "stop": stop, "strong": here is strong,
                 "section": bisect_left(breaks, start)}
                for here in (strong, weak) for kind, start, stop in here
            ])
        uids = pa.array(range(uid, uid + batch.num_rows), pa.int64())
        uid += batch.num_rows
        columns = [batch.column(0), uids, pa.array(digests, pa.string()), pa.array(parts, PARTS)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "uid", "base_sha256", "parts"])


# ------------------------------------------------------------------------- operator


def scan_texts(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", cfg: LinkConfig = LinkConfig()
) -> DataFrame:
    """Stored (id, uid, base_sha256, parts) of every text; `uid` tells rows apart."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    part = "struct<kind: string, start: int, stop: int, section: int, strong: boolean>"
    schema = f"id {kind}, uid long, base_sha256 string, parts array<{part}>"
    return stored(rows.mapInArrow(lambda batches: _scan(batches, cfg), schema), "secret-parts")


def linked_parts(scans: DataFrame, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """(uid, kind, start, stop) of weak parts with a partner of another role in reach, one of the two
    being a secret: an identifier and an endpoint alone give nothing away.

    Both sides of the interval join are dealt by text and section and by bins as wide as the
    reach; a part lies in the bins that its interval touches, a weak one also asks the bins beside
    them. A bin holds no more parts than fit in its width, so a text full of parts is no hot key.
    """
    long = (
        scans.filter(F.size("parts") > 1)
        .select("uid", F.explode("parts").alias("p"))
        .select("uid", "p.*")
    )
    role = F.lit(None)
    for kind, name in ROLES.items():
        role = F.when(F.col("kind") == kind, name).otherwise(role)
    long = long.withColumn("role", role)
    bin_of = lambda x: F.floor(x / cfg.reach)
    partners = long.select(
        "uid", "section", F.col("role").alias("other"), F.col("start").alias("from"), F.col("stop").alias("to"),
        F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("stop")))).alias("bin"),
    )
    asking = long.filter(~F.col("strong")).withColumn(
        "bin", F.explode(F.sequence(bin_of(F.col("start")) - 1, bin_of(F.col("stop")) + 1))
    )
    near = (F.col("from") <= F.col("stop") + cfg.reach) & (F.col("to") >= F.col("start") - cfg.reach)
    met = asking.alias("a").join(
        partners.alias("b"),
        (F.col("a.uid") == F.col("b.uid")) & (F.col("a.section") == F.col("b.section"))
        & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.role") != F.col("b.other"))
        & ((F.col("a.role") == "secret") | (F.col("b.other") == "secret")) & near,
        "left_semi",
    )
    return met.select("uid", "kind", "start", "stop").distinct()


def find_secrets(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", cfg: LinkConfig = LinkConfig()
) -> DataFrame:
    """One row per input row: id, spans (array of kind, start, stop), base_sha256.

    Offsets are code points, ends exclusive. Strong spans always stay, weak ones only when linked. A
    null text is empty; null and repeated ids give their own rows; other columns are not read; an
    empty table gives an empty result.
    """
    scans = scan_texts(df, text_col, id_col, cfg)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    ordered = F.struct("start", place.alias("place"), "stop", "kind")
    linked = linked_parts(scans, cfg).groupBy("uid").agg(F.collect_list(ordered).alias("linked"))
    strong = F.transform(
        F.filter("parts", lambda p: p["strong"]),
        lambda p: F.struct(
            p["start"].alias("start"),
            F.array_position(F.array(*[F.lit(k) for k in KINDS]), p["kind"]).cast("int").alias("place"),
            p["stop"].alias("stop"),
            p["kind"].alias("kind"),
        ),
    )
    every = F.sort_array(F.when(F.col("linked").isNull(), strong).otherwise(F.concat(strong, "linked")))
    spans = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return scans.join(linked, "uid", "left").select(
        F.col("id").alias(id_col), spans.alias("spans"), "base_sha256"
    )
