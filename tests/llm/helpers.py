"""Plain versions of what the operators compute, and rows that are hard on them."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "end."

# nulls in every column, empty and very long texts, ties, repeated rows
ROWS = [
    (1, "Alpha beta gamma delta", "en", "a", 22),
    (2, "alpha BETA gamma delta", "en", "a", 22),
    (2, "alpha BETA gamma delta", "en", "a", 22),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (None, "", None, None, None),
    (5, LONG, "de", "b", len(LONG)),
    (6, LONG, "de", "b", len(LONG)),
    (7, "  spaced \n\n out\ttext ", "fr", None, 20),
    (8, "Ä ä İΣ café ². it's <|endoftext|>", "fr", "b", 30),
    (None, "alpha beta gamma delta", "en", "c", 22),
]


def frame(spark, rows=ROWS, extra=("text_crc32", "uid", "row", "size", "_range", "id")):
    """Documents with further columns named like those operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in extra})


def groups(links, nodes):
    """Smallest node of the component of each node."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def copies(rows):
    """{(doc_id, occurrence): (keep_id, size, sha)} by plain grouping; ids without null."""
    by = defaultdict(list)
    for doc_id, text in rows:
        by[ascii_lower(text)].append(doc_id)
    key = lambda i: (i is not None, i or 0)
    return {t: (max(ids, key=key), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items()}


def simhash(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0d]+", ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
