"""Token ids of whole texts by a tokenizer file, with a bounded memory of words.

Both supported kinds of tokenizer never merge across certain white space, nor a word with the marks
after it. A text is cut there, and each word is encoded once by the tokenizers library and remembered;
cutting, looking up and joining work on whole columns. Texts whose white space does not allow such
cuts are encoded whole.
"""

from __future__ import annotations

import json
import string
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

# fixed values: the white space of Unicode, as it stands in a class of a pattern
_SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# white space in a text of the byte-level kind that does not allow cuts, and the mark of a cut
_RUNS = rf"[{_SPACE}][{_SPACE}]|[\t\x0b-\r\x1c-\x1f\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{3000}}]|\x00"
# marks other than the apostrophe of short forms
_MARKS = string.punctuation.replace("'", "")

# rows and bytes of a batch of texts to encode: each distinct piece is looked up once in a batch
ENCODED_TOGETHER = 5_000, "16m"


@dataclass(frozen=True)
class TokenizerSpec:
    """Contents of a tokenizer file, small and of fixed size, read once on the driver."""

    definition: str
    byte_level: bool
    dtype: str

    @staticmethod
    def read(path: str) -> TokenizerSpec:
        with open(path, encoding="utf-8") as file:
            definition = file.read()
        parsed = json.loads(definition)
        ids = [*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed["added_tokens"])]
        byte_level = parsed["pre_tokenizer"]["type"] == "ByteLevel"
        return TokenizerSpec(definition, byte_level, "<u2" if max(ids) < 1 << 16 else "<u4")

    def ship(self, spark: SparkSession):
        return spark.sparkContext.broadcast((self.definition, self.byte_level, self.dtype))


class Encoder:
    """Ids of texts; remembers a bounded number of words, as Arrow strings and one array of ids."""

    GENERATION = 300_000
    LONGEST_KEPT = 64

    def __init__(self, spec: TokenizerSpec) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec.definition)
        self.dtype, self.byte_level = np.dtype(spec.dtype), spec.byte_level
        self.known = pa.array([], pa.string())
        self.pool, self.sizes = np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def _pieces(self, texts: pa.Array) -> pa.Array:
        """Parts of each text that can be encoded one by one."""
        if self.byte_level:
            marked = pc.replace_substring(texts, " ", "\x00 ")
            marked = pc.replace_substring(marked, "\n", "\x00\n\x00")
            return pc.split_pattern(marked, "\x00")
        # this kind drops white space, so no token crosses it, and lower-cases
        return pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text begins; null is empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        whole = np.zeros(0, np.int64)
        if self.byte_level:
            odd = pc.match_substring_regex(texts, _RUNS)
            whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            texts, all_texts = pc.if_else(odd, "", texts), texts
        lists = self._pieces(texts)
        coded = lists.flatten().dictionary_encode()
        words = _cut_marks(coded.dictionary.cast(pa.string())).dictionary_encode()
        ids, sizes = _picked(*self._values(words.dictionary), words.indices.to_numpy())
        ids, sizes = _picked(ids, sizes.reshape(-1, 2).sum(axis=1), coded.indices.to_numpy())
        firsts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        begins = np.concatenate([[0], np.cumsum(sizes)])[firsts]
        if len(whole):
            parts = np.split(ids, begins[1:-1])
            found, counts = self._ids([all_texts[int(i)].as_py() for i in whole])
            for i, own in zip(whole, np.split(found, np.cumsum(counts)[:-1])):
                parts[i] = own
            ids = np.concatenate(parts)
            begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, begins

    def _values(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and how many each has; what is new is learned."""
        found = pc.index_in(words, value_set=self.known)
        new = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        fresh = words.take(pa.array(new))
        ids, sizes = self._encoded(fresh)
        index = found.fill_null(0).to_numpy().astype(np.int64)
        index[new] = len(self.known) + np.arange(len(new))
        pool, counts = np.concatenate([self.pool, ids]), np.concatenate([self.sizes, sizes])
        values = _picked(pool, counts, index)
        if len(counts) <= self.GENERATION:
            self._remember(pa.concat_arrays([self.known, fresh]), pool, counts)
        else:
            # all but the words of this batch is forgotten
            self._remember(words, *values)
        return values

    def _remember(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        short = pc.less_equal(pc.utf8_length(words), self.LONGEST_KEPT)
        kept = np.flatnonzero(short.to_numpy(zero_copy_only=False))[: self.GENERATION]
        if len(kept) < len(words):
            words, (ids, sizes) = words.take(pa.array(kept)), _picked(ids, sizes, kept)
        self.known, self.pool, self.sizes = words, ids, sizes

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are not known, and how many each has; each kind of word in its way."""
        letters = _mask(pc.utf8_is_alpha(pc.ascii_ltrim(words, " ")))
        plain = letters & _mask(pc.string_is_ascii(words))
        lines = letters & ~plain & ~_mask(pc.starts_with(words, " ")) & self.byte_level
        spaced = letters & ~plain & ~lines
        todo = ((self._plain_ids, plain), (self._spaced_ids, spaced), (self._line_ids, lines), (self._ids, ~letters))
        order, ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for encode, kind in todo:
            group = np.flatnonzero(kind)
            for begin in range(0, len(group), 1_000):
                order.append(group[begin : begin + 1_000])
                found, counts = encode(words.take(pa.array(order[-1])).to_pylist())
                ids.append(found)
                sizes.append(counts)
        return _picked(np.concatenate(ids), np.concatenate(sizes), np.argsort(np.concatenate(order)))

    def _joined(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum())), sizes

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._joined([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of ASCII letters, on which only the model of the tokenizer acts."""
        tokenize = self.tokenizer.model.tokenize
        # the byte-level alphabet writes a space as this letter
        return self._joined([[t.id for t in tokenize(w.replace(" ", "\u0120"))] for w in words])

    def _spaced_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, a space before each; in one line each is one word."""
        return self._in_line("".join(w if w[0] == " " else f" {w}" for w in words), words, 1)

    def _line_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters at the beginning of a line; every other word is a line end."""
        return self._in_line("\n".join(words), words, 2)

    def _in_line(self, line: str, words: list[str], every: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode(line, add_special_tokens=False)
        ids, word = np.array(found.ids, self.dtype), np.array(found.word_ids, np.int64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        if len(starts) != every * len(words) - (every - 1):
            return self._ids(words)
        return _picked(ids, np.diff(starts, append=len(ids)), np.arange(0, len(starts), every))


def _mask(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False)


def _cut_marks(pieces: pa.Array) -> pa.Array:
    """Two strings for each piece: the part up to its last letter or digit, then the marks after it.

    Letters or digits and the marks after them are never one token. A piece that does not end like
    that is the first string and the second is empty. The bytes are shared, only offsets are new.
    """
    heads = pc.ascii_rtrim(pieces, _MARKS)
    cut = _mask(pc.utf8_is_alnum(pc.utf8_slice_codeunits(heads, -1))) & ~_mask(pc.match_substring(pieces, "<|"))
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset :][: len(pieces) + 1]
    ends = np.where(cut, offsets[:-1] + pc.binary_length(heads).to_numpy(), offsets[1:])
    places = np.empty(2 * len(pieces) + 1, np.int32)
    places[::2], places[1::2] = offsets, ends
    return pa.StringArray.from_buffers(2 * len(pieces), pa.py_buffer(places), pieces.buffers()[2])


def _picked(pool: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ids of words that stand one after the other in `pool`, those of the words at `index`, and
    how many each has."""
    counts = sizes[index]
    ends = np.cumsum(counts)
    # id number i of word p stands at begin[p] + i of the pool
    shift = (np.cumsum(sizes) - sizes)[index] - (ends - counts)
    return pool[np.repeat(shift, counts) + np.arange(ends[-1] if len(ends) else 0)], counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(shipped) -> Encoder:
    """The encoder of this worker process for a shipped tokenizer."""
    spec = TokenizerSpec(*shipped.value)
    if spec.definition not in _ENCODERS:
        _ENCODERS[spec.definition] = Encoder(spec)
    return _ENCODERS[spec.definition]
