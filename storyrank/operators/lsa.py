"""Latent semantic analysis: truncated SVD of the TF-IDF matrix by randomised subspace iteration.

With A the document-term matrix, `Q <- orth(A'A Q)` is repeated from a random start, then the
small matrix `(AQ)'(AQ)` gives singular values and the rotation of Q to the right singular
vectors (Halko, Martinsson and Tropp, 2011). A itself is only ever streamed, and the dense basis
lies in a table of pieces. Tasks orthonormalise it by its Gram matrix, the last time twice (Yamamoto
et al., 2015: CholeskyQR2), so width x width numbers meet on the driver, and the basis itself only
where it is proven to fit one block, to be broadcast. A larger one lies in a file of the shared scratch
folder, which tasks map: a row travels to those tasks only that hold one of its terms.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank.config import LookupConfig, LsaConfig
from storyrank.functions import vectors
from storyrank.operators import pairs
from storyrank.operators.features import count_rows, tfidf_long, tfidf_rows
from storyrank.operators.lookup import lookup
from storyrank.operators.pairs import pack_numbers, unpack_numbers, weighed_sums
from storyrank.operators.prefix import running_totals
from storyrank.sources import files
from storyrank.sources.scratch import discard, scratch_path, stored

CHUNK_NONZEROS = 2_048
BLOCK_TERMS = 64
PIECES = "piece int, payload binary"
# pieces in one Arrow batch
SENT_PIECES = 64
# cells for each term that make another partial product worth its size
PARTIAL_CELLS = 8
# cells of a lane
LANE_CELLS = 20_000_000
# pieces whose cells lie together when the matrix is stored by terms
TURNED_PIECES = 64
# cells that are turned at a time
TURNED_CELLS = 2_000_000
# monotonically_increasing_id: a partition, then a row in it
ROW_BITS = 33


@dataclass(frozen=True)
class Lsa:
    """`rows`: input columns but `words`, plus unit array `lsa`. `basis`: (term, loading).

    `parts`: stored tables that only `rows` is read from.
    """

    rows: DataFrame
    basis: DataFrame
    singular_values: np.ndarray
    parts: tuple[DataFrame, ...] = ()


def fit_lsa(
    words: DataFrame,
    terms: DataFrame,
    cfg: LsaConfig = LsaConfig(),
    lookup_cfg: LookupConfig = LookupConfig(),
) -> Lsa:
    """Factor the TF-IDF matrix of `words` (id_str, words, ...) over a stored `terms` table."""
    numbered = stored(
        # in order of a hash, so that frequent terms are dealt evenly to the blocks
        running_totals(
            terms.select("term", "idf", F.xxhash64("term").alias("dealt"), F.lit(1).cast("long").alias("one")),
            ["dealt", "term"], ["one"],
        )
        .select("term", "idf", F.col("one_before").alias("number")),
        "numbered-terms",
    )
    n_terms = numbered.count()
    if n_terms == 0:
        raise ValueError("no term is within the document frequency bounds")
    basis = _start(numbered, n_terms, cfg)
    folder = files.mounted(words.sparkSession, scratch_path(words.sparkSession, "lsa-mapped"))
    if basis.blocks > 1 and folder is not None:
        if n_terms <= lookup_cfg.max_arrow_rows:
            known = numbered.orderBy("number").select("term", "idf").toArrow()
            docs = count_rows(words.withColumn("_doc", F.monotonically_increasing_id()), known)
            return _factor_mapped(stored(docs, "lsa-matrix"), basis, cfg, folder, known["idf"].to_numpy())
        return _factor_mapped(stored(_weighed(words, numbered, n_terms, lookup_cfg), "lsa-matrix"), basis, cfg, folder)
    return factor(stored(_weighed(words, numbered, n_terms, lookup_cfg), "lsa-matrix"), numbered, n_terms, cfg, basis)


def _weighed(words: DataFrame, numbered: DataFrame, n_terms: int, cfg: LookupConfig) -> DataFrame:
    """Columns of `words` but `words`, a row key `_doc`, and the unit TF-IDF row (idx, val)."""
    keyed = words.withColumn("_doc", F.monotonically_increasing_id())
    if n_terms <= cfg.max_arrow_rows:
        return tfidf_rows(keyed, numbered.orderBy("number").select("term", "idf").toArrow())
    keyed = stored(keyed, "lsa-words")
    own = keyed.select(F.col("_doc").alias("id_str"), "words")
    weights = tfidf_long(own, numbered.select("term", "idf"), cfg, small=False)
    cell = F.struct(F.col("number").cast("int").alias("idx"), F.col("weight").alias("val"))
    sparse = (
        weights.join(numbered.select("term", "number"), "term")
        .groupBy(F.col("id_str").alias("_doc"))
        .agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    )
    empty = F.array().cast("array<struct<idx:int,val:double>>")
    cells = F.coalesce("cells", empty)
    return keyed.drop("words").join(sparse, "_doc", "left").withColumns(
        {"idx": F.transform(cells, lambda c: c["idx"]), "val": F.transform(cells, lambda c: c["val"])}
    ).drop("cells")


def factor(
    docs: DataFrame, numbered: DataFrame, n_terms: int, cfg: LsaConfig = LsaConfig(), basis: _Basis | None = None
) -> Lsa:
    """Factor a stored sparse matrix (_doc, idx, val, ...) whose columns are `numbered` terms.

    The basis is a stored table of pieces; it is made, multiplied and orthonormalised in tasks. When
    it is proven to fit `max_block_bytes` it is broadcast and a product needs no exchange of
    documents. A larger one is mapped from the scratch folder, if that is a mounted one (`fit_lsa`).
    Otherwise the matrix is cut into lanes, one for each block of terms and slice of the documents: every
    cell lies in one lane, each lane gets its block once, and a round is one job.
    The start, the order of terms and the precision are the same in all cases. `_doc` is a
    monotonically increasing id.
    """
    basis = _start(numbered, n_terms, cfg) if basis is None else basis
    if basis.blocks == 1:
        return _factor_whole(docs, basis, cfg)
    cells = docs.select("_doc", F.explode(F.arrays_zip("idx", "val")).alias("c")).select("_doc", "c.*")
    return _factor_split(docs.drop("idx", "val"), cells, basis, cfg)


def factor_cells(
    docs: DataFrame, cells: DataFrame, numbered: DataFrame, n_terms: int, cfg: LsaConfig = LsaConfig()
) -> Lsa:
    """As `factor`, for a matrix in long form: rows (_doc, ...) and stored cells (_doc, idx, val).

    Cells are gathered by row and block, so no more than a block of them come together.
    """
    basis = _start(numbered, n_terms, cfg)
    if basis.blocks > 1:
        return _factor_split(docs, cells, basis, cfg)
    gathered = _by_block(cells, basis.size).drop("block")
    joined = docs.join(gathered, "_doc", "left").withColumns({
        "idx": F.coalesce("idx", F.array().cast("array<int>")),
        "val": F.coalesce("val", F.array().cast("array<double>")),
    })
    return _factor_whole(stored(joined, "lsa-matrix"), basis, cfg)


def _start(numbered: DataFrame, n_terms: int, cfg: LsaConfig) -> _Basis:
    width = min(cfg.components + cfg.oversample, n_terms)
    size = max(cfg.max_block_bytes // (8 * width), 1)
    if size < n_terms:
        # whole pieces, except for blocks smaller than one
        size = size // BLOCK_TERMS * BLOCK_TERMS or size
    return _Basis.start(numbered, n_terms, width, size, cfg.seed)


def _factor_whole(docs: DataFrame, basis: _Basis, cfg: LsaConfig) -> Lsa:
    """The basis fits in one block, which is shipped to every task."""
    cells = docs.agg(F.sum(F.size("idx"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    # a partial product is as large as the basis: no more of them than their cells pay for
    tasks = min(max(cells // (PARTIAL_CELLS * basis.n_terms), 1), cores)
    for done in range(cfg.rounds):
        basis = basis.following(_whole_products(docs, basis, tasks), last=done == cfg.rounds - 1)
    shipped = docs.sparkSession.sparkContext.broadcast(basis.whole())
    rotation, singular = _rotation(_sketch_gram(docs, shipped, basis.width), cfg.components)
    return Lsa(_project(docs, shipped, rotation), basis.loadings(rotation), singular)


def _factor_mapped(docs: DataFrame, basis: _Basis, cfg: LsaConfig, folder: str, idf: np.ndarray | None = None) -> Lsa:
    """Both dense factors lie in files of the shared folder, which tasks write in place and map.

    Rows of A Q are made where the documents are, those of A'A Q where the cells of their terms are,
    for which the matrix is stored a second time, by terms. A task touches no more rows than it has
    cells, and neither documents nor cells move during a round. With `idf` the cells of the stored table are
    counts, which stand for count x idf / norm. What a round leaves is deleted when the next one has read it.
    """
    if idf is None:
        docs, scale = docs.withColumn("norm", F.lit(1.0)), None
    else:
        whole = TURNED_PIECES * basis.unit
        scale = docs.sparkSession.sparkContext.broadcast(np.pad(idf, (0, -len(idf) % whole)))
    turned = _turned(docs, basis)
    for done in range(cfg.rounds):
        own = f"{folder}/{done}"
        path = _save_basis(basis, own, scale)
        discard(basis.pieces)
        _write_sketch(docs, basis, path, own)
        os.remove(path)
        basis = basis.following(_turned_products(turned, basis, own, scale), last=done == cfg.rounds - 1)
        shutil.rmtree(own, ignore_errors=True)
    kept = [c for c in docs.columns if c not in ("_doc", "idx", "val", "norm")]
    row = _mapped_rows(basis, _save_basis(basis, f"{folder}/{cfg.rounds}", scale))
    discard(turned)
    sketch = stored(docs.select(*kept, row("idx", "val", "norm").alias("y")), "lsa-sketch")
    shutil.rmtree(folder, ignore_errors=True)
    discard(docs)
    rotation, singular = _rotation(_gram(sketch), cfg.components)
    rows = sketch.select(*kept, _times(rotation)("y").alias("lsa"))
    return Lsa(rows, basis.loadings(rotation), singular, (sketch,))


def _factor_split(docs: DataFrame, cells: DataFrame, basis: _Basis, cfg: LsaConfig) -> Lsa:
    tiles, slices = _tiles(cells, basis)
    for done in range(cfg.rounds):
        basis = basis.following(_lane_products(tiles, slices, basis), last=done == cfg.rounds - 1)
    sketch = stored(_sketch(tiles, slices, basis), "lsa-sketch")
    rotation, singular = _rotation(_gram(sketch), cfg.components)
    unit = sketch.select("_doc", _times(rotation)("y").alias("lsa"))
    blank = F.array_repeat(F.lit(0.0), rotation.shape[1])
    joined = docs.join(unit, "_doc", "left")
    rows = joined.select(*[c for c in docs.columns if c != "_doc"], F.coalesce("lsa", blank).alias("lsa"))
    return Lsa(stored(rows, "lsa-rows"), basis.loadings(rotation), singular)


def factor_square(
    matrix: DataFrame, numbered: DataFrame, n_terms: int, value, cfg: LsaConfig, folder: str
) -> tuple[str, np.ndarray]:
    """Factor a symmetric matrix of packed cells (`pairs.square`), whose rows are `numbered` too.

    Returns a file of rows of A Q in the mounted `folder` and the rotation; their unit products are the
    rows of `factor`. `value` gives cells (a, b, n) their value. A row is added up where its cells lie and
    written in place, so nothing but width x width numbers moves between the rounds.
    """
    spark, basis = matrix.sparkSession, _start(numbered, n_terms, cfg)
    width, whiten = basis.width, basis.whiten
    source = _save_basis(basis, f"{folder}/start")
    discard(basis.pieces)
    for done in range(cfg.rounds):
        sketch = pairs.multiply(matrix, n_terms, value, source, whiten, f"{folder}/{done}/sketch")
        os.remove(source)
        source = pairs.multiply(matrix, n_terms, value, sketch, np.eye(width), f"{folder}/{done}/basis")
        os.remove(sketch)
        whiten = _whitener(_file_gram(spark, source, n_terms, np.eye(width)))
        if done == cfg.rounds - 1:
            whiten = whiten @ _whitener(_file_gram(spark, source, n_terms, whiten))
    sketch = pairs.multiply(matrix, n_terms, value, source, whiten, f"{folder}/sketch")
    os.remove(source)
    rotation, _ = _rotation(_file_gram(spark, sketch, n_terms, np.eye(width)), cfg.components)
    return sketch, rotation


def _file_gram(spark, path: str, n_rows: int, factor: np.ndarray) -> np.ndarray:
    """Gram matrix of the rows of a mapped file, times `factor`."""
    width = len(factor)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, gram = pairs.mapped(path, width), np.zeros((width, width))
        for batch in batches:
            for first in batch.column(0).to_pylist():
                x = rows[first : min(first + pairs.FACTOR_ROWS, n_rows)] @ factor
                gram += x.T @ x
        yield _numbered_rows(gram)

    return _sum_rows(pairs.factor_ranges(spark, n_rows).mapInArrow(partial, "i int, v array<double>"))


# ------------------------------------------------------------------------------ basis


class _Basis:
    """Orthonormal columns over all terms: stored pieces (piece, payload), times `whiten`.

    A piece holds the rows of `unit` consecutive terms; a block of `size` terms is what a task holds
    at a time. Only width x width numbers come to the driver.
    """

    def __init__(self, pieces, numbered, n_terms: int, width: int, size: int, last: bool = False) -> None:
        self.pieces, self.numbered = pieces, numbered
        self.n_terms, self.width, self.size = n_terms, width, size
        self.blocks = -(-n_terms // size)
        self.unit = min(BLOCK_TERMS, size)
        self.whiten = _whitener(self._gram(np.eye(width)))
        if last:
            # once more: the first pass leaves what rounding of the squares has cost
            self.whiten = self.whiten @ _whitener(self._gram(self.whiten))

    @staticmethod
    def start(numbered: DataFrame, n_terms: int, width: int, size: int, seed: int) -> _Basis:
        """Random signs that depend on the term only."""
        unit = min(BLOCK_TERMS, size)
        hashes = [F.xxhash64("term", F.lit(seed + k)).alias(f"h{k}") for k in range(-(-width // 64))]
        piece = F.floor(F.col("number") / unit).cast("int").alias("piece")

        def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                words = np.stack([c.to_numpy() for c in batch.columns[2:]], axis=1)
                bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)[:, :width]
                at = batch.column(1).to_numpy() % unit
                for number, row, sign in zip(batch.column(0).to_pylist(), at, 2.0 * bits - 1.0):
                    if number not in sums:
                        sums[number] = np.zeros((unit, width))
                    sums[number][row] = sign
            if sums:
                yield _payloads(np.array(list(sums)), np.stack([x.ravel() for x in sums.values()]))

        rows = numbered.select(piece, "number", *hashes).repartition("piece")
        pieces = stored(rows.mapInArrow(signs, PIECES), "lsa-pieces")
        return _Basis(pieces, numbered, n_terms, width, size)

    def following(self, pieces: DataFrame, last: bool = False) -> _Basis:
        return _Basis(pieces, self.numbered, self.n_terms, self.width, self.size, last)

    def _gram(self, factor: np.ndarray) -> np.ndarray:
        width = self.width

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gram = np.zeros((width, width))
            for batch in batches:
                for payload in batch.column(0):
                    x = np.frombuffer(payload.as_buffer()).reshape(-1, width) @ factor
                    gram += x.T @ x
            yield _numbered_rows(gram)

        return _sum_rows(self.pieces.select("payload").mapInArrow(partial, "i int, v array<double>"))

    def whole(self) -> np.ndarray:
        """The basis in one array; only for one that fits a block."""
        table = self.pieces.toArrow()
        out = np.zeros((-(-self.n_terms // self.unit), self.unit * self.width))
        for number, payload in zip(table["piece"].to_pylist(), table["payload"]):
            out[number] = np.frombuffer(payload.as_buffer())
        return out.reshape(-1, self.width)[: self.n_terms] @ self.whiten

    def loadings(self, rotation: np.ndarray) -> DataFrame:
        """(term, loading), unpacked in tasks."""
        turn, unit, width = self.whiten @ rotation, self.unit, self.width

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                    rows = np.frombuffer(payload.as_buffer()).reshape(-1, width) @ turn
                    numbers = pa.array(number * unit + np.arange(unit, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([numbers, _rows_to_list(rows)], ["number", "loading"])

        rows = self.pieces.select("piece", "payload").mapInArrow(unpack, "number long, loading array<double>")
        return self.numbered.select("number", "term").join(rows, "number").select("term", "loading")


def project(
    words: DataFrame,
    terms: DataFrame,
    basis: DataFrame,
    cfg: LsaConfig = LsaConfig(),
    lookup_cfg: LookupConfig = LookupConfig(),
) -> DataFrame:
    """Rows of new posts (id_str, words, ...) in a fitted space: input columns but `words`, plus `lsa`.

    `terms` (term, idf) and `basis` (term, loading) are those of the fit, so a post of the fit gets its
    row again. Posts without a term of the vocabulary get a zero row. A basis of proven size travels to
    the posts; the words of a larger one are joined, and a post adds up a row for each of its terms.
    """
    table = stored(terms.select("term", "idf").join(basis, "term"), "lsa-terms")
    head = table.select("loading").first()
    if head is None:
        raise ValueError("the basis has no term")
    width = len(head["loading"])
    if table.count() * width * 8 <= cfg.max_block_bytes:
        known = table.orderBy("term").toArrow()
        loadings = words.sparkSession.sparkContext.broadcast(_list_to_rows(known["loading"].combine_chunks()))
        return _project(tfidf_rows(words, known), loadings, np.eye(width))
    keyed = stored(words.withColumn("_doc", F.monotonically_increasing_id()), "lsa-words")
    own = keyed.select(F.col("_doc").alias("id_str"), "words")
    weights = tfidf_long(own, table.select("term", "idf"), lookup_cfg, small=False)
    cells = lookup(weights, table.select("term", "loading"), ["term"], lookup_cfg, small=False)
    part = F.transform("loading", lambda x: x * F.col("weight"))
    total = Summarizer.sum(array_to_vector(part))
    summed = cells.groupBy(F.col("id_str").alias("_doc")).agg(vector_to_array(total).alias("sum"))
    blank = F.array_repeat(F.lit(0.0), width)
    rows = keyed.drop("words").join(summed, "_doc", "left")
    return rows.withColumn("lsa", vectors.unit(F.coalesce("sum", blank))).drop("_doc", "sum")


# --------------------------------------------------------------------------- products


def _whole_products(docs: DataFrame, basis: _Basis, tasks: int) -> DataFrame:
    """Stored pieces of A'A Q, with Q in every task: one pass over the matrix."""
    context, width = docs.sparkSession.sparkContext, basis.width
    pieces, unit = -(-basis.n_terms // basis.unit), basis.unit
    shipped = context.broadcast(basis.whole())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shipped.value
        total = np.zeros((pieces * unit, width))
        for batch in batches:
            for _, dense, touched in _chunks(batch.column(0), batch.column(1)):
                total[touched] += dense.T @ (dense @ q[touched])
        yield from _used_pieces(total, unit, 0)

    parts = docs.select("idx", "val").coalesce(tasks).mapInArrow(partial, PIECES)
    out = stored(_summed_pieces(parts) if tasks > 1 else parts, "lsa-pieces")
    shipped.unpersist()
    return out


def _save_basis(basis: _Basis, folder: str, scale=None) -> str:
    """The pieces in one file by number, which tasks write in place; without `whiten`, rows times `scale`."""
    os.makedirs(folder, exist_ok=True)
    path, unit, width = f"{folder}/basis", basis.unit, basis.width
    size = unit * width * 8
    with open(path, "wb") as file:
        # pieces that are not there are zero
        file.truncate(-(-basis.n_terms // unit) * size)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(path, "r+b") as file:
            for batch in batches:
                for piece, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                    data = payload.as_buffer()
                    if scale is not None:
                        rows = np.frombuffer(data).reshape(unit, width)
                        data = (rows * scale.value[piece * unit : (piece + 1) * unit, None]).tobytes()
                    file.seek(piece * size)
                    file.write(data)
                n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    basis.pieces.select("piece", "payload").mapInArrow(save, "n long").agg(F.sum("n")).collect()
    return path


def _map_rows(path: str, width: int) -> np.ndarray:
    rows = np.memmap(path, np.float64, "r")
    return np.asarray(rows).reshape(-1, width)


def _sketch_rows(idx: pa.Array, val: pa.Array, q: np.ndarray, whiten: np.ndarray, norm: np.ndarray) -> np.ndarray:
    sizes = idx.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    terms, cells = (x.flatten().to_numpy(zero_copy_only=False) for x in (idx, val))
    out = np.zeros((len(idx), q.shape[1]))
    weighed_sums(np.repeat(np.arange(len(idx)), sizes), terms, cells.astype(np.float64), q, out)
    return out @ whiten / norm[:, None]


def _norms(norm: pa.Array) -> np.ndarray:
    """Lengths of rows; one for those without a cell."""
    found = norm.to_numpy(zero_copy_only=False)
    return np.where(found > 0, found, 1.0)


def _mapped_rows(basis: _Basis, path: str):
    """Column function: sparse row (idx, val, norm) to its row of A Q."""
    width, whiten = basis.width, basis.whiten

    @F.arrow_udf("array<double>")
    def rows(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        q = _map_rows(path, width)
        for idx, val, norm in batches:
            yield _rows_to_list(_sketch_rows(idx, val, q, whiten, _norms(norm)))

    return rows


def _write_sketch(docs: DataFrame, basis: _Basis, path: str, folder: str) -> None:
    """Rows of A Q, by norm once more, in a file for each partition that made the ids, each in its place.

    A task that runs again writes the same bytes.
    """
    width, whiten = basis.width, basis.whiten

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, n = _map_rows(path, width), 0
        for batch in batches:
            doc = batch.column(0).to_numpy()
            norm = _norms(batch.column(3))
            out = _sketch_rows(batch.column(1), batch.column(2), q, whiten, norm) / norm[:, None]
            # rows of one file that follow each other
            cuts = np.flatnonzero(np.diff(doc) != 1) + 1
            file, name = None, None
            for begin, end in zip([0, *cuts], [*cuts, len(doc)]) if len(doc) else ():
                part, row = divmod(int(doc[begin]), 1 << ROW_BITS)
                if part != name:
                    if file is not None:
                        file.close()
                    name = part
                    file = os.fdopen(os.open(f"{folder}/sketch-{part}", os.O_RDWR | os.O_CREAT, 0o644), "r+b")
                file.seek(row * width * 8)
                file.write(out[begin:end].tobytes())
            if file is not None:
                file.close()
            n += len(doc)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    docs.select("_doc", "idx", "val", "norm").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _turned(docs: DataFrame, basis: _Basis) -> DataFrame:
    """Stored cells by blocks of terms: (block, part, first, n, rows, terms, vals), in order of terms.

    `part` is the partition that made the ids, `first` the first row in it, `rows` count from there. Rows,
    steps of terms and counts are packed.
    """
    size, whole = TURNED_PIECES * basis.unit, dict(docs.dtypes)["val"] == "array<int>"

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            begin = done = 0
            while begin < len(sizes):
                stop = max(int(np.searchsorted(ends, done + TURNED_CELLS, side="right")), begin + 1)
                own = batch.slice(begin, stop - begin)
                yield from turned(own, sizes[begin:stop])
                begin, done = stop, int(ends[stop - 1])

    def turned(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc = np.repeat(batch.column(0).to_numpy(), sizes)
        term = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        val = batch.column(2).flatten().to_numpy(zero_copy_only=False)
        part = doc >> ROW_BITS
        order = np.lexsort((term, part)) if len(doc) and part[0] != part[-1] else np.argsort(term, kind="stable")
        doc, term, val, part = doc[order], term[order], val[order], part[order]
        block = term // size
        cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0)) + 1
        out = {name: [] for name in ("block", "part", "first", "n", "rows", "terms", "vals")}
        for a, b in zip([0, *cuts], [*cuts, len(doc)]) if len(doc) else ():
            row = doc[a:b] & ((1 << ROW_BITS) - 1)
            first = int(row.min())
            out["block"].append(int(block[a]))
            out["part"].append(int(part[a]))
            out["first"].append(first)
            out["n"].append(int(b - a))
            out["rows"].append(pack_numbers(row - first))
            out["terms"].append(pack_numbers(np.diff(term[a:b], prepend=block[a] * size)))
            out["vals"].append(pack_numbers(val[a:b]) if whole else val[a:b].tobytes())
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, kind) for v, kind in zip(out.values(), kinds)], list(out)
        )

    shape = "block int, part long, first long, n long, rows binary, terms binary, vals binary"
    cut = docs.select("_doc", "idx", "val").mapInArrow(turn, shape)
    return stored(cut.repartition("block").sortWithinPartitions("block", "part", "first"), "lsa-turned")


def _turned_products(turned: DataFrame, basis: _Basis, folder: str, scale=None) -> DataFrame:
    """Stored pieces of A'A Q from the mapped rows of A Q; rows of a term times `scale`."""
    unit, width = basis.unit, basis.width

    def pieces(total: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
        if scale is not None:
            total *= scale.value[block * len(total) : (block + 1) * len(total), None]
        return _used_pieces(total, unit, block * TURNED_PIECES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, part, y = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                own, at, first, n = (batch.column(c)[i].as_py() for c in range(4))
                if own != block:
                    if block is not None:
                        yield from pieces(total, block)
                    block, total = own, np.zeros((TURNED_PIECES * unit, width))
                if at != part:
                    part, y = at, _map_rows(f"{folder}/sketch-{at}", width)
                rows, steps = (unpack_numbers(batch.column(c)[i].as_buffer(), n) for c in (4, 5))
                vals = batch.column(6)[i].as_buffer()
                vals = np.frombuffer(vals) if scale is None else unpack_numbers(vals, n).astype(np.float64)
                weighed_sums(np.cumsum(steps), rows + first, vals, y, total)
        if block is not None:
            yield from pieces(total, block)

    # a block may lie in two tasks, where its file was split
    return stored(_summed_pieces(turned.mapInArrow(partial, PIECES)), "lsa-pieces")


def _tiles(cells: DataFrame, basis: _Basis) -> tuple[DataFrame, int]:
    """Stored (lane, _doc, idx, val) with positions inside the block, and slices per block."""
    split = _by_block(cells, basis.size)
    cores = cells.sparkSession.sparkContext.defaultParallelism
    slices = max(cells.count() // (basis.blocks * LANE_CELLS), cores // basis.blocks, 1)
    lane = F.col("block") * slices + F.pmod(F.xxhash64("_doc"), F.lit(slices)).cast("int")
    return stored(split.select(lane.cast("int").alias("lane"), "_doc", "idx", "val"), "lsa-tiles"), slices


def _by_block(cells: DataFrame, size: int) -> DataFrame:
    """(_doc, block, idx, val): one row for each document and block of terms that it touches."""
    inner = F.struct((F.col("idx") % size).cast("int").alias("idx"), "val")
    grouped = cells.groupBy("_doc", F.floor(F.col("idx") / size).cast("int").alias("block")).agg(
        F.sort_array(F.collect_list(inner)).alias("cells")
    )
    return grouped.select(
        "_doc", "block",
        F.transform("cells", lambda c: c["idx"]).alias("idx"),
        F.transform("cells", lambda c: c["val"]).alias("val"),
    )


def _sketch(tiles: DataFrame, slices: int, basis: _Basis) -> DataFrame:
    """(_doc, y): rows of A Q. Each lane receives its block of the basis, then its rows."""
    size, unit, width, whiten = basis.size, basis.unit, basis.width, basis.whiten
    per_block = -(-size // unit)
    block = F.floor(F.col("piece") / per_block).cast("int")
    own = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    pieces = basis.pieces.select(block.alias("block"), "piece", "payload", own.alias("slice")).select(
        (F.col("block") * slices + F.col("slice")).alias("lane"), F.lit(0).alias("kind"),
        F.col("piece").cast("long").alias("id"), "payload",
        F.lit(None).cast("array<int>").alias("idx"), F.lit(None).cast("array<double>").alias("val"),
    )
    rows = tiles.select(
        "lane", F.lit(1).alias("kind"), F.col("_doc").alias("id"),
        F.lit(None).cast("binary").alias("payload"), "idx", "val",
    )

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, q, ready = None, None, False
        for batch in batches:
            for part in _same(batch, 2):
                if part.column(0)[0].as_py() != lane:
                    lane, q, ready = part.column(0)[0].as_py(), np.zeros((per_block * unit, width)), False
                if part.column(1)[0].as_py() == 0:
                    for piece, payload in zip(part.column(2).to_pylist(), part.column(3)):
                        at = piece % per_block * unit
                        q[at : at + unit] = np.frombuffer(payload.as_buffer()).reshape(-1, width)
                    continue
                if not ready:
                    q, ready = q @ whiten, True
                out = np.zeros((part.num_rows, width))
                for at, dense, touched in _chunks(part.column(4), part.column(5)):
                    out[at] = dense @ q[touched]
                yield pa.RecordBatch.from_arrays([part.column(2), _rows_to_list(out)], ["_doc", "y"])

    lanes = basis.blocks * slices
    met = pieces.unionByName(rows).repartitionById(lanes, F.col("lane")).sortWithinPartitions("lane", "kind")
    parts = met.mapInArrow(products, "_doc long, y array<double>")
    total = Summarizer.sum(array_to_vector("y"))
    return parts.groupBy("_doc").agg(vector_to_array(total).alias("y"))


def _lane_products(tiles: DataFrame, slices: int, basis: _Basis) -> DataFrame:
    """Stored pieces of A'A Q by lanes, in one job."""
    size, unit, width = basis.size, basis.unit, basis.width
    per_block = -(-size // unit)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, total = None, None
        for batch in batches:
            for part in _same(batch, 1):
                if part.column(0)[0].as_py() != lane:
                    if lane is not None:
                        yield from _used_pieces(total, unit, lane // slices * per_block)
                    lane, total = part.column(0)[0].as_py(), np.zeros((per_block * unit, width))
                y = _list_to_rows(part.column(3))
                for at, dense, touched in _chunks(part.column(1), part.column(2)):
                    total[touched] += dense.T @ y[at]
        if lane is not None:
            yield from _used_pieces(total, unit, lane // slices * per_block)

    joined = tiles.join(_sketch(tiles, slices, basis), "_doc").select("lane", "idx", "val", "y")
    met = joined.repartitionById(basis.blocks * slices, F.col("lane")).sortWithinPartitions("lane")
    parts = met.mapInArrow(partial, PIECES)
    return stored(_summed_pieces(parts) if slices > 1 else parts, "lsa-pieces")


def _same(batch: pa.RecordBatch, columns: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch where one of its first whole-number columns changes."""
    if batch.num_rows:
        keys = np.stack([batch.column(c).to_numpy() for c in range(columns)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(begin, end - begin)


def _used_pieces(total: np.ndarray, unit: int, first: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a dense part that are not all zero, numbered from `first`."""
    whole = total.reshape(len(total) // unit, -1)
    in_use = np.flatnonzero(whole.any(axis=1))
    for begin in range(0, len(in_use), SENT_PIECES):
        own = in_use[begin : begin + SENT_PIECES]
        yield _payloads(own + first, whole[own])


def _summed_pieces(parts: DataFrame) -> DataFrame:
    """One piece for each number, the sum of its parts."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = None, None
        for batch in batches:
            for piece, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(payload.as_buffer())
                if piece != number:
                    if number is not None:
                        yield _payloads(np.array([number]), total[None])
                    number, total = piece, part.copy()
                else:
                    total += part
        if number is not None:
            yield _payloads(np.array([number]), total[None])

    return parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(summed, PIECES)


def _sketch_gram(docs: DataFrame, shipped, width: int) -> np.ndarray:
    """(AQ)'(AQ) with the basis in one block."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width))
        for batch in batches:
            for _, dense, touched in _chunks(batch.column(0), batch.column(1)):
                sketch = dense @ shipped.value[touched]
                gram += sketch.T @ sketch
        yield _numbered_rows(gram)

    rows = docs.select("idx", "val")
    return _sum_rows(rows.mapInArrow(partial, "i int, v array<double>"))


def _gram(sketch: DataFrame) -> np.ndarray:
    """Y'Y of the array column `y`."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = None
        for batch in batches:
            if batch.num_rows:
                y = _list_to_rows(batch.column(0))
                gram = y.T @ y if gram is None else gram + y.T @ y
        if gram is not None:
            yield _numbered_rows(gram)

    return _sum_rows(sketch.select("y").mapInArrow(partial, "i int, v array<double>"))


def _project(docs: DataFrame, basis, rotation: np.ndarray) -> DataFrame:
    """Rows with their unit vector `lsa`, with the shipped basis in one block."""

    @F.arrow_udf("array<double>")
    def project(idx: pa.Array, val: pa.Array) -> pa.Array:
        out = np.zeros((len(idx), rotation.shape[1]))
        for at, dense, touched in _chunks(idx, val):
            out[at] = dense @ basis.value[touched] @ rotation
        return _rows_to_list(_unit_rows(out))

    kept = [c for c in docs.columns if c not in ("_doc", "idx", "val")]
    return docs.select(*kept, project("idx", "val").alias("lsa"))


def _times(factor: np.ndarray):
    """Column function: array row times a small matrix, scaled to length one."""

    @F.arrow_udf("array<double>")
    def product(rows: pa.Array) -> pa.Array:
        return _rows_to_list(_unit_rows(_list_to_rows(rows) @ factor))

    return product


def _payloads(piece: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    payload = pa.array([row.tobytes() for row in values], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), payload], ["piece", "payload"])


def _chunks(idx: pa.Array, val: pa.Array):
    """Split a batch of sparse rows into runs of about CHUNK_NONZEROS entries.

    A run is short enough that its rows, restricted to the terms they touch, make a small dense
    matrix. Yields (positions of the rows, that matrix, touched terms); empty rows are left out.
    """
    sizes = idx.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = np.flatnonzero(sizes)
    sizes = sizes[filled]
    ends = np.cumsum(sizes)
    terms = idx.flatten().to_numpy(zero_copy_only=False)
    weights = val.flatten().to_numpy(zero_copy_only=False)
    begin = first = 0
    while begin < len(filled):
        stop = max(int(np.searchsorted(ends, first + CHUNK_NONZEROS, side="right")), begin + 1)
        last = int(ends[stop - 1])
        touched, column = np.unique(terms[first:last], return_inverse=True)
        dense = np.zeros((stop - begin, len(touched)))
        dense[np.repeat(np.arange(stop - begin), sizes[begin:stop]), column] = weights[first:last]
        yield filled[begin:stop], dense, touched
        begin, first = stop, last


# ----------------------------------------------------------------------- small parts


def _whitener(gram: np.ndarray) -> np.ndarray:
    """W with (XW)'(XW) = I for X'X = gram; directions without weight become zero."""
    values, directions = np.linalg.eigh(gram)
    strong = values > values[-1] * 1e-14
    return directions * np.where(strong, 1.0 / np.sqrt(np.where(strong, values, 1.0)), 0.0)


def _rotation(gram: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    values, directions = np.linalg.eigh(gram)
    top = np.argsort(values)[::-1][: min(components, len(values))]
    return directions[:, top], np.sqrt(np.maximum(values[top], 0.0))


def _numbered_rows(square: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"i": pa.array(range(len(square)), pa.int32()), "v": _rows_to_list(square)}
    )


def _sum_rows(numbered: DataFrame) -> np.ndarray:
    """Add up the small square matrices that the tasks emit as numbered rows."""
    total = Summarizer.sum(array_to_vector("v"))
    rows = numbered.groupBy("i").agg(vector_to_array(total).alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in rows])


def _list_to_rows(rows: pa.Array) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _rows_to_list(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1.0, norm)


def covariance(df: DataFrame, column: str) -> DataFrame:
    """(i, j, value): covariance of the entries of an array column, divisor n - 1, in one pass.

    Tasks add up products of differences to the first row, so that large means cost no digits; rows
    without a vector are left out, all others have the length of the first. None below two rows.
    """
    points = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("x"))
    first = points.first()
    if first is None:
        return df.sparkSession.createDataFrame([], "i int, j int, value double")
    start = np.array(first["x"])
    width = len(start)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            x = np.ones((batch.num_rows, width + 1))
            if batch.num_rows:
                x[:, :-1] = _list_to_rows(batch.column(0)) - start
            total += x.T @ x
        yield _numbered_rows(total)

    total = _sum_rows(points.mapInArrow(partial, "i int, v array<double>"))
    n = total[-1, -1]
    if n < 2:
        return df.sparkSession.createDataFrame([], "i int, j int, value double")
    value = (total[:-1, :-1] - np.outer(total[-1, :-1], total[-1, :-1]) / n) / (n - 1)
    i, j = np.indices(value.shape)
    cells = pa.table({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "value": value.ravel()})
    return df.sparkSession.createDataFrame(cells)


def principal_components(df: DataFrame, column: str, k: int, output: str = "pca") -> DataFrame:
    """Project array column `column` on its `k` first principal components."""
    from pyspark.ml.feature import PCA

    model = PCA(k=k, inputCol="_features", outputCol="_pca")
    featured = df.withColumn("_features", array_to_vector(column))
    return (
        model.fit(featured)
        .transform(featured)
        .withColumn(output, vector_to_array("_pca"))
        .drop("_features", "_pca")
    )


def unit_principal_components(df: DataFrame, column: str, k: int) -> DataFrame:
    """Principal components scaled to unit rows."""
    return principal_components(df, column, k).withColumn("pca", vectors.unit(F.col("pca")))


def flat_map(df: DataFrame, column: str) -> DataFrame:
    """Two-dimensional map: replace `column` by the coordinates `x` and `y`."""
    return (
        principal_components(df, column, 2, "_xy")
        .withColumn("x", F.get("_xy", F.lit(0)))
        .withColumn("y", F.get("_xy", F.lit(1)))
        .drop(column, "_xy")
    )
