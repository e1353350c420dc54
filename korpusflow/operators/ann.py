"""Nearest neighbours over compressed vectors: cells that grow with the table, residual codes that are scanned in place of
vectors, a bound that says which cells and rows are looked at, and exact scores of those.

A vector of unit length is its cell's centre, plus the nearest codeword of each stretch of the residual, plus an error of
which the length is stored. So a query's cosine with a row is known from the codes up to that error: it is their estimate,
plus the query's product with the error vector, which for a query that knows nothing of the error has a deviation of
length / sqrt(dimensions). A search first takes, by estimate, `limit` rows of the nearest cells and scores them exactly;
the least of these scores is a floor that every neighbour must reach. A cell is looked at only if its centre's product with
the query and its radius reach the floor (an exact bound), and a row of it is scored only if its estimate and `margin`
deviations do. So what is scored follows from the data and not from a cap; with a margin of 3 about one neighbour in a
thousand is missed.

Rows of one cell are dealt to parts of bounded size, queries to blocks; a task meets one part with one block. Of rows with
the same vector only the `limit` smallest ids can be among the first `limit`, so a task scores no more copies than that.
Cases: rows and queries without a vector (null, empty or of length 0) are left out; an empty table finds nothing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusflow.functions.vectors import norm
from korpusflow.operators.search import rank_hits, unit_rows

#: Rows that the model is fitted on, those whose id's hash is least, and how many a cell needs of them. Dimensions of a
#: stretch and codewords for it. Rows of a part and queries of a block. Rounds of k-means.
FIT_ROWS, FIT_PER_CELL, STRETCH, CODEWORDS, PART_ROWS, BLOCK_QUERIES, ROUNDS = 20_000, 40, 4, 256, 8192, 2048, 12
MOST_CELLS, MARGIN, DIGITS = 4096, 3.0, 6
#: Numbers that a product holds at most, however many rows, cells or queries meet in a task.
SLICE_VALUES = 1 << 20


class Model(NamedTuple):
    centres: np.ndarray  # cells x dimensions
    stretches: list[np.ndarray]  # places of the dimensions of each stretch
    codebooks: list[np.ndarray]  # codewords x stretch

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes and lengths of the errors of unit vectors."""
        cell = nearest(x, self.centres)
        rest = x - self.centres[cell]
        codes = np.stack([nearest(rest[:, d], book) for d, book in zip(self.stretches, self.codebooks)], axis=1).astype(np.uint8)
        for s, (d, book) in enumerate(zip(self.stretches, self.codebooks)):
            rest[:, d] -= book[codes[:, s]]
        return cell, codes, np.linalg.norm(rest, axis=1)

    def estimates(self, queries: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The products of queries with rows by their codes."""
        out = (queries @ self.centres.T)[:, cells]
        for s, (d, book) in enumerate(zip(self.stretches, self.codebooks)):
            out += (queries[:, d] @ book.T)[:, codes[:, s]]
        return out


class Index(NamedTuple):
    """rows: cell, part, chunk_id, codes, error, copy (hash of the vector), vec; cells: cell, radius, parts, n."""

    model: Model
    rows: DataFrame
    cells: DataFrame


def slices(n: int, width: int) -> list[slice]:
    """n rows of `width` numbers, cut so that SLICE_VALUES numbers or one row are held at once."""
    step = max(1, SLICE_VALUES // max(1, width))
    return [slice(a, min(n, a + step)) for a in range(0, n, step)]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres * centres).sum(1)
    return np.concatenate([np.argmin(square - 2 * x[s] @ centres.T, axis=1) for s in slices(len(x), len(centres))] or [np.zeros(0, np.int64)])


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres by Lloyd's rounds; one that loses its rows takes the place of a random row."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        mine = nearest(x, centres)
        n = np.bincount(mine, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, mine, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def unit_vectors(vectors: DataFrame, name: str) -> DataFrame:
    return unit_rows(vectors.filter(norm(F.col("vec")) > 0), name)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def fit(unit: DataFrame, n: int, seed: int = 11) -> Model:
    """Cells (half the root of the number of rows) and codebooks, fitted on a bounded sample."""
    cells = int(min(MOST_CELLS, max(1, round(n**0.5 / 2))))
    sample = unit.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(max(FIT_ROWS, FIT_PER_CELL * cells)).select("vec").toArrow()
    x, rng = matrix(sample["vec"]), np.random.default_rng(seed)
    if not len(x):
        return Model(np.zeros((1, 0)), [], [])
    centres = k_means(x, min(cells, len(x)), rng)
    rest = x - centres[nearest(x, centres)]
    stretches = np.array_split(np.arange(x.shape[1]), max(1, x.shape[1] // STRETCH))
    return Model(centres, stretches, [k_means(rest[:, d], min(CODEWORDS, max(1, len(x) // 2)), rng) for d in stretches])


def build_index(vectors: DataFrame) -> Index:
    """The index of (chunk_id, vec): the model is fitted on a sample, every row is encoded."""
    unit = unit_vectors(vectors, "chunk_id")
    model = fit(unit, unit.count())
    kind = unit.schema["chunk_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                cell, codes, error = model.encode(x)
                codes = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0), codes, pa.array(error), batch.column(1)], ["cell", "chunk_id", "codes", "error", "vec"])

    coded = unit.mapInArrow(run, f"cell int, chunk_id {kind}, codes binary, error double, vec array<double>")
    centres = unit.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.centres)], "cell int, centre array<double>")
    apart = F.aggregate(F.zip_with("vec", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    cells = coded.join(F.broadcast(centres), "cell").groupBy("cell").agg(F.sqrt(F.max(apart)).alias("radius"), F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
    dealt = coded.join(F.broadcast(cells.select("cell", "parts")), "cell")  # a row a cell, MOST_CELLS at most
    rows = dealt.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).withColumn("copy", F.xxhash64("vec"))
    return Index(model, rows.select("cell", "part", "chunk_id", "codes", "error", "copy", "vec"), cells)


def write_index(index: Index, path: str) -> None:
    """The index as tables, sorted by cell within files, so that a search reads the row groups of its cells."""
    spark = index.rows.sparkSession
    index.rows.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.mode("errorifexists").parquet(f"{path}/rows")
    index.cells.write.mode("errorifexists").parquet(f"{path}/cells")
    m = index.model
    parts = [("centre", i, -1, [float(v) for v in c]) for i, c in enumerate(m.centres)]
    parts += [("codeword", i, s, [float(v) for v in c]) for s, book in enumerate(m.codebooks) for i, c in enumerate(book)]
    spark.createDataFrame(parts, "kind string, no int, stretch int, value array<double>").write.mode("errorifexists").parquet(f"{path}/model")


def read_index(spark: SparkSession, path: str) -> Index:
    found = spark.read.parquet(f"{path}/model").orderBy("kind", "stretch", "no").collect()  # as many rows as the model has
    centres = np.array([r.value for r in found if r.kind == "centre"], float)
    books: dict[int, list] = {}
    for r in found:
        if r.kind == "codeword":
            books.setdefault(r.stretch, []).append(r.value)
    stretches = np.array_split(np.arange(centres.shape[1]), len(books)) if books else []
    model = Model(centres, stretches, [np.array(books[s], float) for s in sorted(books)])
    return Index(model, spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"))


def first_of_copies(ids: np.ndarray, copies: np.ndarray, limit: int) -> np.ndarray:
    """Places of the rows that are among the `limit` smallest ids of their vector's copies."""
    order = np.lexsort((ids, copies))
    begins = np.flatnonzero(np.concatenate([[True], np.diff(copies[order]) != 0]))
    number = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return np.sort(order[number < limit])


def meet(asked: DataFrame, index: Index, blocks: int, run, schema: str) -> DataFrame:
    """run(queries, rows) for each part of a cell and each block of queries (query_id, vec, floor, cell) that look at it."""
    rows = index.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else index.rows.withColumn("block", F.lit(0))
    dealt = asked.join(F.broadcast(index.cells.select("cell", "parts")), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).select("cell", "part", "block", "query_id", "vec", "floor")
    keys = ("cell", "part", "block")
    return dealt.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, schema)


def ann_search(queries: DataFrame, index: Index, limit: int = 10, margin: float = MARGIN) -> tuple[DataFrame, DataFrame]:
    """query_id, chunk_id, score, rank of (query_id, vec), and query_id, scored: how many rows each query scored."""
    model, spark = index.model, queries.sparkSession
    asked = unit_vectors(queries, "query_id")
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    q_kind, kind = asked.schema["query_id"].dataType.simpleString(), index.rows.schema["chunk_id"].dataType.simpleString()
    schema = f"query_id {q_kind}, chunk_id {kind}, score double, scored long"
    deviation = margin / max(1, model.centres.shape[1]) ** 0.5
    radii = {r.cell: r.radius for r in index.cells.collect()}  # a row a cell
    radius = np.array([radii.get(c, -np.inf) for c in range(len(model.centres))])
    sizes = {r.cell: r.n for r in index.cells.collect()}
    size = np.array([sizes.get(c, 0) for c in range(len(model.centres))])

    def probes(first: bool):
        """The cells that a query looks at: at first the nearest that hold enough rows, an eighth of all at least; then
        all that can reach its floor."""

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, floor = matrix(batch.column(1)), np.asarray(batch.column(2))
                for s in slices(len(x), max(len(size), x.shape[1] * len(size) // 8)):  # a query's vector goes out with each of its cells
                    near = x[s] @ model.centres.T
                    if first:
                        order = np.argsort(-near, axis=1)
                        before = np.cumsum(size[order], axis=1) - size[order]
                        wanted = (before < 4 * limit) | (np.arange(len(size)) < len(size) / 8)
                        chosen = np.zeros_like(wanted)
                        np.put_along_axis(chosen, order, wanted, axis=1)
                    else:
                        chosen = near + radius + 1e-6 >= floor[s, None]
                    q, cell = np.nonzero(chosen & (size > 0))
                    yield pa.RecordBatch.from_arrays([c.take(pa.array(q + s.start)) for c in batch.columns] + [pa.array(cell, pa.int32())], ["query_id", "vec", "floor", "cell"])

        return run

    def opened(left: pa.Table, right: pa.Table):
        x, floor = matrix(left["vec"]), left["floor"].to_numpy()
        codes = np.frombuffer(b"".join(right["codes"].to_pylist()), np.uint8).reshape(right.num_rows, -1)
        cells = right["cell"].to_numpy()
        return x, floor, ((s, model.estimates(x[s], cells, codes)) for s in slices(len(x), max(len(codes), len(model.centres))))

    def result(left, right, q, row, score, scored):
        return pa.table([left["query_id"].take(pa.array(q)), right["chunk_id"].take(pa.array(row)), pa.array(score, pa.float64()), pa.array(scored, pa.int64())], ["query_id", "chunk_id", "score", "scored"])

    def empty(left, right):
        return result(left, right, np.zeros(0, int), np.zeros(0, int), [], [])

    def by_estimate(left, right):
        if not left.num_rows or not right.num_rows:
            return empty(left, right)
        found = []
        for s, estimate in opened(left, right)[2]:
            top = np.argsort(-estimate, axis=1, kind="stable")[:, :limit]
            found.append((np.repeat(np.arange(s.start, s.stop), top.shape[1]), top.ravel(), np.take_along_axis(estimate, top, 1).ravel()))
        q, row, score = (np.concatenate([f[k] for f in found]) for k in range(3))
        return result(left, right, q, row, score, np.zeros(len(q)))

    def exactly(left, right):
        if not left.num_rows or not right.num_rows:
            return empty(left, right)
        x, floor, estimates = opened(left, right)
        error = right["error"].to_numpy() * deviation
        ids, copies, rows = right["chunk_id"].to_numpy(zero_copy_only=False), right["copy"].to_numpy(), matrix(right["vec"])
        found: list[tuple] = []
        for s, estimate in estimates:
            reach = estimate + error >= floor[s, None] - 10.0**-DIGITS
            for q in range(s.start, s.stop):
                near = np.flatnonzero(reach[q - s.start])
                if len(near):
                    near = near[first_of_copies(ids[near], copies[near], limit)]
                    score = np.round(rows[near] @ x[q], DIGITS) + 0.0
                    best = np.lexsort((ids[near], -score))[:limit]
                    found.append((np.full(len(best), q), near[best], score[best], np.where(np.arange(len(best)) == 0, len(near), 0)))
        return result(left, right, *(np.concatenate([f[k] for f in found]) for k in range(4))) if found else empty(left, right)

    none = asked.withColumn("floor", F.lit(-2.0))
    probed = f"query_id {q_kind}, vec array<double>, floor double, cell int"
    guessed = rank_hits(meet(none.mapInArrow(probes(True), probed), index, blocks, by_estimate, schema).drop("scored"), limit)
    known = guessed.select("query_id", "chunk_id").join(index.rows.select("chunk_id", F.col("vec").alias("row")), "chunk_id").join(asked, "query_id")
    product = F.aggregate(F.zip_with("row", "vec", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    floors = known.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= limit, F.min(product)).otherwise(-2.0).alias("floor"))
    floored = asked.join(floors, "query_id", "left").select("query_id", "vec", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    found = meet(floored.mapInArrow(probes(False), probed), index, blocks, exactly, schema)
    counts = found.groupBy("query_id").agg((F.sum("scored") + limit).alias("scored"))
    return rank_hits(found.drop("scored"), limit), counts


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, wanted, hits, recall of the exact result's rows."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    total = both.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("hits"))
    return total.withColumn("recall", F.col("hits") / F.col("wanted"))
