"""Embeddings whitened along their largest principal components, fitted on exact integers.

An entry c counts as x = floor(256 c). Each different x vector is fitted once: its products are added up exactly (as
digits of 15 bits, so that doubles multiply them without rounding), tasks first, then Spark. Of the integer
scatter n * sum(x x') - S S' the characteristic polynomial is found modulo primes, one batch of primes a
task, and its roots and their null vectors by ``exact_spectrum``. Only numbers of the dimension's size reach the driver.

Two passes over the rows (fit, result) and one over the different vectors, which are written in 1 to 8
bytes an entry; equal vectors meet in Spark's distinct, combined before the shuffle.

Defined cases: rows whose vector is missing or holds missing or non-finite entries go; rows with an empty vector
go, as they have no component. Vectors of different lengths are fitted apart, each length on its own. Entries beyond
64 bits take the largest 64-bit number of their sign. There are as many components as entries, up to the number
asked; a component without variance has no whitened value and explains 0 (nothing, where no component
varies). ``deviation`` is missing where it exceeds a long. Rows without an id and repeated rows are all answered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import map_batches, map_partitions, materialize, quoted
from billspark.llm.exact_spectrum import RealRoots, chinese_remainders, common_divisor, enough_primes, null_vectors, polynomials_modulo

#: Bits of a digit in exact products, and of the parts in which tasks hand in their sums.
DIGIT, PART = 15, 30
#: Numbers that the primes of one batch may hold.
HELD = 2_000_000


@dataclass
class Model:
    """Fit of one length of vectors."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # a component a row; none for components without variance
    values: list[float]  # eigenvalues of the covariance
    explained: list[float | None]  # of every component
    identity_error: float | None = None


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length above 0: which rows of a list column are finite throughout, and their entries."""
    kept = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.take(pa.array(kept))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # missing entries are NaN
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        block = flat[starts[rows][:, None] + np.arange(size)]
        fine = np.isfinite(block).all(1)
        if fine.any():
            yield kept[rows[fine]], block[fine]


def whole_numbers(block: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        floor = np.floor(256 * block)
    inside = np.abs(floor) < 2.0**63
    edge = np.where(floor > 0, np.iinfo(np.int64).max, np.iinfo(np.int64).min)
    return np.where(inside, np.where(inside, floor, 0).astype(np.int64), edge)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes an entry that hold it, their number first; equal rows have equal bytes."""
    far = np.maximum(x.max(1), -(x.min(1) + 1))
    widths = np.select([far < 1 << 7, far < 1 << 15, far < 1 << 31], [1, 2, 4], 8).tolist()
    return [bytes([w]) + row.astype(f"<i{w}").tobytes() for w, row in zip(widths, x)]


def unpacked(column: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of packed rows of one length and width."""
    groups: dict[tuple[int, int], list[bytes]] = {}
    for row in column.to_pylist():
        groups.setdefault((row[0], len(row)), []).append(row[1:])
    for (width, _), rows in groups.items():
        yield np.frombuffer(b"".join(rows), f"<i{width}").reshape(len(rows), -1).astype(np.int64)


def digits(x: np.ndarray) -> list[np.ndarray]:
    """Signed digits of base 2^DIGIT, the lowest first, as doubles."""
    out, half = [], 1 << (DIGIT - 1)
    while x.any() or not out:
        low = ((x + half) & ((1 << DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        x = (x >> DIGIT) + ((x & ((1 << DIGIT) - 1)) >= half)
    return out


def exact_products(rows: DataFrame) -> DataFrame:
    """``size, i, j, part, value``: exact sums of products of entries i <= j by parts; entry ``size`` is the constant 1."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        held: dict[int, dict[int, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                for x in unpacked(batch.column(0).slice(at, 1_000)):
                    size = x.shape[1]
                    parts = digits(np.column_stack([x, np.ones(len(x), np.int64)]))
                    levels = held.setdefault(size, {})
                    for a, left in enumerate(parts):
                        for b, right in enumerate(parts):
                            levels[a + b] = levels.get(a + b, 0) + (left.T @ right).astype(np.int64)
        for size, levels in held.items():
            i, j = np.triu_indices(size + 1)
            total = sum(level[i, j].astype(object) << (DIGIT * k) for k, level in levels.items())
            part = 0
            while total.any():
                yield [[size] * len(i), i, j, [part] * len(i), (total & ((1 << PART) - 1)).astype(np.int64)]
                total, part = total >> PART, part + 1
                if ((total == 0) | (total == -1)).all():  # what is left is a sign
                    yield [[size] * len(i), i, j, [part] * len(i), total.astype(np.int64)]
                    break

    schema = "size int, i int, j int, part int, value long"
    return map_partitions(rows, ["x"], add, schema).groupBy("size", "i", "j", "part").agg(F.sum("value").alias("value"))


def characteristic_polynomial(spark, scatter: np.ndarray) -> list[int]:
    """Exact coefficients, the constant first; each task takes a few primes."""
    size = len(scatter)
    primes = enough_primes(size, int(np.trace(scatter)))
    together = max(1, min(64, HELD // (2 * size * size)))
    batches = [(i, primes[i : i + together]) for i in range(0, len(primes), together)]
    shared = spark.sparkContext.broadcast(scatter)

    def residues(batch: pa.RecordBatch) -> list:
        found, names = [], []
        for chosen in batch.column(1).to_pylist():
            found += polynomials_modulo(shared.value, chosen).tolist()
            names += chosen
        return [names, found]

    todo = spark.createDataFrame(batches, "batch int, primes array<long>").repartition(len(batches), "batch")
    rows = map_batches(todo, ["batch", "primes"], residues, "prime long, coefficients array<long>").collect()
    shared.destroy()
    return chinese_remainders(np.array([r.coefficients for r in rows]), [r.prime for r in rows])


def fit(spark, n: int, sums: list[int], products: np.ndarray, components: int) -> Model:
    size = len(sums)
    scatter = n * products - np.multiply.outer(np.array(sums, object), np.array(sums, object))
    trace, wanted = int(np.trace(scatter)), min(components, size)
    if not trace:
        return Model(n, sums, np.zeros((0, size)), [], [None] * wanted)
    divisor = common_divisor(scatter)
    scatter = scatter // divisor
    vectors: list[np.ndarray] = []
    values, explained = [], []
    for root in RealRoots(characteristic_polynomial(spark, scatter)).largest(wanted):
        (top, scale), times = root.middle, min(root.times, wanted - len(vectors))
        vectors += null_vectors(scatter, root)[:times]
        values += [top * divisor / (n * n << scale)] * times
        explained += [top * divisor / (trace << scale)] * times
    return Model(n, sums, np.array(vectors), values, explained + [0.0] * (wanted - len(values)))


def projected(model: Model, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """Whitened values (a column a component with variance) and the exact squared deviations."""
    most = max(int(x.max()), -int(x.min())) * model.n + max(map(abs, model.sums))
    if most * most * x.shape[1] < 2**63:
        apart = model.n * x - np.array(model.sums, np.int64)
        squares: list[int | None] = (apart * apart).sum(1).tolist()
    else:
        apart = model.n * x.astype(object) - np.array(model.sums, object)
        squares = [s if s < 2**63 else None for s in (apart * apart).sum(1).tolist()]
    centred = apart.astype(np.float64) / model.n
    return centred @ model.vectors.T / np.sqrt(model.values), squares


def identity_errors(spark, rows: DataFrame, models: dict[int, Model]) -> None:
    """Measures the covariance of the whitened fit list."""
    shared = spark.sparkContext.broadcast(models)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                for x in unpacked(batch.column(0).slice(at, 1_000)):
                    white = projected(shared.value[x.shape[1]], x)[0]
                    white = np.column_stack([white, np.ones(len(white))])
                    held[x.shape[1]] = held.get(x.shape[1], 0.0) + white.T @ white
        for size, total in held.items():
            i, j = np.triu_indices(len(total))
            yield [[size] * len(i), i, j, total[i, j]]

    parts = map_partitions(rows, ["x"], add, "size int, i int, j int, value double")
    sums: dict[int, dict[tuple[int, int], float]] = {}
    for row in parts.groupBy("size", "i", "j").agg(F.sum("value").alias("value")).toLocalIterator():
        sums.setdefault(row["size"], {})[row.i, row.j] = row["value"]
    shared.destroy()
    for size, model in models.items():
        last, n = len(model.values), model.n
        if last:
            mean = [sums[size][i, last] / n for i in range(last)]
            model.identity_error = max(
                abs(sums[size][i, j] / n - mean[i] * mean[j] - (i == j)) for i in range(last) for j in range(i, last)
            )


def whiten(df: DataFrame, components: int = 4, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every row and component."""
    spark = df.sparkSession
    rows = df.select(quoted(id_column).cast("long").alias("vec_id"), quoted(vector_column).alias("vector"))

    def pack(batch: pa.RecordBatch) -> list:
        return [[row for _, block in by_size(batch.column(0)) for row in packed(whole_numbers(block))]]

    fitted = materialize(map_batches(rows, ["vector"], pack, "x binary").distinct(), "fit-list")
    totals: dict[int, dict[tuple[int, int], int]] = {}
    for row in exact_products(fitted).toLocalIterator():
        own = totals.setdefault(row["size"], {})
        own[row.i, row.j] = own.get((row.i, row.j), 0) + (row["value"] << (PART * row.part))
    models = {}
    for size, sums in totals.items():
        products = np.array([[sums.get((min(i, j), max(i, j)), 0) for j in range(size)] for i in range(size)], object)
        models[size] = fit(spark, sums[size, size], [sums.get((i, size), 0) for i in range(size)], products, components)
    identity_errors(spark, fitted, models)
    shared = spark.sparkContext.broadcast(models)

    def answer(batch: pa.RecordBatch) -> list:
        out: list[list] = [[] for _ in range(7)]
        ids = batch.column(0).to_pylist()
        for places, block in by_size(batch.column(1)):
            model = shared.value[block.shape[1]]
            white, squares = projected(model, whole_numbers(block))
            number = len(model.explained)
            values = [[*row, *[None] * (number - len(row))] for row in white.tolist()]
            out[0] += [ids[i] for i in places for _ in range(number)]
            out[1] += list(range(1, number + 1)) * len(places)
            out[2] += [model.n] * (number * len(places))
            out[3] += [s for s in squares for _ in range(number)]
            out[4] += [v for row in values for v in row]
            out[5] += model.explained * len(places)
            out[6] += [model.identity_error] * (number * len(places))
        return out

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return map_batches(rows, ["vec_id", "vector"], answer, schema)
