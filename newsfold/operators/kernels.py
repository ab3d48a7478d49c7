"""Kernel features by landmarks, so that a linear SVM can stand in for a kernel SVM.

The exact kernel solver compares all pairs of rows. Here each row is compared
with m landmark rows only (Nystroem map, Williams and Seeger 2001), which is an
approximation that grows linearly with the rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsfold import fixed_values as V
from newsfold.operators.rows import sample_n

# Most numbers in one intermediate block of a task.
BLOCK_NUMBERS = 4_000_000
MAX_LANDMARKS = 2_000
# Most numbers in the landmark matrix that is sent to every executor (160 MB).
MAX_SHARED_NUMBERS = 20_000_000


@dataclass(frozen=True)
class Kernel:
    """A kernel and its parameters: x.z, (g x.z)^d, exp(-g |x-z|^2) or tanh(g x.z)."""

    name: str
    gamma: float = 1.0
    degree: int = 3

    def __call__(self, dots: np.ndarray, left_squares: np.ndarray, right_squares: np.ndarray) -> np.ndarray:
        if self.name == "linear":
            return dots
        if self.name == "poly":
            return (self.gamma * dots) ** self.degree
        if self.name == "rbf":
            return np.exp(-self.gamma * (left_squares[:, None] + right_squares[None, :] - 2 * dots))
        if self.name == "sigmoid":
            return np.tanh(self.gamma * dots)
        raise ValueError(f"unknown kernel {self.name}")


def scale_gamma(df: DataFrame, features: str = "features") -> float:
    """1 / (number of features x variance of all matrix cells), from sums of the stored numbers of each vector."""
    vector = F.unwrap_udt(features)
    values, zero = vector["values"], F.lit(0.0)
    row = df.select(
        F.coalesce(vector["size"], F.size(values)).cast("double").alias("width"),  # dense vectors store no size
        F.aggregate(values, zero, lambda a, x: a + x).alias("total"),
        F.aggregate(values, zero, lambda a, x: a + x * x).alias("squares"),
    ).agg(F.nullif(F.count(F.lit(1)), F.lit(0)).alias("n"), F.max("width").alias("width"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).first()
    if row["n"] is None:
        raise ValueError("no rows")
    cells = row["n"] * row["width"]
    variance = row["squares"] / cells - (row["total"] / cells) ** 2
    return 1.0 / (row["width"] * variance) if variance > 0 else 1.0


def _widths(column: pa.Array) -> np.ndarray:
    """Vector sizes of a batch; dense vectors store no size."""
    if isinstance(column, pa.ExtensionArray):
        column = column.storage
    sizes = column.field("size").to_numpy(zero_copy_only=False)
    lengths = np.diff(column.field("values").offsets.to_numpy())
    return np.where(np.isnan(sizes.astype(float)), lengths, sizes).astype(int)


def _storage_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, indices and values of a batch of ML vectors in their Arrow storage."""
    if isinstance(column, pa.ExtensionArray):
        column = column.storage
    kinds = column.field("type").to_numpy(zero_copy_only=False)
    values, indices = column.field("values"), column.field("indices")
    flat = values.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(values.offsets.to_numpy()) if len(values) else np.zeros(0, int)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    if (kinds == 0).all():
        return offsets, indices.flatten().to_numpy(zero_copy_only=False), flat
    picked = [
        np.asarray(indices[i].as_py()) if kinds[i] == 0 else np.arange(lengths[i]) for i in range(len(kinds))
    ]
    return offsets, np.concatenate(picked).astype(int), flat


@dataclass(frozen=True)
class LandmarkTerms:
    """The terms of m landmarks: those of many landmarks as rows of a matrix, the others with a list of their landmarks.

    A product over a matrix row costs m steps, of which few count if the term is in few landmarks, as most are.
    """

    m: int
    common: np.ndarray  # matrix of the common terms
    column: np.ndarray  # row of a term in it, or -1
    first: np.ndarray  # where the list of a term begins, and where it ends
    landmark: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, matrix: np.ndarray) -> "LandmarkTerms":
        """From a matrix (terms, landmarks). A term in n of m landmarks is in about n / m of the rows, with n steps each."""
        terms, m = matrix.shape
        n_landmarks = np.count_nonzero(matrix, axis=1)
        is_common = n_landmarks**2 > 4 * m
        column = np.where(is_common, np.cumsum(is_common) - 1, -1)
        term, landmark = np.nonzero(np.where(is_common[:, None], 0, matrix))
        first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms))]).astype(int)
        return cls(m, matrix[is_common], column, first, landmark, matrix[term, landmark])

    def products(self, rows: np.ndarray, place: np.ndarray, values: np.ndarray, n_rows: int) -> np.ndarray:
        """Dot products of all rows with all landmarks, from the rows' cells in row order."""
        dots = np.zeros((n_rows, self.m))
        flat = dots.reshape(-1)
        column = self.column[place]
        is_common = column >= 0
        row, column, value = rows[is_common], column[is_common], values[is_common]
        step = max(1, BLOCK_NUMBERS // max(1, len(self.common)))
        for start in range(0, n_rows, step):
            stop = min(start + step, n_rows)
            part = slice(*np.searchsorted(row, [start, stop]))
            cells = np.zeros((stop - start, len(self.common)))
            cells[row[part] - start, column[part]] = value[part]
            dots[start:stop] = cells @ self.common
        lengths = self.first[place + 1] - self.first[place]
        listed = lengths > 0
        row, place, value, lengths = rows[listed], place[listed], values[listed], lengths[listed]
        step = max(1, BLOCK_NUMBERS // max(1, lengths.max(initial=0)))
        for start in range(0, len(row), step):
            part = slice(start, start + step)
            n = lengths[part]
            entry = np.arange(n.sum()) + np.repeat(self.first[place[part]] - np.cumsum(n) + n, n)
            low, high = row[part][0], row[part][-1] + 1
            cell = np.repeat((row[part] - low) * self.m, n) + self.landmark[entry]
            flat[low * self.m : high * self.m] += np.bincount(
                cell, np.repeat(value[part], n) * self.weight[entry], (high - low) * self.m
            )
        return dots


def kernel_features(
    df: DataFrame,
    landmarks: DataFrame,
    kernel: Kernel,
    features: str = "features",
    out: str = "kernel_features",
) -> DataFrame:
    """Add ``out``: K(x, landmarks) times the inverse root of K(landmarks, landmarks).

    Landmarks are few (see ``pick_landmarks``) and travel to the tasks as one
    matrix over the terms they contain. Directions with a negative or vanishing
    eigenvalue, which the sigmoid kernel can have, are left out.
    """
    vectors = [r[0] for r in landmarks.select(features).limit(MAX_LANDMARKS + 1).collect()]
    if not 0 < len(vectors) <= MAX_LANDMARKS:
        raise ValueError(f"need 1 to {MAX_LANDMARKS} landmarks")
    width, m = vectors[0].size, len(vectors)
    cells = [(v.indices, v.values) if hasattr(v, "indices") else (np.arange(width), v.toArray()) for v in vectors]
    used = np.unique(np.concatenate([i for i, _ in cells]))
    if (len(used) + 1) * m > MAX_SHARED_NUMBERS:
        raise ValueError(f"{m} landmarks over {len(used)} terms are too many to send to all tasks; take fewer")
    matrix = np.zeros((len(used), m))
    for column, (indices, values) in enumerate(cells):
        matrix[np.searchsorted(used, indices), column] = values
    squares = (matrix**2).sum(axis=0)
    eigenvalues, eigenvectors = np.linalg.eigh(kernel(matrix.T @ matrix, squares, squares))
    kept = eigenvalues > max(eigenvalues.max(), 0) * 1e-10
    root = (eigenvectors[:, kept] / np.sqrt(eigenvalues[kept])) @ eigenvectors[:, kept].T
    shared = df.sparkSession.sparkContext.broadcast((used, LandmarkTerms.of(matrix), squares, root, kernel))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, table, squares, root, kernel = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            offsets, indices, values = _storage_arrays(batch.column("_vector"))
            place = np.minimum(np.searchsorted(used, indices), max(len(used) - 1, 0))
            known = used[place] == indices if len(used) else np.zeros(len(indices), bool)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            row_squares = np.bincount(rows, values**2, batch.num_rows)
            dots = table.products(rows[known], place[known], values[known], batch.num_rows)
            mapped = kernel(dots, row_squares, squares) @ root
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, mapped.size + 1, m), pa.int32()), pa.array(mapped.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], lists], schema=pa.schema(
                    [*[batch.schema.field(c) for c in others], pa.field("_mapped", pa.list_(pa.float64()))]
                )
            )

    others = [c for c in df.columns if c != features]
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField("_mapped", T.ArrayType(T.DoubleType()))])
    mapped = df.select(*others, F.col(features).alias("_vector")).mapInArrow(score, schema)
    return mapped.withColumn(out, array_to_vector("_mapped")).drop("_mapped")


def pick_landmarks(df: DataFrame, m: int, key: str, seed: int = V.SEED) -> DataFrame:
    """m rows by hash order."""
    if m > MAX_LANDMARKS:
        raise ValueError(f"at most {MAX_LANDMARKS} landmarks")
    return sample_n(df.select(key, "features"), m, key, seed)
