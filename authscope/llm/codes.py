"""Vector codes: product quantisation in integers, with exact distances.

Components become integers, so every sum, distance and mean is exact and the codes do not
depend on how the rows are dealt out. Dot products run in float64 BLAS on limbs of the
integers that are so narrow that no product or sum reaches 2**53.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authscope.session import cut_lineage

SCALE = 1024
SLICE = 1 << 20  # distances held at a time


def limbs(values: np.ndarray, width: int) -> list[np.ndarray]:
    """Signed integers as float64 limbs, least first: ``sum(limb << (width * i))`` gives them back.

    All limbs but the last are below ``2**width``, the last is the signed rest. There are as
    many as the largest value needs.
    """
    out = []
    while True:
        if not values.size or max(-int(values.min()), int(values.max())) < 1 << width:
            return [*out, values.astype(np.float64)]
        out.append((values & ((1 << width) - 1)).astype(np.float64))
        values = values >> width


def exact_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact where the result fits 64 bits.

    Two limbs of ``width`` bits, multiplied and summed over ``d`` components, stay below
    ``2**(2 * width) * d <= 2**53``, so each BLAS product is exact; the products are put together
    in int64.
    """
    width = (53 - max(1, a.shape[1]).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, width)
    for i, x in enumerate(limbs(a, width)):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << (width * (i + j))
    return out


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first entry of ``book`` at the least squared distance from each row, and that distance."""
    entry, distance = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    norms = (book * book).sum(axis=1)
    step = max(1, SLICE // len(book))
    for lo in range(0, len(parts), step):
        p = parts[lo : lo + step]
        far = norms - 2 * exact_dots(p, book)
        best = far.argmin(axis=1)
        entry[lo : lo + step] = best
        distance[lo : lo + step] = far[np.arange(len(p)), best] + (p * p).sum(axis=1)
    return entry, distance


def _blocks(batches, parts: int, length: int):
    """Each batch with its vectors as an array (row, part, component)."""
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("whole").flatten().to_numpy().astype(np.int64)
            yield batch, flat.reshape(batch.num_rows, parts, length)


def _summer(books: np.ndarray):
    """Sums of the components and counts of the rows by entry: (slot, total), slots in one range."""
    parts, entries, length = books.shape

    def run(batches):
        sums, counts = np.zeros((parts, entries, length), np.int64), np.zeros((parts, entries), np.int64)
        for _, x in _blocks(batches, parts, length):
            for p in range(parts):
                entry = nearest(x[:, p], books[p])[0]
                order = np.argsort(entry, kind="stable")
                used, first, n = np.unique(entry[order], return_index=True, return_counts=True)
                sums[p, used] += np.add.reduceat(x[order, p], first)
                counts[p, used] += n
        all_ = np.concatenate([sums.ravel(), counts.ravel()])
        slot = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(all_[slot])], ["slot", "total"])

    return run


def _coder(books: np.ndarray):
    parts, _, length = books.shape
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for batch, x in _blocks(batches, parts, length):
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            code = digits[found[0][0]]
            for entry, _ in found[1:]:
                code = np.char.add(code, digits[entry])
            error = np.sum([d for _, d in found], axis=0)
            columns = [batch.column("id"), batch.column("label"), pa.array(code), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])

    return run


def integer_vectors(vectors: DataFrame, key: str, vector: str, label: str, parts: int) -> DataFrame:
    """Rows (id, label, whole) of the vectors that can be coded, their components as integers."""
    v = F.col(vector)
    # Distances over a whole vector stay below 2**62 up to this size of a component.
    most = F.floor(F.sqrt(F.lit(2.0**62) / F.size(v)) / 2)
    good = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double") * SCALE) < most))
    rows = vectors.where(v.isNotNull()).where((F.size(v) > 0) & (F.size(v) % parts == 0) & good)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return rows.select(F.col(key).alias("id"), F.col(label).alias("label"), whole.alias("whole"))


def vector_codes(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """A code of one byte for each part of every vector, with its squared error.

    Each component x is floor(1024 * x). A part's codebook starts as that part of the first
    ``entries`` (256 at most) vectors by key; each round assigns all parts to their nearest
    entry, ties to the lower one, and moves every used entry to the floor of its parts' mean. A
    round is a narrow pass over the integers and one aggregate of at most ``entries`` * (length +
    parts) sums a task; only the codebooks, of that size as well, are on the driver.

    Dropped are null and empty vectors, those with a null or non-finite component or one too
    large for 64-bit distances (131,072 for 64 components), those of another length than the most
    frequent one (of equally frequent ones the longest), and lengths that ``parts`` does not
    divide. Equal keys are rows of their own, in order of their components; null keys come last.
    Null labels are one label. With fewer vectors than entries the codebooks have that many. No
    vectors give no rows. Only key, vector and label are read, so other columns may have any names.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits has 256 entries at most")
    key_type, label_type = (vectors.schema[c].dataType.simpleString() for c in (key, label))
    rows = cut_lineage(integer_vectors(vectors, key, vector, label, parts))
    size = rows.groupBy(F.size("whole").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if size is None:
        return rows.select(
            F.col("id").alias(key),
            *(F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"))),
            F.lit(None).cast("string").alias("codebooks_sha256"),
        )
    rows = rows.where(F.size("whole") == size["size"])
    length = size["size"] // parts
    first = rows.orderBy(F.col("id").asc_nulls_last(), "whole").select("whole").limit(entries).collect()
    books = np.array([r["whole"] for r in first], np.int64).reshape(len(first), parts, length).transpose(1, 0, 2)
    books = np.ascontiguousarray(books)

    for _ in range(rounds):
        made = rows.select("whole").mapInArrow(_summer(books), "slot long, total long")
        totals = made.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
        flat = [0] * (books.size + books.shape[0] * books.shape[1])
        for r in totals:
            flat[r["slot"]] = int(r["total"])
        for at, n in enumerate(flat[books.size :]):
            if n:
                p, entry = divmod(at, books.shape[1])
                books[p, entry] = [s // n for s in flat[at * length : (at + 1) * length]]

    coded = rows.mapInArrow(_coder(books), f"id {key_type}, label {label_type}, code string, error long")
    coded = cut_lineage(coded)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
