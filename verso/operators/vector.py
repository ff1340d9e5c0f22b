"""Exact filtered cosine retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verso.operators.lexical import top


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double precision, to six places; null where a norm is zero."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return F.round(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), 6)


#: Vectors of a block, and copies of the queries when they are joined to blocks by a shuffle.
VECTORS, SALTS = 1024, 8


def _packed(rows: DataFrame, id_: str, more: dict[str, str], most: int) -> DataFrame:
    """``id_, v`` and other columns to rows of up to ``most`` vectors of one length: arrays of the columns, and ``size, matrix``."""
    kind = rows.schema[id_].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            lengths = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
            sizes, of = np.unique(lengths, return_inverse=True)
            for n, size in enumerate(sizes.tolist()):
                at = np.flatnonzero(of == n)
                for part in np.split(at, range(most, len(at), most)) if size else ():
                    rows_ = batch.take(pa.array(part))
                    flat = rows_.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8")  # null components become NaN
                    columns = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), rows_.column(c)) for c in (id_, *more)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([size], pa.int32()), pa.array([flat.tobytes()], pa.binary())], [f"{c}_list" for c in (id_, *more)] + ["size", "matrix"])

    lists = ", ".join(f"{c}_list array<{k}>" for c, k in ((id_, kind), *more.items()))
    return rows.select(id_, "v", *more).mapInArrow(pack, f"{lists}, size int, matrix binary")


def search(chunks: DataFrame, queries: DataFrame, k: int = 20, keep: Column | None = None, block: int = 256) -> DataFrame:
    """The ``k`` nearest chunks (``chunk_id, embedding``) of each query (``query_id, query_vector``).

    Filters apply before ranking, and so does the access of users, if queries
    carry ``user_department`` and ``is_admin``. Vectors and queries are packed
    into blocks, which are joined and multiplied; the best ``k`` of a block
    leave its task for each query. Vectors of another length than a query's, or
    of norm zero, are near to nothing.
    """
    row = chunks if keep is None else chunks.filter(keep)
    department = F.coalesce("department", F.lit("")) if "department" in chunks.columns else F.lit("")
    row = row.select("chunk_id", F.col("embedding").cast("array<double>").alias("v"), department.alias("department"))
    access = "user_department" in queries.columns
    user = {"user_department": "string", "is_admin": "boolean"} if access else {}
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v"), *[F.col(c).cast(t).alias(c) for c, t in user.items()])
    asked = _packed(asked, "query_id", user, block).withColumnRenamed("matrix", "questions").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    packed = _packed(row, "chunk_id", {"department": "string"}, VECTORS).withColumn("salt", F.pmod(F.xxhash64("matrix"), F.lit(SALTS)).cast("int"))
    kinds = [f.schema[c].dataType.simpleString() for f, c in ((queries, "query_id"), (chunks, "chunk_id"))]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                size = batch.column("size")[r].as_py()
                x, y = (np.frombuffer(batch.column(c)[r].as_buffer(), "<f8").reshape(-1, size) for c in ("matrix", "questions"))
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.round(y @ x.T / (np.sqrt((y * y).sum(1))[:, None] * np.sqrt((x * x).sum(1))), 6)
                good = np.isfinite(score)
                if access:
                    names, of = np.unique(np.array(batch.column("department_list")[r].as_py(), object), return_inverse=True)
                    admin, own = batch.column("is_admin_list")[r].as_py(), batch.column("user_department_list")[r].as_py()
                    good &= np.array([[bool(a) or d in ("", o or "") for d in names] for a, o in zip(admin, own)])[:, of]
                score = np.where(good, score, -np.inf)
                if score.shape[1] > k:  # all that tie with the k-th stay
                    good &= score >= np.partition(score, -k, 1)[:, -k][:, None]
                q, c = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([batch.column("query_id_list")[r].values.take(pa.array(q)), batch.column("chunk_id_list")[r].values.take(pa.array(c)), pa.array(score[q, c])], ["query_id", "chunk_id", "vector_score"])

    found = packed.join(asked, ["size", "salt"]).mapInArrow(look, f"query_id {kinds[0]}, chunk_id {kinds[1]}, vector_score double")
    return top(found, k, "vector_score", "vector_rank")
