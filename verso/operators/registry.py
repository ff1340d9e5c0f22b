"""Document registry and chunk table: deduplication, status, patches, deletes, listings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verso.functions.patterns import DEPARTMENTS, STATUSES, TYPES
from verso.operators.predicates import readable
from verso.session import shared_dir, stored


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, file_hash, first_id, is_duplicate``: the first document of each content by id.

    The smallest id of a hash is a partial aggregate and joins back; no group
    is gathered.
    """
    row = docs.select("doc_id", content_hash(F.coalesce(F.col("text"), F.lit(""))).alias("file_hash"))
    first = row.groupBy("file_hash").agg(F.min("doc_id").alias("first_id"))
    return row.join(first, "file_hash").select("doc_id", "file_hash", "first_id", (F.col("doc_id") != F.col("first_id")).alias("is_duplicate"))


def accept_uploads(uploads: DataFrame, registry: DataFrame) -> DataFrame:
    """Uploads (``doc_id, file_hash``) whose content no document holds that has not failed."""
    alive = registry.filter("status != 'failed'").select("file_hash")
    fresh = uploads.join(alive, "file_hash", "left_anti")
    first = W.partitionBy("file_hash").orderBy("doc_id")
    return fresh.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def latest_status(events: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """The last status of each key in an append-only log."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(at, tie)).alias("status"), F.max(at).alias("updated_at"), F.count("*").alias("n_events"))


def check_patch(patch: DataFrame) -> DataFrame:
    """Patches with known values only: an unknown status, type or department is an error."""
    for name, known in (("document_status", STATUSES), ("document_type", TYPES), ("department", ("", *DEPARTMENTS))):
        patch = patch.withColumn(name, F.when(F.col(name).isNull() | F.col(name).isin(*known), F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {name}: "), F.col(name))).cast("string")))
    return patch


def patch_metadata(chunks: DataFrame, patch: DataFrame) -> DataFrame:
    """Chunks with the columns of ``patch`` (one row a ``doc_id``) that are not null; other values stay."""
    names = [c for c in patch.columns if c != "doc_id"]
    p = patch.select("doc_id", *[F.col(c).alias(f"_{c}") for c in names])
    out = chunks.join(p, "doc_id", "left")
    return out.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in chunks.columns])


def delete(table: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Rows of documents that are not deleted; the same call serves registry and chunks."""
    return table.join(doc_ids.select("doc_id"), "doc_id", "left_anti")


def listing(docs: DataFrame, search: str | None = None, status: str | None = None, dept: str | None = None, is_admin: bool = False, page: int = 1, size: int = 20) -> DataFrame:
    """A page of the registry, newest first, with the total and the number of pages."""
    row = docs.filter(readable(dept, is_admin))
    if search:
        row = row.filter(F.col("original_name").rlike("(?iu)" + search))
    if status:
        row = row.filter(F.col("document_status") == status)
    total = row.agg(F.count("*").alias("total"))
    shown = row.orderBy(F.desc("created_at"), "doc_id").offset((page - 1) * size).limit(size)
    return shown.join(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))  # one row


class Listing:
    """Documents in their order, newest first, written once in sorted ranges, so that a page reads the range that it lies in.

    ``at`` counts the rows of a range; the ranges' sizes say where each begins.
    A page is neither sorted nor skipped to, and totals are known.
    """

    def __init__(self, docs: DataFrame, order: tuple[Column, ...] | None = None):
        order = order or (F.desc("created_at"), F.asc("doc_id"))
        self.rows = stored(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "listing")
        sizes = self.rows.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n")).orderBy("range").collect()
        self.ranges, self.total = [], 0
        for r in sizes:
            self.ranges.append((r["range"] << 33, self.total, r["n"]))
            self.total += r["n"]

    def pages(self, size: int = 20) -> int:
        return -(-self.total // size)

    def page(self, number: int, size: int = 20) -> DataFrame:
        """The rows of a page, in order, with the total and the number of pages."""
        first, here = (number - 1) * size, F.lit(False)
        for base, before, n in self.ranges:
            a, b = max(first, before), min(first + size, before + n)
            if a < b:
                here = here | F.col("at").between(base + a - before, base + b - before - 1)
        shown = self.rows.filter(here).coalesce(1).sortWithinPartitions("at").drop("at")
        return shown.withColumns({"total": F.lit(self.total).cast("long"), "pages": F.lit(self.pages(size)).cast("long")})

    def numbered(self) -> DataFrame:
        """All rows with their ``position``, from 0."""
        before = F.split(F.lit(",".join(str(b) for _, b, _ in self.ranges)), ",").cast("array<long>")
        bases = F.split(F.lit(",".join(str(a >> 33) for a, _, _ in self.ranges)), ",").cast("array<long>")
        place = F.array_position(bases, F.shiftright("at", 33)) - 1
        return self.rows.withColumn("position", F.get(before, place.cast("int")) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at")


def register_users(users: DataFrame, existing: DataFrame) -> DataFrame:
    """New users (``user_id, email, username``) whose e-mail and name are both free, as if registered one by one by id.

    Of users whose ids are the smallest of both their e-mail and their name all
    register at once; who shares either with them is refused, and the rest goes
    round again. Every round settles at least the smallest id of what is left.
    """

    def free(rows: DataFrame, taken: DataFrame) -> DataFrame:
        return rows.join(taken.select("email"), "email", "left_anti").join(taken.select("username"), "username", "left_anti")

    shared_dir(users.sparkSession, "users")  # sets a folder for checkpoints where there is none
    left, out = free(users, existing).select(users.columns).checkpoint(), []
    while not left.isEmpty():
        mail, name = (left.groupBy(c).agg(F.min("user_id").alias("user_id")) for c in ("email", "username"))
        out.append(left.join(mail, ["email", "user_id"], "left_semi").join(name, ["username", "user_id"], "left_semi").select(users.columns).checkpoint())
        left = free(left, out[-1]).select(users.columns).checkpoint()
    return reduce(DataFrame.unionByName, out, left)


def row_digest(with_text: bool = True) -> Column:
    """A digest of a chunk's id, metadata and text."""
    parts = ["chunk_id", "department", "document_status", "document_type"] + (["text"] if with_text else [])
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]))


def digest_sums(row: Column) -> list[Column]:
    """Aggregates ``n, s0..s3, x0..x3`` of digests, which do not depend on order and add up: sums by adding, ``x`` by exclusive or."""
    halves = [F.conv(F.substring(row, i, 8), 16, 10).cast("long") for i in (1, 9, 17, 25)]
    return [F.count("*").alias("n"), *[F.sum(h).alias(f"s{i}") for i, h in enumerate(halves)], *[F.bit_xor(h).alias(f"x{i}") for i, h in enumerate(halves)]]


def checksum_of(sums: Iterable[Sequence[int]]) -> str:
    """The checksum of a corpus from the sums of its parts, each ``n, s0..s3, x0..x3``."""
    total = [0] * 9
    for part in sums:
        total = [a + b if i < 5 else a ^ b for i, (a, b) in enumerate(zip(total, part))]
    shown = total if total[0] else [0]  # sums of no rows are null and left out
    return hashlib.md5("|".join(map(str, shown)).encode()).hexdigest()


def corpus_checksum(chunks: DataFrame, with_text: bool = True) -> DataFrame:
    """One row ``checksum, n``: it changes when any chunk's id, metadata or text does.

    Digests of rows are folded by exclusive or and by sum, in partial
    aggregates: the checksum does not depend on order and gathers no rows.
    """
    out = chunks.agg(*digest_sums(row_digest(with_text)))
    return out.select(F.md5(F.concat_ws("|", "n", *[f"{a}{i}" for a in "sx" for i in range(4)])).alias("checksum"), "n")


def admit(uploads: DataFrame, registry: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Uploads (``doc_id, filename, file_hash``) with ``reason`` and ``stored_name``.

    An upload is refused for its extension, or because a document that has not
    failed, or an earlier accepted upload, holds the same content. The stored
    name is of the upload alone, so that a repeated run gives the same.
    """
    kind = F.lower(F.regexp_extract("filename", r"\.([^./]+)$", 1))
    row = uploads.withColumn("_kind", kind)
    good = row.filter(F.col("_kind").isin(*extensions)).join(registry.filter("status != 'failed'").select("file_hash"), "file_hash", "left_anti")
    first = good.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("_first"))
    out = row.join(first, "doc_id", "left")
    reason = F.when(~F.col("_kind").isin(*extensions), "bad_extension").when(F.col("_first").isNull(), "duplicate")
    name = F.concat(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "file_hash")), F.lit("."), "_kind")
    return out.withColumn("reason", reason).withColumn("stored_name", F.when(F.col("reason").isNull(), name)).drop("_kind", "_first")


def latest_fields(events: DataFrame, key: str, at: str, tie: str, fields: list[str]) -> DataFrame:
    """The last value of each field that an event sets; an event leaves alone what is null in it."""
    order = F.struct(at, tie)
    return events.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields], F.max(at).alias("updated_at"))


def fetch(wanted: DataFrame, docs: DataFrame, dept: str | None = None, is_admin: bool = False) -> DataFrame:
    """Documents by id for one user, with ``found``; what the user may not read is not found, like what does not exist."""
    mine = docs.filter(readable(dept, is_admin)).withColumn("found", F.lit(True))
    return wanted.select("doc_id").join(mine, "doc_id", "left").na.fill(False, ["found"])


def totals(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row with the numbers of documents, chunks and vectors."""
    d = docs.agg(F.count("*").alias("documents"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors"))
    return d.join(c)  # one row each


def batch_report(results: DataFrame, at: str) -> DataFrame:
    """One row of a batch of ingested documents (``status``): how many, how many succeeded and failed, and its seconds."""
    seconds = F.timestamp_diff("MICROSECOND", F.min(at), F.max(at)) / 1e6
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("succeeded"), F.count_if(F.col("status") != "done").alias("failed"), seconds.alias("elapsed_s"))


def with_labels(rows: DataFrame, column: str = "department") -> DataFrame:
    """Rows with the label of their department; an unknown one is its own label."""
    label = F.create_map(*[F.lit(x) for pair in DEPARTMENTS.items() for x in pair])
    return rows.withColumn("label", F.coalesce(F.try_element_at(label, F.col(column)), F.col(column)))
