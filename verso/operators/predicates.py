"""Metadata filters and access control as boolean columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metadata(filters: dict[str, object] | None) -> Column:
    """Equality with every value that is not null; no filter is true."""
    tests = [F.col(k) == F.lit(v) for k, v in (filters or {}).items() if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def department(dept: str | Column | None, column: str = "department") -> Column:
    """Open rows, and those of the user's department; a missing department is open."""
    own = F.lit(dept) if dept is None or isinstance(dept, str) else dept
    here = F.coalesce(F.col(column), F.lit(""))
    return (here == "") | (here == F.coalesce(own, F.lit("")))


def readable(dept: str | Column | None, is_admin: bool | Column = False) -> Column:
    admin = F.lit(is_admin) if isinstance(is_admin, bool) else is_admin
    return F.coalesce(admin, F.lit(False)) | department(dept)


def visible(users: DataFrame, docs: DataFrame) -> DataFrame:
    """Users (``user_id, user_department, is_admin``) with the documents that they may read.

    Two equality joins instead of one with an OR: by department for all users,
    and by the departments that exist for administrators.
    """
    wide = docs.withColumn("department", F.coalesce("department", F.lit("")))
    every = wide.select(F.col("department").alias("may")).distinct()
    mine = users.filter("not coalesce(is_admin, false)").withColumn("may", F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("user_department", F.lit(""))))))
    theirs = users.filter("coalesce(is_admin, false)").join(F.broadcast(every.agg(F.collect_list("may").alias("all"))))  # one row: departments are few
    theirs = theirs.select(*users.columns, F.explode("all").alias("may"))
    return mine.unionByName(theirs).join(wide, F.col("may") == wide["department"]).drop("may")


def owned(owner: Column, user: Column, is_admin: Column) -> Column:
    """Sessions, deletes and patches are for the owner and for administrators; null owners and users match nobody."""
    return F.coalesce(is_admin, F.lit(False)) | F.coalesce(owner == user, F.lit(False))


def has_role(role: Column, *allowed: str) -> Column:
    return F.coalesce(role.isin(*allowed), F.lit(False))
