"""The record store's queries over tables: scope, search, pages, facets, statistics, latest rows, and rewrites in place of updates and deletes."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Scope:
    """Who asks: an administrator sees all; others the projects they manage and, in those they are members of, what they made."""

    user: str | None = None
    admin: bool = False
    managed: Sequence = ()
    member: Sequence = ()


def scope_filter(scope: Scope | None, project: Column, creator: Column) -> Column:
    if scope is None or scope.admin:
        return F.lit(True)
    branches = []
    if scope.managed:
        branches.append(project.isin(*scope.managed))
    if scope.member and scope.user is not None:
        branches.append(project.isin(*scope.member) & (creator == scope.user))
    return functools.reduce(lambda a, b: a | b, branches, F.lit(False))


def record_filter(records: DataFrame, members: DataFrame, user: str, office_head: bool = False, project: str = "project_id", creator: str = "created_by") -> DataFrame:
    """The records a user may read, from the membership table: a manager's role, or any role for an office head, shows the whole project."""
    own = members.where(F.col("user_id") == user)
    managed = own.where(F.lit(office_head) | (F.col("role_in_project") == "truong_phong")).select(F.col("project_id").alias("m_project")).distinct()
    joined = own.select(F.col("project_id").alias("m_project")).distinct()
    wide = records.join(managed, records[project] == managed["m_project"], "left_semi")
    narrow = records.where(F.col(creator) == user).join(joined, F.col(project) == joined["m_project"], "left_semi").join(managed, F.col(project) == managed["m_project"], "left_anti")
    return wide.unionByName(narrow)


def equal_or_all(c: Column, value: str | None) -> Column:
    """``c = value``; a blank value or ``all`` asks for everything."""
    v = (value or "").strip()
    return F.lit(True) if not v or v.lower() == "all" else c == v


def source_filter(folder: Column, path: Column, value: str | None) -> Column:
    v = (value or "").strip()
    return F.lit(True) if not v or v.lower() == "all" else (folder == v) | path.like(f"%{v}%")


def search_any(columns: Sequence[Column], text: str | None) -> Column:
    """``text`` is in one of the columns, in any case."""
    t = (text or "").strip()
    return F.lit(True) if not t else functools.reduce(lambda a, b: a | b, [F.coalesce(c.ilike(f"%{t}%"), F.lit(False)) for c in columns])


def search_any_value(df: DataFrame, text: str) -> DataFrame:
    """Rows with ``text`` in any column's value, in any case; 0 and '' are no values."""
    values = [F.when(~F.col(f"`{c}`").cast("string").isin("", "0", "0.0", "false"), F.col(f"`{c}`").cast("string")) for c in df.columns]
    return df.where(F.exists(F.array(*values), lambda v: F.coalesce(F.contains(F.lower(v), F.lit(text.lower())), F.lit(False))))


def id_in(df: DataFrame, column: str, ids: Sequence | DataFrame) -> DataFrame:
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")
    return df.where(F.col(column).isin(*ids))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """One page in a total order; a top-k, no global sort."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most}, offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


@dataclass
class RecordQuery:
    """A listing of records with their batches."""

    scope: Scope | None = None
    search: str | None = None
    search_columns: Sequence[str] = ()
    equal: dict[str, str | None] = field(default_factory=dict)
    least_batch: int = 0
    most_batch: int = 0


def list_records(records: DataFrame, batches: DataFrame, q: RecordQuery, *, key: str = "batch_id", project: str = "project_id", creator: str = "created_by", batch_size: str = "total_files") -> DataFrame:
    """Records that the query asks for, left-joined to their batches; filters on records come before the join, those on batches after it."""
    out = records.where(scope_filter(q.scope, F.col(project), F.col(creator)))
    for column, value in q.equal.items():
        out = out.where(equal_or_all(F.col(column), value))
    out = out.where(search_any([F.col(c) for c in q.search_columns], q.search) if q.search_columns else F.lit(True))
    out = out.join(batches, key, "left")
    if q.least_batch > 0:
        out = out.where(F.col(batch_size) >= q.least_batch)
    if q.most_batch > 0:
        out = out.where(F.col(batch_size) <= q.most_batch)
    return out


def facet(df: DataFrame, key: Column, time: Column | None = None, skip_empty: bool = False) -> DataFrame:
    """value, n and, with a time, its first and last."""
    rows = df.withColumn("value", key)
    if skip_empty:
        rows = rows.where(F.col("value").isNotNull() & (F.trim("value") != ""))
    aggs = [F.count("*").alias("n")]
    if time is not None:
        aggs += [F.min(time).alias("first_at"), F.max(time).alias("last_at")]
    return rows.groupBy("value").agg(*aggs)


def stats(records: DataFrame, batches: DataFrame, status: str, folder: str, ok: str, failed: str) -> DataFrame:
    """One row: totals, successes, errors, distinct folders, and the batches under their own scope."""
    one = records.agg(F.count("*").alias("total"), F.count_if(F.col(status) == ok).alias("success"), F.count_if(F.col(status) == failed).alias("error"), F.countDistinct(folder).alias("folders"))
    return one.join(F.broadcast(batches.agg(F.count("*").alias("batches"))))  # one row each


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order. A window over the keys; for one value only, ``latest_value`` aggregates partially."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def latest_value(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The values of each key's last row by ``order``; combines map-side, so a hot key is no burden."""
    top = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
    """``current`` with ``changes``: the last change of a key replaces the row; columns of ``keep_old`` keep what was there where the change has null."""
    values = [c for c in current.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_new"))
    old = current.select(*keys, F.struct(*values).alias("_old"))
    both = old.join(last, list(keys), "full_outer")
    pick = lambda c: (
        F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")) if c in keep_old else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    )
    return both.select(*[c if c in keys else pick(c).alias(c) for c in current.columns])


def coalescing_fold(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's last non-null value of each column: a chain of upserts in one aggregation."""
    return df.groupBy(*keys).agg(*[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.struct(*order))).alias(v) for v in values])


def insert_if_absent(current: DataFrame, rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The table with the rows whose keys it lacks, and those rows."""
    new = rows.dropDuplicates(list(keys)).join(current.select(*keys), list(keys), "left_anti")
    return current.unionByName(new, allowMissingColumns=True), new


def retain_except(df: DataFrame, column: str, value) -> DataFrame:
    """All rows but those of ``value``; null is distinct from it."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def delete_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def delete_project(tables: dict[str, DataFrame], project_id: str, batches: str = "ocr_batches", audits: str = "cccd_crop_audits", reviews: str = "ocr_field_reviews", records: str = "ocr_records") -> dict[str, DataFrame]:
    """All tables without a project: its audits go with its batches and its reviews with its records, those of other projects stay."""
    out = {n: retain_except(t, "project_id", project_id) if "project_id" in t.columns else t for n, t in tables.items()}
    if audits in out and batches in tables:
        out[audits] = delete_keys(tables[audits], tables[batches].where(F.col("project_id") == project_id), ["batch_id"])
    if reviews in out and records in tables:
        gone = tables[records].where(F.col("project_id") == project_id).select(F.col("id").alias("document_id"))
        out[reviews] = delete_keys(tables[reviews], gone, ["document_id"])
    return out


def orphans(outputs: DataFrame, records: DataFrame, output_id: str, record_id: str) -> DataFrame:
    return outputs.join(records.select(F.col(record_id).alias(output_id)), output_id, "left_anti")


def effective_region(project_region: Column, creator_region: Column, default: str) -> Column:
    return F.coalesce(F.nullif(project_region, F.lit("")), creator_region, F.lit(default))


def bounded_text(c: Column, n: int = 50) -> Column:
    return F.substring(c.cast("string"), 1, n)


def progress(df: DataFrame, batch: str, status: Column, done: Sequence[str], failed: Sequence[str], total: Column | None = None) -> DataFrame:
    """processed, success, error, total and percent (one decimal) of each batch; complete when all are processed."""
    n = F.count("*") if total is None else F.max(total)
    out = df.groupBy(batch).agg(F.count_if(status.isin(*done)).alias("success"), F.count_if(status.isin(*failed)).alias("error"), n.alias("total"))
    processed = F.col("success") + F.col("error")
    return out.withColumns({"processed": processed, "percent": F.round(100 * processed / F.col("total"), 1), "complete": processed >= F.col("total")})


def files_per_minute(files: Column, seconds: Column) -> Column:
    return F.when((seconds > 5) & (files > 0), F.round(files / (seconds / 60), 1))


def access(requests: DataFrame, members: DataFrame) -> DataFrame:
    """``requests`` (user_id, is_admin, is_head, project_id, created_by) with is_member, can_access and can_delete.

    An administrator may read and delete all. Others must be members of the
    project; its managers, and office heads, may do both with all of it, other
    members may read what they made. A request without a project is refused.
    """
    roles = members.groupBy("project_id", "user_id").agg(F.bool_or(F.coalesce(F.col("role_in_project") == "truong_phong", F.lit(False))).alias("_manager"))
    out = requests.join(roles, ["project_id", "user_id"], "left")
    member, admin = F.col("_manager").isNotNull(), F.coalesce("is_admin", F.lit(False))
    manager = member & (F.col("_manager") | F.coalesce("is_head", F.lit(False)))
    own = F.coalesce(F.col("created_by") == F.col("user_id"), F.lit(False))
    return out.select(*requests.columns, member.alias("is_member"), (admin | manager | (member & own)).alias("can_access"), (admin | manager).alias("can_delete"))


def last_admin_guard(users: DataFrame, user: str) -> DataFrame:
    """One row: whether another active administrator is left without ``user``. ``users`` has user_id, is_admin and is_active."""
    return users.agg(F.coalesce(F.bool_or((F.col("user_id") != user) & F.col("is_admin") & F.col("is_active")), F.lit(False)).alias("allowed"))


def dump(records: DataFrame, order: Sequence[Column], limit: int = 10_000) -> DataFrame:
    """The newest records with their payloads, 10,000 at most, as one page."""
    return page(records, order, limit, 0, 10_000)


def oldest_documents(records: DataFrame, order: Sequence[Column], limit: int = 5000) -> DataFrame:
    """The oldest documents that have rows; the limit counts documents, so it comes before their rows are exploded."""
    return page(records.where(F.col("rows").isNotNull()), order, limit, 0, 5000)


def union_text_sources(pages: DataFrame, texts: str = "mutations") -> DataFrame:
    """Each document's texts of all pages in one array, pages in order."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("page_index", F.coalesce(texts, F.array().cast("array<string>")).alias("t")))), lambda p: p["t"])
    return pages.groupBy("doc_id").agg(F.flatten(lists).alias(texts))
