"""Release tags: parsing, kinds, identifiers of snapshots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def release_version(tag: Column) -> Column:
    """(major, minor, patch) of a tag that is nothing but a release number, else null."""
    c = F.regexp_replace(tag, r"\A[vV]", "")
    c = F.regexp_replace(c, r"(?i)\Arelease[-_.]?", "")
    c = F.regexp_replace(c, r"(?i)[-_.]?release\z", "")
    whole = r"\A(\d+)(?:\.(\d+))?(?:\.(\d+))?\z"
    part = lambda k: F.coalesce(F.when(F.regexp_extract(c, whole, k) != "", F.regexp_extract(c, whole, k)).try_cast("int"), F.lit(0))
    return F.when(c.rlike(whole), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def version_kind(version: Column) -> Column:
    return F.when((version["minor"] == 0) & (version["patch"] == 0), "major").when(version["patch"] == 0, "minor").otherwise("patch")


def snapshot_id(repo: Column, commit: Column, day: Column) -> Column:
    return F.concat_ws("_", repo, F.substring(commit, 1, 8), F.date_format(day, "yyyyMMdd"))


def is_iso_date(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(c, "Z", "+00:00")).isNotNull()


def is_valid_snapshot(slice_id: Column, commit: Column, date: Column) -> Column:
    return (F.coalesce(slice_id, F.lit("")) != "") & (F.coalesce(commit, F.lit("")) != "") & F.coalesce(is_iso_date(date), F.lit(False)) & (F.length(slice_id) >= 5)
