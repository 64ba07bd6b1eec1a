"""Schemas, column mapping and schema tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The wide posting as exported, in column order.
AD_SCHEMA_DDL = """
    duplicate_group string, title string, url string, tst_created string, tst_deleted string,
    duration double, is_temporary boolean, has_homeoffice boolean,
    work_quota struct<minimum:int, maximum:int>, location string,
    locations array<struct<country:string, province:string, district:int, postal_code:string>>,
    cantons_bonus array<string>, content_clean string, origin string,
    company struct<
        id:int, name:string, bfs_uid:string, crn:string,
        metadata:array<struct<id:int, name:string, type:string>>,
        addresses:array<struct<country:string, city:string, postal_code:string, street:string, is_primary:boolean>>,
        size:struct<id:int, name:string, employees:struct<minimum:int, maximum:int>>,
        url:string, is_recruiter:boolean>,
    occupations array<struct<id:string, name:string>>, language string
"""  # noqa: E501


def ad_schema() -> T.StructType:
    return T.StructType.fromDDL(AD_SCHEMA_DDL)


@dataclass(frozen=True)
class ColumnMap:
    """Physical column names of the posting table."""

    date: str = "tst_created"
    content: str = "content_clean"
    language: str = "language"
    locations: str = "locations"
    job_id: str = "duplicate_group"
    company: str = "company"
    company_id: str = "id"
    company_name: str = "name"
    is_recruiter: str = "is_recruiter"
    metadata: str = "metadata"
    size: str = "size"
    size_id: str = "id"
    size_name: str = "name"


@dataclass(frozen=True)
class PrepareConfig:
    columns: ColumnMap = ColumnMap()
    country: str | None = "CH"
    date_start: str | None = None
    date_end: str | None = None
    exclude_recruiters: bool = True
    exclude_size_id: str | None = None
    # Old rule: also drop postings whose size class is unknown.
    strict_nulls: bool = False
    languages: tuple[str, ...] | None = ("de", "fr", "it", "rm", "en")
    # Significance per size class id.
    size_alpha: tuple[tuple[str, float], ...] = (
        ("57000002", 0.005),
        ("57000003", 0.002),
        ("57000004", 0.001),
    )
    fallback_alpha: float = 0.01


def has_field(schema: T.DataType, path: str) -> bool:
    """Whether a dotted path exists; array elements are looked into."""
    for name in path.split("."):
        while isinstance(schema, T.ArrayType):
            schema = schema.elementType
        if not isinstance(schema, T.StructType) or name not in schema.fieldNames():
            return False
        schema = schema[name].dataType
    return True
