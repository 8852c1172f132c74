"""Declared schemas (nothing is inferred)."""

from __future__ import annotations

CONTRIBUTOR_DDL = "STRUCT<ip: STRING, username: STRING, id: BIGINT>"
REVISION_FIELDS_DDL = (
    "id BIGINT, parentid BIGINT, timestamp STRING, contributor " + CONTRIBUTOR_DDL +
    ", minor STRING, comment STRING, text STRUCT<_VALUE: STRING, _bytes: BIGINT>"
)
REVISION_DDL = f"STRUCT<{REVISION_FIELDS_DDL}>"
# One page record of a current or history dump.  Timestamps stay text here and
# are parsed with try_to_timestamp so a bad value goes to a reject frame.
PAGE_HEAD_DDL = "id BIGINT, title STRING, ns INT, redirect STRUCT<_title: STRING>"
PAGE_SCHEMA_DDL = f"{PAGE_HEAD_DDL}, revision ARRAY<{REVISION_DDL}>"
# All-string variant used for well-formedness checks only.
STRING_PAGE_SCHEMA_DDL = "id STRING, title STRING, ns STRING, revision ARRAY<STRING>"
