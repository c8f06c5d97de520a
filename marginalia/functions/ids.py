"""Identifiers as expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5_url(name: Column) -> Column:
    """Version-5 UUID of ``name`` in the URL namespace."""
    digest = F.sha1(F.concat(F.lit(uuid.NAMESPACE_URL.bytes), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def point_id(source: Column, page: Column, index: Column) -> Column:
    return uuid5_url(F.concat_ws(":", source, page.cast("string"), index.cast("string")))


def parent_id(source: Column, path: Column) -> Column:
    """Id of a section; null for an empty path."""
    joined = F.concat(source, F.lit("::"), F.array_join(path, " > "))
    return F.when(F.size(F.coalesce(path, F.array())) > 0, F.concat(F.lit("P-"), F.substring(F.sha1(joined), 1, 12)))
