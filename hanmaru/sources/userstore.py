"""The user dictionary under several writers: numbered documents, of which a writer takes the next number or learns that another did.

Edits are kept as rows (seq, id, old_reading, old_value, reading, value, comment, created_at, updated_at) until they are
committed. Where another writer was first, the store is read again and the edits are applied to what it holds now, so no
edit of either is lost; of edits to one entry the later commit counts. Rows without reading or value stay in the editor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import userdict
from . import stores, versions

TRIES, KEEP = 10, 3
COLUMNS = ["id", "reading", "value", "comment", "created_at", "updated_at"]


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("document-").removesuffix(".json")) for n in versions.names(spark, path) if n.startswith("document-"))


def _name(path: str, version: int) -> str:
    return f"{path}/document-{version:020d}.json"


def current(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(version, entries with pos); version 0 and no entries where there is no store."""
    found = _numbers(spark, path)
    if not found:
        return 0, stores.load_user_entries(spark, f"{path}/none")
    return found[-1], stores.load_user_entries(spark, _name(path, found[-1]))


def replaced(spark: SparkSession, path: str, entries: DataFrame, version: int) -> bool:
    """Writes entries (with pos) as this version, unless another writer took it: whether it was free."""
    fresh = f"{path}/_new-{uuid.uuid4().hex}"
    stores.user_document(entries).coalesce(1).write.text(fresh)
    part = next(n for n in versions.names(spark, fresh) if n.startswith("part-"))
    done = versions.take(spark, f"{fresh}/{part}", _name(path, version))
    versions.remove(spark, fresh)
    return done


def commit(spark: SparkSession, path: str, edits: DataFrame, deletes: DataFrame | None = None, tries: int = TRIES) -> int:
    """Applies edits, and deletes (seq, reading, value), to the newest document; returns the version that holds them."""
    changes = userdict.renames(edits.where((F.length("reading") > 0) & (F.length("value") > 0)))
    if deletes is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("id", "string"), ("comment", "string"), ("created_at", "timestamp"), ("updated_at", "timestamp"))]
        changes = changes.unionByName(deletes.select(*none, "reading", "value", (F.col("seq") * 2 + 1).alias("seq"), F.lit("delete").alias("op")))
    for _ in range(tries):
        version, entries = current(spark, path)
        if replaced(spark, path, userdict.applied_in_order(entries, changes), version + 1):
            for old in _numbers(spark, path)[:-KEEP]:
                versions.remove(spark, _name(path, old))
            return version + 1
    raise RuntimeError(f"{path}: {tries} other writers were first")


def buffer(stored: DataFrame, edited: DataFrame) -> DataFrame:
    """What an editor shows after a reload: its own rows (`edited`, by id) as long as they aren't committed, the store's else."""
    mine = edited.select(*COLUMNS, F.lit(True).alias("dirty"))
    return stored.select(*COLUMNS, F.lit(False).alias("dirty")).join(mine.select("id"), "id", "left_anti").unionByName(mine)
