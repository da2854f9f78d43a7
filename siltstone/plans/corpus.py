"""Queries of the general training-data operators (snapshots)."""

from __future__ import annotations

from siltstone.operators.snapshots import change_counts, snapshot_changes
from siltstone.plans.registry import Registry
from siltstone.sources.tables import table
from siltstone.streaming.ingest import shared_folder

registry = Registry()

_CHANGES = r"""
WITH clean AS (
  SELECT version_no, regexp_replace(chunk_id, '^\s+|\s+$', '', 'g') AS chunk_id, loaded_at, source_id,
         nullif(regexp_replace(lower(regexp_replace(text_hash, '^\s+|\s+$', '', 'g')), '^sha256:', ''), '') AS hash
  FROM chunk_snapshots WHERE version_no IS NOT NULL AND chunk_id IS NOT NULL),
state AS (
  SELECT version_no, chunk_id, hash, source_id FROM clean WHERE chunk_id <> ''
  QUALIFY row_number() OVER (PARTITION BY version_no, chunk_id ORDER BY loaded_at DESC NULLS LAST, hash DESC NULLS LAST, source_id DESC NULLS LAST) = 1),
steps AS (
  SELECT version_no AS later, lag(version_no) OVER (ORDER BY version_no) AS earlier FROM (SELECT DISTINCT version_no FROM state)),
new AS (SELECT s.later, n.* FROM steps s JOIN state n ON n.version_no = s.later WHERE s.earlier IS NOT NULL),
old AS (SELECT s.later, o.* FROM steps s JOIN state o ON o.version_no = s.earlier),
changes AS (
  SELECT coalesce(n.later, o.later) AS version_no, coalesce(n.chunk_id, o.chunk_id) AS chunk_id,
         CASE WHEN o.chunk_id IS NULL THEN 'added' WHEN n.chunk_id IS NULL THEN 'removed'
              WHEN n.hash <> o.hash THEN 'changed' END AS change_type,
         CASE WHEN n.chunk_id IS NULL THEN o.source_id ELSE n.source_id END AS source_id
  FROM new n FULL JOIN old o ON n.later = o.later AND n.chunk_id = o.chunk_id)
"""


@registry.add("p6_found", _CHANGES + "SELECT version_no, chunk_id, change_type FROM changes WHERE change_type IS NOT NULL")
def p6_found(spark, sf_dir):
    # Another run that names the same folder goes on with its ordinals.
    store = shared_folder(spark, "ordinals")
    return snapshot_changes(table(spark, sf_dir, "chunk_snapshots"), store=store).select("version_no", "chunk_id", "change_type")


@registry.add(
    "p6_by_source",
    _CHANGES
    + """SELECT version_no, source_id, count(*) FILTER (change_type = 'added') AS added,
  count(*) FILTER (change_type = 'removed') AS removed, count(*) FILTER (change_type = 'changed') AS changed
FROM changes WHERE change_type IS NOT NULL GROUP BY version_no, source_id""",
)
def p6_by_source(spark, sf_dir):
    return change_counts(snapshot_changes(table(spark, sf_dir, "chunk_snapshots")))
