"""Functions for SQL text: a session's tables by name, and scalar and table functions over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Who asks; null sees nothing.
USER = "asking_user"

FUNCTIONS = {
    # the workspaces that who asks belongs to
    "current_workspace_ids": f"""() RETURNS TABLE (workspace_id BIGINT)
        RETURN SELECT DISTINCT m.workspace_id FROM workspace_users m WHERE m.user_id = {USER}""",
    # whether who asks may manage the members of a workspace
    "is_workspace_admin": f"""(workspace BIGINT) RETURNS BOOLEAN
        RETURN EXISTS (SELECT 1 FROM workspace_users m WHERE m.workspace_id = workspace AND m.user_id = {USER} AND m.role IN ('owner', 'admin'))""",
    # items of each of the batches, in all and by status
    "batch_item_counts": """(batches ARRAY<BIGINT>) RETURNS TABLE (batch_id BIGINT, total BIGINT, approved BIGINT, pending BIGINT, needs_revision BIGINT)
        RETURN SELECT i.batch_id, count(*), count_if(i.status = 'approved'), count_if(i.status = 'pending'), count_if(i.status = 'needs_revision')
          FROM items i WHERE batches IS NULL OR array_contains(batches, i.batch_id) GROUP BY i.batch_id""",
}


def register(spark: SparkSession, tables: Mapping[str, DataFrame], user: int | None = None) -> None:
    """Name ``tables`` (workspace_users, items and any others) in the session, for ``user``, and create FUNCTIONS."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    spark.sql(f"DECLARE OR REPLACE VARIABLE {USER} BIGINT DEFAULT {'NULL' if user is None else int(user)}")
    for name, definition in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{definition}")
