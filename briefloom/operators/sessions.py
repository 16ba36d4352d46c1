"""Session rows in the one shape that every job stores and every reader expects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.schemas import SESSION_ENTRIES


def session_rows(rows: DataFrame, batch_id: str, created_at) -> DataFrame:
    """``rows`` as full ``SESSION_ENTRIES``.

    Missing lists are empty, a missing time is ``created_at``, and a missing
    id hashes the batch, project, type and summary, so a retry of one batch
    writes the same ids.
    """
    own = F.sha2(F.concat_ws("|", F.lit("session"), F.lit(batch_id), "project_id", "type", "summary"), 256)
    default = {"id": own, "created_at": F.lit(created_at).cast("timestamp_ntz")}
    cols = []
    for f in SESSION_ENTRIES.fields:
        if f.name in rows.columns:
            cols.append(F.col(f.name))
        else:
            empty = F.array().cast(f.dataType) if f.dataType.typeName() == "array" else F.lit("")
            cols.append(default.get(f.name, empty).alias(f.name))
    return rows.select(*cols)
