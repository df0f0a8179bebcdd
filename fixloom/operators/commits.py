"""Which commit an entry describes: full ids, and shortened ids resolved within their own project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixloom.functions.identity import commit_key, repo_key
from fixloom.runtime import written


def commit_entries(entries: DataFrame, *keep: str, few: int = 200_000) -> DataFrame:
    """Rows of ``entries`` with ``commit_of``: the 40 hex digits of their commit, or ``project#digits``.

    A full id stands for itself in any project. A shortened one (7 to 39 digits) stands for each full id of an
    entry of the same project that it begins (more than one: a row for each); if there is none, for itself within
    its project. ``keep`` are the columns to carry. Entries without a recognisable id are left out.

    ``entries`` are read once, into a narrow table of keys. Only the shortened ids meet the full ones, on project and
    first seven digits, so a project with a third of the rows is spread over its commits: up to ``few`` of them are
    broadcast, and full ids that begin with none are left where they are; more are joined.
    """
    keys = [commit_key(F.col("commit_id")).alias("_id"), repo_key(F.col("project_url")).alias("_p")]
    base = written(entries.select(*keep, *keys).where(F.col("_id").isNotNull()), "keys")
    full, begin = F.length("_id") == 40, F.substring("_id", 1, 7).alias("_k")
    short = base.where(~full)
    names = short.where(F.col("_p").isNotNull()).select("_p", begin, "_id").distinct()
    known = base.where(full & F.col("_p").isNotNull()).select("_p", begin, F.col("_id").alias("_f"))
    starts = names.select("_p", "_k").distinct()
    if short.count() <= few:
        names, starts = F.broadcast(names), F.broadcast(starts)
    else:
        known = known.distinct()
    known = known.join(starts, ["_p", "_k"], "left_semi").distinct()
    begins = known.join(names, ["_p", "_k"]).where(F.expr("startswith(_f, _id)")).select(F.col("_p").alias("_bp"), F.col("_id").alias("_bi"), "_f")
    own = F.concat_ws("#", F.coalesce("_p", F.lit("")), "_id")
    resolved = short.join(begins, (F.col("_p") == F.col("_bp")) & (F.col("_id") == F.col("_bi")), "left").select(*keep, F.coalesce("_f", own).alias("commit_of"))
    return base.where(full).select(*keep, F.col("_id").alias("commit_of")).unionByName(resolved)
