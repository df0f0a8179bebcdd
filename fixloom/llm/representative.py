"""One surviving record for each group of duplicates, chosen field by field.

The vote of ``consensus`` with weights that rank entries: where each rank outweighs all lower ones together, the value
of the first-ranked entry has the majority in every column of any alignment, so it is the consensus, and nothing has to be
aligned. ``surviving_entries`` finds that entry; weights that do not rank strictly go through ``consensus_fields``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixloom.operators.commits import commit_entries

# Texts that stand in for a missing value (fixed values).
STAND_INS = ("-", "--", "?", "n/a", "na", "none", "null", "nil", "nan", "tbd", "todo", "unknown", "undefined", "pending", "missing", "empty", "(none)", "(null)", "(empty)", "no message", "(no message)")
CVE = r"^CVE-[0-9]{4}-[0-9]{4,}$"
FIELDS = ("cve_ids", "message", "diff", "files_changed", "authored_at", "committed_at")


def usable_text(text: Column) -> Column:
    """Neither NULL, empty, blank nor a stand-in for a missing value."""
    t = F.lower(F.regexp_replace(text, r"^[\s ]+|[\s ]+$", ""))
    return F.coalesce((t != "") & ~t.isin(*STAND_INS), F.lit(False))


def usable_time(at: Column) -> Column:
    """Not NULL and not the zero of the epoch, which stands in for a missing time."""
    return F.coalesce(F.unix_micros(at) != 0, F.lit(False))


def usable(commit: Column, cve_ids: Column) -> dict[str, Column]:
    """For each of ``FIELDS`` whether the entry has a usable value."""
    short = lambda c: F.when(F.length(c) > 64, F.lit("x")).otherwise(c)  # noqa: E731  a long text is blank or real, never a stand-in
    text = lambda c: F.when(F.length(c) > 64, F.coalesce(c.rlike(r"[^\s ]"), F.lit(False))).otherwise(usable_text(short(c)))
    return {
        "cve_ids": F.coalesce(F.exists(cve_ids, lambda c: F.coalesce(F.upper(F.trim(c)).rlike(CVE), F.lit(False))), F.lit(False)),
        "message": text(commit["message"]),
        "diff": text(commit["diff"]),
        "files_changed": F.coalesce(F.exists(commit["files_changed"], usable_text), F.lit(False)),
        "authored_at": usable_time(commit["authored_at"]),
        "committed_at": usable_time(commit["committed_at"]),
    }


def trust_of(sources: Column, catalogue: DataFrame, most: int = 10_000) -> Column:
    """Smallest ``trust`` of the sources, after all others if none is in the catalogue (checked: ``most`` rows)."""
    rows = catalogue.select("src_dataset", "trust").where("src_dataset IS NOT NULL AND trust IS NOT NULL").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the catalogue has more than {most} sources")
    last = F.lit(2_147_483_647)
    if not rows:
        return last
    table = F.create_map(*(F.lit(x) for r in rows for x in (r[0], int(r[1]))))
    return F.coalesce(F.array_min(F.transform(sources, lambda s: F.coalesce(table[F.coalesce(s, F.lit(""))], last))), last)


def surviving_entries(entries: DataFrame, catalogue: DataFrame, least: int = 2) -> DataFrame:
    """``first_id, n_entries, commit_of, function_name, <field>_id``: for each group the entry whose value survives.

    A group is all entries of one commit with equal ``function_name`` (NULL equals NULL), if it has ``least`` of
    them. Among a field's usable values the most trusted source wins, then the latest ``ingested_at`` (NULL last),
    then the smallest ``entry_id``; NULL if none is usable. Texts are judged where they are read: only ids, ranks
    and six flags are shuffled, and min over (trust, age, id) combines map-side, so a group with a third of the rows
    costs one row for each task. Entries without a commit id belong to no group.
    """
    rows = entries.select(
        "entry_id", "project_url", "commit_id", "function_name",
        F.struct(trust_of(F.col("src_datasets"), catalogue).alias("t"), F.coalesce(-F.unix_micros("ingested_at"), F.lit(2**63 - 1)).alias("a"), F.col("entry_id").alias("e")).alias("_rank"),
        *(ok.alias(f"_{f}") for f, ok in usable(F.col("commit"), F.col("cve_ids")).items()),
    )
    keyed = commit_entries(rows, "entry_id", "function_name", "_rank", *(f"_{f}" for f in FIELDS))
    groups = keyed.groupBy("commit_of", "function_name").agg(
        F.min("entry_id").alias("first_id"), F.count(F.lit(1)).alias("n_entries"), *(F.min(F.when(F.col(f"_{f}"), F.col("_rank"))).alias(f"_{f}") for f in FIELDS)
    )
    return groups.where(F.col("n_entries") >= least).select("first_id", "n_entries", "commit_of", "function_name", *(F.col(f"_{f}.e").alias(f"{f}_id") for f in FIELDS))


def found(entries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``first_id, field_name, entry_id``."""
    winners = surviving_entries(entries, catalogue)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_id").alias("entry_id")) for f in FIELDS)))
    return winners.select("first_id", each.alias("_w")).select("first_id", "_w.field_name", "_w.entry_id").where(F.col("entry_id").isNotNull())
