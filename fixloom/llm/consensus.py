"""Best representative by token-level consensus: align the values of a group, vote token by token, keep the closest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixloom.llm.representative import CVE, FIELDS, trust_of, usable, usable_text
from fixloom.operators.commits import commit_entries
from fixloom.runtime import written

_TOKEN = re.compile(r"\w+|[^\w\s]")
GAP = ""
# Between the members of a set; texts are cut into words and marks instead.
SEP, TEXTS = "\u0001", ("message", "diff")


def agreed(values: list[list[str]], weights: list[float]) -> list[str]:
    """Progressive alignment, the heaviest value first: columns hold weighted tokens, gaps vote as well."""
    order = sorted(range(len(values)), key=lambda i: (-weights[i], i))
    columns = [Counter({t: weights[order[0]]}) for t in values[order[0]]]
    placed = weights[order[0]]
    for i in order[1:]:
        profile = [max(c.items(), key=lambda kv: (kv[1], kv[0]))[0] for c in columns]
        merged: list[Counter] = []
        for op, a, b, c, d in SequenceMatcher(None, profile, values[i], autojunk=False).get_opcodes():
            old, new = columns[a:b], values[i][c:d]
            for k in range(max(len(old), len(new))):
                column = old[k] if k < len(old) else Counter({GAP: placed})
                column[new[k] if k < len(new) else GAP] += weights[i]
                merged.append(column)
        columns, placed = merged, placed + weights[i]
    winners = (max(c.items(), key=lambda kv: (kv[1], kv[0]))[0] for c in columns)
    return [t for t in winners if t != GAP]


def closest(texts: list[str], weights: list[float], words: bool = True) -> int:
    """Index of the value most like the consensus; the heavier, then the earlier one at a tie."""
    values = [_TOKEN.findall(t.lower()) if words else t.split(SEP) for t in texts]
    target = agreed(values, weights)
    like = [SequenceMatcher(None, target, v, autojunk=False).ratio() for v in values]
    return max(range(len(texts)), key=lambda i: (like[i], weights[i], -i))


def _vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by chunk -> one row a chunk, with the whole weight of it."""
    names = ["g", "field", "text", "weight", "entry_id"]
    rows = (r for b in batches for r in b.itertuples(index=False, name=None))
    out = []
    for (g, field, _), chunk in groupby(rows, key=lambda r: r[:3]):
        seen: dict[str, tuple] = {}
        for m in chunk:
            seen.setdefault(m[3], m)  # a repeated row has brought its text twice
        members = list(seen.values())
        best = members[closest([m[3] for m in members], [m[4] for m in members], field in TEXTS)] if len(members) > 1 else members[0]
        out.append((g, field, best[3], sum(m[4] for m in members), best[5]))
        if len(out) >= 1000:
            yield pd.DataFrame(out, columns=names)
            out = []
    yield pd.DataFrame(out, columns=names)


def field_texts() -> dict[str, Column]:
    """For each field of a record its usable value as one text, else NULL; sets are sorted and distinct."""
    ok = usable(F.col("commit"), F.col("cve_ids"))
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(F.array_sort(F.array_distinct(a)), SEP))
    values = {
        "cve_ids": joined(F.filter(F.transform("cve_ids", lambda c: F.upper(F.trim(c))), lambda c: F.coalesce(c.rlike(CVE), F.lit(False)))),
        "message": F.col("commit.message"), "diff": F.col("commit.diff"), "files_changed": joined(F.filter("commit.files_changed", usable_text)),
        "authored_at": F.unix_micros("commit.authored_at").cast("string"), "committed_at": F.unix_micros("commit.committed_at").cast("string"),
    }
    return {f: F.when(ok[f], values[f]) for f in FIELDS} | {"src_datasets": joined(F.filter("src_datasets", usable_text))}


def _digest(text: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def ballots(entries: DataFrame, catalogue: DataFrame, texts: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups (``g, first_id``), votes (``g, field, d, weight, entry_id``, a row for each distinct value) and counts
    (``g, field, k, major, entry_id``: values, whether one has the majority, the heaviest one's smallest entry).
    """
    each = F.array(*(F.struct(F.lit(f).alias("field"), t.alias("text")) for f, t in texts.items()))
    weight = F.lit(1.0) / F.greatest(trust_of(F.col("src_datasets"), catalogue), F.lit(1))
    digests = F.transform(F.filter(each, lambda x: x["text"].isNotNull()), lambda x: F.struct(x["field"].alias("field"), _digest(x["text"]).alias("d")))
    keyed = commit_entries(entries.select("entry_id", "project_url", "commit_id", "function_name", weight.alias("weight"), digests.alias("digests")), "entry_id", "function_name", "weight", "digests")
    key = _digest(F.concat_ws("\u0001", F.col("commit_of"), F.coalesce("function_name", F.lit("\u0000"))))
    keyed = written(keyed.select(key.alias("g"), "entry_id", "weight", "digests"), "keyed")
    groups = written(keyed.groupBy("g").agg(F.min("entry_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "first_id"), "groups")
    flat = keyed.select("g", "entry_id", "weight", F.inline("digests"))
    votes = flat.groupBy("g", "field", "d").agg(F.round(F.sum("weight"), 9).alias("weight"), F.min("entry_id").alias("entry_id")).join(groups.select("g"), "g", "left_semi")
    votes = written(votes, "votes")
    heaviest = F.max(F.struct("weight", (-F.col("entry_id")).alias("e")))
    sizes = votes.groupBy("g", "field").agg(F.count(F.lit(1)).alias("k"), F.sum("weight").alias("all"), heaviest.alias("top"))
    sizes = written(sizes.select("g", "field", "k", (F.col("top.weight") * 2 > F.col("all") + 1e-6).alias("major"), (-F.col("top.e")).alias("entry_id")), "sizes")
    return groups, votes, sizes.withColumn("major", F.col("major") | (F.col("k") == 1))


def consensus_fields(entries: DataFrame, catalogue: DataFrame, texts: dict[str, Column], chunk: int = 32, few: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Groups (``g, first_id``) of entries of one commit and function, and winners (``g, field, entry_id``): for each
    of the fields ``texts`` the entry whose value agrees best with the others of its group.

    A value votes with the sum of 1/trust of its entries; equal values are counted together first, map-side and by
    digest, so a group with a third of all rows shrinks to its distinct values. A value with more than half of the
    weight of its group wins every column of any alignment, so the consensus is that value, and it is taken without
    reading a text. Only where no value has that are the values aligned: their entries (``entry_id`` alone is
    broadcast, up to ``few``) give their texts, nothing else is shuffled. More distinct values than ``chunk`` vote in
    rounds: chunks of that size by hash, each sending its winner on with the whole weight of the chunk, until one is
    left. So no task ever holds more than one chunk of a group. Fields without a usable value, and entries without
    commit id, give no winner. Ties go to the heavier, then the smaller entry. Texts are read whole, however long;
    aligning two grows with the product of their lengths at worst.
    """
    groups, votes, sizes = ballots(entries, catalogue, texts)
    done = sizes.where("major").select("g", "field", "entry_id")
    each = F.array(*(F.struct(F.lit(f).alias("field"), t.alias("text")) for f, t in texts.items()))
    contested = written(votes.join(sizes.where("NOT major").select("g", "field"), ["g", "field"], "left_semi"), "contested")
    wanted = contested.select("entry_id").distinct()
    wanted = F.broadcast(wanted) if contested.count() <= few else wanted
    values = entries.join(wanted, "entry_id", "left_semi").select("entry_id", F.inline(each)).where("text IS NOT NULL").select("entry_id", "field", "text", _digest(F.col("text")).alias("d"))
    votes = written(contested.join(values, ["entry_id", "field", "d"]).select("g", "field", "text", "weight", "entry_id"), "votes")
    while True:
        sizes = votes.groupBy("g", "field").agg(F.count(F.lit(1)).alias("k"))
        done = done.unionByName(votes.join(sizes.where("k = 1").select("g", "field"), ["g", "field"], "left_semi").select("g", "field", "entry_id"))
        many = votes.join(sizes.where("k > 1"), ["g", "field"])
        if many.isEmpty():
            break
        part = F.pmod(F.xxhash64("text"), F.ceil(F.col("k") / F.lit(chunk)).cast("long"))
        cut = many.select("g", "field", part.alias("part"), "text", "weight", "entry_id").repartition("g", "field", "part").sortWithinPartitions("g", "field", "part", F.desc("weight"), "entry_id")
        votes = written(cut.mapInPandas(_vote, "g binary, field string, text string, weight double, entry_id long"), "votes")
    return groups, done


def consensus_values(entries: DataFrame, catalogue: DataFrame, value: Column, is_usable: Column, chunk: int = 32) -> DataFrame:
    """``first_id, entry_id``: for each group the entry whose text agrees best; see ``consensus_fields``."""
    groups, done = consensus_fields(entries, catalogue, {"message": F.when(is_usable, value)}, chunk)
    return groups.join(done, "g").select("first_id", "entry_id")


def consensus_records(entries: DataFrame, catalogue: DataFrame, chunk: int = 32) -> DataFrame:
    """One record for each group of two entries or more, every field from the entry whose value of it agrees best.

    ``first_id``, its project, commit id and function; the fields of ``FIELDS`` and ``src_datasets``, NULL without any
    usable value. An entry that wins fields is joined once, whatever their number, and only the values that won go on.
    """
    texts = field_texts()
    groups, done = consensus_fields(entries, catalogue, texts, chunk)
    fields = [*texts, ""]
    winners = done.join(groups, "g").select("g", "first_id", "entry_id", "field").unionByName(groups.select("g", "first_id", F.col("first_id").alias("entry_id"), F.lit("").alias("field")))
    chosen = F.expr(" | ".join(f"bit_or(CASE WHEN field = '{f}' THEN {1 << i} ELSE 0 END)" for i, f in enumerate(fields)))
    picks = winners.groupBy("g", "first_id", "entry_id").agg(chosen.alias("_chosen"))
    of = {"project_url": "", "commit_id": "", "function_name": ""} | {f: f for f in texts}
    commit = F.col("commit")
    columns = {c: commit[c] if c in FIELDS and c != "cve_ids" else F.col(c) for c in of}
    rows = picks.join(entries.select("entry_id", *(v.alias(c) for c, v in columns.items())), "entry_id")
    kept = [F.when(F.col("_chosen").bitwiseAND(F.lit(1 << fields.index(f))) != 0, F.col(c)).alias(c) for c, f in of.items()]
    return rows.select("g", "first_id", *kept).groupBy("g").agg(F.min("first_id").alias("first_id"), *(F.first(c, ignorenulls=True).alias(c) for c in of)).drop("g")


def consensus_messages(entries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``first_id, entry_id`` of the commit message that agrees best with the others of its group."""
    return consensus_values(entries, catalogue, F.col("commit.message"), usable(F.col("commit"), F.col("cve_ids"))["message"])


def majorities(entries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``first_id, field_name, n_values, entry_id``: for each field with a usable value the entry whose value has the
    majority of its group's weight, NULL where none has it and the values have to be aligned.
    """
    groups, _, sizes = ballots(entries, catalogue, field_texts())
    return sizes.join(groups, "g").select("first_id", F.col("field").alias("field_name"), F.col("k").alias("n_values"), F.when(F.col("major"), F.col("entry_id")).alias("entry_id"))
