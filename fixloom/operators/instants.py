"""Texts in mixed formats and zones -> one instant in UTC; zones of clocks estimated where nobody names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixloom.functions.instants import EPOCH, read_instant, utc_micros
from fixloom.operators.skew import salted_join
from fixloom.runtime import written

# Offset histories that are tried for a clock whose zone is not known (a parameter, not a fixed list).
CANDIDATES = (
    "UTC", "Europe/London", "Europe/Berlin", "Europe/Helsinki", "Europe/Moscow", "Asia/Dubai", "Asia/Kolkata", "Asia/Shanghai", "Asia/Tokyo",
    "Australia/Adelaide", "Australia/Sydney", "Pacific/Auckland", "America/Sao_Paulo", "America/Halifax", "America/New_York", "America/Chicago",
    "America/Denver", "America/Los_Angeles",
)


_DAY = 86_400_000_000


def _lag(zone: str) -> Column:
    """From the wall time, read in ``zone``, to the ingestion, in microseconds."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col("_w.wall"))
    return F.col("_in") - F.timestamp_diff("MICROSECOND", F.expr(EPOCH), utc)


def _phases(known: DataFrame, bins: int, least: int, times: int) -> DataFrame:
    """``_s, steady``: the bins of the day in which the lags of times with a zone crowd, by source.

    A source with fewer than ``least`` such times takes those of all sources together (``_s`` NULL and ``_all``).
    """
    phase = F.floor(F.pmod(F.col("_lag"), F.lit(_DAY)) / (_DAY // bins)).cast("int")
    counts = known.select("_s", phase.alias("b")).groupBy("_s", "b").agg(F.count(F.lit(1)).alias("k"))
    chance = lambda k, n: k * (F.log(n / k / bins) + 1) + F.log(F.lit(bins))  # noqa: E731  logarithm of the odds that any bin is so full by chance
    crowd = lambda rows, *keys: rows.groupBy(*keys).agg(F.sum("k").alias("n"), F.collect_list(F.struct("b", "k")).alias("all")).select(*keys, "n", F.transform(F.filter("all", lambda x: (x["k"] * bins >= F.col("n") * times) & (chance(x["k"], F.col("n")) < -7)), lambda x: x["b"]).alias("steady"))
    own = crowd(counts, "_s").where(F.col("n") >= least).select("_s", F.lit(False).alias("_all"), "steady")
    return own.unionByName(crowd(counts.groupBy("b").agg(F.sum("k").alias("k")).withColumn("_s", F.lit(None).cast(counts.schema["_s"].dataType)), "_s").select("_s", F.lit(True).alias("_all"), "steady"))


def estimate_zones(
    df: DataFrame, source: str, texts: list[str], ingested: str, candidates: tuple[str, ...] = CANDIDATES, slack_s: int = 60, tolerance: float = 0.01, most_early: float = 0.1,
    bins: int = 288, crowd: int = 10, least: int = 50, few: int = 10_000,
) -> DataFrame:
    """``source, zone, n_local, n_violations``: the offset history under which a source's zone-less times fit best.

    An instant comes before its ingestion, and a source takes in its records at a steady pace. Each candidate reads
    every zone-less time of the source; a time violates it if the lag to the ingestion is below ``-slack_s``, or if the
    lag is off the steady pace. The pace is no assumption: it is learned from the times that name their zone (of the
    source if it has ``least``, else of all), as the bins of the day in which their lags crowd (``crowd`` times an even
    share, and one in a thousand by chance); where they do not, or no time names a zone, order alone counts. Of the
    candidates within ``tolerance`` of the fewest violations the one with the smallest lags wins, as a later reading
    that still breaks no order is the tighter one; then the earlier in ``candidates``.

    ``zone`` is NULL where none fits: without a pace if more than ``most_early`` of the times come after their ingestion,
    with one if no more lags keep it than twice what chance would. Each row meets the fixed list of candidates in its
    own task and only (source, candidate) sums are shuffled, so a source with a third of the rows costs nothing
    extra; the paces of up to ``few`` sources are broadcast, those of more are joined. Times that are no time or lack an ingestion say nothing. A source without zone-less times gets no row; NULL is a
    source of its own. Empty input gives no rows.
    """
    per_text = [read_instant(F.col(text)) for text in texts]
    read = df.where(F.col(ingested).isNotNull()).select(F.col(source).alias("_s"), F.unix_micros(F.col(ingested)).alias("_in"), F.explode(F.array(*per_text)).alias("_w"))
    known = read.where(F.col("_w.epoch_us").isNotNull() | (F.col("_w.zone").isNotNull() & (F.col("_w.zone") != "?") & F.col("_w.wall").isNotNull()))
    utc = F.coalesce("_w.epoch_us", F.timestamp_diff("MICROSECOND", F.expr(EPOCH), F.convert_timezone(F.col("_w.zone"), F.lit("UTC"), F.col("_w.wall"))))
    phases = written(_phases(known.select("_s", (F.col("_in") - utc).alias("_lag")), bins, least, crowd), "phases")
    common = next((list(r["steady"]) for r in phases.where("_all").collect()), [])  # one row of at most ``bins``
    own = phases.where("NOT _all").select(F.col("_s").alias("_of"), F.col("steady").alias("_own"))
    own = F.broadcast(own) if own.count() <= few else own  # a row for each source
    pace = F.coalesce("_own", F.array(*(F.lit(x) for x in common)).cast("array<int>"))

    local = read.where(F.col("_w.zone").isNull() & F.col("_w.wall").isNotNull() & F.col("_w.epoch_us").isNull())
    local = local.join(own, F.col("_s").eqNullSafe(F.col("_of")), "left").withColumn("_pace", pace)
    local = local.select("_s", F.size("_pace").alias("_k"), "_pace", *(_lag(z).alias(f"_l{i}") for i, z in enumerate(candidates)))
    sums = []
    for i in range(len(candidates)):
        lag = F.col(f"_l{i}")
        phase = F.floor(F.pmod(lag + F.lit(slack_s * 1_000_000), F.lit(_DAY)) / (_DAY // bins)).cast("int")
        exact = F.floor(F.pmod(lag, F.lit(_DAY)) / (_DAY // bins)).cast("int")
        off = (F.col("_k") > 0) & ~F.array_contains("_pace", phase) & ~F.array_contains("_pace", exact)
        sums += [F.sum(((lag < -slack_s * 1_000_000) | off).cast("long")).alias(f"_v{i}"), F.sum(lag.cast("double")).alias(f"_t{i}")]
    counts = local.groupBy("_s").agg(F.count(F.lit(1)).alias("n_local"), F.max("_k").alias("_k"), *sums)
    each = F.array(*(F.struct(F.col(f"_v{i}").alias("bad"), F.col(f"_t{i}").alias("lag"), F.lit(i).alias("i"), F.lit(z).alias("zone")) for i, z in enumerate(candidates)))
    fewest = F.array_min(F.transform(each, lambda c: c["bad"]))
    near = F.filter(each, lambda c: c["bad"] <= fewest + F.col("n_local") * tolerance)
    best = F.array_min(F.transform(near, lambda c: F.struct(c["lag"], c["i"], c["bad"], c["zone"])))
    rows = counts.select(F.col("_s").alias(source), best.alias("_b"), "n_local", "_k")
    kept = F.when(F.col("_k") == 0, F.col("_b.bad") <= F.col("n_local") * most_early).otherwise(F.col("n_local") - F.col("_b.bad") > 2 * F.col("n_local") * F.col("_k") / bins)
    return rows.select(source, F.when(kept, F.col("_b.zone")).alias("zone"), "n_local", F.col("_b.bad").alias("n_violations"))


def source_zones(df: DataFrame, source: str, texts: list[str], ingested: str, catalogue: DataFrame) -> DataFrame:
    """``source, zone`` of every source: the catalogue's (NULL there: UTC), else the estimate, else UTC.

    A source listed twice takes the smaller zone. Only if ``df`` has sources that the catalogue lacks are their zones
    estimated, from their rows alone.
    """
    listed = catalogue.where(F.col(source).isNotNull()).groupBy(source).agg(F.coalesce(F.min("local_tz"), F.lit("UTC")).alias("zone"))
    unlisted = df.select(source).where(F.col(source).isNotNull()).distinct().join(listed.select(source), source, "left_anti")
    if unlisted.isEmpty():
        return listed
    own = df.join(unlisted, source, "left_semi")
    return listed.unionByName(estimate_zones(own, source, texts, ingested).where("zone IS NOT NULL").select(source, "zone"))


def zone_report(df: DataFrame, source: str, texts: list[str], ingested: str, catalogue: DataFrame) -> DataFrame:
    """``source, zone, listed, differs``: the estimated zone of each source beside the catalogue's (UTC if that has none)."""
    listed = catalogue.where(F.col(source).isNotNull()).groupBy(source).agg(F.coalesce(F.min("local_tz"), F.lit("UTC")).alias("listed"))
    rows = estimate_zones(df, source, texts, ingested).join(listed, source, "left")
    return rows.select(source, "zone", "listed", (~F.col("zone").eqNullSafe(F.col("listed"))).alias("differs"))


def normalise_instants(df: DataFrame, key: str, source: str, texts: list[str], ingested: str, catalogue: DataFrame, most: int = 10_000) -> DataFrame:
    """``key, field_name, epoch_us``: a row for each text of each row that denotes an existing date and time.

    NULL, empty, nonsense and impossible dates give no row; repeated rows give repeated rows; a source that is
    NULL, or has neither a catalogue entry nor a zone that fits its times, counts as UTC. The zones of up to ``most``
    sources become a literal map, so that one pass without a shuffle is all; those of more are joined, salted.
    """
    zones = source_zones(df, source, texts, ingested, catalogue)
    few = zones.limit(most + 1).collect()
    if len(few) > most:
        rows = salted_join(df.select(source, key, *texts), zones.withColumnRenamed("zone", "_zone"), source, F.col(key))
        zone = F.coalesce("_zone", F.lit("UTC"))
    else:
        rows = df
        table = sorted((r[0], r[1]) for r in few)
        zone = F.coalesce(F.create_map(*(F.lit(x) for kv in table for x in kv))[F.coalesce(F.col(source), F.lit(""))], F.lit("UTC")) if table else F.lit("UTC")
    values = F.array(*(F.struct(F.lit(t).alias("field_name"), utc_micros(F.col(t), zone).alias("epoch_us")) for t in texts))
    return rows.select(F.col(key), F.explode(values).alias("_v")).select(key, "_v.field_name", "_v.epoch_us").where(F.col("epoch_us").isNotNull())
