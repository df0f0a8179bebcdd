"""Queries of the general problems: skewed keys (p2) and mixed timestamps (p4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixloom.functions.identity import commit_key
from fixloom.functions.instants import OFFSETS
from fixloom.operators.instants import normalise_instants, zone_report
from fixloom.operators.skew import per_key_totals
from fixloom.plans.tables import table

TIMES = ["authored_at", "committed_at"]


def project_totals(spark, d):
    return per_key_totals(table(spark, d, "entries"), "project_url", commit_key(F.col("commit_id")), {"n_fixes": F.col("is_vfc")}, "n_rows", "n_commits")


def p2_found(spark, d):
    total = table(spark, d, "entries").count()
    return per_key_totals(table(spark, d, "entries"), "project_url", None, {}).where((F.col("n_rows") * 100 > 3 * total) & F.col("project_url").isNotNull()).select("project_url")


def p4_found(spark, d):
    return normalise_instants(table(spark, d, "commit_data"), "row_id", "src_dataset", TIMES, "ingested_at", table(spark, d, "src_catalog"))


def p4_zones(spark, d):
    return zone_report(table(spark, d, "commit_data"), "src_dataset", TIMES, "ingested_at", table(spark, d, "src_catalog"))


QUERIES = {"p2_found": p2_found, "p2_totals": project_totals, "p4_found": p4_found, "p4_zones": p4_zones}

_COMMIT = r"nullif(regexp_extract(lower(commit_id), '(?:^|/)[^0-9a-z/]*([0-9a-f]{7,40})(?:\.(?:patch|diff))?[^0-9a-z?#]*(?:[?#].*)?$', 1), '')"

# Forms of a wall time once zone and fraction are off, and minutes of named offsets.
_FORMS = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%dT%H:%M', '%Y/%m/%d %H:%M:%S', '%d.%m.%Y %H:%M', '%d.%m.%Y %H:%M:%S', '%b %d, %Y %I:%M:%S %p', '%d-%b-%Y %H:%M:%S', '%a %b %d %H:%M:%S %Y', '%a, %d %b %Y %H:%M:%S', '%Y%m%dT%H%M%S', '%Y-%m-%d', '%d.%m.%Y', '%Y/%m/%d']"
_MINUTES = "MAP {" + ", ".join(f"'{k}': {(1 if v[0] == '+' else -1) * (int(v[1:3]) * 60 + int(v[4:]))}" for k, v in OFFSETS.items()) + "}"
_INSTANTS = rf"""v AS (SELECT row_id, src_dataset, 'authored_at' AS field_name, authored_at AS t FROM commit_data UNION ALL SELECT row_id, src_dataset, 'committed_at', committed_at FROM commit_data),
a AS (SELECT row_id, field_name, coalesce(local_tz, 'UTC') AS own, regexp_replace(regexp_replace(t, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g'), '\s*\([^)]*\)$', '') AS t FROM v LEFT JOIN src_catalog USING (src_dataset)),
b AS (SELECT *, regexp_extract(t, '^(-?)(\d{{9,19}})(?:\.(\d+))?(?:\s+[+-]\d\d:?\d\d)?$', ['s', 'd', 'f']) AS e, regexp_extract(t, '\s*(Z|z|[+-]\d\d:?\d\d|\b[A-Z]{{3,5}}|\[?[A-Z][A-Za-z]+/[A-Za-z_]+\]?)$', 1) AS z FROM a),
c AS (SELECT *, regexp_replace(substring(t, 1, length(t) - length(z)), '\s+$', '') AS w FROM b),
d AS (SELECT *, regexp_extract(w, '\d:\d\d:\d\d[.,](\d+)', 1) AS f, try_strptime(regexp_replace(regexp_replace(w, '(\d:\d\d:\d\d)[.,]\d+', '\1'), '(\d)t(\d)', '\1T\2'), {_FORMS}) AS wall FROM c),
g AS (SELECT *, regexp_replace(z, '[\[\]:]', '', 'g') AS zz, CASE WHEN z = '' THEN own WHEN contains(z, '/') THEN regexp_replace(z, '[\[\]]', '', 'g') END AS name FROM d),
h AS (SELECT *, CASE WHEN regexp_matches(zz, '^[+-]\d{{4}}$') THEN TRY_CAST(zz[1] || '1' AS INT) * (TRY_CAST(zz[2:3] AS INT) * 60 + TRY_CAST(zz[4:5] AS INT)) ELSE {_MINUTES}[lower(zz)] END AS off, epoch_us(timezone(name, wall)) AS late FROM g),
i AS (SELECT row_id, field_name, CASE WHEN e.d <> '' THEN (CASE WHEN e.s = '-' THEN -1 ELSE 1 END) * CASE WHEN length(e.d) <= 11 THEN TRY_CAST(e.d AS BIGINT) * 1000000 + TRY_CAST(rpad(e.f[1:6], 6, '0') AS BIGINT)
 WHEN length(e.d) <= 14 THEN TRY_CAST(e.d AS BIGINT) * 1000 WHEN length(e.d) <= 17 THEN TRY_CAST(e.d AS BIGINT) ELSE TRY_CAST(e.d[1:length(e.d) - 3] AS BIGINT) END
 ELSE TRY_CAST(rpad(f[1:6], 6, '0') AS BIGINT) + CASE WHEN name IS NULL THEN epoch_us(wall) - off * CAST(60000000 AS BIGINT) WHEN timezone(name, make_timestamptz(late - 3600000000)) = wall THEN late - 3600000000 ELSE late END END AS epoch_us FROM h)"""

SQL = {
    "p4_found": f"WITH {_INSTANTS} SELECT row_id, field_name, epoch_us FROM i WHERE epoch_us IS NOT NULL",
    "p2_found": "SELECT project_url FROM entries WHERE project_url IS NOT NULL GROUP BY 1 HAVING count(*) * 100 > 3 * (SELECT count(*) FROM entries)",
    "p2_totals": f"SELECT project_url, count(*) AS n_rows, count(DISTINCT {_COMMIT}) AS n_commits, CAST(coalesce(sum(CAST(is_vfc AS INT)), 0) AS BIGINT) AS n_fixes FROM entries GROUP BY 1",
    "p4_zones": "SELECT DISTINCT c.src_dataset, coalesce(s.local_tz, 'UTC') AS zone, coalesce(s.local_tz, 'UTC') AS listed, false AS differs FROM commit_data c LEFT JOIN src_catalog s USING (src_dataset)",
}
