"""SQL of the queries of problems tagged llm, over whole tables."""

from __future__ import annotations

from fixloom.llm.representative import STAND_INS
from fixloom.plans.curation import COMPONENTS, URL_KEY

_ID = r"nullif(regexp_extract(lower(commit_id), '(?:^|/)[^0-9a-z/]*([0-9a-f]{7,40})(?:\.(?:patch|diff))?[^0-9a-z?#]*(?:[?#].*)?$', 1), '')"
KEYED = f"""base AS (SELECT *, {_ID} AS id, {URL_KEY} AS proj FROM entries),
known AS (SELECT DISTINCT proj AS kp, id AS kf, id[1:7] AS k7 FROM base WHERE length(id) = 40 AND proj IS NOT NULL),
keyed AS (SELECT base.*, id AS commit_of FROM base WHERE length(id) = 40
 UNION ALL SELECT base.*, coalesce(kf, concat_ws('#', coalesce(proj, ''), id)) FROM base LEFT JOIN known ON proj = kp AND id[1:7] = k7 AND starts_with(kf, id) WHERE length(id) < 40)"""
_OUT = ", ".join(f"'{s}'" for s in STAND_INS)
_TEXT = "({t} IS NOT NULL AND regexp_replace({t}, '^\\s+|\\s+$', '', 'g') <> '' AND lower(regexp_replace({t}, '^\\s+|\\s+$', '', 'g')) NOT IN (" + _OUT + "))"
_FLAGS = {
    "cve_ids": "len([v FOR v IN coalesce(cve_ids, []) IF regexp_full_match(upper(trim(v)), 'CVE-[0-9]{4}-[0-9]{4,}')]) > 0",
    "message": _TEXT.format(t="x.commit.message"), "diff": _TEXT.format(t="x.commit.diff"),
    "files_changed": "len([v FOR v IN coalesce(x.commit.files_changed, []) IF " + _TEXT.format(t="v") + "]) > 0",
    "authored_at": "coalesce(epoch_us(x.commit.authored_at) <> 0, false)", "committed_at": "coalesce(epoch_us(x.commit.committed_at) <> 0, false)",
}
_RANK = "struct_pack(t := coalesce(t, 2147483647), a := coalesce(-epoch_us(ingested_at), 9223372036854775807), e := entry_id)"

_VALUES = {
    "cve_ids": "array_to_string(list_sort(list_distinct([upper(trim(v)) FOR v IN coalesce(cve_ids, []) IF regexp_full_match(upper(trim(v)), 'CVE-[0-9]{4}-[0-9]{4,}')])), '|')",
    "message": "x.commit.message", "diff": "x.commit.diff",
    "files_changed": "array_to_string(list_sort(list_distinct([v FOR v IN x.commit.files_changed IF " + _TEXT.format(t="v") + "])), '|')",
    "authored_at": "CAST(epoch_us(x.commit.authored_at) AS VARCHAR)", "committed_at": "CAST(epoch_us(x.commit.committed_at) AS VARCHAR)",
    "src_datasets": "array_to_string(list_sort(list_distinct([v FOR v IN src_datasets IF " + _TEXT.format(t="v") + "])), '|')",
}
_USABLE = _FLAGS | {"src_datasets": "len([v FOR v IN coalesce(src_datasets, []) IF " + _TEXT.format(t="v") + "]) > 0"}
_BLANK = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def _bare(v: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({v}), '{_BLANK}', '', 'g'), '/{{2,}}', '/', 'g'), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')"


_PAIR = r"""'["'']?([A-Za-z_]+)["'']?\s*(?:=>|[:=])\s*("[^"]*"|''[^'']*''|[^,;|}\n]*)'"""
_RECORDS = f"""x AS (SELECT raw_id, project_url AS p, commit_id AS c, extra, regexp_extract_all(extra, {_PAIR}, 1) AS n, regexp_extract_all(extra, {_PAIR}, 2) AS v FROM raw_records),
rec AS (SELECT raw_id, {_bare('p')} AS p, {_bare('c')} AS c, array_to_string(list_sort([concat({_bare('n[i]')}, '=', {_bare('v[i]')}) FOR i IN range(1, len(n) + 1)]), chr(10)) AS f FROM x),
grp AS (SELECT *, min(raw_id) OVER (PARTITION BY p, c, f) AS first_id FROM rec)"""

SQL = {
    "p5_majority": f"""WITH {KEYED}, src AS (SELECT entry_id AS e0, min(trust) AS t FROM (SELECT entry_id, unnest(src_datasets) AS s FROM entries) JOIN src_catalog ON s = src_dataset GROUP BY 1),
r AS (SELECT commit_of AS c, coalesce(function_name, chr(1)) AS f, entry_id, CAST(1 AS DOUBLE) / greatest(coalesce(t, 2147483647), 1) AS w, {', '.join(f'CASE WHEN {_USABLE[k]} THEN {v} END AS v_{k}' for k, v in _VALUES.items())} FROM keyed x LEFT JOIN src ON e0 = entry_id),
g AS (SELECT c, f, min(entry_id) AS first_id FROM r GROUP BY 1, 2 HAVING count(*) > 1),
u AS ({' UNION ALL '.join(f"SELECT c, f, '{k}' AS field_name, v_{k} AS v, w, entry_id FROM r WHERE v_{k} IS NOT NULL" for k in _VALUES)}),
vo AS (SELECT c, f, field_name, v, round(sum(w), 9) AS w, min(entry_id) AS entry_id FROM u GROUP BY 1, 2, 3, 4),
z AS (SELECT c, f, field_name, count(*) AS n_values, sum(w) AS al, max(struct_pack(w := w, e := -entry_id)) AS top FROM vo GROUP BY 1, 2, 3)
SELECT first_id, field_name, n_values, CASE WHEN n_values = 1 OR top.w * 2 > al + 1e-6 THEN -top.e END AS entry_id FROM z JOIN g USING (c, f)""",
    "p1_commits": f"WITH {KEYED}, c AS (SELECT commit_of, min(entry_id) AS first_id, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split <> 'train') AS n_held FROM keyed WHERE split IN ('train', 'validation', 'test') GROUP BY 1) SELECT * FROM c WHERE n_train > 0 AND n_held > 0",
    "p7_check": "SELECT count(*) AS n_entries, CAST(0 AS BIGINT) AS n_projects, CAST(0 AS BIGINT) AS n_commits, true AS in_share FROM entries",
    "p8_check": "SELECT target_id, count(DISTINCT doc_id) AS n_documents, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_gaps, CAST(0 AS BIGINT) AS n_cut FROM pack_targets, documents GROUP BY 1",
    "p6_found": f"WITH {_RECORDS} SELECT first_id, raw_id FROM grp WHERE raw_id <> first_id",
    "p6_collapsed": f"WITH {_RECORDS} SELECT first_id, count(*) AS n_copies FROM grp GROUP BY 1",
    "p1_found": f"WITH {KEYED}, p AS (SELECT a.entry_id AS x, b.entry_id AS y FROM keyed a JOIN keyed b ON a.commit_of = b.commit_of WHERE a.split = 'train' AND b.split IN ('validation', 'test')) SELECT least(x, y) AS entry_id_1, greatest(x, y) AS entry_id_2 FROM p",
    "p1_report": f"""WITH {KEYED}, tr AS (SELECT commit_of, count(*) AS n FROM keyed WHERE split = 'train' GROUP BY 1),
h AS (SELECT entry_id, split, src_datasets, coalesce(sum(n), 0) AS n FROM keyed LEFT JOIN tr USING (commit_of) WHERE split IN ('validation', 'test') GROUP BY 1, 2, 3),
u AS (SELECT split, unnest(list_distinct(src_datasets)) AS src_dataset, n FROM h)
SELECT split, src_dataset, count(*) AS n_entries, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaked, CAST(sum(n) AS BIGINT) AS n_pairs FROM u GROUP BY 1, 2""",
    "p3_found": f"WITH RECURSIVE {COMPONENTS}, ends AS (SELECT url1 AS url FROM relationship_edges WHERE url1 IS NOT NULL UNION SELECT url2 FROM relationship_edges WHERE url2 IS NOT NULL) SELECT coalesce(label, ends.url) AS group_url, ends.url FROM ends LEFT JOIN comp ON comp.url = ends.url",
    "p3_sizes": f"WITH RECURSIVE {COMPONENTS}, ends AS (SELECT url1 AS url FROM relationship_edges WHERE url1 IS NOT NULL UNION SELECT url2 FROM relationship_edges WHERE url2 IS NOT NULL) SELECT coalesce(label, ends.url) AS group_url, count(*) AS n_members FROM ends LEFT JOIN comp ON comp.url = ends.url GROUP BY 1",
    "p5_found": f"""WITH {KEYED}, src AS (SELECT entry_id AS e0, min(trust) AS t FROM (SELECT entry_id, unnest(src_datasets) AS s FROM entries) JOIN src_catalog ON s = src_dataset GROUP BY 1),
r AS (SELECT commit_of, function_name, entry_id, {_RANK} AS rank, {', '.join(f'{c} AS f_{f}' for f, c in _FLAGS.items())} FROM keyed x LEFT JOIN src ON e0 = entry_id),
g AS (SELECT min(entry_id) AS first_id, {', '.join(f'min(CASE WHEN f_{f} THEN rank END) AS w_{f}' for f in _FLAGS)} FROM r GROUP BY commit_of, function_name HAVING count(*) > 1)
{' UNION ALL '.join(f"SELECT first_id, '{f}' AS field_name, w_{f}.e AS entry_id FROM g WHERE w_{f} IS NOT NULL" for f in _FLAGS)}""",
    "p7_found": f"""WITH RECURSIVE base AS (SELECT entry_id, {_ID} AS id, {URL_KEY} AS proj FROM entries), pr AS (SELECT DISTINCT proj, id FROM base WHERE length(id) = 40),
lo AS (SELECT id, min(proj) AS a FROM pr GROUP BY 1), ed AS (SELECT DISTINCT a, proj AS b FROM pr JOIN lo USING (id) WHERE a <> proj),
e2 AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), walk AS (SELECT a AS url, a AS label FROM e2 UNION SELECT e2.b, walk.label FROM walk JOIN e2 ON walk.url = e2.a),
comp AS (SELECT url, min(label) AS label FROM walk GROUP BY 1) SELECT coalesce(label, proj) AS group_url, entry_id FROM base LEFT JOIN comp ON proj = url""",
}
