"""DuckDB SQL for those pN_ queries that SQL can express on whole tables."""

SQL = {
    "p1_found": r"""
        WITH t AS (
            SELECT pmcid, section_no, text, 2000 AS cap FROM paper_section WHERE length(text) > 2000
            UNION ALL SELECT pmcid, 0, body, 24000 FROM paper_fulltext WHERE length(body) > 24000)
        SELECT DISTINCT pmcid, section_no,
            CASE WHEN list_max(list_transform(string_split_regex(text, '[ \t\n]+'), lambda x: length(x))) > cap
                 THEN 'forced' ELSE 'boundary' END AS cut
        FROM t""",
    "p5_agreement": r"""
        WITH l AS (
            SELECT review, work_id, rater_id, created_at,
                CASE lower(regexp_replace(human_decision, '^\s+|\s+$', '', 'g')) WHEN 'include' THEN 1 WHEN 'exclude' THEN 0 END AS y
            FROM overrides),
        f AS (
            SELECT review, work_id, y FROM (
                SELECT *, row_number() OVER (PARTITION BY review, work_id, rater_id ORDER BY created_at DESC, y DESC) AS k
                FROM l WHERE y IS NOT NULL AND rater_id IS NOT NULL) WHERE k = 1),
        i AS (SELECT count(*) AS m, sum(y) AS yes FROM f GROUP BY review, work_id HAVING count(*) > 1),
        s AS (SELECT count(*) AS n_items, CAST(sum(m) AS BIGINT) AS n_labels, sum(yes)::DOUBLE AS yes,
                sum(2.0 * yes * (m - yes) / (m - 1)) / sum(m) AS o FROM i),
        e AS (SELECT *, 2 * yes * (n_labels - yes) / (n_labels::DOUBLE * (n_labels - 1)) AS x FROM s)
        SELECT n_items, n_labels, round(1 - o, 6) AS observed, round(1 - x, 6) AS expected, round(1 - o / x, 6) AS alpha FROM e""",
}
