"""SQL of the training-data queries for the whole tables, independent of the operators."""

_NUM = "try_cast(nullif(regexp_extract({0}, '([0-9]+)', 1), '') AS BIGINT)"


def _num(c: str) -> str:
    return _NUM.format(c)


_P1 = f"""
WITH RECURSIVE ties AS (
  SELECT DISTINCT {_num('seq')} AS s,
         CASE WHEN tstamp ILIKE '%e%' THEN
           CAST(split_part(lower(trim(tstamp)), 'e', 1) AS DECIMAL(38,18)) * CAST(power(10, CAST(split_part(lower(trim(tstamp)), 'e', 2) AS INT)) AS DECIMAL(18,0))
         ELSE try_cast(trim(tstamp) AS DECIMAL(38,18)) END AS k
  FROM frame_meta),
m AS (SELECT s, CAST(k AS DECIMAL(38,15)) AS k FROM ties WHERE s IS NOT NULL AND k > 0),
links AS (SELECT DISTINCT a.s AS a, b.s AS b FROM m a JOIN m b ON a.k = b.k AND a.s <> b.s),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
grp AS (SELECT a AS s, least(a, min(b)) AS g FROM reach GROUP BY a)
SELECT DISTINCT gt_id, g AS group_seq FROM gt_lines JOIN grp ON grp.s = {_num('seq')} WHERE gt_id IS NOT NULL
"""

_USABLE = """
WITH d AS (SELECT DISTINCT ON (desc_id) desc_id, regexp_replace(lower(road_type), '[^a-z]', '', 'g') AS r,
                  regexp_replace(lower(climate), '[^a-z]', '', 'g') AS c FROM frame_desc WHERE desc_id IS NOT NULL),
u AS (SELECT desc_id, a.tag AS road_type, b.tag AS climate FROM d
      JOIN tag_alias a ON a.field_name = 'road_type' AND a.alias = d.r
      JOIN tag_alias b ON b.field_name = 'climate' AND b.alias = d.c),
n AS (SELECT count(*) // 4 AS n FROM u),
have AS (SELECT road_type, climate, count(*) AS usable FROM u GROUP BY ALL),
rep AS (SELECT t.road_type, t.climate, share_permille, min_rows, coalesce(usable, 0) AS usable,
               CAST(greatest(min_rows, (share_permille * n) // 1000) AS BIGINT) AS quota
        FROM sample_targets t CROSS JOIN n LEFT JOIN have h ON h.road_type = t.road_type AND h.climate = t.climate)
"""

_TERMS = f"""
WITH g AS (SELECT DISTINCT ON (gt_id) gt_id, {_num('seq')} AS s, cls_kw FROM gt_lines WHERE gt_id IS NOT NULL),
f AS (SELECT DISTINCT ON (desc_id) desc_id, {_num('seq')} AS s, road_type, climate FROM frame_desc WHERE desc_id IS NOT NULL),
v AS (SELECT 'cls_kw' AS field_name, s, lower(trim(cls_kw, E' \\t\\r\\n')) AS term FROM g
      UNION ALL SELECT 'road_type', s, lower(trim(road_type, E' \\t\\r\\n')) FROM f
      UNION ALL SELECT 'climate', s, lower(trim(climate, E' \\t\\r\\n')) FROM f),
a AS (SELECT field_name, count(DISTINCT s) AS al FROM v GROUP BY 1),
t AS (SELECT field_name, term, count(*) AS n_rows, count(DISTINCT s) AS n_records FROM v WHERE term <> '' GROUP BY 1, 2),
r AS (SELECT field_name, term, n_rows, n_records,
             CASE WHEN n_rows < 5 THEN 'rare' WHEN 10 * n_records > 6 * al THEN 'common' END AS mark FROM t JOIN a USING (field_name))
"""

_PAIRS = f"""
WITH l AS (SELECT DISTINCT ON (scan_id) scan_id, {_num('seq')} AS e,
      CASE WHEN timestamp_pc > 0 AND NOT isnan(timestamp_pc) AND NOT isinf(timestamp_pc) THEN CAST(round(timestamp_pc * 1000000) AS BIGINT) END AS t
      FROM lidar_frames WHERE scan_id IS NOT NULL),
c AS (SELECT {_num('seq')} AS e, CAST(round(timestamp_img * 1000000) AS BIGINT) AS u, min(image_id) AS image_id FROM camera_frames
      WHERE timestamp_img > 0 AND NOT isnan(timestamp_img) AND NOT isinf(timestamp_img) AND image_id IS NOT NULL GROUP BY 1, 2),
j AS (SELECT scan_id, image_id, abs(t - u) AS gap,
             row_number() OVER (PARTITION BY scan_id ORDER BY abs(t - u), image_id) AS k
      FROM l JOIN c ON c.e = l.e AND c.u BETWEEN l.t - 40000 AND l.t + 40000)
"""

_TOP = f"""
WITH p AS (SELECT DISTINCT ON (pred_id) pred_id, {_num('seq')} AS s, {_num('frame')} AS f, lower(trim(condition)) AS c, score, line_idx
           FROM pred_lines WHERE pred_id IS NOT NULL AND coalesce(cls_kw <> 'dummy', true) AND score IS NOT NULL AND NOT isnan(score)),
r AS (SELECT pred_id, row_number() OVER (PARTITION BY s, f, c ORDER BY score DESC, line_idx ASC NULLS LAST, pred_id) AS place
      FROM p WHERE s IS NOT NULL AND f IS NOT NULL AND c IS NOT NULL)
"""

_SPANS = """
WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, i, substring(text, i, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, n - 198)) AS i FROM t WHERE n >= 200)),
m AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w SEMI JOIN m ON m.s = w.s),
c AS (SELECT doc_id, CAST(sum(least(200, i - coalesce(p, i - 200))) AS INTEGER) AS chars, CAST(count(*) FILTER (p IS NULL OR i > p + 200) AS INTEGER) AS spans FROM h GROUP BY doc_id)
"""

SQL = {
    "p1_found": _P1,
    "p2_found": _USABLE + "SELECT road_type, climate FROM rep WHERE usable < quota",
    "p2_report": _USABLE + "SELECT *, least(usable, quota) AS taken, usable < quota AS exhausted FROM rep",
    "p3_found": _TERMS + "SELECT field_name, term, mark FROM r WHERE mark IS NOT NULL",
    "p3_terms": _TERMS + "SELECT * FROM r",
    "p5_found": _PAIRS + "SELECT scan_id, image_id FROM j WHERE k = 1",
    "p5_pairs": _PAIRS + "SELECT l.scan_id, l.e AS entity_no, j.image_id, j.gap / 1000000 AS gap FROM l LEFT JOIN j ON j.scan_id = l.scan_id AND k = 1",
    "p6_found": _TOP + "SELECT pred_id FROM r WHERE place <= 3",
    "p6_top": _TOP + "SELECT pred_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3",
    "p9_found": _SPANS + "SELECT doc_id FROM c",
    "p9_spans": _SPANS + "SELECT t.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_chars, coalesce(chars, 0) AS shared_chars, CAST(coalesce(chars * 1000 // n, 0) AS INTEGER) AS shared_permille, coalesce(spans, 0) AS n_spans FROM t LEFT JOIN c ON c.doc_id = t.doc_id",
}
