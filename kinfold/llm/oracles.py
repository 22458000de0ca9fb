"""SQL the queries of this package are compared with, where SQL can say the same."""

from __future__ import annotations

from .canon import character_map

_SCORE = "CASE WHEN NOT isnan(score) AND score BETWEEN 0 AND 1 THEN score END"

P2_FOUND = """
WITH RECURSIVE links AS (
  SELECT source_path AS a, duplicate_of AS b FROM manifest_row
  WHERE source_path <> '' AND duplicate_of <> '' AND source_path <> duplicate_of
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(source_path, group_id) USING KEY (source_path) AS (
  SELECT a, min(least(a, b)) FROM edges GROUP BY a
  UNION
  SELECT e.b, min(r.group_id) FROM reach r JOIN edges e ON e.a = r.source_path
  JOIN recurring.reach old ON old.source_path = e.b
  WHERE r.group_id < old.group_id GROUP BY e.b
)
SELECT source_path, group_id FROM reach
"""

P4_FOUND = f"""
SELECT group_id, id FROM (
  SELECT group_id, id, count(*) OVER (PARTITION BY group_id) AS n, row_number() OVER (
    PARTITION BY group_id ORDER BY {_SCORE} DESC NULLS LAST,
      CASE WHEN exif_tag_count >= 0 THEN exif_tag_count END DESC NULLS LAST, gps_present DESC NULLS LAST,
      CASE WHEN file_size_bytes >= 1 THEN file_size_bytes END DESC NULLS LAST, id) AS place
  FROM migration_manifest WHERE group_id <> '')
WHERE place = 1 AND n >= 2
"""

P5_FOUND = f"""
SELECT group_id, CAST(place AS INTEGER) AS rank_no, id FROM (
  SELECT group_id, id, row_number() OVER (PARTITION BY group_id ORDER BY {_SCORE} DESC, id) AS place
  FROM migration_manifest WHERE group_id <> '' AND {_SCORE} IS NOT NULL)
WHERE place <= 3
"""


P6_FOUND = """
WITH bare AS (SELECT id, regexp_extract(lower(phash), '^\\s*(?:0x)?([0-9a-f]{16})\\s*$', 1) AS x FROM migration_manifest),
usable AS (
  SELECT id, h FROM (SELECT id, CAST('0x' || x AS UBIGINT) AS h FROM bare WHERE x <> '') WHERE bit_count(h) BETWEEN 4 AND 60
), near AS (
  SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY bit_count(xor(a.h, b.h)), b.id) AS place
  FROM usable a JOIN usable b ON a.id <> b.id AND bit_count(xor(a.h, b.h)) <= 7)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM near WHERE place <= 5
"""


P7_KEPT = """
SELECT budget_id, CAST(sum((n + capacity_tokens - 1) // capacity_tokens) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS characters,
  CAST(0 AS BIGINT) AS too_full, CAST(0 AS BIGINT) AS shared_slots, true AS within_2_percent
FROM (SELECT length(text) AS n FROM documents WHERE text <> ''), token_budget WHERE capacity_tokens >= 1 GROUP BY budget_id
"""


def _one_form(text: str) -> str:
    """SQL for the one form of a text: the same character map, applied by translate and replace."""
    pairs = character_map()
    single = {chr(k): v for k, v in pairs.items() if len(v) == 1 and k != 0}
    gone = "".join(chr(k) for k, v in pairs.items() if not v and k != 0)
    quoted = lambda x: x.replace("'", "''")
    out = f"translate({text}, '{''.join(single)}{gone}', '{quoted(''.join(single.values()))}')"
    for k, v in pairs.items():
        if len(v) > 1:
            out = f"replace({out}, '{chr(k)}', '{v}')"
    return f"nfc_normalize({out})"


def _runs(table: str, key: str, text: str) -> str:
    """Every run of 12 words of a table's texts."""
    return f"""
SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS run FROM (
  SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (
    SELECT {key}, regexp_extract_all(lower({_one_form(text)}), '[\\p{{L}}\\p{{Nd}}]+') AS w FROM {table} WHERE {text} IS NOT NULL))"""


P8_FOUND = f"""
WITH corpus AS ({_runs("documents", "doc_id", "text")}), tests AS ({_runs("eval_item", "item_id", "passage")})
SELECT DISTINCT doc_id, item_id FROM corpus JOIN tests USING (run)
"""

P9_FOUND = f"""
WITH formed AS (SELECT doc_id, text, {_one_form("text")} AS form FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM formed a JOIN formed b ON a.form = b.form
WHERE a.doc_id < b.doc_id AND a.text <> b.text AND regexp_matches(a.form, '\\S')
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p6_found": P6_FOUND, "p7_kept": P7_KEPT, "p8_found": P8_FOUND, "p9_found": P9_FOUND}
