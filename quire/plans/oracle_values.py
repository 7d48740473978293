"""Equivalent SQL of the queries on fields that hold several values."""

from __future__ import annotations

HEADS = "['reference signs', 'bezugszeichen', 'classes', 'klassen', 'cited documents', 'entgegenhaltungen', 'keywords', 'stichwörter']"
HEAD = "reference signs|bezugszeichen|classes|klassen|cited documents|entgegenhaltungen|keywords|stichw[öÖ]rter"
# Marks of quoted values, of the two kinds of quotes, and of slashes inside of class symbols; the tables hold none of these signs.
MARK, SIDE, HELD = "chr(57601)", "chr(57602)", "chr(57603)"
DELIMITER = r"[,;|·•+&\t\n\r]|/|\s{2,}"
OPENS = r"(^|[,;|/·•+&\t\n\r]\s?|\s\s)\s*"
QUOTED = OPENS + r"""(?:"((?:[^"]|"")*)"|''((?:[^'']|'''')*)'')""" + rf"(\s*(?:$|{DELIMITER}))"


def values(text: str, is_class: str) -> str:
    """Values of a field: slashes between digits are hidden for classes, quoted values marked (twice, as matches share delimiters), the rest split."""
    slash = rf"regexp_replace({{x}}, '([0-9])/([0-9])', '\1' || {HELD} || '\2', 'g')"
    hidden = f"case when {is_class} then {slash.format(x=slash.format(x=text))} else {text} end"
    mark = rf"regexp_replace(HERE, '{QUOTED}', '\1' || {MARK} || '\2' || {SIDE} || '\3' || {MARK} || '\4', 'g')"
    pieces = f"string_split({mark.replace('HERE', mark.replace('HERE', hidden))}, {MARK})"
    literal = f"""trim(replace(split_part(p, {SIDE}, 1), '""', '"') || replace(split_part(p, {SIDE}, 2), '''''', ''''))"""
    plain = rf"[regexp_replace(v, '^\s+|\s+$', '', 'g') for v in regexp_split_to_array(p, '{DELIMITER}')]"
    return f"[replace(v, {HELD}, '/') for v in flatten([case when i % 2 = 0 then [{literal}] else {plain} end for p, i in {pieces}]) if v <> '']"


def oracle_sql() -> dict[str, str]:
    base = rf"""with t as (select distinct doc_id, element_id record_id, table_data.cell_rows cells, table_data.source_format f, table_data.header_row h from elements where table_data is not null),
r as (select doc_id, record_id, cells[1] heads, unnest(cells) row_cells, generate_subscripts(cells, 1) - 1 row_no from t where h and len(cells) > 0),
c as (select doc_id, record_id, heads, row_no, unnest(row_cells) cell, generate_subscripts(row_cells, 1) - 1 col_no from r where row_no > 0),
k as (select doc_id, record_id, row_no, col_no, cell, lower(trim(heads[col_no + 1])) head from c where cell is not null),
b as (select distinct doc_id, block_id record_id, raw_text from blocks where regexp_matches(raw_text, '(?im)^[^\S\n]*({HEAD})[^\S\n]*[:=\-‐-―−]')),
l as (select doc_id, record_id, regexp_replace(unnest(string_split(raw_text, chr(10))), '\r$', '') line, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 row_no from b),
m as (select doc_id, record_id, row_no, regexp_extract(line, '(?i)^\s*({HEAD})\s*[:=\-‐-―−]\s*(.*)$', 1) head, regexp_extract(line, '(?i)^\s*({HEAD})\s*[:=\-‐-―−]\s*(.*)$', 2) body from l),
f as (
  select 'cell_rows' field_name, doc_id, record_id, row_no, col_no, cell as text, head in ('classes', 'klassen') is_class from k where list_contains({HEADS}, head)
  union all select 'source_format', doc_id, record_id, 0, 0, f, false from t where f is not null
  union all select 'raw_text', doc_id, record_id, row_no, 0, body, lower(head) in ('classes', 'klassen') from m where head <> ''),
v as (select field_name, doc_id, record_id, row_no, col_no, VALUES vs from f),
u as (select field_name, doc_id, record_id, row_no, col_no, generate_subscripts(vs, 1) - 1 value_no, unnest(vs) "value" from v where len(vs) >= 2)
""".replace("VALUES", values("text", "is_class"))
    return {"p3_values": base + "select * from u", "p3_found": base + "select field_name, doc_id, record_id, row_no, col_no, value_no from u"}
