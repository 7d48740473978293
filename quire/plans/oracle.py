"""Equivalent SQL of the document queries, written for another engine and independently of the expressions in use."""

from __future__ import annotations

from . import oracle_elements, oracle_values

SP = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EOL = r"\r\n|[\n\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
LABEL = r"(?i)^(?:(?:page|seite|p\.|s\.)\s*)?(\d{1,5})(?:\s*(?:of|von|/)\s*\d{1,5})?$"
DOTS = r"(?:\s*\.\s*){4,}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SP}+', ' ', 'g')")


def lines(x: str) -> str:
    return f"[{strip('l')} for l in regexp_split_to_array({x}, '{EOL}') if {strip('l')} <> '']"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def number(x: str) -> str:
    return f"try_cast(nullif(regexp_extract({strip(x)}, '{LABEL}', 1), '') as integer)"


SCAN = rf"""scan as (
  select * from (select distinct doc_id, block_id, page_index, page_width, page_height, is_highlighted, bbox.x0 x0, bbox.y0 y0, bbox.x1 x1, bbox.y1 y1,
    regexp_replace(regexp_replace(coalesce(raw_text, ''), '\r\n?', chr(10), 'g'), '^\n+|\n+$', '', 'g') t from blocks) where {strip('t')} <> '')"""
ZONE = "case when y1 <= page_height * 0.12 then 'top' when y0 >= page_height * 0.88 then 'bottom' when x1 <= page_width * 0.22 then 'left' when x0 >= page_width * 0.78 then 'right' end"

PAGES = rf"""sized as (select *, max(page_width) over (partition by doc_id, page_index) w from scan),
side as (select *, (x0 + x1) / 2 / w c from sized),
pairs as (select distinct a.doc_id, a.page_index from side a join side b using (doc_id, page_index) where a.c < 0.45 and b.c > 0.55 and least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 8),
pages as (
  select doc_id, page_index, count(*) text_blocks, sum(length({strip('t')}))::bigint chars, max(w) w, count(*) filter (c < 0.45) l, count(*) filter (c > 0.55) r, count(*) filter (c between 0.45 and 0.55) m,
    min(x0) filter (c > 0.55) - max(x1) filter (c < 0.45) gap, max(greatest(0, x1 - x0)) filter (c < 0.45 or c > 0.55) widest from side group by all),
layouts as (
  select p.doc_id, p.page_index, text_blocks, chars,
    case when coalesce(gap >= greatest(24, w * 0.08) and widest <= w * 0.62, false) and q.doc_id is not null then 'possible_multi_column' when text_blocks < 4 then 'one_column'
      when l >= 2 and r >= 2 and m = 0 then 'possible_multi_column' else 'one_column' end likely_layout
  from pages p left join pairs q on p.doc_id = q.doc_id and p.page_index = q.page_index)"""

PROFILE = """seen as (select doc_id, count(*) native, sum(chars) chars, max(page_index) last, bool_or(likely_layout = 'possible_multi_column') multi from layouts group by 1),
docs as (select doc_id, max(page_count)::bigint page_count from doc_ir group by 1),
profile as (
  select d.doc_id, coalesce(page_count, last + 1, 0)::bigint page_count, coalesce(native, 0)::bigint native_text_page_count, greatest(0, coalesce(page_count, last + 1, 0) - coalesce(native, 0))::bigint no_text_page_count,
    coalesce(chars, 0)::bigint extracted_char_count, case when multi then 'possible_multi_column' when native > 0 then 'one_column' else 'unknown' end likely_layout
  from docs d left join seen s on d.doc_id = s.doc_id)"""

ARTIFACTS = rf"""several as (select doc_id from scan group by 1 having count(distinct page_index) >= 2),
margin as (select s.*, array_to_string({lines('t')}, ' ') line, {ZONE} zone from scan s semi join several using (doc_id)),
labelled as (select *, {number('line')} number from margin where zone is not null),
num as (select *, number - page_index shift, row_number() over (partition by doc_id order by page_index, y0, x0, block_id) seq from labelled where number is not null),
shifts as (select doc_id, shift, count(*) n, min(seq) f from num group by all),
mainshift as (select doc_id, first(shift order by n desc, f) shift, max(n) most from shifts group by 1),
totals as (
  select doc_id, count(*) total, count(*) filter (number = page_index + 1) onpage from num group by 1),
gaps as (select a.doc_id, count(*) n from num a join num b on a.doc_id = b.doc_id and b.seq = a.seq + 1 where b.number <> a.number + 1 group by 1),
numbers as (
  select n.doc_id, n.block_id, n.page_index, 'page_number' artifact_type, n.line as text, n.number, n.y0
  from num n join totals t on n.doc_id = t.doc_id join mainshift m on n.doc_id = m.doc_id left join gaps g on n.doc_id = g.doc_id
  where total >= 2 and (onpage >= 2 or g.n is null or (most >= greatest(3, total // 2) and n.shift = m.shift))),
texts as (select *, {fold(squeeze('line'))} k from labelled where number is null and length(line) between 1 and 120),
groups as (select doc_id, zone, k from texts group by all having count(distinct page_index) >= case when zone in ('left', 'right') then 3 else 2 end),
repeated as (
  select t.doc_id, t.block_id, t.page_index, case zone when 'top' then 'header' when 'bottom' then 'footer' else 'margin_note' end artifact_type, t.line as text, null::integer number, t.y0
  from texts t semi join groups using (doc_id, zone, k)),
artifacts as (select * from numbers union all select * from repeated)"""

KEPT = "kept as (select s.* from scan s anti join artifacts using (doc_id, block_id))"

ORDER = """kw as (select k.*, likely_layout, max(page_width) over (partition by k.doc_id, k.page_index) w from kept k left join layouts l on k.doc_id = l.doc_id and k.page_index = l.page_index),
ks as (select *, (x0 + x1) / 2 / w c from kw),
kpairs as (select distinct a.doc_id, a.page_index from ks a join ks b using (doc_id, page_index) where a.c < 0.45 and b.c > 0.55 and least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 8),
kpages as (
  select doc_id, page_index, any_value(likely_layout) lay, max(w) w, min(x0) filter (c > 0.55) - max(x1) filter (c < 0.45) gap, max(greatest(0, x1 - x0)) filter (c < 0.45 or c > 0.55) widest,
    min(y0) filter (c < 0.45 or c > 0.55) top, max(y1) filter (c < 0.45 or c > 0.55) bottom from ks group by all),
clear as (select k.* from kpages k semi join kpairs using (doc_id, page_index) where lay = 'possible_multi_column' and gap >= greatest(24, w * 0.08) and widest <= w * 0.62),
kr as (
  select ks.*, case when cl.doc_id is null then 9 when c < 0.45 then 1 when c > 0.55 then 2 when y1 <= top then 0 when y0 >= bottom then 3 else 9 end rk
  from ks left join clear cl on ks.doc_id = cl.doc_id and ks.page_index = cl.page_index),
km as (select *, max(rk) over (partition by doc_id, page_index) worst from kr),
ordered as (select *, (row_number() over (partition by doc_id order by page_index, case when worst = 9 then 0 else rk end, round_even(y0, 1), round_even(x0, 1), block_id) - 1)::bigint read_seq from km)"""

HEADS = "('inhaltsverzeichnis', 'inhalt', 'contents', 'table of contents')"
TR, LD = r"^\s*(.+?)\s+(\d{1,4})\s*$", r"^\s*(\d{1,4})\s+(.+?)\s*$"


def undot(x: str) -> str:
    return f"regexp_replace({x}, '{DOTS}', ' ', 'g')"


def clean(x: str) -> str:
    return f"regexp_replace({squeeze(undot(x))}, '^[ .]+|[ .]+$', '', 'g')"


ENTRIES = rf"""cand as (select doc_id, page_index, block_id, read_seq, t, {lines('t')} ls from ordered where regexp_matches(t, '(?m)\d\s*$|^\s*\d')),
ln as (select doc_id, page_index, block_id, read_seq, unnest(ls) l, generate_subscripts(ls, 1) i, len(ls) n from cand),
nx as (select *, lead(l) over (partition by doc_id, block_id order by i) a, {undot('l')} h from ln),
nu as (select *, {undot('a')} u, {fold(squeeze('l'))} in {HEADS} is_head, regexp_matches(l, '^\d+(?:\.\d+)*\.?$') sec from nx),
rd as (
  select doc_id, page_index, block_id, read_seq, i, n,
    case when is_head then -1 when a is not null and sec and regexp_matches(u, '{TR}') then 2 when a is not null and sec and regexp_matches(l, '^\d+$') and {fold(squeeze('a'))} not in {HEADS} then 2 when a is not null and sec then 0
      when regexp_matches(h, '{TR}') then 1 when regexp_matches(h, '{LD}') and regexp_matches(regexp_extract(h, '{LD}', 2), '^\d+(?:\.\d+)*\.?\s+') then 1 else 0 end used,
    case when a is not null and sec and regexp_matches(u, '{TR}') then l || ' ' || regexp_extract(u, '{TR}', 1) when a is not null and sec then a when regexp_matches(h, '{TR}') then regexp_extract(h, '{TR}', 1) else regexp_extract(h, '{LD}', 2) end title,
    case when a is not null and sec and regexp_matches(u, '{TR}') then regexp_extract(u, '{TR}', 2) when a is not null and sec then l when regexp_matches(h, '{TR}') then regexp_extract(h, '{TR}', 2) else regexp_extract(h, '{LD}', 1) end label
  from nu),
rc as (select * replace (case when used > 0 and ({clean('title')} = '' or length({clean('title')}) > 140) then 0 else used end as used), {clean('title')} ct from rd),
walk as (
  select doc_id, page_index, block_id, read_seq, i, used, ct, label from rc where i = 1
  union all
  select r.doc_id, r.page_index, r.block_id, r.read_seq, r.i, r.used, r.ct, r.label from walk w join rc r on r.doc_id = w.doc_id and r.block_id = w.block_id and r.i = w.i + abs(w.used) where w.used <> 0),
many as (select doc_id, page_index, block_id, read_seq, i::bigint i, ct title, label, count(*) over (partition by doc_id, block_id) n from walk where used > 0),
one as (
  select doc_id, page_index, block_id, read_seq, ls, ls[1] f, {undot("array_to_string(ls, ' ')")} m from cand),
onr as (
  select doc_id, page_index, block_id, read_seq,
    case when len(ls) >= 2 and regexp_matches(f, '^\d+$') then f when len(ls) >= 2 and regexp_matches(f, '{DOTS}') then regexp_extract(f, '(\d{{1,4}})\s*$', 1) when regexp_matches(m, '{TR}') then regexp_extract(m, '{TR}', 2)
      when regexp_matches(m, '{LD}') and regexp_matches(regexp_extract(m, '{LD}', 2), '^\d+(?:\.\d+)*\.?\s+') then regexp_extract(m, '{LD}', 1) else '' end label,
    case when len(ls) >= 2 and (regexp_matches(f, '^\d+$') or regexp_matches(f, '{DOTS}')) then array_to_string(ls[2:], ' ') when regexp_matches(m, '{TR}') then regexp_extract(m, '{TR}', 1)
      when regexp_matches(m, '{LD}') and regexp_matches(regexp_extract(m, '{LD}', 2), '^\d+(?:\.\d+)*\.?\s+') then regexp_extract(m, '{LD}', 2) else '' end title
  from one where not (len(ls) = 1 and {fold(squeeze('f'))} in {HEADS})),
onc as (select o.*, {clean('title')} ct from onr o anti join (select doc_id, block_id from many where n >= 2) using (doc_id, block_id)),
be as (
  select doc_id, page_index, block_id, read_seq, i, title, label from many where n >= 2
  union all select doc_id, page_index, block_id, read_seq, 1, ct, label from onc where label <> '' and ct <> '' and length(ct) <= 140),
cnt as (select doc_id, page_index, count(*) entries from be group by all),
fst as (select *, row_number() over (partition by doc_id, page_index order by read_seq) pl from ordered),
pg as (select doc_id, page_index, bool_or(pl <= 5 and {fold(squeeze("split_part(t, chr(10), 1)"))} in {HEADS}) titled, count(*) filter (regexp_matches(t, '{DOTS}')) leaders from fst group by all),
base as (select p.doc_id, p.page_index, coalesce(entries, 0)::bigint entries, (titled and coalesce(entries, 0) >= 3) or (coalesce(entries, 0) >= 8 and leaders >= 3) b from pg p left join cnt c on p.doc_id = c.doc_id and p.page_index = c.page_index),
grow as (select doc_id, page_index, entries from base where b union select x.doc_id, x.page_index, x.entries from grow g join base x on x.doc_id = g.doc_id and x.page_index = g.page_index + 1 where x.entries >= 3),
tocp as (select distinct * from grow),
toce as (
  select b.doc_id, (row_number() over (partition by b.doc_id order by b.read_seq, b.i) - 1)::bigint entry_no, b.page_index, b.title,
    case when regexp_extract(b.title, '^(\d+(?:\.\d+)*)\.?\s+', 1) = '' then 2 else least(6, length(regexp_extract(b.title, '^(\d+(?:\.\d+)*)\.?\s+', 1)) - length(replace(regexp_extract(b.title, '^(\d+(?:\.\d+)*)\.?\s+', 1), '.', '')) + 1) end::integer toc_level, b.label page_label
  from be b semi join (select doc_id, page_index from tocp where entries > 0) using (doc_id, page_index))"""

BASE = f"with recursive {SCAN}, {PAGES}, {PROFILE}, {ARTIFACTS}, {KEPT}, {ORDER}"
BODY = "body as (select o.* from ordered o anti join (select doc_id, page_index from tocp where entries > 0) using (doc_id, page_index))"
BANDS = """lagged as (select *, lag(page_index) over d lp, lag(y0) over d ly0, lag(y1) over d ly1 from body window d as (partition by doc_id order by read_seq)),
banded as (
  select *, (sum(case when coalesce(lp = page_index and (greatest(0, least(ly1, y1) - greatest(ly0, y0)) / greatest(1, least(greatest(0, ly1 - ly0), greatest(0, y1 - y0))) >= 0.35 or (abs(y0 - ly0) <= 8 and abs(y1 - ly1) <= 12)), false) then 0 else 1 end)
    over (partition by doc_id order by read_seq) - 1)::bigint band_no from lagged)"""

TABLES = rf"""tl as (select doc_id, block_id, [l for l in string_split(t, chr(10)) if {strip('l')} <> ''] ls from scan where contains(t, chr(10))),
cut as (
  select doc_id, block_id, ls, unnest(['tab', 'pipe', 'multispace']) f, unnest([1, 2, 3]) o,
    unnest([[[{strip('c')} for c in string_split({strip('l')}, chr(9))] for l in ls], [[{strip('c')} for c in string_split(regexp_replace({strip('l')}, '^\|+|\|+$', '', 'g'), '|')] for l in ls], [[{strip('c')} for c in regexp_split_to_array({strip('l')}, '{SP}{{2,}}')] for l in ls]]) cells,
    unnest([list_bool_and([contains(l, chr(9)) for l in ls]), list_bool_and([contains(l, '|') for l in ls]), list_bool_and([regexp_matches(l, '{SP}{{2,}}') for l in ls])]) held
  from tl where len(ls) >= 2),
fit as (select *, row_number() over (partition by doc_id, block_id order by o) r from cut where held and len(cells[1]) >= 2 and list_bool_and([len(x) = len(cells[1]) for x in cells])),
grid as (select doc_id, block_id, f source_format, cells from fit where r = 1 and list_bool_and([list_bool_and([c <> '' for c in x]) for x in cells]))"""

SEGMENTS = rf"""parts as (select doc_id, block_id, unnest(p) part, generate_subscripts(p, 1) sn from (select doc_id, block_id, regexp_split_to_array({strip('t')}, '\n{SP}*\n+') p from scan)),
sl as (select doc_id, block_id, sn, {lines('part')} ls from parts where {strip('part')} <> ''),
sm as (select doc_id, block_id, sn, case when len(ls) >= 2 and ls[1] in ('n', 'l', '•', 'â€¢') then list_concat(['• ' || ls[2]], ls[3:]) else ls end ls from sl),
pr as (select doc_id, block_id, sn, unnest(ls) l, generate_subscripts(ls, 1) i, len(ls) n from sm),
pn as (select *, lead(l) over (partition by doc_id, block_id, sn order by i) a from pr),
fix as (select doc_id, block_id, sum((a is not null)::integer)::bigint wrap_repairs, sum((coalesce(regexp_matches(l, '\p{{L}}-$') and regexp_matches(a, '^\p{{Ll}}'), false))::integer)::bigint hyphen_repairs from pn group by all)"""


# Warnings of all tables that carry them, in the order of stages.
WARNINGS = " union all ".join(f"select doc_id, {i} stage, unnest(warnings) w, generate_subscripts(warnings, 1) seq from {t}" for i, t in enumerate(("doc_ir", "blocks", "elements", "paragraphs")))

# Blocks, and cells of the tables of elements laid out as blocks on pages of their own.
LAID = """lt as (select *, row_number() over (partition by doc_id order by element_id) k from (select distinct doc_id, element_id, table_data.cell_rows cells from elements where len(table_data.cell_rows) > 0)),
lr as (select doc_id, element_id, k, unnest(cells) row_cells, generate_subscripts(cells, 1) r from lt),
ly as (select doc_id, element_id, k, r, unnest(row_cells) cell, generate_subscripts(row_cells, 1) c from lr),
laid as (select doc_id, element_id || '-' || r || '-' || c block_id, (1000 + k)::integer page_index, null::double page_width, null::double page_height, cell raw_text, false is_highlighted,
  struct_pack(x0 := 110.0 * c, y0 := 24.0 * r, x1 := 110.0 * c + 100, y1 := 24.0 * r + 12)::struct(x0 double, y0 double, x1 double, y1 double) bbox from ly),
""" + SCAN.replace("from blocks)", "from (select doc_id, block_id, page_index, page_width, page_height, raw_text, is_highlighted, bbox from blocks union all select * from laid))")


def oracle_sql() -> dict[str, str]:
    toc = f"{BASE}, {ENTRIES}"
    return {
        "blocks_scan": f"with {SCAN} select doc_id, block_id, page_index, length(t)::bigint chars, length(t) - length(replace(t, chr(10), '')) + 1 as line_count from scan",
        "page_profile": f"with {SCAN}, {PAGES} select doc_id, page_index, text_blocks, chars, likely_layout from layouts",
        "doc_profile": f"with {SCAN}, {PAGES}, {PROFILE} select * from profile",
        "page_number_artifacts": f"with {SCAN}, {ARTIFACTS} select doc_id, block_id, page_index, number from numbers",
        "repeated_margin_artifacts": f"with {SCAN}, {ARTIFACTS} select doc_id, block_id, artifact_type, text from repeated",
        "artifact_counts": f"with {SCAN}, {ARTIFACTS} select doc_id, artifact_type, count(*) removed from artifacts group by all",
        "kept_blocks": f"with {SCAN}, {ARTIFACTS}, {KEPT} select doc_id, block_id from kept",
        "kept_margin_blocks": f"""with {SCAN}, {ARTIFACTS}, {KEPT}, m as (select *, {ZONE} zone, array_to_string({lines('t')}, ' ') line from kept)
            select doc_id, block_id, page_index, zone, case when {number('line')} is not null then 'numeric_margin_text' else 'margin_text' end reason, case when length(line) > 160 then substr(line, 1, 159) || '...' else line end snippet from m where zone is not null""",
        "reading_order": f"{BASE} select doc_id, block_id, read_seq from ordered",
        "toc_pages": f"{toc} select doc_id, page_index, entries from tocp",
        "toc_entries": f"{toc} select * from toce",
        "row_bands": f"{toc}, {BODY}, {BANDS} select doc_id, block_id, band_no from banded",
        "delimited_tables": f"with {SCAN}, {TABLES}, r as (select doc_id, block_id, source_format, unnest(cells) x, generate_subscripts(cells, 1) - 1 row_no from grid) select doc_id, block_id, source_format, row_no, generate_subscripts(x, 1) - 1 col_no, unnest(x) cell from r",
        "line_repairs": f"with {SCAN}, {SEGMENTS} select doc_id, block_id, hyphen_repairs, wrap_repairs from fix",
        "image_captions": rf"""with {SCAN}, im as (select distinct doc_id, image.image_id image_id, source_refs[1].page_index page_index, source_refs[1].bbox.x0 ix0, source_refs[1].bbox.y0 iy0, source_refs[1].bbox.x1 ix1, source_refs[1].bbox.y1 iy1 from elements where image is not null and len(source_refs) > 0),
            near as (select i.doc_id, image_id, t, row_number() over (partition by i.doc_id, image_id order by abs(y0 - iy1), block_id) r from im i join scan s on i.doc_id = s.doc_id and i.page_index = s.page_index
              where regexp_matches(t, '(?i)^\s*(?:abb\.?|fig\.?|figure)\s+\d+') and least(abs(y0 - iy1), abs(iy0 - y1)) <= 42 and least(x1, ix1) - greatest(x0, ix0) >= least(greatest(0, x1 - x0), greatest(0, ix1 - ix0)) * 0.25)
            select doc_id, image_id, {squeeze('t')} caption from near where r = 1""",
        "warnings_distinct": f"""with w as ({WARNINGS}), f as (select doc_id, w.code code, w.message message, w.page_index page_index, min(struct_pack(stage := stage, seq := seq, severity := w.severity)) k from w group by all),
            n as (select *, row_number() over (partition by doc_id order by k.stage, k.seq, code, message, page_index nulls first) - 1 warning_no from f)
            select doc_id, warning_no, code, message, k.severity severity, page_index from n where warning_no < 8""",
        **oracle_values.oracle_sql(),
        **oracle_elements.oracle_sql({"bands": f"{toc}, {BODY}, {BANDS}"}, TABLES, SEGMENTS, strip, squeeze, fold, lines, number, f"{toc}, {BODY}, {BANDS}".replace(SCAN, LAID), SCAN),
    }
