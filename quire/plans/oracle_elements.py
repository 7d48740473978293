"""Equivalent SQL of the queries on elements, reports and markup; it goes on with the tables of ``oracle``."""

from __future__ import annotations

SP = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
URL = r"https?://[^\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}<>''\x22]+"


def lstrip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+', '')"


def esc(x: str, quotes: bool = False) -> str:
    out = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"""replace(replace({out}, '"', '&quot;'), '''', '&#x27;')""" if quotes else out


def inline(x: str) -> str:
    """Escaped text with its web links: urls lose the punctuation at their end."""
    bare = r"""regexp_replace(u, '[.,;:!?)"\]}]+$', '')"""
    link = f"""'<a href="' || {esc(bare, True)} || '">' || {esc(bare)} || '</a>' || {esc(f"substr(u, length({bare}) + 1)")}"""
    urls = f"[{link} for u in regexp_extract_all({x}, '{URL}')]"
    gaps = f"[{esc('g')} for g in regexp_split_to_array({x}, '{URL}')]"
    return f"array_to_string([coalesce(p[1], '') || coalesce(p[2], '') for p in list_zip({gaps}, {urls})], '')"


IS_BULLET = rf"(starts_with({lstrip('t')}, '•') or starts_with({lstrip('t')}, 'â€¢') or regexp_matches({lstrip('t')}, '^[nl]{SP}+\S'))"


def runs(strip, lines) -> str:
    """Bands that can be rows of tables, chained; of each chain every end part is counted, and the longest that makes a table is a run."""
    first, second = "ls[1]", "ls[2]"
    no_table = rf"""({strip('t')} = '' or (len(ls) >= 2 and ((len(regexp_split_to_array({first}, '{SP}+')) >= 4 and regexp_matches({second}, '^\p{{Ll}}'))
      or (regexp_matches({first}, '^\d+$') and regexp_matches({second}, '^\d+\.')))) or {IS_BULLET} or regexp_matches({strip('t')}, '^[-–]')
      or regexp_full_match(replace({strip('t')}, chr(10), ''), '[\s.]+') or (length({strip('t')}) - length(replace({strip('t')}, '.', '')) > 12 and length({strip('t')}) > 40))"""
    return rf"""rf as (select *, {lines('t')} ls, {IS_BULLET} bullet from banded),
rg as (select *, y1 - y0 <= 36 and len(ls) between 2 and 6 and list_bool_and([length(l) <= 90 for l in ls]) and not {no_table} alone from rf),
bd as (select doc_id, band_no, min(page_index) page_index, count(*) size, min(x0) x0, min(y0) y0, max(y1) y1, case when count(*) >= 2 then not bool_or(bullet) else bool_and(alone) end tab from rg group by all),
bl as (select b.*, coalesce(a.tab and b.tab and a.page_index = b.page_index and b.y0 >= a.y0 and b.y0 - a.y1 <= 32 and (abs(b.x0 - a.x0) <= 32 or (a.size > 1 and b.size > 1)), false) follows
  from bd b left join bd a on a.doc_id = b.doc_id and a.band_no = b.band_no - 1),
bc as (select *, sum((not follows)::integer) over (partition by doc_id order by band_no) chain, round_even(x0 / 10, 0) * 10 edge from bl),
bt as (select * from bc where tab),
ends as (select a.doc_id, a.chain, a.band_no, b.edge, count(*) n, bool_or(b.size > 1) wide from bt a join bt b on a.doc_id = b.doc_id and a.chain = b.chain and b.band_no >= a.band_no group by all),
tests as (select doc_id, chain, band_no, sum(n) n, max(n) most, bool_or(wide) wide from ends group by all),
starts as (select doc_id, chain, min(band_no) run_no from tests where n >= 3 and (wide or most >= greatest(3, n - 1)) group by all),
runs as (select b.doc_id, run_no, b.band_no, b.page_index from bt b join starts s on b.doc_id = s.doc_id and b.chain = s.chain and b.band_no >= s.run_no)"""


def parts(strip, squeeze, lines) -> str:
    """Blocks outside of runs: those like tables, and the paragraphs of all others."""
    count = rf"""len([c for c in (case when contains({strip('l')}, chr(9)) then [{strip('c')} for c in string_split({strip('l')}, chr(9))]
      when contains(l, '|') then [{strip('c')} for c in string_split(regexp_replace({strip('l')}, '^\|+|\|+$', '', 'g'), '|')] else [{strip('c')} for c in regexp_split_to_array({strip('l')}, '{SP}{{2,}}')] end) if c <> ''])"""
    return rf"""single as (select b.* from banded b anti join runs r on b.doc_id = r.doc_id and b.band_no = r.band_no),
lk as (select doc_id, block_id, [{count} for l in {lines('t')}] n, [l for l in {lines('t')} if {IS_BULLET.replace("regexp_replace(t,", "regexp_replace(l,")}] listed, {lines('t')} ls from single where contains(t, chr(10))),
lc as (select doc_id, block_id, unnest(n) n from lk where len(listed) = 0 and len(ls) >= 2),
likes as (select distinct doc_id, block_id from (select doc_id, block_id, n, count(*) c from lc where n >= 2 group by all) where c >= 2),
tabs as (select s.*, g.source_format, g.cells from single s left join grid g on s.doc_id = g.doc_id and s.block_id = g.block_id left join likes k on s.doc_id = k.doc_id and s.block_id = k.block_id where g.doc_id is not null or k.doc_id is not null),
words as (select s.* from single s anti join tabs using (doc_id, block_id)),
joined as (select doc_id, block_id, sn, string_agg(case when a is null then l when regexp_matches(l, '\p{{L}}-$') and regexp_matches(a, '^\p{{Ll}}') then left(l, -1) else l || ' ' end, '' order by i) s,
  sum((a is not null)::integer)::bigint wraps, sum(coalesce(regexp_matches(l, '\p{{L}}-$') and regexp_matches(a, '^\p{{Ll}}'), false)::integer)::bigint hyphens from pn group by all),
shown as (select * replace (case when starts_with({lstrip('s')}, '•') or starts_with({lstrip('s')}, 'â€¢') then '• ' || regexp_replace({lstrip('s')}, '^[•â€¢]+{SP}*', '')
  when length({lstrip('s')}) >= 12 and regexp_matches({lstrip('s')}, '^[nl]{SP}+\S') then '• ' || regexp_replace({lstrip('s')}, '^[nl]{SP}+', '') else s end as s) from (select * replace ({squeeze('s')} as s) from joined)),
seg as (select w.doc_id, w.block_id, w.read_seq, w.page_index, w.is_highlighted, w.x0, w.y0, w.x1, w.y1, regexp_matches({strip('w.t')}, '^\p{{Ll}}') low, sn - 1 sn, s, wraps, hyphens from words w join shown using (doc_id, block_id) where s <> ''),
sgl as (select *, lag(page_index) over d lp, lag(is_highlighted) over d lh, lag(x0) over d lx, lag(y1) over d ly, lag(s) over d ls from seg window d as (partition by doc_id order by read_seq, sn)),
sgn as (select *, sum(case when coalesce(sn = 0 and lp = page_index and lh is not distinct from is_highlighted and abs(lx - x0) <= 8 and y0 - ly between 0 and 18 and not regexp_matches(ls, '[.!?:;][''")\]]?$') and low, false) then 0 else 1 end)
  over (partition by doc_id order by read_seq, sn) no from sgl),
paras as (select doc_id, 'p' || case when no < 10000 then lpad(no::varchar, 4, '0') else no::varchar end element_id, string_agg(s, ' ' order by read_seq, sn) as text, bool_or(coalesce(is_highlighted, false)) hi, arg_min(page_index, (read_seq, sn)) page_index,
  arg_min(x0, (read_seq, sn)) x0, arg_min(y0, (read_seq, sn)) y0, arg_max(x0, (read_seq, sn)) lx, arg_max(y1, (read_seq, sn)) ly, arg_max(page_index, (read_seq, sn)) lp, sum(hyphens)::bigint hyphens, (sum(wraps) + count(*) - 1)::bigint wraps from sgn group by doc_id, no)"""


CELL_ROWS = "null::varchar[][]"
ELEMENTS = f"""tocb as (select o.* from ordered o semi join (select doc_id, page_index from tocp where entries > 0) using (doc_id, page_index)),
pics as (select doc_id, image_id, any_value(alt) alt, any_value(file) file, any_value(kind) kind, any_value(page_index) page_index, any_value(x0) x0, any_value(y0) y0, any_value(x1) x1, any_value(y1) y1
  from (select doc_id, image.image_id image_id, image.alt_text alt, image.file_name file, image.media_type kind, source_refs[1].page_index page_index, unnest(source_refs[1].bbox) from elements where image is not null and len(source_refs) > 0) group by all),
capt as (select p.doc_id, p.image_id, CAPTION caption, row_number() over (partition by p.doc_id, p.image_id order by abs(s.y0 - p.y1), s.block_id) r from pics p join scan s on s.doc_id = p.doc_id and s.page_index = p.page_index
  where regexp_matches(t, '(?i)^\\s*(?:abb\\.?|fig\\.?|figure)\\s+\\d+') and least(abs(s.y0 - p.y1), abs(p.y0 - s.y1)) <= 42 and least(s.x1, p.x1) - greatest(s.x0, p.x0) >= least(greatest(0, s.x1 - s.x0), greatest(0, p.x1 - p.x0)) * 0.25),
every as (
  select doc_id, element_id, case when hi then 'callout' else 'paragraph' end kind, text, page_index, x0, y0, lp, lx, ly, null::varchar warning, {CELL_ROWS} cells, null::varchar file from paras
  union all select doc_id, 'table-' || block_id, 'table', t, page_index, x0, y0, page_index, x0, y1, case when cells is null then 'table_fallback_used' end, cells, null from tabs
  union all select doc_id, 'toc-p' || lpad((arg_min(page_index, read_seq) + 1)::varchar, 4, '0'), 'toc', 'Inhaltsverzeichnis', arg_min(page_index, read_seq), arg_min(x0, read_seq), arg_min(y0, read_seq), arg_max(page_index, read_seq), arg_max(x0, read_seq),
    arg_max(y1, read_seq), 'toc_links_not_resolved', {CELL_ROWS}, null from tocb group by doc_id
  union all select p.doc_id, p.image_id, 'image', coalesce(alt, caption, 'Image from page ' || (page_index + 1)), page_index, x0, y0, page_index, x0, y1, null, {CELL_ROWS}, file from pics p left join (select * from capt where r = 1) c on c.doc_id = p.doc_id and c.image_id = p.image_id),
seqd as (select *, (row_number() over (partition by doc_id order by coalesce(page_index, 1000000000), round_even(coalesce(y0, 0), 1), round_even(coalesce(x0, 0), 1), element_id) - 1)::bigint seq from every),
call as (select *, lag(kind) over d pk, lag(lp) over d pp, lag(ly) over d py, lag(lx) over d px from seqd window d as (partition by doc_id order by seq)),
isle as (select *, sum(case when coalesce(kind = 'callout' and pk = 'callout' and pp = page_index and y0 - py between -2 and 28 and abs(x0 - px) <= 16, false) then 0 else 1 end) over (partition by doc_id order by seq) g from call),
elems as (select doc_id, min(seq) elem_seq, arg_min(element_id, seq) element_id, arg_min(kind, seq) element_type, string_agg(text, chr(10) || chr(10) order by seq) as text, arg_min(page_index, seq) page_index, arg_min(x0, seq) x0, arg_min(y0, seq) y0,
  count(*) merged, any_value(warning) warning, any_value(cells) cells, any_value(file) file, any_value(kind) from isle group by doc_id, g)"""


def targets(squeeze, fold, number) -> str:
    return f"""labels as (select doc_id, number, page_index from (select *, row_number() over (partition by doc_id, number order by page_index, y0) r from artifacts where artifact_type = 'page_number') where r = 1),
lastp as (select doc_id, max(page_index) last from elems group by 1),
firsts as (select doc_id, page_index, element_id from (select *, row_number() over (partition by doc_id, page_index order by round_even(y0, 1), round_even(x0, 1), element_id) r from elems
  where element_type in ('paragraph', 'callout', 'table') and {squeeze('text')} <> '' and {fold(squeeze('text'))} <> 'notizen' and {number(squeeze('text'))} is null) where r = 1),
aimed as (select t.*, coalesce(l.page_index, case when {number('page_label')} >= 1 and {number('page_label')} - 1 <= last then {number('page_label')} - 1 end) target_page
  from toce t left join labels l on l.doc_id = t.doc_id and l.number = {number('page_label')} left join lastp p on p.doc_id = t.doc_id),
led as (select a.*, f.element_id target_id from aimed a left join firsts f on f.doc_id = a.doc_id and f.page_index = a.target_page)"""


def markup(strip, squeeze) -> str:
    short = rf"(length({strip('X')}) <= 90 and len(regexp_split_to_array({strip('X')}, '{SP}+')) <= 10 and not regexp_matches({strip('X')}, '[.,;:]$'))"
    attr = f"""case when coalesce(element_id, '') = '' then '' else ' id="' || {esc('element_id', True)} || '"' end"""
    row = lambda x, tag: f"""'<tr>' || array_to_string(['<{tag}>' || {inline("coalesce(c, '')")} || '</{tag}>' for c in {x}], '') || '</tr>'"""
    grid = lambda rows, css: f"""'<figure class="{css}"' || ida || '><table><thead>' || {row(rows + '[1]', 'th')} || '</thead>' || case when len({rows}) > 1 then '<tbody>' || array_to_string([{row('r', 'td')} for r in {rows}[2:]], '') || '</tbody>' else '' end || '</table></figure>'"""
    boxes = f"[p for p in [{strip('q')} for q in string_split(text, chr(10) || chr(10))] if p <> '']"
    boxed = f"""[case when i = 1 and {short.replace('X', 'boxes[i]')} then '<p class="callout-title">' else '<p>' end || {inline('boxes[i]')} || '</p>' for i in range(1, len(boxes) + 1)]"""
    return rf"""em as (select *, {attr} ida, element_type = 'paragraph' and (starts_with({lstrip('text')}, '•') or starts_with({lstrip('text')}, 'â€¢')) item, {boxes} boxes, [[{strip('c')} for c in string_split(l, '|')] for l in string_split(text, chr(10))] bars from elems),
en as (select *, len(bars) >= 2 and list_bool_and([len(r) >= 2 and list_bool_and([c <> '' for c in r]) for r in bars]) barred, coalesce(lag(item) over d, false) before, coalesce(lead(item) over d, false) after from em window d as (partition by doc_id order by elem_seq)),
tocm as (select doc_id, '<nav class="pdf-toc" epub:type="toc"><h2>Inhaltsverzeichnis</h2><ol>' || string_agg('<li class="toc-level-' || greatest(1, least(6, toc_level)) || '">' || case when target_id is not null then '<a href="#' || {esc('target_id', True)} || '">' || {esc('title')} || '</a>'
  else '<span>' || {esc('title')} || '</span>' end || case when coalesce(page_label, '') = '' then '' else '<span class="toc-page">' || {esc('page_label')} || '</span>' end || '</li>', '' order by entry_no) || '</ol></nav>' m from led group by 1),
mk as (select e.doc_id, elem_seq, element_id, item, before, after, case when item then '<li' || ida || '>' || {inline(f"regexp_replace(text, '^{SP}*(?:•|â€¢)?{SP}*', '')")} || '</li>'
  when element_type = 'paragraph' then '<p class="' || case when {short.replace('X', 'text')} then 'short' else 'body-text' end || '"' || ida || '>' || {inline('text')} || '</p>'
  when element_type = 'callout' then '<aside class="callout"' || ida || '>' || array_to_string({boxed}, '') || '</aside>'
  when element_type = 'table' and cells is not null then {grid('cells', 'table')} when element_type = 'table' and barred then {grid('bars', 'table-fallback')}
  when element_type = 'table' then '<figure class="table-fallback"' || ida || '><pre>' || {esc('text')} || '</pre></figure>'
  when element_type = 'image' then '<figure class="image"' || ida || '><img src="' || {esc('file', True)} || '" alt="' || {esc('text', True)} || '" /></figure>' else m end m from en e left join tocm t on t.doc_id = e.doc_id)"""


ACTIONS = (
    "page_numbers_removed headers_removed footers_removed total_paragraphs tables_rendered_semantically table_fallbacks_rendered element_warnings hyphenations_repaired line_wraps_repaired order_warnings "
    "total_raw_blocks table_like_blocks_detected images_detected images_preserved images_not_preserved decorative_images_removed toc_entries callouts bullet_items web_links"
).split()
REPORT = """gw as (select doc_id, code, message, page_index, bool_or(severity = 'error') err from (select doc_id, unnest(warnings, recursive := true) from doc_ir union all select doc_id, unnest(warnings, recursive := true) from blocks) group by all),
gd as (select doc_id, count(*) n, count(*) filter (code = 'image_not_preserved') lost, count(*) filter (err) errors from gw group by 1),
ra as (select doc_id, count(*) filter (artifact_type = 'page_number') pn, count(*) filter (artifact_type = 'header') he, count(*) filter (artifact_type = 'footer') fo from artifacts group by 1),
re as (select doc_id, count(*) filter (element_type in ('paragraph', 'callout')) paras, count(*) filter (element_type = 'table') tables, count(*) filter (element_type = 'table' and cells is not null) good, count(*) filter (warning is not null) warned,
  count(*) filter (element_type = 'callout') callouts, count(*) filter (element_type = 'paragraph' and starts_with(LSTRIP, '•')) bullets, count(*) filter (contains(text, 'http://') or contains(text, 'https://')) links, count(*) filter (element_type = 'image') pics,
  count(*) filter (element_type = 'image' and file is null) lost from elems group by 1),
rp as (select doc_id, sum(hyphens) hy, sum(wraps) wr from paras group by 1),
rm as (select doc_id, count(*) multi from layouts where likely_layout = 'possible_multi_column' group by 1),
rs as (select doc_id, count(*) blocks from scan group by 1),
rt as (select doc_id, count(*) entries from toce group by 1),
rr as (select p.*, coalesce(pn, 0) page_numbers_removed, coalesce(he, 0) headers_removed, coalesce(fo, 0) footers_removed, coalesce(paras, 0) total_paragraphs, coalesce(good, 0) tables_rendered_semantically, coalesce(tables - good, 0) table_fallbacks_rendered,
  coalesce(warned, 0) element_warnings, coalesce(hy, 0)::bigint hyphenations_repaired, coalesce(wr, 0)::bigint line_wraps_repaired, coalesce(multi, 0) order_warnings, coalesce(blocks, 0) total_raw_blocks, coalesce(tables, 0) table_like_blocks_detected,
  coalesce(pics, 0) images_detected, coalesce(pics - re.lost, 0) images_preserved, coalesce(re.lost, 0) images_not_preserved, 0::bigint decorative_images_removed, coalesce(entries, 0) toc_entries, coalesce(callouts, 0) callouts, coalesce(bullets, 0) bullet_items, coalesce(links, 0) web_links,
  coalesce(gd.n, 0) gn, coalesce(gd.lost, 0) gl, coalesce(gd.errors, 0) ge
  from profile p left join ra on ra.doc_id = p.doc_id left join re on re.doc_id = p.doc_id left join rp on rp.doc_id = p.doc_id left join rm on rm.doc_id = p.doc_id left join rs on rs.doc_id = p.doc_id left join rt on rt.doc_id = p.doc_id left join gd on gd.doc_id = p.doc_id),
sc as (select *, likely_layout = 'possible_multi_column' two, greatest(0, least(100, 100 - case when page_count > 0 then round_even(no_text_page_count / page_count * 25, 0) else 0 end - case when likely_layout = 'possible_multi_column' then 20 else 0 end
  - least(20, order_warnings * 5) - least(15, (gl + images_not_preserved) * 5) - case when extracted_char_count = 0 then 30 else 0 end))::bigint quality_score from rr),
st as (select *, case when ge > 0 then 'error' when gn + images_not_preserved + order_warnings + element_warnings + two::integer + no_text_page_count > 0 then 'warning' else 'ok' end status from sc)
select * exclude (gn, gl, ge, two), case when status = 'error' then 'error' when quality_score >= 90 and status = 'ok' then 'ok' when quality_score >= 70 then 'warning' else 'error' end verdict from st"""


def oracle_sql(known: dict[str, str], tables: str, segments: str, strip, squeeze, fold, lines, number, laid: str, scan: str) -> dict[str, str]:
    """Queries by name. ``known``: the start of a statement up to the bands; ``laid``: the same over blocks laid out from cells."""
    grouped = f"{known['bands']}, {runs(strip, lines)}"
    built = f"{grouped}, {tables}, {segments}, {parts(strip, squeeze, lines)}"
    elems = f"{built}, {ELEMENTS.replace('CAPTION', squeeze('t'))}"
    aimed = f"{elems}, {targets(squeeze, fold, number)}"
    report = REPORT.replace("LSTRIP", lstrip("text"))
    listed = ", ".join(f"struct_pack(action := '{a}', times := {a})" for a in ACTIONS)
    return {
        "table_runs": f"{laid}, {runs(strip, lines)} select doc_id, run_no, band_no, page_index from runs",
        "table_elements": f"{built} select doc_id, block_id, source_format from tabs",
        "rebuilt_paragraphs": f"{built} select doc_id, element_id, text, hi is_highlighted, page_index, hyphens hyphen_repairs, wraps wrap_repairs from paras",
        "elements_sorted": f"{elems} select doc_id, elem_seq, element_id, element_type, text, page_index, merged from elems",
        "callouts": f"{elems} select doc_id, elem_seq, element_id, text, merged from elems where element_type = 'callout'",
        "toc_targets": f"{aimed} select doc_id, entry_no, title, page_label, target_page::bigint target_page, target_id from led",
        "xhtml_elements": rf"""{aimed}, {markup(strip, squeeze)} select doc_id, elem_seq, element_id,
            case when item and not before then '<ul class="bullet-list">' || chr(10) else '' end || coalesce(m, '') || case when item and not after then chr(10) || '</ul>' else '' end markup from mk""",
        "quality_report": f"{elems}, {report}",
        "recovery_warnings": f"""{aimed}, sized_docs as (select doc_id, page_count n from profile),
            every_page as (select doc_id, unnest(range(n))::integer page_index from sized_docs),
            blank as (select e.* from every_page e anti join layouts l on l.doc_id = e.doc_id and l.page_index = e.page_index),
            two as (select doc_id, page_index from layouts where likely_layout = 'possible_multi_column'),
            said as (
              select doc_id, 'page_has_no_native_text' code, page_index from blank union all select distinct doc_id, 'image_or_no_text_pages_present', null::integer from blank
              union all select distinct doc_id, 'possible_multi_column', null::integer from two union all select doc_id, 'possible_multi_column_reading_order_uncertain', page_index from two
              union all select doc_id, warning, page_index from elems where warning is not null
              union all select l.doc_id, 'toc_entry_unresolved', t.page_index from led l left join elems t on t.doc_id = l.doc_id and t.element_type = 'toc' where target_id is null
              union all select doc_id, 'image_not_preserved', page_index from elems where element_type = 'image' and file is null)
            select doc_id, code, page_index, case when code in ('toc_links_not_resolved', 'toc_entry_unresolved') then 'info' else 'warning' end severity,
              case when code like '%reading_order%' then 1 when code in ('toc_entry_unresolved', 'image_not_preserved') then 3 when code in ('toc_links_not_resolved', 'table_fallback_used') then 2 else 0 end stage, count(*) times from said group by all""",
        "report_actions": f"select * from (select doc_id, unnest([{listed}], recursive := true) from ({elems}, {report})) where times > 0",
        "verdict": f"select doc_id, quality_score, status, verdict from ({elems}, {report})",
        "highlight_blocks": f"""with {scan}, r as (select doc_id, page_index, min(bbox.x0) a, min(bbox.y0) b, max(bbox.x1) c, max(bbox.y1) d from blocks where is_highlighted group by all)
            select s.doc_id, block_id from scan s join r on r.doc_id = s.doc_id and r.page_index = s.page_index where c - a >= 80 and d - b >= 30 and (x0 + x1) / 2 between a - 2 and c + 2 and (y0 + y1) / 2 between b - 2 and d + 2""",
        "decorative_images": """with p as (select distinct doc_id, image.image_id image_id, image.media_type kind, source_refs[1].page_index page_index, unnest(source_refs[1].bbox) from elements where image is not null and len(source_refs) > 0),
            z as (select doc_id, page_index, max(page_width) w, max(page_height) h from blocks group by all),
            m as (select p.*, case when y1 <= h * 0.15 then 'top' when y0 >= h * 0.85 then 'bottom' when x1 <= w * 0.18 then 'left' when x0 >= w * 0.82 then 'right' end zone from p left join z on p.doc_id = z.doc_id and p.page_index = z.page_index
              where greatest(0, x1 - x0) <= greatest(48, w * 0.09) and greatest(0, y1 - y0) <= greatest(48, h * 0.09)),
            g as (select doc_id, zone, kind from m where zone is not null group by all having count(distinct page_index) >= 3)
            select m.doc_id, image_id from m join g on m.doc_id = g.doc_id and m.zone = g.zone and m.kind is not distinct from g.kind""",
        "linkified_text": f"select doc_id, element_id, {inline('text')} markup from (select distinct doc_id, element_id, text from paragraphs) where text <> ''",
    }
