"""Equivalent SQL of the queries that SQL can say. The consistent form is told in another way than by the operator: every look-alike letter goes to one side, in all words."""

from __future__ import annotations

from .textform import CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES


def letters(x: str) -> str:
    """The letters of a line in small form, look-alikes and full-width forms as the Latin ones."""
    wide = {chr(0xFEE0 + ord(c)): c for c in "abcdefghijklmnopqrstuvwxyz"}
    alike = CYRILLIC_LOOKALIKES | GREEK_LOOKALIKES | wide
    small = {k.lower(): v.lower() for k, v in alike.items()} | {k: v for k, v in alike.items() if k == k.lower()}  # small ones decide
    ligatures = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
    out = f"lower(nfc_normalize({x}))"
    for a, b in ligatures.items():
        out = f"replace({out}, '{a}', '{b}')"
    out = f"translate({out}, '{''.join(small)}', '{''.join(small.values())}')"
    return rf"regexp_replace(nfc_normalize({out}), '\P{{L}}', '', 'g')"


REPEATED = rf"""b as (select distinct coalesce(site, '') site, doc_id, block_id, raw_text from blocks),
l as (select site, doc_id, block_id, unnest(string_split(raw_text, chr(10))) line, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 line_no from b where length(raw_text) > 0),
k as (select site, doc_id, block_id, line_no, {letters('line')} key from l),
n as (select site, count(distinct doc_id) n from b group by 1),
s as (select site, key, count(distinct doc_id) d from k where length(key) >= 10 group by all),
kept as (select s.site, key from s join n on s.site = n.site where d >= 3 and d * 5 >= n),
gone as (select k.doc_id, k.block_id, line_no from k semi join kept using (site, key))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {REPEATED} select doc_id, block_id, line_no from gone",
        "p1_cleaned": f"""with {REPEATED}, g as (select doc_id, block_id, list(line_no) gone from gone group by all)
            select b.doc_id, b.block_id, case when g.gone is null then raw_text else array_to_string([x for x, i in string_split(raw_text, chr(10)) if not list_contains(gone, i - 1)], chr(10)) end clean_text, coalesce(len(gone), 0)::bigint lines_removed
            from b left join g on g.doc_id = b.doc_id and g.block_id = b.block_id""",
    }
