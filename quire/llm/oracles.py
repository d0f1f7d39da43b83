"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_SYMBOLS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_DIGIT = " || ".join(f"substr({_SYMBOLS}, (((('0x' || substr(hex, {5 * k + 1}, 5))::bigint >> {5 * s}) & 31) + 1)::bigint, 1)" for k in range(8) for s in (3, 2, 1, 0))

WARC = f"""
    with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex, min(page_id) over (partition by coalesce(html, '')) as first from pages)
    select page_id, strlen(body)::bigint as payload_bytes, {_DIGIT} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from p"""

# Blocks beside the article whose opening tag is on three pages of the host go, and on smaller hosts those that name
# themselves.  Of the character references the pages of these tables have only these, some cut off before their semicolon.
_REFERENCES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")]
_DECODED = "body"
for _name, _char in _REFERENCES:
    _DECODED = f"regexp_replace({_DECODED}, '&{_name};?', '{_char}', 'g')"
HTML = rf"""
    with p as (select page_id, url, lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) as host, regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '<!--.*?-->', '', 'g') as body from pages),
    blocks as (select page_id, host, block, regexp_extract(block, '^<([^>]*)>', 1) as opening from (select page_id, host, unnest(regexp_extract_all(body, '(?s)<(?:nav|footer|div)[^>]*>.*?(?:</(?:nav|footer|div)>|$)')) as block from p)),
    often as (select host, opening from blocks group by host, opening having count(distinct page_id) >= 3),
    gone as (select page_id, list(distinct block) as blocks from blocks left join often using (host, opening) where often.host is not null or opening in ('nav', 'footer', 'div class="ad"') group by page_id),
    a as (select page_id, url, list_reduce(list_prepend(body, coalesce(blocks, [])), lambda x, y: replace(x, y, ' ')) as body from p left join gone using (page_id)),
    b as (select page_id, url, regexp_replace(regexp_replace(body, '<(?:/?(?:p|h1|article)|br)>', ' ', 'g'), '</?[a-z0-9]+>', '', 'g') as body from a),
    c as (select page_id, url, trim(regexp_replace({_DECODED}, '\s+', ' ', 'g')) as text from b)
    select page_id, url, text, length(text)::bigint as n_chars from c"""


def _hits(kind: str, order: int, pattern: str, value: str) -> str:
    return rf"""select doc_id, source, lang, n, '{kind}' as kind, {order} as o, string_split(piece, chr(2))[1] as hit, {value} as value, (coalesce(sum(length(replace(piece, chr(2), ''))) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0))::bigint as s
        from (select doc_id, source, lang, unnest(parts) as piece, generate_subscripts(parts, 1) as n from (select doc_id, source, lang, string_split(regexp_replace(coalesce(text, ''), '{pattern}', chr(1) || '\0' || chr(2), 'g'), chr(1)) as parts from documents))"""


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SECRETS = rf"""
    with h as ({_hits("assign", 0, _ASSIGN, f"regexp_extract(string_split(piece, chr(2))[1], '{_ASSIGN}', 2)")} union all {_hits("access", 1, "AKIA[A-Z0-9]+", "string_split(piece, chr(2))[1]")} union all {_hits("hex", 2, "[0-9a-f]+", "string_split(piece, chr(2))[1]")}),
    base as (select doc_id, source, lang, kind, o, s, s + length(hit) as e, value from h where n > 1 and length(value) >= [12, 18, 16][o + 1]),
    held as (select value, count(distinct coalesce(source, '')) as owners, count(distinct coalesce(source, '') || '/' || coalesce(lang, '')) as repositories from base group by value),
    told as (select value, case when owners >= 3 or owners = 2 and repositories >= 5 then 'example' when owners = 2 then 'shared' else 'live' end as verdict from held),
    more as (select distinct doc_id, verdict as kind, list_position(['live', 'shared', 'example'], verdict) + 2 as o, e - length(base.value) as s, e
        from base join told on base.value = told.value where verdict = 'example' or (len(list_distinct(string_split(base.value, ''))) >= 6 and regexp_matches(base.value, '[0-9]') and regexp_matches(base.value, '[A-Za-z]'))),
    every as (select doc_id, kind, o, s, e from base union all select doc_id, kind, o, s, e from more),
    b as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, string_agg(kind || ':' || s || ':' || e, ',' order by s, o, e) as spans from base group by doc_id),
    a as (select doc_id, string_agg(kind || ':' || s || ':' || e, ',' order by s, o, e) as spans from every group by doc_id)
    select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b.spans, '')) as base_sha256, coalesce(a.spans, '') as spans
    from documents d left join b on b.doc_id = d.doc_id left join a on a.doc_id = d.doc_id"""

_WORD = r"[^\x20\x09-\x0D]+"
LINES = rf"""
    with d as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
    wins as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as win from (select doc_id, w, unnest(generate_series(1, len(w) - 7)) as i from d where len(w) >= 8)),
    twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, win) as k from wins) where k > 1),
    rep as (select doc_id, count(distinct i + j) as n from twice, generate_series(0, 7) as g(j) group by doc_id),
    lines as (select doc_id, source, line, n, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), ' ') as norm, len(regexp_extract_all(line, '{_WORD}')) as k
        from (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from d)),
    dup as (select doc_id, count(*) - count(distinct line) as n from lines where k > 0 group by doc_id),
    size as (select source, count(distinct doc_id) as docs from d group by source),
    bad as (select l.source, norm from lines l join size using (source) where k > 0 group by l.source, norm having count(distinct doc_id) >= 20 and count(distinct doc_id) > 0.01 * max(docs) or count(distinct doc_id) >= 200),
    lost as (select doc_id, sum(k) as n from lines join bad using (source, norm) where k > 0 group by doc_id),
    s as (select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(lost.n, 0) as lost
        from d left join dup using (doc_id) left join rep using (doc_id) left join lost using (doc_id)),
    f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from s)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (n_words - lost < 0.3 * n_words) as kept from f"""

# Every pair of a label; vectors of these tables have ids of their own.
VECTORS = """
    with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
    links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
        where isfinite(list_cosine_similarity(a.e, b.e)) and list_cosine_similarity(a.e, b.e) >= 0.93),
    reach as (select vec_id as x, vec_id as y from v union select reach.x, links.y from reach join links on reach.y = links.x),
    told as (select x as vec_id, min(y) as component_id from reach group by x)
    select vec_id, count(links.y)::bigint as n_links, any_value(component_id) as component_id, vec_id = any_value(component_id) as kept
    from told left join links on links.x = told.vec_id group by vec_id"""

ORACLES = {"op1_html": HTML, "op4_warc": WARC, "op5_secrets": SECRETS, "op10_lines": LINES, "op13_vectors": VECTORS}
