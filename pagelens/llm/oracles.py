"""DuckDB SQL for the corpus queries that SQL can express, over the same tables."""

from __future__ import annotations

from pagelens.llm import linededup, spelling, trie, urlfilter, warc


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


MAXSCORE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from (select distinct * from v where vec_id % 100 = 0) q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""


def url_filter() -> str:
    rules = ", ".join(f"({quoted(r)}, {quoted(r.partition('/')[0])}, {quoted('/' + r.partition('/')[2])}, {quoted(v)})" for v, r in urlfilter.RULES)
    listed = " or ".join(f"host = {quoted(e)} or ends_with(host, {quoted('.' + e)})" for e in urlfilter.BLOCKED)
    return f"""
with rules(rule, domain, start, verdict) as (values {rules}),
parts as (
  select page_id, row_number() over () as n,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
fits as (
  select n, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from parts join rules on (host = domain or ends_with(host, '.' || domain)) and starts_with(path, start) group by n)
select page_id, host, path, rule, coalesce(verdict, case when {listed} then 'block' else 'allow' end) as verdict
from parts left join fits using (n)
"""


def _sha1(value: str) -> str:
    """SQL for `sha1:` and the base-32 digits."""
    return f"""'sha1:' || list_aggregate(list_transform(range(32), lambda i: substr({quoted(warc.BASE32)}, (((('0x' || substr(sha1({value}), 5 * (i // 4) + 1, 5))::bigint) >> (15 - 5 * (i % 4))) & 31)::integer + 1, 1)), 'string_agg', '')"""


def _uuid(*parts: str) -> str:
    name = f"md5(concat_ws(chr(1), {', '.join(parts)}))"
    return f"'<urn:uuid:' || regexp_replace({name}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '>'"


def warc_derivatives() -> str:
    html = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in warc.DROPPED:
        html = rf"regexp_replace({html}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    html = rf"regexp_replace(regexp_replace({html}, '[\s\x0b]+', ' ', 'g'), '(?i)</?(?:{warc.BLOCKS})\b[^>]*>', chr(10), 'g')"
    text = f"regexp_replace({html}, '<[^>]*>', '', 'g')"
    for entity, sign in warc.ENTITIES:
        text = f"replace({text}, {quoted(entity)}, {quoted(sign)})"
    text = rf"trim(regexp_replace(regexp_replace({text}, ' +', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    crlf = "chr(13) || chr(10)"
    header = "Content-Type: " + warc.HEADERS["Content-Type"]
    size = "octet_length(encode({}))"
    return rf"""
with page as (
  select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as html, {quoted(header)} as source_headers from pages),
made as (
  select *, {_sha1("html")} as source_payload, {text} as text, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1), '[\s\x0b]+', ' ', 'g')) as title from page),
known as (select *, {_uuid("'response'", "coalesce(page_id::varchar, '')", "target_uri", "source_payload")} as source_id from made),
blocks as (
  select page_id, target_uri, source_headers, source_payload, source_id, 'response' as record_type, null::varchar as refers_to, 'application/http; msgtype=response' as content_type,
    'HTTP/1.1 200 OK' || {crlf} || source_headers || {crlf} || 'Content-Length: ' || {size.format("html")} || {crlf} || {crlf} || html as block, null::varchar as source_digest from known
  union all
  select page_id, target_uri, source_headers, source_payload, source_id, 'metadata', source_id, 'application/warc-fields',
    'title: ' || title || {crlf} || 'source-content-type: ' || {quoted(warc.HEADERS["Content-Type"])} || {crlf} || 'source-payload-digest: ' || source_payload || {crlf}
    || 'links: ' || len(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref')) || {crlf} || 'text-characters: ' || length(text) || {crlf}, source_payload from known
  union all
  select page_id, target_uri, source_headers, source_payload, source_id, 'conversion', source_id, 'text/plain', text, source_payload from known),
digests as (select *, {_sha1("block")} as block_digest from blocks)
select page_id, record_type, case when record_type = 'response' then source_id else {_uuid("record_type", "source_id", "block_digest")} end as record_id, refers_to, target_uri, content_type,
  {size.format("block")}::integer as content_length, block_digest, case when record_type = 'response' then source_payload else block_digest end as payload_digest, source_digest, source_headers
from digests
"""


def line_dedup(min_docs: int = linededup.MIN_DOCS, long: int = linededup.LONG) -> str:
    depth, static, tail, parts = linededup.DEPTH, linededup.STATIC, linededup.TAIL, linededup.SEGMENTS
    bounds = ", ".join(f"ceil({j} * (n - {depth}) / {parts})::integer as b{j}" for j in range(parts + 1))
    stretches = ", ".join(f"list_slice(words, {depth + 1} + b{j}, {depth} + b{j + 1}) as g{j}" for j in range(parts))
    kept = [
        f"select line, {{'kept': {list(c)}, 'words': list_concat(list_slice(words, 1, {depth}), {', '.join(f'g{j}' for j in c)}), 'n': n}} as template from stretched where {' + '.join(f'len(g{j})' for j in c)} >= {static} * (n - {depth})"
        for c in linededup.KEPT
    ]
    return rf"""
with texts as (select distinct doc_id, text from documents where doc_id is not null),
lines as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from texts),
tidy as (select doc_id, text, pos, trim(regexp_replace(line, '[ \t\r]+', ' ', 'g'), ' ') as words from lines),
wild as (select *, regexp_replace(words, '[^ ]*[0-9][^ ]*', '<*>', 'g') as w from tidy),
masked as (select doc_id, text, pos, case when 2 * (len(string_split(w, '<*>')) - 1) > len(string_split(words, ' ')) then words else w end as line from wild where words <> ''),
different as (select distinct line, string_split(line, ' ') as words, len(string_split(line, ' ')) as n from masked),
bounded as (select *, {bounds} from different where n >= {depth + tail}),
stretched as (select line, words, n, {stretches} from bounded),
templates as (
  select line, {{'kept': []::integer[], 'words': [line], 'n': n}} as template from different
  union all {" union all ".join(kept)}),
recurring as (
  select template, min(doc_id) as first_doc from masked join templates using (line) group by template
  having count(distinct doc_id) >= {min_docs} or (count(distinct doc_id) >= 2 and any_value(template.n) >= {long})),
first as (select line, min(first_doc) as first_doc from templates join recurring using (template) group by line),
by_doc as (select doc_id, text, list(distinct pos) as pos from masked join first using (line) where doc_id <> first_doc group by doc_id, text),
cut as (
  select d.doc_id, d.text, string_split(d.text, chr(10)) as l, coalesce(b.pos, []) as gone from documents d left join by_doc b on b.doc_id = d.doc_id and b.text = d.text),
done as (select doc_id, coalesce(len(l), 0) as n_lines, len(gone) as n_dropped, case when len(gone) = 0 then text else array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: not list_contains(gone, i)), lambda i: l[i]), chr(10)) end as kept from cut)
select doc_id, n_lines::integer as n_lines, n_dropped::integer as n_dropped, length(kept)::integer as kept_chars, md5(kept) as kept_md5 from done
"""


QUOTATIONS = r"""
with recursive m as (select distinct conv_id, turn, role, coalesce(text, '') as text from conversations),
keyed as (select *, row_number() over (order by conv_id, turn, role, text) as mid from m),
lines as (select mid, conv_id, turn, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from keyed),
levels as (
  select mid, conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) as level,
    trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '[\s\x0b]+', ' ', 'g')) as body from lines),
begun as (select *, coalesce(lag(level) over w <> level or lag(body) over w = '', true)::int as begins from levels window w as (partition by mid order by pos)),
runs as (select *, sum(begins) over (partition by mid order by pos) as run from begun),
whole as (select mid, conv_id, turn, level, run, min(pos) as pos, list(body order by pos) as bodies from runs where body <> '' group by all),
units as (
  select mid, conv_id, turn, level, pos, 'p' as unit, array_to_string(bodies, ' ') as body from whole
  union all select mid, conv_id, turn, level, pos, 'l', unnest(bodies) from whole where len(bodies) > 1),
originals as (select conv_id, body, min({'turn': turn, 'mid': mid}) as first from units where level = 0 and conv_id is not null and turn is not null group by conv_id, body),
linked as (select u.*, o.first, len(string_split(u.body, ' ')) as words from units u join originals o on o.conv_id = u.conv_id and o.body = u.body where u.level > 0 and o.first.turn < u.turn),
votes as (select mid, level, first, sum(words) as words from linked group by mid, level, first),
passages as (select mid, count(distinct pos) as n_linked from linked group by mid),
links as (select mid, arg_min(first, {'l': level, 'w': -words, 't': -first.turn, 'm': first.mid}) as parent, any_value(n_linked) as n_linked from votes join passages using (mid) group by mid),
chain(mid, root, depth) as (
  select mid, parent, 1 from links
  union all select c.mid, l.parent, c.depth + 1 from chain c join links l on l.mid = c.root.mid),
roots as (select mid, arg_max(root, depth) as root, max(depth) as depth from chain group by mid),
quoted as (select mid, count(*) as n_quoted from units where level > 0 and unit = 'p' group by mid),
final as (
  select k.conv_id, coalesce(r.root.turn, k.turn) as thread_turn, coalesce(r.depth, 0)::integer as depth, k.turn, k.role, l.parent.turn as parent_turn, coalesce(q.n_quoted, 0)::bigint as n_quoted, coalesce(l.n_linked, 0)::bigint as n_linked,
    case when regexp_matches(k.text, '(?m)^(?:[ \t]*>)+') then trim(array_to_string(list_filter(string_split(k.text, chr(10)), lambda x: not regexp_matches(x, '^(?:[ \t]*>)+') and not regexp_matches(x, '(?i)^on .{1,200} wrote:\s*$')), chr(10)), ' ' || chr(10)) else k.text end as text
  from keyed k left join links l using (mid) left join roots r using (mid) left join quoted q using (mid))
select *, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || text || chr(10) as chat from final
"""


#: The table of CRC-32, and the checksum of the UTF-8 bytes of a string.
CRC_TABLE = "crcs as (select list_transform(range(256), lambda b: list_reduce([b::bigint] || list_transform(range(8), lambda i: i::bigint), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"


def crc32(value: str) -> str:
    """SQL for the unsigned CRC-32 of a string, beside the relation `crcs`."""
    step = "lambda c, b: xor(c >> 8, list_extract(t, (xor(c, b) & 255)::integer + 1))"
    return f"xor(list_reduce([4294967295::bigint] || list_transform(range(octet_length(encode({value}))), lambda i: ('0x' || substr(hex(encode({value})), 2 * i::integer + 1, 2))::bigint), {step}), 4294967295)"


def spelling_variants() -> str:
    """Near words by the words that are left when one code point goes: equal ones of one place, or a word itself."""
    return rf"""
with recursive {CRC_TABLE},
runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents where text is not null),
counted as (select id, run, count(*) as n from runs group by id, run),
hashed as (select run, n, {crc32("id || ':' || run")} as h from counted cross join crcs),
damaged as (select case when h % {spelling.DAMAGED} = 0 then substr(run, 1, (h % length(run))::integer) || substr(run, (h % length(run))::integer + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from damaged where length(word) >= {spelling.SHORTEST} group by word having sum(n) >= {spelling.SELDOM}),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
left_over as (select word, n, i, substr(word, 1, i::integer - 1) || substr(word, i::integer + 1) as rest from places),
pairs as (
  select a.word, b.word as other, b.n as other_n from left_over a join left_over b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select l.word, w.word, w.n from left_over l join words w on l.rest = w.word
  union select w.word, l.word, l.n from left_over l join words w on l.rest = w.word),
near as (select word, count(*) as n_near, min({{'n': -other_n, 'w': other}}) as best from pairs group by word),
formed as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when -best.n >= 2 * w.n then best.w end as form, case when -best.n >= 2 * w.n then (-best.n)::bigint end as form_n
  from words w left join near using (word)),
chain(word, root, depth) as (
  select word, form, 1 from formed where form is not null
  union all select c.word, f.form, c.depth + 1 from chain c join formed f on f.word = c.root where f.form is not null),
ends as (select word, arg_max(root, depth) as root from chain group by word)
select word, form, coalesce(root, word) as root, n, n_near, form_n from formed left join ends using (word)
"""


def prefix_trie() -> str:
    """Every node with every node below it, from the paths of the conversations."""
    turn = "md5(concat_ws(chr(0), length(role)::varchar, role, text))"
    return f"""
with recursive {CRC_TABLE},
rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
turns as (select conv_id, {turn} as t, length(text) as size, row_number() over (partition by conv_id order by turn nulls first, {turn}) as place from rows),
convs as (select conv_id, conv_id - conv_id % {trie.SHARE} as base, count(*) as n from turns group by conv_id),
heads as (select conv_id, base, n, ({crc32("conv_id::varchar")} % {trie.HEAD}) as h from convs cross join crcs),
built as (
  select c.conv_id, t.place as depth, t, size from heads c join turns t on t.conv_id = c.base and t.place <= h
  union all
  select c.conv_id, least(h, coalesce(b.n, 0)) + t.place - h, t, size from heads c join turns t using (conv_id) left join convs b on b.conv_id = c.base where t.place > h),
paths(conv_id, depth, node, above, size) as (
  select conv_id, 0::bigint, '', null::varchar, 0::bigint from convs
  union all select p.conv_id, b.depth, md5(p.node || t), p.node, b.size from paths p join built b on b.conv_id = p.conv_id and b.depth = p.depth + 1),
lengths as (select conv_id, max(depth) as last from paths group by conv_id),
nodes as (
  select depth, node, any_value(above) as above, any_value(size) as size, min(conv_id) as conv_id, count(*) as n_convs, bool_and(depth = last) as childless,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = last) as ends
  from paths join lengths using (conv_id) group by depth, node),
below as (select distinct a.depth, a.node, b.depth as d, b.node as x from paths a join paths b on b.conv_id = a.conv_id and b.depth >= a.depth),
sums as (
  select b.depth, b.node, count(*) filter (b.d = b.depth + 1) as n_children, count(*) filter (n.childless) as n_leaves, sum((n.n_convs - 1) * n.size)::bigint as saved_tokens
  from below b join nodes n on n.depth = b.d and n.node = b.x group by b.depth, b.node)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from nodes n join sums using (depth, node) left join nodes p on p.depth = n.depth - 1 and p.node = n.above
"""


def all_sql() -> dict[str, str]:
    return {"op4_maxscore": MAXSCORE, "op5_line_dedup": line_dedup(), "op6_warc": warc_derivatives(), "op8_url_filter": url_filter(), "op10_quotations": QUOTATIONS, "op12_spelling_variants": spelling_variants(), "op13_prefix_trie": prefix_trie()}
