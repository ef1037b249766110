"""SQL for the queries on records, in the dialect of the driver's engine.

Written from the statement of each problem, not from the operators, so that both can be
held against each other on whole tables.
"""

from __future__ import annotations

from castellan.functions.text import BLANKS

_CHARS = " || ".join(f"chr({ord(c)})" for c in BLANKS)


def trimmed(c: str) -> str:
    return f"trim({c}, {_CHARS})"


def filled(c: str) -> str:
    return f"(coalesce({trimmed(c)}, '') <> '')"


def session_key_sql(sid: str, path: str | None = None) -> str:
    own = f"nullif(lower({trimmed(sid)}), '')"
    if path is None:
        return own
    name = f"split_part(split_part({path}, '/', -1), '.', 1)"
    return f"coalesce({own}, case when {filled(name)} then {name} end)"


_ROLE = f"lower(case when {filled('msg_role')} then {trimmed('msg_role')} else {trimmed('event_type')} end)"
_DATETIME = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def is_datetime_sql(c: str) -> str:
    return f"(regexp_full_match({c}, '{_DATETIME}') and try_cast(substr({c}, 1, 10) as date) is not null)"


def _instant(c: str) -> str:
    zone = f"right({c}, 6)"
    minutes = f"(cast(substr({zone}, 2, 2) as bigint) * 60 + cast(substr({zone}, 5, 2) as bigint))"
    frac = f"cast(rpad(regexp_extract({c}, '\\.([0-9]{{1,6}})', 1), 6, '0') as bigint)"
    local = f"epoch_us(cast(substr({c}, 1, 10) || ' ' || substr({c}, 12, 8) as timestamp)) + {frac}"
    shift = f"case when {c} like '%Z' then 0 when {zone} like '-%' then -{minutes} else {minutes} end * 60000000"
    return f"case when {is_datetime_sql(c)} then {local} - {shift} end"


#: Rows that count, with role, session key and instant.
KEPT = f"""
with keyed as (
  select *, {session_key_sql('session_id', 'src_path')} as session_key,
    case {_ROLE} when 'human' then 'user' when 'model' then 'assistant' when 'user' then 'user' when 'assistant' then 'assistant' when 'system' then 'system' end as role
  from session_messages),
kept as (
  select *, {_instant('ts_text')} as own_us,
    coalesce(role = 'assistant' and {filled('content_id')} and {filled('tool_name')}, false) as is_call
  from keyed where session_key is not null
  qualify row_number() over (partition by session_key, src_path, line_no order by ingest_ts desc nulls last, row_id desc) = 1),
timed as (
  select *, last_value(own_us ignore nulls) over (partition by session_key, src_path order by line_no rows between unbounded preceding and current row) as instant
  from kept)
"""

P4_ORPHANS = f"""
{KEPT},
calls as (
  select k.session_key, {trimmed('k.content_id')} as id, max(k.ingest_ts) as last_in from kept k where is_call group by 1, 2),
gone as (select {session_key_sql('session_id')} as session_key, {trimmed('content_id')} as id, max(deleted_at) as gone_at from call_deletions group by 1, 2),
living as (
  select c.session_key, c.id from calls c left join gone g on c.session_key = g.session_key and c.id = g.id
  where g.gone_at is null or g.gone_at <= c.last_in),
refs as (
  select 'session_messages' as ref_table, 'tool_use_id' as ref_column, row_id as ref_key, session_key, {trimmed('tool_use_id')} as id, ingest_ts as seen from kept where {filled('tool_use_id')}
  union all select 'tool_results', 'tool_use_id', result_id, {session_key_sql('session_id')}, {trimmed('tool_use_id')}, returned_at from tool_results where {filled('tool_use_id')}
  union all select 'findings', 'call_id', finding_id, {session_key_sql('session_id')}, {trimmed('call_id')}, seen_at from findings where {filled('call_id')}),
lost as (
  select * from refs r where not exists (select 1 from living l where l.session_key = r.session_key and l.id = r.id)
  union all
  select 'findings', 'session_id', finding_id, {session_key_sql('session_id')}, '', seen_at from findings where {filled('session_id')}
    and {session_key_sql('session_id')} not in (select k from (select {session_key_sql('session_id', 'src_path')} as k from session_files) where k is not null))
"""

_CSV_FIELD = '("([^"]|"")*"|[^",]*)'
# json_valid takes NaN, Infinity and commas before a closing bracket; RFC 8259 doesn't
_BARE = """regexp_replace(raw_text, '"([^"\\\\]|\\\\.)*"', '""', 'g')"""
_JSON_BAD = f"(not json_valid(raw_text) or regexp_matches({_BARE}, '(?i)nan|inf|,\\s*[}}\\]]'))"

_DRIFT = """
with recursive tree as (
  select r.rec_id, t.id, t.parent, t.key, t.type from drift_records r, json_tree(r.record) t where json_valid(r.record)),
names as (select field_name, min(canonical_name) as canonical_name from field_names group by 1),
fields as (
  select c.rec_id, c.id, c.parent, c.type, c.key, p.type = 'ARRAY' as in_array,
    coalesce(n.canonical_name, replace(replace(lower(c.key), '_', ''), '-', '')) as name
  from tree c left join tree p on p.rec_id = c.rec_id and p.id = c.parent
  left join names n on n.field_name = replace(replace(lower(c.key), '_', ''), '-', '')),
walk as (
  select rec_id, id, '' as path, type, cast(null as varchar) as spelling, true as element, false as inside from tree where parent is null
  union all
  select f.rec_id, f.id, case when f.in_array then w.path when w.path = '' then f.name else w.path || '.' || f.name end, f.type, f.key, f.in_array, w.inside or f.in_array
  from walk w join fields f on f.rec_id = w.rec_id and f.parent = w.id where w.path <> 'message.content.input'),
seen as (
  select d.stream_name, d.file_id, w.path as field_path, w.spelling,
    case w.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then null else 'number' end as kind
  from walk w join drift_records d using (rec_id) where not w.element),
files as (
  select stream_name, file_id, row_number() over (partition by stream_name order by min(file_time), file_id) as no from drift_records group by 1, 2),
cat as (
  select s.stream_name, f.no, s.file_id, field_path, list_sort(list(distinct spelling)) as spellings,
    coalesce(list_sort(list(distinct kind) filter (kind is not null)), []) as kinds
  from seen s join files f on f.stream_name = s.stream_name and f.file_id = s.file_id group by 1, 2, 3, 4),
pairs as (
  select n.stream_name, n.file_id, n.no, o.no as old_no from files n join files o on o.stream_name = n.stream_name and o.no = n.no - 1),
both_ as (select p.file_id, a.field_path, a.spellings, a.kinds, b.spellings as old_spellings, b.kinds as old_kinds from pairs p
  join cat a on a.stream_name = p.stream_name and a.no = p.no join cat b on b.stream_name = p.stream_name and b.no = p.old_no and b.field_path = a.field_path),
one as (
  select p.file_id, a.field_path, 'added' as change_kind from pairs p join cat a on a.stream_name = p.stream_name and a.no = p.no
    where not exists (select 1 from cat b where b.stream_name = p.stream_name and b.no = p.old_no and b.field_path = a.field_path)
  union all
  select p.file_id, b.field_path, 'removed' from pairs p join cat b on b.stream_name = p.stream_name and b.no = p.old_no
    where not exists (select 1 from cat a where a.stream_name = p.stream_name and a.no = p.no and a.field_path = b.field_path)),
changed as (
  select o.* from one o where position('.' in o.field_path) = 0
    or exists (select 1 from both_ b where b.file_id = o.file_id and b.field_path = regexp_replace(o.field_path, '\\.[^.]*$', ''))
  union all select file_id, field_path, 'renamed' from both_ where spellings <> old_spellings
  union all select file_id, field_path, 'retyped' from both_ where kinds <> old_kinds and len(kinds) > 0 and len(old_kinds) > 0)
"""

SQL = {
    "p2_found": f"{_DRIFT} select file_id, field_path, change_kind from changed",
    "p2_casts": f"""{_DRIFT},
per_record as (select rec_id, field_path, spelling, kind, bool_or(inside) as inside from (
  select w.rec_id, w.path as field_path, w.spelling, w.inside, case w.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then null else 'number' end as kind
  from walk w where not w.element) group by 1, 2, 3, 4),
folded as (select field_path, coalesce(list_sort(list(distinct kind) filter (kind is not null)), []) as json_types, list_sort(list(distinct spelling)) as spellings, count(*) as records, bool_or(inside) as inside from per_record group by 1)
select field_path, json_types, spellings, records, case when inside then 'string' when json_types = ['number'] then 'double' when json_types = ['boolean'] then 'boolean' else 'string' end as column_type from folded""",
    "p2_changes": f"""{_DRIFT},
held as (select file_id, field_path from both_),
steps as (
  select p.stream_name, p.no as file_no, p.file_id, 'added' as change_kind, a.field_path, a.spellings, a.kinds as json_types, null::varchar[] as was_spelled, null::varchar[] as was_typed
    from pairs p join cat a on a.stream_name = p.stream_name and a.no = p.no
    where not exists (select 1 from cat b where b.stream_name = p.stream_name and b.no = p.old_no and b.field_path = a.field_path)
  union all
  select p.stream_name, p.no, p.file_id, 'removed', b.field_path, null, null, b.spellings, b.kinds from pairs p join cat b on b.stream_name = p.stream_name and b.no = p.old_no
    where not exists (select 1 from cat a where a.stream_name = p.stream_name and a.no = p.no and a.field_path = b.field_path))
select * from steps s where position('.' in s.field_path) = 0 or exists (select 1 from held h where h.file_id = s.file_id and h.field_path = regexp_replace(s.field_path, '\\.[^.]*$', ''))
union all
select p.stream_name, p.no, b.file_id, k.kind, b.field_path, b.spellings, b.kinds, b.old_spellings, b.old_kinds
from both_ b join pairs p on p.file_id = b.file_id join (select unnest(['renamed', 'retyped']) as kind) k
  on (k.kind = 'renamed' and b.spellings <> b.old_spellings) or (k.kind = 'retyped' and b.kinds <> b.old_kinds and len(b.kinds) > 0 and len(b.old_kinds) > 0)""",
    "p2_values": f"""{_DRIFT},
parents as (select distinct regexp_replace(path, '\\.[^.]*$', '') as path from walk where not element and position('.' in path) > 0),
plain as (select distinct path from walk where type not in ('OBJECT', 'ARRAY', 'NULL') and path <> ''),
columns_ as (select distinct path from walk w where not element and (path not in (select path from parents) or path in (select path from plain)))
select w.path as field_path, count(distinct case when w.inside or w.type <> 'NULL' then w.rec_id end) as records from walk w join columns_ c on c.path = w.path where not w.element group by 1""",
    "p3_found": """
with r as (select rec_id, cast(record as json) as j from nested_records),
shaped as (select rec_id, j, json_extract(j, '$.message.content') as c, json_extract(j, '$.toolUseResult') as u from r),
blocks as (
  select rec_id, 0 as i, c as b from shaped where json_type(c) = 'VARCHAR'
  union all
  select rec_id, cast(t.i as integer) as i, json_extract(c, '$[' || t.i || ']') as b from shaped, unnest(range(cast(json_array_length(c) as bigint))) as t(i) where json_type(c) = 'ARRAY'),
typed as (
  select rec_id, i, b, case when json_type(b) = 'VARCHAR' then 'text' when json_type(b, '$.type') = 'VARCHAR' then b ->> '$.type' else 'text' end as node_type
  from blocks where json_type(b) in ('OBJECT', 'VARCHAR')),
inner_ as (select rec_id, i, json_extract(b, '$.content') as c, case when json_type(b, '$.tool_use_id') = 'VARCHAR' then b ->> '$.tool_use_id' else '' end as link_key from typed where node_type = 'tool_result' and json_type(b) = 'OBJECT'),
parts as (
  select rec_id, i, 0 as k, c as p, link_key from inner_ where json_type(c) = 'VARCHAR'
  union all
  select rec_id, i, cast(t.k as integer), json_extract(c, '$[' || t.k || ']'), link_key from inner_, unnest(range(cast(json_array_length(c) as bigint))) as t(k) where json_type(c) = 'ARRAY')
select rec_id, 'content.' || i as node_path, node_type,
  coalesce(case when json_type(b) = 'OBJECT' and node_type = 'tool_result' and json_type(b, '$.tool_use_id') = 'VARCHAR' then b ->> '$.tool_use_id'
    when json_type(b) = 'OBJECT' and node_type = 'tool_use' and json_type(b, '$.id') = 'VARCHAR' then b ->> '$.id' end, '') as link_key from typed
union all
select rec_id, 'content.' || i || '.content.' || k, case when json_type(p) = 'VARCHAR' then 'text' when json_type(p, '$.type') = 'VARCHAR' then p ->> '$.type' else 'text' end, link_key from parts where json_type(p) in ('OBJECT', 'VARCHAR')
union all
select rec_id, 'toolUseResult.structuredPatch.' || t.k, 'hunk', case when json_type(u, '$.filePath') = 'VARCHAR' then u ->> '$.filePath' else '' end
from shaped, unnest(range(cast(json_array_length(json_extract(u, '$.structuredPatch')) as bigint))) as t(k)
where json_type(u) = 'OBJECT' and json_type(u, '$.structuredPatch') = 'ARRAY' and json_type(u, '$.structuredPatch[' || t.k || ']') = 'OBJECT'
union all
select rec_id, 'self', 'tool_use', case when json_type(j, '$.id') = 'VARCHAR' then j ->> '$.id' else '' end from shaped
where json_type(j, '$.type') = 'VARCHAR' and j ->> '$.type' = 'tool_use' and coalesce(json_type(j, '$.message'), 'NULL') = 'NULL'
""",
    "p4_found": f"{P4_ORPHANS} select ref_table, ref_column, ref_key from lost",
    "p4_report": f"""{P4_ORPHANS}
select ref_table, ref_column, cast(date_trunc('month', seen at time zone 'UTC') as timestamp) as month, count(*) as orphans, count(distinct (coalesce(session_key, chr(1)), id)) as missing_keys
from lost group by 1, 2, 3""",
    "p5_found": f"""
with lines as (select *, lower(trim(line_format)) as f from raw_lines where {filled('raw_text')}),
j as (select raw_id, raw_text as t, {_JSON_BAD} as broken from lines where f = 'jsonl'),
jv as (select raw_id, broken, case when not broken then try_cast(t as json) end as v from j),
c as (select raw_id, raw_text as t, regexp_full_match(raw_text, '(?s){_CSV_FIELD}(,{_CSV_FIELD})*') as ok from lines where f = 'csv' and line_no is distinct from 0),
cells as (select raw_id, ok, list_transform(regexp_extract_all(',' || t, '(?s),{_CSV_FIELD}', 1), lambda x: case when x like '"%' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) as v from c)
select raw_id, 'syntax' as reason from jv where broken
union all select raw_id, 'not_object' from jv where not broken and json_type(v) <> 'OBJECT'
union all select raw_id, 'invalid_value' from jv where not broken and json_type(v) = 'OBJECT' and (
  coalesce(json_type(v, '$.type'), '') <> 'VARCHAR' or (v ->> '$.type') not in ('assistant', 'user', 'system', 'summary')
  or (coalesce(json_type(v, '$.timestamp'), 'NULL') <> 'NULL' and not (json_type(v, '$.timestamp') = 'VARCHAR' and {is_datetime_sql("(v ->> '$.timestamp')")})))
union all select raw_id, 'quoting' from cells where not ok
union all select raw_id, 'column_count' from cells where ok and len(v) <> 9
union all select raw_id, 'invalid_value' from cells where ok and len(v) = 9 and not (
  v[1] <> '' and regexp_full_match(v[4], '[0-9]+') and regexp_full_match(v[5], '[0-9]+') and regexp_full_match(v[6], '[0-9]+')
  and v[7] in ('A', 'B', 'C', 'D', 'F') and regexp_full_match(v[8], '[+-]?[0-9]+') and coalesce(try_cast(v[8] as integer) between 0 and 100, false)
  and (v[9] = '' or coalesce({is_datetime_sql('v[9]')}, false)))
""",
}



def _shown(j: str, path: str) -> str:
    """A string as it is, null for null, else the JSON text."""
    return f"case json_type({j}, '$.{path}') when 'VARCHAR' then {j} ->> '$.{path}' when 'NULL' then null else cast(json_extract({j}, '$.{path}') as varchar) end"


def _spelled(j: str, *names: str) -> str:
    return "coalesce(" + ", ".join([f"nullif({_shown(j, n)}, '')" for n in names] + [_shown(j, n) for n in names]) + ")"


#: Nodes with their labels: a node opens and closes at one tick each, so what stands before
#: it in its record has used up two ticks a node.
_LABELS = f"""{SQL['p3_found'].partition('select rec_id, ' + chr(39) + 'content.')[0].rstrip().rstrip(',')},
selfs as (select rec_id, -1 as i, j as b, 'tool_use' as node_type from shaped where json_type(j, '$.type') = 'VARCHAR' and j ->> '$.type' = 'tool_use' and coalesce(json_type(j, '$.message'), 'NULL') = 'NULL'),
every as (select * from typed union all select * from selfs),
sound as (select rec_id, i, k, p, link_key, case when json_type(p) = 'VARCHAR' then 'text' when json_type(p, '$.type') = 'VARCHAR' then p ->> '$.type' else 'text' end as part_type from parts where json_type(p) in ('OBJECT', 'VARCHAR')),
sized as (select e.*, coalesce(n.n, 0) as n_parts from every e left join (select rec_id, i, count(*) as n from sound group by 1, 2) n on n.rec_id = e.rec_id and n.i = e.i),
b_ as (select *, 1 + coalesce(sum(2 + 2 * n_parts) over (partition by rec_id order by i rows between unbounded preceding and 1 preceding), 0) as pre from sized),
p_ as (select s.*, b_.pre as parent_pre, b_.pre + 2 * row_number() over (partition by s.rec_id, s.i order by k) - 1 as pre from sound s join b_ on b_.rec_id = s.rec_id and b_.i = s.i),
totals as (select rec_id, sum(2 + 2 * n_parts) as t from sized group by 1),
hunks as (
  select rec_id, cast(t.k as integer) as k, u, json_extract(u, '$.structuredPatch[' || t.k || ']') as h from shaped, unnest(range(cast(json_array_length(json_extract(u, '$.structuredPatch')) as bigint))) as t(k)
  where json_type(u) = 'OBJECT' and json_type(u, '$.structuredPatch') = 'ARRAY' and json_type(u, '$.structuredPatch[' || t.k || ']') = 'OBJECT'),
h_ as (select h.*, coalesce(t.t, 0) + 2 * row_number() over (partition by h.rec_id order by k) - 1 as pre from hunks h left join totals t on t.rec_id = h.rec_id),
links as (select rec_id, i, case when json_type(b) = 'OBJECT' and node_type = 'tool_result' and json_type(b, '$.tool_use_id') = 'VARCHAR' then b ->> '$.tool_use_id' when json_type(b) = 'OBJECT' and node_type = 'tool_use' and json_type(b, '$.id') = 'VARCHAR' then b ->> '$.id' else '' end as link_key from b_)
"""
_RESULTS = [
    ("type", "result_type", ""), ("filePath", "result_file_path", ""), ("content", "result_content", ""), ("originalFile", "original_file", ""), ("userModified", "user_modified", "boolean"),
    ("stdout", "stdout", ""), ("stderr", "stderr", ""), ("interrupted", "interrupted", "boolean"), ("isImage", "is_image", "boolean"), ("noOutputExpected", "no_output_expected", "boolean"),
]
_RESULT_COLUMNS = ", ".join(f"case when json_type(u) = 'OBJECT' then {'try_cast(' + _shown('u', n) + ' as boolean)' if t else _shown('u', n)} end as {a}" for n, a, t in _RESULTS)
_TEXT = "case when json_type({0}) = 'VARCHAR' then {0} ->> '$' else {1} end"
SQL["p3_records"] = f"""{_LABELS}
select s.rec_id, cast(0 as integer) as pre, cast(1 + coalesce(t.t, 0) + 2 * coalesce(n.n, 0) as integer) as post, case when json_type(j, '$.type') = 'VARCHAR' then j ->> '$.type' else '' end as record_type,
  {_shown('j', 'cwd')} as cwd, {_shown('j', 'sessionId')} as session_id, {_shown('j', 'timestamp')} as ts_text, {_shown('j', 'message.role')} as message_role, {_shown('j', 'message.model')} as message_model,
  case json_type(u) when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then null else case when u is not null then 'number' end end as result_form,
  case when json_type(u) <> 'OBJECT' then {_shown('j', 'toolUseResult')} end as result_text, {_RESULT_COLUMNS}
from shaped s left join totals t on t.rec_id = s.rec_id left join (select rec_id, count(*) as n from hunks group by 1) n on n.rec_id = s.rec_id where json_type(j) = 'OBJECT'"""
SQL["p3_blocks"] = f"""{_LABELS}
select b_.rec_id, cast(pre as integer) as pre, cast(pre + 1 + 2 * n_parts as integer) as post, cast(0 as integer) as parent_pre, case when b_.i < 0 then 'self' else 'content.' || b_.i end as node_path, case when b_.i >= 0 then b_.i end as ordinal,
  node_type as block_type, link_key, case when json_type(b) = 'OBJECT' then {_spelled('b', 'name', 'tool', 'tool_name')} end as tool_name, case when json_type(b) = 'OBJECT' then {_spelled('b', 'input', 'parameters', 'params')} end as tool_input,
  {_TEXT.format('b', _shown('b', 'text'))} as text from b_ join links l on l.rec_id = b_.rec_id and l.i = b_.i"""
SQL["p3_parts"] = f"""{_LABELS}
select rec_id, cast(pre as integer) as pre, cast(pre + 1 as integer) as post, cast(parent_pre as integer) as parent_pre, 'content.' || i as parent_path, 'content.' || i || '.content.' || k as node_path, k as ordinal, part_type, link_key,
  {_TEXT.format('p', _shown('p', 'text'))} as text, case when json_type(p) = 'OBJECT' then {_shown('p', 'source')} end as source from p_"""
SQL["p3_hunks"] = f"""{_LABELS}
select rec_id, cast(pre as integer) as pre, cast(pre + 1 as integer) as post, cast(0 as integer) as parent_pre, 'toolUseResult.structuredPatch.' || k as node_path, k as ordinal, case when json_type(u, '$.filePath') = 'VARCHAR' then u ->> '$.filePath' else '' end as file_path,
  {', '.join(f"try_cast({_shown('h', n)} as integer) as {a}" for n, a in (('oldStart', 'old_start'), ('oldLines', 'old_lines'), ('newStart', 'new_start'), ('newLines', 'new_lines')))}, {_shown('h', 'lines')} as lines from h_"""
SQL["p3_unreadable"] = """
select rec_id, case when record is null then 'null' when not json_valid(record) then 'syntax' else 'not_object' end as reason from nested_records
where record is null or not json_valid(record) or json_type(cast(record as json)) <> 'OBJECT'"""
SQL["p5_failures"] = f"""with found as ({SQL['p5_found']}) select raw_id, src_file, line_no, lower(trim(line_format)) as line_format, reason, raw_text, loaded_at from found join raw_lines using (raw_id)"""
SQL["p5_report"] = f"""with found as ({SQL['p5_found']}) select src_file, lower(trim(line_format)) as line_format, reason, count(*) as failing from found join raw_lines using (raw_id) group by all"""
SQL["p5_csv_rows"] = f"""
with found as ({SQL['p5_found']}),
c as (select raw_id, src_file, line_no, loaded_at, raw_text as t from raw_lines where lower(trim(line_format)) = 'csv' and line_no is distinct from 0 and {filled('raw_text')} and raw_id not in (select raw_id from found)),
v as (select *, list_transform(regexp_extract_all(',' || t, '(?s),{_CSV_FIELD}', 1), lambda x: case when x like '"%' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) as v from c)
select raw_id, src_file, line_no, nullif(v[1], '') as session_id, nullif(v[2], '') as src_path, nullif(v[3], '') as project_root, try_cast(v[4] as bigint) as event_count, try_cast(v[5] as bigint) as skipped_lines,
  try_cast(v[6] as bigint) as tool_call_count, nullif(v[7], '') as grade, try_cast(v[8] as integer) as grade_score, nullif(v[9], '') as first_ts, loaded_at from v"""

SQL["p5_jsonl_rows"] = f"""
with found as ({SQL['p5_found']}),
j as (select raw_id, src_file, line_no, loaded_at, cast(raw_text as json) as v from raw_lines where lower(trim(line_format)) = 'jsonl' and {filled('raw_text')} and raw_id not in (select raw_id from found))
select raw_id, src_file, line_no, {', '.join(f"{_shown('v', path)} as {name}" for path, name in (('type', 'event_type'), ('sessionId', 'session_id'), ('timestamp', 'ts_text'), ('cwd', 'cwd'), ('message.role', 'msg_role'), ('message.content', 'content')))}, loaded_at from j"""
