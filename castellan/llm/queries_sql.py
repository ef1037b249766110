"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from castellan.functions.text import WHITE_SPACE
from castellan.llm.secrets import FIELDS
from castellan.plans.records_sql import KEPT, filled, session_key_sql, trimmed

_DROP = "'0123456789' || " + " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def near(c: str) -> str:
    return f"translate(coalesce({c}, ''), '{_UP}' || {_DROP}, '{_UP.lower()}')"


def _runs(seq: str, rows: str, same: str, order: str, key: str, amount: str, more: str = "") -> str:
    """Runs of at least three; ``more`` are further columns of each."""
    return f"""
select '{seq}' as seq_table, session_key, first({key} order by place) as first_row_id, cast(sum({amount}) as bigint) as occurrences{more}
from (
  select *, sum(fresh) over (partition by session_key order by place) as run from (
    select *, case when sign is distinct from lag(sign) over (partition by session_key order by place) then 1 else 0 end as fresh from (
      select *, {same} as sign, row_number() over (partition by session_key order by {order}) as place from {rows})))
group by session_key, run having count(*) >= 3"""


def _both_runs(with_places: bool) -> str:
    def more(key: str, position: str, us: str) -> str:
        if not with_places:
            return ""
        first, last = f"first({us} order by place)", f"last({us} order by place)"
        return (
            f", last({key} order by place) as last_row_id, count(*) as n_rows, list(cast({position} as bigint) order by place)[2:] as also_at,"
            f" make_timestamp({first}) as first_at, make_timestamp({last}) as last_at, ({last} - {first}) / 1e6 as duration_s"
        )

    return f"""
{KEPT},
c as (select * from timed where is_call),
f as (select *, {session_key_sql('session_id')} as session_key, epoch_us(seen_at) as us from findings),
g as (select * from f where session_key is not null)
{_runs('session_messages', 'c', f"row(lower({trimmed('tool_name')}), {near('tool_input')})", 'instant nulls first, src_path nulls first, line_no nulls first', 'row_id', '1', more('row_id', 'line_no', 'instant'))}
union all
{_runs('findings', 'g', f"row(rule_id, title, {near('evidence')})", 'seen_at nulls first, finding_id', 'finding_id', 'coalesce(occurrences, 1)', more('finding_id', 'event_index', 'us'))}"""


SQL = {
    "p1_found": f"""
{KEPT},
facts as (
  select *, row_number() over (partition by session_key order by instant nulls first, src_path nulls first, line_no nulls first) as place,
    coalesce(role = 'user' and not {filled('tool_use_id')}, false) as prompt,
    coalesce(is_call or (role = 'assistant' and {filled('body')}), false) as reply,
    coalesce(role in ('user', 'assistant') and ({filled('body')} or is_call or {filled('tool_use_id')}), false) as content
  from timed),
gaps as (select session_key from facts group by session_key, src_path having count(line_no) <> max(line_no) + 1 or min(line_no) <> 0),
unanswered as (
  select session_key from (
    select session_key, prompt, lead(reply) over (partition by session_key order by place) as answered from facts where prompt or reply)
  where prompt and not coalesce(answered, false)),
opening as (
  select session_key from facts where role is distinct from 'system'
  qualify row_number() over (partition by session_key order by place) = 1 and not prompt)
select distinct session_key from (
  select session_key from gaps union all select session_key from facts where role is null union all select session_key from opening
  union all select session_key from facts group by 1 having not bool_or(content) union all select session_key from unanswered)""",
    "p6_found": _both_runs(False),
    "p6_runs": _both_runs(True),
    # what must hold whatever was drawn, cut or masked
    "p7_kept": " union all ".join(f"select '{t}' as src_table, '{c}' as field_name, cast({k} as bigint) as row_key, true as same_length, true as same_lines, true as same_rest from {t} where length({c}) > 0" for t, c, k in FIELDS),
    "p8_round_trip": "select doc_id, md5(coalesce(text, '')) as text_md5 from documents",
    "p9_checks": f"select distinct lower({trimmed('source')}) as source, true as within_cap, true as share_met, true as as_large_as_possible from mix_targets where source is not null and target_share > 0 and max_repeats > 0",
    "p10_checks": "select doc_id, true as sound from documents",
}
SQL["p1_conversations"] = (
    SQL["p1_found"].replace("select distinct session_key from (", "select f.session_key, cast(place - 1 as bigint) as turn, role as speaker, make_timestamp(instant) as spoken_at, row_id, content_id, tool_name, tool_input, tool_use_id, body from facts f where session_key not in (select session_key from (")
    + ")"
)
