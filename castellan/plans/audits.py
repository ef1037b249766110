"""Queries of the audit over the tables of a data folder, with their SQL.

A session is a transcript file of session_messages: kept rows, line numbers as event
indices.  Operators on findings also run over the findings table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castellan.functions import evidence, hosts, lexers, paths
from castellan.functions.text import session_key
from castellan.operators import grading, sessions
from castellan.operators.ordering import numbered
from castellan.operators.tables import cut, stored
from castellan.plans.audit import audit_events, egress_of, inputs
from castellan.plans.load import table
from castellan.plans.records_sql import KEPT, filled, session_key_sql, trimmed
from castellan.rules import catalog as C
from castellan.rules import shell, simple
from castellan.rules.base import findings
from castellan.sources import transcripts


def _events(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.events_of_messages(table(spark, d, "session_messages"))


def _inputs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    events = stored(_events(spark, d))
    return inputs(events, cut(sessions.sessions(events)))


def _found(spark: SparkSession, d: str) -> DataFrame:
    """The findings table in the form of collapsible findings."""
    level = F.array_position(F.array(*map(F.lit, C.SEVERITIES)), F.lower("severity")).cast("int") - 1
    return table(spark, d, "findings").select(
        session_key(F.col("session_id")).alias("session_key"), "rule_id", "title", "evidence", "event_index", F.struct("seen_at", "finding_id").alias("emit"), "finding_id", "tool_name", level.alias("severity")
    )


def tool_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions.calls(_events(spark, d))
    return rows.groupBy("tool_kind").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("session_key").alias("sessions"))


def majority_cwd(spark: SparkSession, d: str) -> DataFrame:
    return sessions.majority_cwd(_events(spark, d))


def home_folders(spark: SparkSession, d: str) -> DataFrame:
    return sessions.homes(_events(spark, d))


def session_attributes(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions(stored(_events(spark, d))).drop("last_event")


def session_counters(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions(stored(_events(spark, d))).select("session_key", "event_count", "tool_call_count", "truncated_results", "first_ts", "last_ts")


def correlated_results(spark: SparkSession, d: str) -> DataFrame:
    return sessions.results(_events(spark, d)).select("session_key", "event_index", "tool_use_id", "tool_name")


def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.contains("text", F.lit("://"))).select("doc_id", F.posexplode(hosts.url_hosts(F.col("text"))).alias("place", "host"))
    return docs.withColumn("external", hosts.is_external(F.col("host")))


def contacted_hosts(spark: SparkSession, d: str) -> DataFrame:
    return simple.contacted_hosts(egress_of(_events(spark, d)))


def _rule(rule):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = findings([rule], _inputs(spark, d))
        return evidence.with_evidence(found).drop("emit", "remediation", "detail", "category")

    return query


def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(evidence.redact(F.col("text"))).alias("text_md5"))


def shortened_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence.with_evidence(table(spark, d, "findings").select("finding_id", "evidence"))


def escaped_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with control characters in their visible form."""
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"[\x00-\x1f\x7f-\x9f]"))
    return docs.select("doc_id", F.md5(evidence.escaped(F.col("text"))).alias("text_md5"))


def report_places(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each session in report order."""
    found = _found(spark, d).join(table(spark, d, "findings").select("finding_id", "category"), "finding_id").where("session_key is not null")
    return numbered(found.select("session_key", "finding_id", (-F.col("severity")).alias("_level"), "category", "event_index", "emit"), "session_key", "_level", "category", "event_index", "emit", name="place").select("session_key", "finding_id", "place")


def first_wins(spark: SparkSession, d: str) -> DataFrame:
    """First finding of each session, rule and event, by time and id."""
    f = _found(spark, d)
    return f.groupBy("session_key", "rule_id", "event_index").agg(F.min_by("finding_id", "emit").alias("finding_id"))


def collapsed_findings(spark: SparkSession, d: str) -> DataFrame:
    return grading.collapse(_found(spark, d)).select("session_key", "rule_id", "title", "evidence", "finding_id", "severity", "occurrences", F.array_join("also_at", ",").alias("also_at"))


def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return grading.severity_counts(grading.collapse(_found(spark, d)))


def graded_sessions(spark: SparkSession, d: str) -> DataFrame:
    return grading.grades(grading.severity_counts(grading.collapse(_found(spark, d)))).select("session_key", "grade", "grade_score")


def min_grade(spark: SparkSession, d: str) -> DataFrame:
    return grading.at_least(table(spark, d, "session_files").select("src_path", "grade", "grade_score"), "C")


def fail_on(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).agg(F.max("severity").alias("worst")).select("worst", (F.col("worst") >= C.HIGH).alias("fails"))


def tail_newest(spark: SparkSession, d: str) -> DataFrame:
    """The 50 newest session files: the limit is the operator."""
    return table(spark, d, "session_files").select("src_path", "last_ts").orderBy(F.desc_nulls_last("last_ts"), "src_path").limit(50)


def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    p = paths.normal(paths.posix_path_column(F.col("file_path")))
    return table(spark, d, "tool_results").where(F.col("file_path").startswith("/")).select(
        "result_id", p.alias("path"), paths.is_sensitive(F.col("file_path")).alias("sensitive"), paths.is_scratch(F.col("file_path")).alias("scratch"), paths.is_device(F.col("file_path")).alias("device")
    )


def command_segments(spark: SparkSession, d: str) -> DataFrame:
    calls = _inputs(spark, d)["calls"].where("tool_kind = 'bash' and cmd <> ''")
    return calls.select("session_key", "event_index", F.posexplode("segments").alias("place", "s")).select("session_key", "event_index", "place", "s.text", "s.masked")


def hidden_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(lexers.unhidden(F.col("text"))).alias("place", "v")).select("doc_id", "place", F.col("v.note").alias("note"), F.md5("v.text").alias("text_md5"))


def audit_findings(spark: SparkSession, d: str) -> DataFrame:
    return audit_events(stored(_events(spark, d))).findings.drop("emit")


def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    found = audit_events(stored(_events(spark, d))).findings
    return found.groupBy("rule_id", "title", "severity").agg(F.count(F.lit(1)).alias("findings"), F.sum("occurrences").alias("occurrences"))


def fleet_summary(spark: SparkSession, d: str) -> DataFrame:
    return grading.summary_lines(audit_events(stored(_events(spark, d))).results)


def session_reports(spark: SparkSession, d: str) -> DataFrame:
    from castellan.plans.report import session_documents

    done = audit_events(stored(_events(spark, d)))
    return session_documents(done._replace(findings=cut(done.findings)))


QUERIES = {
    f.__name__: f
    for f in (
        tool_kinds, majority_cwd, home_folders, session_attributes, session_counters, correlated_results, url_hosts, contacted_hosts, redacted_documents, shortened_evidence, escaped_texts, report_places, first_wins, collapsed_findings,
        severity_counts, graded_sessions, min_grade, fail_on, tail_newest, path_predicates, command_segments, hidden_texts, audit_findings, rule_counts, fleet_summary, session_reports,
    )
} | {
    f"rule_{n}": _rule(r)
    for n, r in (
        ("integrity", simple.integrity), ("filesystem", shell.filesystem), ("destructive", shell.destructive), ("credentials", shell.credentials),
        ("network", simple.network), ("remote_code", simple.remote_code), ("persistence", simple.persistence), ("injection", simple.injection),
    )
}

# -- SQL -----------------------------------------------------------------------------------


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KIND = "case " + "when n like 'mcp\\_\\_%' escape '\\' then 'mcp' " + " ".join(f"when n = '{n}' then '{k}'" for n, k in C.TOOL_KINDS.items()) + " else 'other' end"
_EVENTS = f"""{KEPT},
e as (select coalesce(src_path, session_key) as session_key, line_no as event_index, nullif(cwd, '') as cwd, nullif(ts_text, '') as ts, tool_name, tool_input, coalesce({trimmed('content_id')}, '') as call_id, {trimmed('tool_use_id')} as ref, body
  from kept where line_no is not null),
calls as (select *, {_KIND} as kind from (select *, lower(trim(tool_name)) as n from e where {filled('tool_name')} and tool_input like '{{%')),
results as (select * from e where {filled('ref')} and body <> '')"""
_FIELD = lambda n: f"case when json_type(tool_input, '$.{n}') = 'VARCHAR' then tool_input ->> '$.{n}' end"
_FINDINGS = f"f as (select *, {session_key_sql('session_id')} as session_key, list_position([{', '.join(map(_q, C.SEVERITIES))}], lower(severity)) - 1 as level from findings)"
_COLLAPSED = f"""with {_FINDINGS},
r as (select *, row_number() over w as rn, count(*) over (partition by session_key, rule_id, title, evidence) as times from f window w as (partition by session_key, rule_id, title, evidence order by seen_at nulls first, finding_id)),
c as (select session_key, rule_id, title, evidence, first(finding_id order by rn) as finding_id, cast(first(level order by rn) as integer) as severity, max(times) as occurrences,
  coalesce(array_to_string(list_slice(list_sort(list(distinct event_index) filter (rn > 1)), 1, 4), ','), '') as also_at from r group by all)"""
_COUNTS = "select session_key, " + ", ".join(f"count(*) filter (severity = {i}) as n_{n}" for i, n in enumerate(C.SEVERITIES)) + ", max(severity) as worst from c group by 1"


def _redact_sql(c: str) -> str:
    for label, p in C.REDACTIONS:
        new = f"\\1<redacted:{label}>\\3" if re.compile(p).groups else f"<redacted:{label}>"
        c = f"regexp_replace({c}, {_q(p)}, {_q(new)}, 'g')"
    return c


def _match(column: str, p: str, ignore_case: bool = True, multiline: bool = False) -> str:
    flags = ("i" if ignore_case else "") + ("m" if multiline else "")
    return f"regexp_matches({column}, {_q(('(?' + flags + ')' if flags else '') + p)})"


def _short(c: str) -> str:
    line = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return f"case when length({line}) > 160 then left({line}, 157) || '...' else {line} end"


def _first_title(rows: str, text: str, rule: str, patterns: list[C.Pattern]) -> str:
    """One row per event and title: severity, and evidence of the first call."""
    each = " union all ".join(f"select session_key, event_index, tool_name, {_q(p.title)} as title, {p.severity} as severity, {text} as evidence from {rows} where {_match(text, p.regex, p.ignore_case, p.multiline)}" for p in patterns)
    return f"select distinct session_key, '{rule}' as rule_id, severity, title, {_short(_redact_sql('evidence'))} as evidence, event_index, tool_name from ({each})"


def _hosts(text: str) -> str:
    """Hosts of URLs, in order."""
    return f"list_transform(regexp_extract_all({text}, {_q('(?i)' + C.HOST_URL)}, 1), lambda x: lower(trim(split_part(split_part(split_part(x, '@', -1), '/', 1), ':', 1))))"


def _external(h: str) -> str:
    part = lambda i: f"try_cast(split_part({h}, '.', {i}) as bigint)"
    private = f"({part(1)} = 10 or ({part(1)} = 172 and {part(2)} between 16 and 31) or ({part(1)} = 192 and {part(2)} = 168) or ({part(1)} = 169 and {part(2)} = 254))"
    return f"(not ({h} in ('localhost', '0.0.0.0', '::1') or {h} like '127.%' or {h} like '%.local' or (regexp_full_match({h}, '[0-9]+(\\.[0-9]+){{3}}') and {private})))"


_COMMANDS = f"cmds as (select *, coalesce({_FIELD('command')}, '') as cmd from calls where kind = 'bash')"

SQL = {
    "tool_kinds": f"{_EVENTS} select kind as tool_kind, count(*) as calls, count(distinct session_key) as sessions from calls group by 1",
    "majority_cwd": f"{_EVENTS}, n as (select session_key, cwd, count(*) as n, min(event_index) as first_at from e where cwd is not null group by 1, 2) select session_key, first(cwd order by n desc, first_at) as project_root from n group by 1",
    "session_counters": f"""{_EVENTS},
a as (select session_key, count(*) as event_count, min_by(ts, event_index) filter (ts is not null) as first_ts, max_by(ts, event_index) filter (ts is not null) as last_ts from e group by 1)
select session_key, event_count, (select count(*) from calls c where c.session_key = a.session_key) as tool_call_count,
  (select count(*) from results r where r.session_key = a.session_key and length(body) > {C.MAX_RESULT_CHARS}) as truncated_results, first_ts, last_ts from a""",
    "correlated_results": f"""{_EVENTS},
named as (select session_key, call_id, max_by(tool_name, event_index) as tool from calls where call_id <> '' group by 1, 2)
select r.session_key, r.event_index, r.ref as tool_use_id, coalesce(n.tool, '') as tool_name from results r left join named n on n.session_key = r.session_key and n.call_id = r.ref""",
    "url_hosts": f"""with h as (select doc_id, {_hosts('text')} as hs from documents where contains(text, '://')),
u as (select doc_id, host, min(i) as i from (select doc_id, unnest(hs) as host, unnest(range(1, len(hs) + 1)) as i from h) where host <> '' group by 1, 2)
select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as integer) as place, host, {_external('host')} as external from u""",
    "redacted_documents": f"select doc_id, md5({_redact_sql('text')}) as text_md5 from documents where text is not null",
    "shortened_evidence": f"select finding_id, {_short(_redact_sql(chr(99) + 'oalesce(evidence, ' + chr(39) * 2 + ')'))} as evidence from findings",
    "first_wins": f"with {_FINDINGS} select session_key, rule_id, event_index, first(finding_id order by seen_at nulls first, finding_id) as finding_id from f group by 1, 2, 3",
    "collapsed_findings": f"{_COLLAPSED} select session_key, rule_id, title, evidence, finding_id, severity, occurrences, also_at from c",
    "severity_counts": f"{_COLLAPSED} {_COUNTS}",
    "graded_sessions": f"""{_COLLAPSED}, n as ({_COUNTS}),
s as (select *, greatest(0, least(100, 100 - 45 * n_critical - least(60, 15 * n_high) - least(20, 6 * n_medium) - least(10, 2 * n_low))) as raw from n),
g as (select *, case when n_critical = 0 and n_high > 0 then least(raw, 76) else raw end as grade_score from s)
select session_key, case when n_critical > 0 then 'F' when grade_score >= 90 then 'A' when grade_score >= 80 then 'B' when grade_score >= 70 then 'C' when grade_score >= 55 then 'D' else 'F' end as grade, grade_score from g""",
    "min_grade": "select src_path, grade, grade_score from session_files where upper(trim(grade)) in ('C', 'D', 'F')",
    "fail_on": f"with {_FINDINGS} select cast(max(level) as integer) as worst, max(level) >= 3 as fails from f",
    "tail_newest": "select src_path, last_ts from session_files order by last_ts desc nulls last, src_path limit 50",
    "rule_remote_code": f"{_EVENTS}, {_COMMANDS}, {_first_title('cmds', 'cmd', 'SXR-005', C.REMOTE_CODE).replace('select distinct', 'out_ as (select distinct', 1)}) select * from out_",
    "rule_injection": f"""{_EVENTS},
named as (select session_key, call_id, max_by(tool_name, event_index) as tool from calls where call_id <> '' group by 1, 2),
seen as (select r.session_key, r.event_index, coalesce(n.tool, '') as tool_name, left(r.body, {C.MAX_RESULT_CHARS}) as body from results r left join named n on n.session_key = r.session_key and n.call_id = r.ref
  where lower(trim(coalesce(n.tool, ''))) not in ('write', 'edit', 'multiedit', 'notebookedit'))
{_first_title('seen', 'body', 'SXR-007', C.INJECTION)}""",
}

_HOME = "regexp_extract({}, '^(/home/[^/]+|/Users/[^/]+|/c/Users/[^/]+|/root)(/|$)', 1)"
_HOMES = f"""
cand as (
  select session_key, 0 as tier, -n as a, at_ as b, 0 as c, {_HOME.format('cwd')} as home from (select session_key, cwd, count(*) as n, min(event_index) as at_ from e where cwd is not null group by 1, 2)
  union all
  select session_key, 1, event_index, 0, k, {_HOME.format('p')} from (
    select session_key, event_index, unnest([0, 1, 2]) as k, unnest([{', '.join(_FIELD(n) for n in C.PATH_FIELDS)}]) as p from calls)),
homes as (select session_key, first(home order by tier, a, b, c) as home from cand where home <> '' group by 1)"""
SQL["home_folders"] = f"{_EVENTS}, {_HOMES} select session_key, home from homes"
_ATTRIBUTES = SQL["session_counters"].replace("\nselect session_key, event_count, (select", ",\ncounted as (select session_key, event_count, (select", 1).replace("a as (select session_key, count(*)", "a as (select session_key, any_value(sid) as session_id, count(*)", 1)
SQL["session_attributes"] = (
    _ATTRIBUTES.replace("first_ts, last_ts from a", "first_ts, last_ts, session_id from a),", 1).replace("e as (select coalesce(src_path, session_key) as session_key,", "e as (select coalesce(src_path, session_key) as session_key, session_key as sid,", 1)
    + f"""{_HOMES},
roots as (select session_key, first(cwd order by n desc, at_) as project_root from (select session_key, cwd, count(*) as n, min(event_index) as at_ from e where cwd is not null group by 1, 2) group by 1)
select c.session_key, event_count, cast(0 as bigint) as skipped_lines, tool_call_count, truncated_results, first_ts, last_ts, coalesce(project_root, '') as project_root, coalesce(home, '{C.NO_HOME}') as home, session_id
from counted c left join roots r on r.session_key = c.session_key left join homes h on h.session_key = c.session_key"""
)
_STEPS = "list_reduce(list_concat([''], list_filter(string_split({0}, '/'), lambda x: x not in ('', '.'))), lambda done, x: case when x = '..' then regexp_replace(done, '/[^/]*$', '') else done || '/' || x end)"
SQL["path_predicates"] = f"""select result_id, case when file_path like '//%' and file_path not like '///%' then '/' else '' end || coalesce(nullif({_STEPS.format('file_path')}, ''), '/') as path,
  regexp_matches(file_path, {_q(C.SENSITIVE)}) as sensitive, regexp_matches(file_path, {_q(C.SCRATCH)}) as scratch, file_path in ({', '.join(map(_q, C.DEVICES))}) as device
from tool_results where file_path like '/%'"""
_CRON = r"\bcrontab\s+(?:[^\s\-]|-(?:[^l]|$)|-l\w)|/etc/cron\.|/var/spool/cron"
_PERSIST_TESTS = [(t, " and ".join(_match("cmd", _CRON if "crontab" in r else r) for r in rx)) for t, _, rx in C.PERSIST_COMMANDS]
_PERSIST_ROWS = " union all ".join(
    [f"select session_key, event_index, tool_name, {_q(t)} as title, cmd as evidence from cmds where {test}" for t, test in _PERSIST_TESTS]
    + [f"select session_key, event_index, tool_name, {_q(t)}, path from files where {_match('path', rx)}" for t, _, rx in C.PERSIST_PATHS]
)
SQL["rule_persistence"] = f"""{_EVENTS}, {_COMMANDS},
files as (select *, coalesce({', '.join(f"nullif({_FIELD(n)}, '')" for n in C.PATH_FIELDS)}, '') as path from calls where kind in ('write', 'edit'))
select distinct session_key, 'SXR-006' as rule_id, 3 as severity, title, {_short(_redact_sql('evidence'))} as evidence, event_index, tool_name from ({_PERSIST_ROWS})"""


# What the calls of a session reach, for the tables at hand: files by their tools, hosts by
# URLs in commands and web calls.  A shell command that names a path, a host without a
# scheme, or an MCP input with a URL, would need the lexers: such calls give a row of their
# own here, so that they can't go unnoticed.
_ROOTS = "roots as (select session_key, first(cwd order by n desc, at_) as root from (select session_key, cwd, count(*) as n, min(event_index) as at_ from e where cwd is not null group by 1, 2) group by 1)"
_NORMAL = "'/' || substr(" + _STEPS.format("whole") + ", 2)"
_REACH = f"""{_ROOTS},
files as (
  select c.*, coalesce({', '.join(f"nullif({_FIELD(n)}, '')" for n in C.PATH_FIELDS)}, '') as path, r.root from calls c left join roots r on r.session_key = c.session_key where kind in ('read', 'write', 'edit')),
absolute as (select *, case when path like '/%' then path when cwd is not null then cwd || '/' || path end as whole from files where path <> '' and path not like '~%'),
reached as (select *, {_NORMAL} as p from absolute where whole is not null),
outside as (
  select *, kind <> 'read' as writes, regexp_matches(p, '^(/tmp|/var/tmp|/var/folders)(/|$)') as scratch, regexp_matches(p, '^(/etc|/root)(/|$)|/\\.(ssh|aws|gnupg|kube|docker|config)') as sensitive
  from reached where not (p = root or p like root || '/%') and p not in ('/dev/null', '/dev/stdout', '/dev/stderr', '/dev/tty', '/dev/zero', '/dev/random', '/dev/urandom')),
fs as (
  select session_key, 'SXR-001' as rule_id, cast(case when writes and scratch then 1 when writes then 3 when sensitive then 2 else 1 end as integer) as severity,
    case when writes and scratch then 'Write reaches the OS scratch directory' when writes then 'Write reaches outside the project root'
      when sensitive then 'Read touches a sensitive directory outside the project root' else 'Read reaches outside the project root' end as title,
    case when writes then 'Writes ' else 'Read ' end || p || ', outside the session''s project root (' || root || ').' as detail, path as evidence, event_index, tool_name, {_q(C.DOCUMENTED['scope'])} as remediation from outside
  union all select session_key, 'SXR-001', 0, 'unread: a command with a path', '', tool_input, event_index, tool_name, '' from calls where kind = 'bash' and regexp_matches({_FIELD('command')}, '(^|[\\s"''=])([~/]|\\.\\./)')
  union all select session_key, 'SXR-001', 0, 'unread: a home or an MCP path', '', path, event_index, tool_name, '' from files where path like '~%'
  union all select session_key, 'SXR-001', 0, 'unread: an MCP path', '', tool_input, event_index, tool_name, '' from calls where kind = 'mcp' and regexp_matches(tool_input, '"(path|file|filename|dir|target|dest)": *"(/|~)')),
texts as (
  select session_key, event_index, tool_name, kind, case kind when 'bash' then coalesce({_FIELD('command')}, '') when 'web' then coalesce(nullif({_FIELD('url')}, ''), {_FIELD('query')}, '') else tool_input end as text from calls where kind in ('bash', 'web', 'mcp')),
named as (select *, list_filter(list_distinct({_hosts('text')}), lambda h: h <> '' and {_external('h')}) as hs from texts where kind <> 'mcp' or text like '%://%'),
net as (
  select session_key, 'SXR-004' as rule_id, 2 as severity, 'Outbound network request' as title, 'Reaches ' || array_to_string(hs, ', ') || '.' as detail, text as evidence, event_index, tool_name, 'Check that the task needs each of these hosts.' as remediation
  from named where len(hs) = 1 and kind <> 'mcp'
  union all select session_key, 'SXR-004', 0, 'unread: hosts', '', text, event_index, tool_name, '' from named where len(hs) > 1 or kind = 'mcp'
  union all select session_key, 'SXR-004', 0, 'unread: no plain request', '', text, event_index, tool_name, '' from texts where kind <> 'mcp'
    and (regexp_matches(text, '(?i)\\|\\s*(sudo\\s+)?(sh|bash|zsh|dash|python3?|node|ruby|perl)|/dev/(tcp|udp)|webhook[.]site|hooks[.]slack|api/webhooks|ngrok|pastebin|\\s-e\\b|\\s(-d|--data|-X)|(post|put|patch)\\s*\\(|-Method')
      or (regexp_matches(text, '(?i)(^|\\s)(curl|wget|nc|ncat|httpie|http)(\\.exe)?\\s') and text not like '%://%')))"""
_RULE_COLUMNS = f"session_key, rule_id, severity, title, {_short(_redact_sql('evidence'))} as evidence, event_index, tool_name"
SQL["rule_filesystem"] = f"{_EVENTS}, {_REACH} select {_RULE_COLUMNS} from fs"
SQL["rule_network"] = f"{_EVENTS}, {_REACH} select {_RULE_COLUMNS} from net"
SQL["contacted_hosts"] = f"{_EVENTS}, {_REACH} select session_key, list_sort(list(distinct host)) as network_hosts from (select session_key, unnest(hs) as host from named) group by 1"
_CATEGORY = "case rule_id when 'SXR-001' then 'filesystem-reach' else 'network-egress' end"
_AUDITED = f"""{_EVENTS}, {_REACH},
raw_ as (select session_key, rule_id, {_CATEGORY} as category, severity, title, detail, {_short(_redact_sql('evidence'))} as evidence, event_index, tool_name, remediation from (select * from fs union all select * from net)),
ranked as (select *, row_number() over w as rn, count(*) over (partition by session_key, rule_id, title, evidence) as times from raw_ window w as (partition by session_key, rule_id, title, evidence order by event_index)),
found as (
  select session_key, rule_id, category, title, evidence, first(severity order by rn) as severity, first(detail order by rn) as detail, first(event_index order by rn) as event_index, first(tool_name order by rn) as tool_name,
    first(remediation order by rn) as remediation, max(times) as occurrences, coalesce(list_slice(list_sort(list(distinct event_index) filter (rn > 1)), 1, 4), []) as also_at from ranked group by 1, 2, 3, 4, 5)"""
SQL["audit_findings"] = f"{_AUDITED} select * from found"
SQL["rule_counts"] = f"{_AUDITED} select rule_id, title, severity, count(*) as findings, cast(sum(occurrences) as bigint) as occurrences from found group by 1, 2, 3"
_PER_SESSION = f"""
base as (select session_key, any_value(sid) as session_id, count(*) as event_count, min_by(ts, event_index) filter (ts is not null) as first_ts, max_by(ts, event_index) filter (ts is not null) as last_ts from e group by 1),
counts as (select session_key, {', '.join(f"count(*) filter (severity = {i}) as n_{n}" for i, n in enumerate(C.SEVERITIES))}, max(severity) as worst from found group by 1),
joined as (
  select b.*, coalesce(r.root, '') as project_root, (select count(*) from calls c where c.session_key = b.session_key) as tool_call_count,
    (select count(*) from results x where x.session_key = b.session_key and length(body) > {C.MAX_RESULT_CHARS}) as truncated_results, {', '.join(f"coalesce(n_{n}, 0) as n_{n}" for n in C.SEVERITIES)}, worst,
    coalesce(h.network_hosts, []) as network_hosts
  from base b left join counts k on k.session_key = b.session_key left join roots r on r.session_key = b.session_key
  left join (select session_key, list_sort(list(distinct host)) as network_hosts from (select session_key, unnest(hs) as host from named) group by 1) h on h.session_key = b.session_key),
scored as (select *, greatest(0, least(100, 100 - 45 * n_critical - least(60, 15 * n_high) - least(20, 6 * n_medium) - least(10, 2 * n_low))) as raw from joined),
graded as (select *, case when n_critical = 0 and n_high > 0 then least(raw, 76) else raw end as grade_score from scored),
final as (select *, case when n_critical > 0 then 'F' when grade_score >= 90 then 'A' when grade_score >= 80 then 'B' when grade_score >= 70 then 'C' when grade_score >= 55 then 'D' else 'F' end as grade from graded)"""
_WITH_SID = _AUDITED.replace("e as (select coalesce(src_path, session_key) as session_key,", "e as (select coalesce(src_path, session_key) as session_key, session_key as sid,", 1)
_BITS = "array_to_string(list_filter([" + ", ".join(f"case when n_{n} > 0 then n_{n} || ' {n}' end" for n in reversed(C.SEVERITIES)) + "], lambda x: x is not null), ', ')"
SQL["fleet_summary"] = f"""{_WITH_SID}, {_PER_SESSION}
select session_key, '  ' || grade || ' (' || lpad(cast(grade_score as varchar), 3, ' ') || '/100)  ' || case when length(bits) < 24 then rpad(bits, 24, ' ') else bits end || '  '
  || lpad(cast(total as varchar), cast(greatest(2, length(cast(total as varchar))) as integer), ' ') || ' total' || case when truncated_results > 0 then '  !' || truncated_results || ' truncated' else '' end || '  '
  || coalesce(last_ts, first_ts, '-') || '  ' || session_id || '  ' || session_key as line, worst, cast(grade_score as bigint) as grade_score, grade
from (select *, case when {_BITS} = '' then 'clean' else {_BITS} end as bits, {' + '.join(f'n_{n}' for n in C.SEVERITIES)} as total from final)"""
_FINDING_STRUCT = ", ".join(f"'{n}': " + (f"([{', '.join(map(_q, C.SEVERITIES))}])[severity + 1]" if n == "severity" else n) for n in ("rule_id", "category", "severity", "title", "detail", "evidence", "event_index", "tool_name", "remediation", "occurrences", "also_at"))
_SESSION_STRUCT = ", ".join(f"'{n}': {'f.session_key' if n == 'path' else 'cast(0 as bigint)' if n == 'skipped_lines' else 'cast(grade_score as bigint)' if n == 'grade_score' else n}" for n in ("path", "session_id", "project_root", "event_count", "tool_call_count", "skipped_lines", "truncated_results", "first_ts", "last_ts", "grade", "grade_score", "network_hosts"))
SQL["session_reports"] = f"""{_WITH_SID}, {_PER_SESSION},
lists as (select session_key, list({{{_FINDING_STRUCT}}} order by severity desc, category, event_index, rule_id) as fs from found group by 1)
select f.session_key, cast(to_json({{{_SESSION_STRUCT}, 'counts': {{{', '.join(f"'{n}': n_{n}" for n in C.SEVERITIES)}}}, 'findings': coalesce(l.fs, [])}}) as varchar) as document
from final f left join lists l on l.session_key = f.session_key"""
_SEGMENT = """("[^"]*"?|'[^']*'?|[^"';\n|&])+"""
_PIECE = """"[^"]*"?|'[^']*'?|[^"']+"""
SQL["command_segments"] = f"""{_EVENTS}, {_COMMANDS},
parts as (select session_key, event_index, regexp_extract_all(cmd, {_q('(?:' + _SEGMENT[1:])}) as xs from cmds where cmd <> ''),
cut as (select session_key, event_index, list_filter(xs, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '') as xs from parts),
each as (select session_key, event_index, unnest(range(1, len(xs) + 1)) as i, unnest(xs) as text from cut)
select session_key, event_index, cast(i - 1 as integer) as place, text,
  array_to_string(list_transform(regexp_extract_all(text, {_q(_PIECE)}), lambda x: case when x[1] not in ('"', chr(39)) then x when length(x) > 1 and x[-1] = x[1] then x[1] || repeat(' ', length(x) - 2) || x[1] else x[1] || repeat(' ', length(x) - 1) end), '') as masked
from each"""
# Rules that find nothing in these tables: any text with a sign of theirs would be a row.
_NOTHING = "select session_key, '{0}' as rule_id, 0 as severity, 'unread' as title, text as evidence, event_index, tool_name from (select session_key, event_index, tool_name, tool_input as text from calls where {1})"
SQL["rule_destructive"] = f"{_EVENTS} {_NOTHING.format('SXR-002', 'kind in (' + _q('bash') + ') and regexp_matches(' + _FIELD('command') + ', ' + _q('(?i)>|rm -|dd .*of=|drop (table|database|schema)|truncate |reset +--hard|push.*(-f|--force)|chmod.*777|mkfs') + ')')}"
SQL["rule_credentials"] = f"{_EVENTS} {_NOTHING.format('SXR-003', 'kind in (' + _q('bash') + ', ' + _q('read') + ', ' + _q('write') + ', ' + _q('edit') + ', ' + _q('mcp') + ') and regexp_matches(tool_input, ' + _q('(?i)[.]ssh|[.]aws|gcloud|[.]azure|[.]kube|[.]docker|[.]netrc|[.]npmrc|[.]pypirc|[.]gnupg|[.]env|etc.shadow|PRIVATE KEY|sk_live|AKIA[0-9A-Z]{16}|gh[pousr]_|github_pat|sk-ant|xox[baprs]-|AIza|glpat-|gh +auth +token') + ')')}"
SQL["rule_integrity"] = "select '' as session_key, '' as rule_id, 0 as severity, '' as title, '' as evidence, 0 as event_index, '' as tool_name where false"


def _escaped_sql(c: str) -> str:
    for i in (*range(1, 32), *range(127, 160)):
        c = f"replace({c}, chr({i}), '\\x{i:02x}')"
    return c


SQL["escaped_texts"] = f"select doc_id, md5({_escaped_sql('text')}) as text_md5 from documents where text <> {_escaped_sql('text')}"
SQL["report_places"] = f"""with {_FINDINGS} select session_key, finding_id, row_number() over (partition by session_key order by level desc, category nulls first, event_index nulls first, seen_at nulls first, finding_id) - 1 as place
from f where session_key is not null"""
