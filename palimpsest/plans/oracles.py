"""DuckDB SQL that says what each query says, over the same tables."""

from __future__ import annotations

from ..functions import exprs as X
from ..operators import knowledge as K
from ..operators import record as R
from ..operators import working as W
from ..sources.testdata import DANGLING, REFERENCE, TODAY
from ..streaming import pulse as P
from ..streaming.pulse import LIMIT

ROUND4 = "floor(({})*10000+0.5e0)/10000e0"
MEM = """
e0 as (select *, cast(regexp_extract(props, '[0-9]+') as bigint) as k from events),
mem as (
  select event_id, ts, cast(ts as date) as day,
    case when event_id%50=0 then 'correction' when event_type='purchase' then 'decision' when event_type='view' then 'observation'
         when event_type='click' then 'insight' when event_type='signup' then 'preference' else 'error' end as type,
    value/100 as importance, event_id%4<>0 as consolidated, case when event_id%3=0 then 1.0e0 else 0.25e0+0.0075e0*k end as decay_score,
    case when k>0 then event_id-k end as assoc_event_id, case when event_id%7=0 then 'ke_'||printf('%03d',k) end as assoc_ke, k, props,
    'evt_'||strftime(ts,'%Y%m%d')||'_'||printf('%03d', row_number() over (partition by cast(ts as date) order by event_id)) as id
  from e0),
linked as (
  select m.*, list_filter([case when m.assoc_event_id is not null then coalesce(o.id, '{dangling}') end, m.assoc_ke], lambda x: x is not null) as links
  from mem m left join mem o on o.event_id = m.assoc_event_id)""".replace("{dangling}", DANGLING)
AGE = f"cast(floor((epoch_us(timestamp '{REFERENCE}')-epoch_us(ts))/86400000000) as bigint)"
DECAY = ROUND4.format("{score}*exp(-(ln(2e0)/30e0)*{age})")


def _classified(source: str = "mem", score: str = "decay_score") -> str:
    new = DECAY.format(score=score, age="age")
    return f"""
    aged as (select *, {AGE} as age from {source}),
    scored as (select * replace ({score} as decay_score), {new} as computed_score from aged),
    classified as (select *, case when not coalesce(consolidated,false) then 'unconsolidated' when not (age>0 and decay_score is not null) then 'kept'
      when computed_score<0.2e0 then 'archived' when computed_score<>decay_score then 'decayed' else 'kept' end as action from scored)"""


REPORT = "count(*) as events_scanned, count(*) filter (action='unconsolidated') as unconsolidated, count(*) filter (action='decayed') as decayed, count(*) filter (action='archived') as archived"


def _score(links: str, search: str = "0.5e0") -> str:
    return ROUND4.format(f"0.6e0*{search}+0.25e0*greatest(0e0,least(1e0,importance))+0.15e0*least(1e0,({links})/5e0)")


KNOW = """
files as (
  select source||'-'||doc_id||'.md' as file, doc_id,
    '# '||source||chr(10)||'> Notes for '||source||chr(10)||'<!-- knowledge_entry: ke_'||printf('%03d',doc_id)||' -->'||chr(10)||'## Entry '||doc_id||chr(10)||replace(text,chr(10),' ')||chr(10)||'**Confidence**: '
    ||case doc_id%6 when 0 then 'high' when 1 then 'medium' when 2 then 'low' when 3 then '0.'||(doc_id%10) when 4 then 'High' else '1.2.3' end||chr(10)
    ||'**Associations**: ke_'||printf('%03d',(doc_id*7+3)%100)||', evt_20240101_'||printf('%03d',doc_id%20+1)||' [ke_001]'||chr(10)||'<!-- /knowledge_entry -->' as content
  from documents),
entries as (
  select file, regexp_extract(content,'knowledge_entry: (\\S+) -->',1) as id, substring(content, strpos(content,'<!-- knowledge_entry')) as content from files),
parsed as (
  select *, regexp_extract(content,'\\*\\*Confidence\\*\\*:\\s*([\\d.]+|high|medium|low)',1,'i') as said,
    list_filter(regexp_split_to_array(regexp_extract(content,'\\*\\*Associations?\\*\\*:\\s*([^\\n]+)',1,'i'),'[,\\s]+'), lambda x: starts_with(x,'ke_') or starts_with(x,'evt_')) as links
  from entries),
rated as (
  select *, case said when 'high' then 0.9e0 when 'medium' then 0.6e0 when 'low' then 0.3e0
    else coalesce(nullif(try_cast(regexp_extract(said,'^([0-9]+\\.?[0-9]*|\\.[0-9]+)',1) as double),0),0.5e0) end as importance from parsed)"""
GRAPH = f"""{MEM}, {KNOW},
nodes as (select id, 'event' as kind, props as content, importance, links, event_id as ord from linked union all select id, 'knowledge', content, importance, links, 0 from rated),
forward as (select id as src, unnest(links) as dst, unnest(range(len(links))) as pos, 0 as dir from nodes),
backward as (select unnest(links) as src, id as dst, event_id as pos, 1 as dir from linked),
back_from as (select b.* from backward b where src in (select id from nodes))"""


def _explore(direction: str, depth: int, dangling: bool = False) -> str:
    edges = "select src, dst from forward" + ("" if direction == "forward" else " union select src, dst from back_from")
    met = f"{'not ' if dangling else ''}in (select id from nodes)"
    return f"""with recursive {GRAPH}, edges as (select distinct * from ({edges})),
    walk as (select id as root, id, 0 as depth from linked union select w.root, e.dst, w.depth+1 from walk w join edges e on e.src=w.id where w.depth<{depth})
    select root, id, cast(min(depth) as int) as depth from walk where id {met} group by root, id"""


INDEX = f"""{KNOW},
split as (select file, string_split(content, chr(10)) as lines from files),
picked as (
  select file, len(list_filter(lines, lambda x: starts_with(trim(x),'## '))) as n_entries, list_filter(lines, lambda x: starts_with(x,'# '))[1] as title,
    substring(regexp_replace(list_filter(lines, lambda x: trim(x)<>'' and not starts_with(x,'# ') and length(x)>5 and not starts_with(x,'<!--'))[1],'^[>|│]\\s*',''),1,100) as text
  from split),
rows as (select file, n_entries, regexp_replace(coalesce(title,'# '||replace(file,'.md','')),'^#\\s*','') as title, coalesce(case when length(text)=100 then text||'...' else text end,'') as description from picked)"""
_HEAD = ", ".join("(%d, '%s')" % (i, h.replace("'", "''")) for i, h in enumerate(K.INDEX_HEAD))
LAST = """
last as (
  select conv_id as session_id, max_by(text, turn) filter (role='user') as last_user, max_by(text, turn) filter (role='assistant') as last_assistant,
    count(*) filter (role='user') as n_user, count(*) filter (role='assistant') as n_assistant
  from conversations group by conv_id)"""


def _auto(words) -> str:
    any_of = " or ".join(f"contains(lower(coalesce(last_user,'')||chr(10)||coalesce(last_assistant,'')),'{w}')" for w in words)
    return f"""with {LAST} select session_id, '{R.AUTO_TYPE}' as type, 'User: '||substring(coalesce(last_user,''),1,500)||chr(10)||'Asst: '||substring(coalesce(last_assistant,''),1,500) as content,
    0.6e0 as importance, '{R.AUTO_TAG}' as tags from last where n_user+n_assistant>0 and ({any_of})"""


STACKS = """
stacks as (
  select o_custkey as workspace, coalesce(list(o_orderkey order by o_orderkey) filter (o_orderstatus='F'),[]) as path, coalesce(list(o_orderkey order by o_orderkey) filter (o_orderstatus='O'),[]) as pending,
    coalesce(cast(max(o_orderkey) filter (o_orderstatus='P') as varchar),'None') as focus
  from orders group by o_custkey),
sized as (select *, len(path) as np, len(pending) as nq, least(3,len(path)) as p0 from stacks),
viewed as (select *, least(6-p0,nq) as q from sized),
limits as (select *, least(np, p0+6-p0-q) as p from viewed)"""


def _scope(condition: str) -> str:
    return f"with {MEM}, few as (select * from mem where {condition}), {_classified('few')} select day, {REPORT} from classified group by day"


SCAN = """select id, cast(day as varchar) as day, strftime(ts,'%Y-%m-%dT%H:%M:%S.%g')||'Z' as timestamp, type, props as content, importance, type as tags, array_to_string(links,',') as associations, consolidated, decay_score from linked"""
MOVED = """select case when {within} and action='archived' then 'archive' else 'events' end as place, day||'.jsonl' as file, id,
    case when {within} and action='decayed' then computed_score else decay_score end as decay_score, event_id as more from classified"""
#: The places of a workspace named ws.
PLACES = (
    ("events", "ws/.memory/events"), ("archive", "ws/.memory/archive"), ("active", "ws/.memory/active"), ("focus_stack", "ws/.memory/active/focus_stack.json"), ("focus_view", "ws/.memory/active/focus_stack.md"),
    ("scratchpad", "ws/.memory/active/scratchpad.md"), ("memory", "ws/memory"), ("knowledge", "ws/memory/knowledge"), ("skills_verified", "ws/memory/skills/verified"), ("skills_drafts", "ws/memory/skills/drafts"),
    ("skills_registry", "ws/memory/skills/_registry.json"), ("dot_memory", "ws/.memory"), ("events_schema", "ws/.memory/events/_schema.json"), ("scripts", "ws/.memory/scripts"), ("index", "ws/MEMORY_INDEX.md"),
    ("day_events", "ws/.memory/events/2024-01-05.jsonl"), ("day_log", "ws/memory/2024-01-05.md"),
)


def _fold() -> str:
    room = f"greatest(0, {W.SLOTS - 1}-len(pending))"
    return f"""with recursive a as (select user_id as workspace, event_type as kind, event_id as e, row_number() over (partition by user_id order by event_id) as n from events),
    s as (select distinct user_id as workspace, cast(0 as bigint) as n, '{W.NO_GOAL}' as goal, '{W.NO_FOCUS}' as focus, cast([] as varchar[]) as pending, cast([] as varchar[]) as overflow from events
      union all select s.workspace, a.n, case kind when 'signup' then 'goal '||e else goal end, case kind when 'signup' then 'focus '||e when 'click' then coalesce(pending[1], '{W.DONE}') else focus end,
        case kind when 'signup' then ['a'||e,'b'||e] when 'view' then pending||['a'||e,'b'||e] when 'click' then pending[2:] when 'purchase' then [] else pending||overflow[1:{room}] end,
        case kind when 'purchase' then pending||overflow when 'error' then overflow[{room}+1:] else overflow end from s join a on a.workspace=s.workspace and a.n=s.n+1)
    select workspace, goal, '' as path, focus, array_to_string(pending,',') as pending, array_to_string(overflow,',') as overflow, n as n_done, cast(0 as bigint) as n_refused from s
    qualify n=max(n) over (partition by workspace)"""


def _context() -> str:
    quoted = lambda text: "'" + text.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"
    filled = lambda template, *values: "||".join(x for pair in zip(map(quoted, template.split("{}")), (*values, "''"), strict=True) for x in pair)
    health = filled(P.TELEMETRY, "unconsolidated", "coalesce(np+1+nq,0)") + "||" + quoted("\n>\n" + P.INDEX)
    return f"""with recursive {STACKS}, t as (select user_id as session_id, event_id as seq, case event_type when 'purchase' then 'prompt' when 'signup' then 'mem' else 'tool' end as kind,
      row_number() over (partition by user_id order by event_id) as n from events),
    run as (select session_id, n, seq, kind, case when kind='tool' then 1 else 0 end as ticks, cast(null as bigint) as fired from t where n=1
      union all select t.session_id, t.n, t.seq, t.kind, case when t.kind='mem' then 0 when t.kind='tool' then r.ticks+1 when r.ticks>={LIMIT} then 0 else r.ticks end,
        case when t.kind='prompt' and r.ticks>={LIMIT} then r.ticks end from run r join t on t.session_id=r.session_id and t.n=r.n+1),
    loose as (select user_id as session_id, count(*) filter (event_id%4=0) as unconsolidated from events group by user_id),
    parts as (select r.session_id, r.seq, case when workspace is not null then {quoted(P.FOCUS_HEAD)}||'Focus: '||focus end as f,
        case when n=1 then {quoted(P.WAKE)}||{health} when fired is not null then {filled(P.OVERLOAD, 'fired')}||{health} end as m
      from run r join loose using (session_id) left join sized on workspace=r.session_id where kind='prompt')
    select session_id, seq, case when f is not null or m is not null then {quoted(P.CONTEXT_HEAD)}||coalesce(f,'')||case when f is not null and m is not null then chr(10)||chr(10) else '' end||coalesce(m,'')||{quoted(P.CONTEXT_FOOT)} end as context from parts"""


def oracle_sql() -> dict[str, str]:
    from .queries import MORE_TRIGGERS

    done = f"with {MEM}, {_classified()} "
    graph = f"with {GRAPH} "
    hops = """
    links_all as (select * from forward union all select src, dst, pos, dir from back_from),
    step1 as (select l.id as root, e.dst as id, dir, pos from linked l join links_all e on e.src=l.id where e.dst<>l.id),
    met1 as (select root, id, min((dir, pos)) as best from step1 group by root, id),
    lev1 as (select root, id, row_number() over (partition by root order by best) as ord from met1 where id in (select id from nodes)),
    step2 as (select l.root, e.dst as id, l.ord, e.dir, e.pos from lev1 l join links_all e on e.src=l.id where e.dst<>l.root),
    met2 as (select root, id, min((ord, dir, pos)) as best from step2 anti join met1 using (root, id) group by root, id),
    lev2 as (select root, id, row_number() over (partition by root order by best) as ord from met2 where id in (select id from nodes)),
    found as (select id as root, id, 0 as depth, 1 as ord from linked union all select root, id, 1, ord from lev1 union all select root, id, 2, ord from lev2)"""
    out = {
        "mem_events_scan": f"with {MEM} select event_id, id, day, type, importance, array_to_string(links,',') as associations, consolidated, decay_score from linked",
        "telemetry_unconsolidated": f"with {MEM} select count(*) filter (not coalesce(consolidated,false)) as unconsolidated, count(*) as events from mem",
        "age_days": f"select event_id, {AGE} as age from events",
        "decay_scores": f"with {MEM}, aged as (select *, {AGE} as age from mem) select event_id, {DECAY.format(score='decay_score', age='age')} as new_score from aged",
        "decay_compounded_two_runs": f"""{done}, once as (select event_id, ts, consolidated, case when action='decayed' then computed_score else decay_score end as decay_score from classified where action<>'archived'),
            again as (select event_id, consolidated, decay_score, {AGE} as age, {DECAY.format(score='decay_score', age=AGE)} as computed_score from once)
            select event_id, decay_score, computed_score, case when not consolidated then 'unconsolidated' when age<=0 then 'kept' when computed_score<0.2e0 then 'archived' when computed_score<>decay_score then 'decayed' else 'kept' end as action from again""",
        "score_default_search": f"with {MEM} select event_id, {_score('(assoc_event_id is not null)::int+(assoc_ke is not null)::int')} as score from mem",
        "score_with_search": f"with {MEM} select event_id, {_score('event_id%8', '(k/100e0)')} as score from mem",
        "rank_topk_per_type": f"with {MEM}, s as (select event_id, type, {_score('event_id%8')} as score from mem) select *, row_number() over (partition by type order by score desc, event_id) as place from s qualify place<=10",
        "consolidate_classify": f"{done} select event_id, age, computed_score, action from classified",
        "consolidate_kept": f"{done} select event_id, case when action='decayed' then computed_score else decay_score end as decay_score, action from classified where action<>'archived'",
        "consolidate_archived": f"{done} select event_id, decay_score, computed_score from classified where action='archived'",
        "consolidate_report": f"{done} select {REPORT} from classified",
        "consolidate_report_by_day": f"{done} select day, {REPORT} from classified group by day",
        "archive_union": f"{done} select event_id, decay_score from mem where type='correction' union all select event_id, decay_score from classified where action='archived'",
        "scope_session": _scope(f"day = date '{TODAY}'"),
        "scope_day": _scope(f"day >= date '{TODAY}' - 7"),
        "scope_full": _scope("true"),
        "edges_exploded": f"with {MEM} select id as src, cast(unnest(range(len(links))) as bigint) as pos, unnest(links) as dst from linked",
        "assoc_degree": f"with {MEM}, e as (select unnest(links) as dst from linked) select dst as id, count(*) as links_in from e group by dst",
        "explore_ordered": f"{graph}, {hops} select root, id, cast(depth as int) as depth, cast(ord as bigint) as ord from found",
        "explore_scored_nodes": f"""{graph}, {hops} select f.root, f.id, cast(f.depth as int) as depth, n.kind, n.importance, cast(len(n.links) as bigint) as n_links, {_score('len(n.links)')} as score,
            cast(case when length(n.content)>300 then 303 else length(n.content) end as bigint) as n_chars from found f join nodes n on n.id=f.id""",
        "explore_visited": f"{graph}, {hops} select root, count(*) as n_visited from found group by root",
        "explore_both_d2": _explore("both", 2),
        "explore_dangling": _explore("forward", 2, True),
        "reinforced_events": f"""with recursive {GRAPH}, edges as (select distinct * from (select src, dst from forward union select src, dst from back_from)),
            walk as (select id, 0 as depth from linked where type='correction' union select e.dst, w.depth+1 from walk w join edges e on e.src=w.id where w.depth<2)
            select event_id, 1.0e0 as decay_score from linked where id in (select id from walk) and decay_score<1""",
        "knowledge_resolve": f"with {KNOW} select file, id, content from entries",
        "knowledge_confidence": f"with {KNOW} select id, importance from rated",
        "knowledge_assoc_parse": f"with {KNOW} select id, array_to_string(links,',') as associations from rated",
        "knowledge_index_rows": f"with {INDEX} select * from rows",
        "knowledge_index_render": f"""with {INDEX} select cast(part as int) as part, '' as file, line from (values {_HEAD}) h(part, line)
            union all select {len(K.INDEX_HEAD)}, file, '- `memory/knowledge/'||file||'` ('||n_entries||' entries) — **'||title||'**: '||description from rows""",
        "daily_log_render": f"""with {MEM} select event_id, '### '||strftime(ts,'%H:%M')||' — '||type||' [importance: '||regexp_replace(regexp_replace(printf('%.4f',importance),'0+$',''),'\\.$','')||']'||chr(10)||props||chr(10)
            ||'Tags: '||type||' | ID: '||id||case when len(links)>0 then ' | Assoc: '||array_to_string(links,', ') else '' end||chr(10) as entry from linked""",
        "next_event_seq": "select cast(ts as date) as day, count(*)+1 as next_seq from events group by 1",
        "last_turns": f"with {LAST} select session_id, last_user, last_assistant from last",
        "new_session_flag": f"with {LAST} select session_id, n_user, n_assistant, n_user<=1 and n_assistant=0 as new_session from last",
        "auto_record_candidates": _auto(X.TRIGGERS),
        "auto_record_more_words": _auto(MORE_TRIGGERS),
        "stack_usage": f"with {STACKS} select workspace, np+1+nq as used from sized",
        "focus_view_7": f"""with {STACKS} select workspace, array_to_string(path[np-p+1:np],',') as shown_path, focus as current_focus, array_to_string(pending[1:q],',') as shown_pending, np-p as hidden_path, nq-q as hidden_pending from limits""",
        "pulse_ticks_batch": f"""with recursive t as (select user_id as session_id, event_id as seq, case event_type when 'purchase' then 'prompt' when 'signup' then 'mem' else 'tool' end as kind,
            row_number() over (partition by user_id order by event_id) as n from events),
            run as (select session_id, n, seq, kind, case when kind='tool' then 1 else 0 end as ticks, cast(null as bigint) as fired from t where n=1
              union all select t.session_id, t.n, t.seq, t.kind, case when t.kind='mem' then 0 when t.kind='tool' then r.ticks+1 when r.ticks>={LIMIT} then 0 else r.ticks end,
                case when t.kind='prompt' and r.ticks>={LIMIT} then r.ticks end from run r join t on t.session_id=r.session_id and t.n=r.n+1)
            select session_id, seq, fired as ticks from run where fired is not null""",
        "working_fold": _fold(),
        "jsonl_strict_scan": f"with {MEM}, bad as (select distinct day from mem where event_id%50=0 and day(day)%7=0) {SCAN} where day not in (select day from bad)",
        "jsonl_lenient_scan": f"with {MEM} {SCAN}",
        "workspace_telemetry": f"with {MEM} select count(*) filter (not consolidated) as unconsolidated, cast(0 as bigint) as used from mem",
        "workspace_next_seq": """with e as (select event_id, cast(ts as date) as day, (event_id%10=0)::int as blank, (event_id%50=0 and day(cast(ts as date))%7=0)::int as bad from events),
            last as (select day, max(event_id) as last from e group by day)
            select day||'.jsonl' as file, cast(sum(1+blank+bad) - max(case when event_id=last and bad=0 then blank else 0 end) + 1 as bigint) as next_seq from e join last using (day) group by day""",
        "workspace_consolidate_full": f"{done} {MOVED.format(within='true')}",
        "workspace_consolidate_day": f"{done} {MOVED.format(within=f"day >= date '{TODAY}' - 7")}",
        "workspace_index_file": f"""with {INDEX} select line from (values {_HEAD}) h(part, line) union all select '- `memory/knowledge/'||file||'` ('||n_entries||' entries) — **'||title||'**: '||description from rows""",
        "index_length": f"""with {INDEX}, lines as (select line from (values {_HEAD}) h(part, line) union all select '- `memory/knowledge/'||file||'` ('||n_entries||' entries) — **'||title||'**: '||description from rows)
            select cast(sum(length(line))+count(*)-1 as bigint) as index_chars from lines""",
        "path_catalog": "select * from (values " + ", ".join(f"('{k}','{v}')" for k, v in PLACES) + ") p(name, path)",
        "tool_kinds": "select event_id, case when event_id%10<>0 and event_id%3=0 then 'mem' else 'tool' end as kind from events",
        "age_of_text_times": f"""with {MEM}, t as (select * replace (case when event_id%10>1 then ts end as ts) from mem), {_classified('t')} select event_id, age, action from classified""",
        "bullet_items": r"""select doc_id, array_to_string(list_filter(list_transform(string_split('- [10:20] '||source||chr(10)||'* '||lang||chr(10)||'- [09:15]'||chr(10)||'-'||chr(10)||text, chr(10)),
            lambda x: regexp_replace(regexp_replace(x, '^[-*]\s*(\[[0-9]{2}:[0-9]{2}\])?\s*', ''), '^\s+|\s+$', '', 'g')), lambda x: x<>''), '|') as items from documents""",
        "scratchpad_notes": r"""with d as (select doc_id, coalesce(text,'') as text, trim(regexp_extract(chr(10)||text, '\n## ([^\n]*)', 1)) as found, '- [10:20] seen '||doc_id as note from documents),
            h as (select *, regexp_extract(text, '^([^\n]*\n)*?## [^\n]*') as upto from d)
            select doc_id, case when coalesce(found,'')='' then case when regexp_replace(text,'\s+$','')='' then '# Scratchpad' else regexp_replace(text,'\s+$','') end||chr(10)||chr(10)||'## Notes'||chr(10)||note||chr(10)
              else upto||chr(10)||note||substring(text,length(upto)+1)||case when ends_with(substring(text,length(upto)+1),chr(10)) then '' else chr(10) end end as text from h""",
        "record_bulk": f"""with {MEM}, old as (select day, count(*) as n from mem where type<>'error' group by day),
            new as (select *, coalesce(n,0)+row_number() over (partition by day order by event_id) as seq from mem left join old using (day) where type='error')
            select 'evt_'||strftime(day,'%Y%m%d')||'_'||printf('%03d',seq) as id, strftime(ts,'%Y-%m-%dT%H:%M:%S.%g')||'Z' as timestamp, type, props as content, case when event_id%2=0 then importance else 0.5e0 end as importance,
              '' as tags, '' as associations, false as consolidated, 1.0e0 as decay_score from new""",
        "prompt_context": _context(),
        "session_state": f"""with recursive t as (select user_id as session_id, case event_type when 'purchase' then 'prompt' when 'signup' then 'mem' else 'tool' end as kind, row_number() over (partition by user_id order by event_id) as n from events),
            run as (select session_id, n, cast((kind='tool')::int as bigint) as ticks from t where n=1 union all select t.session_id, t.n, case when t.kind='mem' then 0 when t.kind='tool' then r.ticks+1 when r.ticks>={LIMIT} then 0 else r.ticks end
              from run r join t on t.session_id=r.session_id and t.n=r.n+1)
            select session_id, ticks from run qualify n=max(n) over (partition by session_id)""",
        "focus_frontend": f"""with {STACKS} select workspace, '**Project Goal:** Goal'||chr(10)||'**Last Updated:** {REFERENCE}'||chr(10)||chr(10)
            ||case when np>0 then '**Path:**'||chr(10)||case when p<np then '  └─ ... ('||(np-p)||' earlier steps hidden)'||chr(10) else '' end||array_to_string(list_transform(path[np-p+1:np], lambda x: '  └─ '||x),chr(10))||chr(10)||chr(10) else '' end
            ||'**🚀 FOCUS:** '||focus||case when nq>0 then chr(10)||chr(10)||'**Upcoming:**'||chr(10)||array_to_string(list_transform(pending[1:q], lambda x: '  - '||x),chr(10))
              ||case when q<nq then chr(10)||'  - ... ('||(nq-q)||' later steps pending in backend queue)' else '' end else '' end as text from limits""",
        "derived_by_type_rollup": f"{done} select type, day, count(*) as n, count(*) filter (action='archived') as archived, cast(sum(cast(floor(computed_score*10000+0.5e0) as bigint)) as bigint) as score_sum from classified group by rollup(type, day)",
        "sql_functions": f"""with {MEM}, aged as (select *, {AGE} as age from mem) select event_id, {DECAY.format(score='decay_score', age='age')} as new_score, {_score('event_id%8')} as score,
            'evt_'||strftime(day,'%Y%m%d')||'_'||printf('%03d',event_id) as id from aged""",
    }
    return out | {f"explore_forward_d{d}": _explore("forward", d) for d in (1, 2, 3)}
