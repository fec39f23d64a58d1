"""DuckDB SQL that says what some of the queries say, without their methods; the others are held against brute force in tests/llm."""

from __future__ import annotations

from .line_dedup import MIN_WORDS
from .quality_ledger import ABUSE, LABELLED, RULES, SYMBOLS, TERM_RATIO, TERM_SHARE, TERM_TEXTS, TOXIC
from .queries import URL_RULES
from .url_reputation import SECOND_LEVEL, SERVICES, STRENGTH

WORD = r"[^\x20\x09-\x0D]+"
ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"


def _op1(labels: str = "select doc_id as page_id, quality=0 or toxic=1 as bad from labels where doc_id is not null") -> str:
    rules = ", ".join(f"('{k}','{r}','{r.partition('/')[0]}','/{r.partition('/')[2]}')" for k, r in URL_RULES)
    two, services = (", ".join(f"'{x}'" for x in xs) for xs in (SECOND_LEVEL, SERVICES))

    def level(units: str, key: str, out: str, of: str) -> str:
        """The strength of the prior at a level (units have key, n, bad, prior), and the shrunk rates."""
        room = "sum(n*prior*(1-prior)*(1-1e0/n))"
        spread = "sum(n*(pow(bad*1e0/n-prior,2)-prior*(1-prior)/n))"
        return f"""{out}_s as (select coalesce(greatest({STRENGTH[0]}e0,least({STRENGTH[1]}e0,1e0/greatest(1e-6,{spread}/greatest({room},1e-12))-1)),{STRENGTH[1]}e0) as s from {units} where n>=2 and prior>0 and prior<1),
        {out} as (select {of}, (bad+prior*s)/(n+s) as rate, s from {units}, {out}_s)"""

    # The share of the posterior below one half, by Simpson's rule on x, or on u = x^a where the density has a pole at 0.
    return rf"""with cut as (select page_id, case when strpos(url,'://')>0 then substring(url, strpos(url,'://')+3) end as rest from pages),
    seen as (select page_id, coalesce(translate(regexp_extract(rest,'^([^/?#]*)',1),{ASCII}),'') as host, coalesce(regexp_extract(rest,'^[^/?#]*([^?#]*)',1),'') as path, row_number() over () as row from cut),
    fits as (select row, kind, rule, row_number() over (partition by row order by length(rule) desc, kind desc) as k from seen, (values {rules}) r(kind, rule, name, prefix)
      where (host=name or ends_with(host,'.'||name)) and starts_with(path,prefix)),
    lab as (select page_id, count(*) as n, sum(bad::int) as bad from ({labels}) where page_id is not null and bad is not null group by page_id),
    hosts as (select host, coalesce(sum(n),0)::double as n, coalesce(sum(bad),0)::double as bad, regexp_replace(regexp_replace(host,'^.*@|:[0-9]*$','','g'),'\.+$','') as plain from seen left join lab using (page_id) group by host),
    suf as (select *, case when regexp_matches(plain,'^[0-9.]+$') then plain when regexp_extract(plain,'([^.]+\.[^.]+)$',1) in ({services}) or regexp_matches(plain,'(^|\.)[^.]+\.[^.][^.]$') and regexp_extract(plain,'([^.]+)\.[^.]+$',1) in ({two})
      then regexp_extract(plain,'([^.]+\.[^.]+)$',1) else regexp_extract(plain,'([^.]*)$',1) end as suffix from hosts),
    dom as (select *, regexp_extract(substring(plain,1,greatest(length(plain)-length(suffix)-1,0)),'([^.]*)$',1) as label from suf),
    h as (select host, n, bad, suffix, case when label='' then suffix else label||'.'||suffix end as domain from dom),
    d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by domain, suffix),
    s as (select suffix, sum(n) as n, sum(bad) as bad from d group by suffix),
    s1 as (select s.*, (select (sum(bad)+0.5e0)/(sum(n)+1) from s) as prior from s),
    {level('s1', 'suffix', 's2', 'suffix')},
    d1 as (select d.*, s2.rate as prior from d join s2 using (suffix)),
    {level('d1', 'domain', 'd2', 'domain')},
    h1 as (select h.*, d2.rate as prior from h join d2 using (domain)),
    {level('h1', 'host', 'h2', 'host, n')},
    post as (select host, rate, rate*(n+s) as a, (1-rate)*(n+s) as b from h2),
    grid as (select host, rate, a, b, pow(0.5e0,least(1e0,a))/2000 as step, i, case when i in (0,2000) then 1 when i%2=1 then 4 else 2 end as w from post, range(2001) g(i)),
    risk as (select host, any_value(rate) as rate, sum(w*case when a<1 then exp((b-1)*ln(1-pow(i*step,1/a)))/a when i=0 then (a=1)::int else exp((a-1)*ln(i*step)+(b-1)*ln(1-i*step)) end)*any_value(step)/3/exp(lgamma(any_value(a))+lgamma(any_value(b))-lgamma(any_value(a)+any_value(b))) as under from grid group by host, a, b)
    select page_id, host, path, rule, coalesce(kind, case when under<0.05 then 'block' else 'allow' end) as verdict, rate
    from seen join risk using (host) left join fits on fits.row=seen.row and k=1"""


def _op4() -> str:
    return rf"""with recursive d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text,''),{ASCII}),'{WORD}') as ws from documents),
    tok as (select r, unnest(ws) as w, generate_subscripts(ws,1) as i, len(ws) as n from d where len(ws)>0),
    win as (select r, n, i, array_to_string([w, lead(w,1) over x, lead(w,2) over x, lead(w,3) over x, lead(w,4) over x],' ') as g from tok window x as (partition by r order by i)),
    sh as (select distinct r, g from win where i<=greatest(1,n-4)), size as (select r, count(*) as n from sh group by r),
    pairs as (select a.r as a, b.r as b, count(*) as k from sh a join sh b on a.g=b.g and a.r<b.r group by a.r, b.r),
    link as (select a, b from pairs join size x on x.r=a join size y on y.r=b where k*5>=4*(x.n+y.n-k)),
    e as (select a, b from link union all select b, a from link),
    step as (select r, r as root from d union select e.b, step.root from step join e on e.a=step.r),
    cls as (select step.r, min(d.doc_id) as class_id from step join d on d.r=step.root group by step.r)
    select d.doc_id, coalesce(class_id,d.doc_id) as class_id, (select count(*) from e where e.a=d.r) as n_links from d join cls using (r)"""


def _op6() -> str:
    bits = "|".join(f"(case when {r.fails} then {1 << r.bit} else 0 end)" for r in (*RULES, TOXIC))
    abuse = "|".join(ABUSE)
    terms = r"list_distinct(regexp_extract_all(lower(text),'[\p{L}\p{M}\p{N}]+'))"
    return rf"""with d as (select row_number() over () as r, doc_id, lang, coalesce(text,'') as t from documents),
    lab as (select doc_id, max((toxic=1)::int) as toxic from labels where doc_id is not null and toxic is not null group by doc_id),
    tx as (select lang, text, max(toxic) as toxic from documents join lab using (doc_id) where text is not null group by lang, text),
    ev as (select lang, sum(toxic) as toxic, count(*)-sum(toxic) as clean from tx group by lang),
    tw as (select lang, word, sum(toxic) as t, count(*)-sum(toxic) as c from (select lang, toxic, unnest({terms}) as word from tx) group by lang, word),
    term as (select w.lang, word from tw w join ev e on w.lang is not distinct from e.lang where t>={TERM_TEXTS} and t>={TERM_SHARE}e0*toxic and t*clean>={TERM_RATIO}*(c+0.5e0)*toxic),
    tox as (select r, count(*) as n_toxic_terms from (select r, lang, unnest({terms.replace('text', 't')}) as word from d) x join term y on x.word=y.word and x.lang is not distinct from y.lang group by r),
    m as (select r, doc_id, t, regexp_extract_all(t,'{WORD}') as ws, list_filter(string_split(t,chr(10)), lambda x: regexp_matches(x,'{WORD}')) as ls from d),
    tok as (select r, unnest(ws) as w, generate_subscripts(ws,1) as i from m),
    win as (select r, i, w, lead(w,1) over x as w1, lead(w,2) over x as w2 from tok window x as (partition by r order by i)),
    dup as (select r, i from (select r, i, count(*) over (partition by r, w, w1, w2) as c from win where w2 is not null) where c>1),
    cov as (select r, count(distinct i+o) as n from dup, (values (0),(1),(2)) v(o) group by r),
    a as (select doc_id, len(ws) as n_words, length(array_to_string(ws,'')) as word_chars, len(regexp_extract_all(t,'{SYMBOLS}')) as n_symbols, len(ls) as n_lines, len(ls)-len(list_distinct(ls)) as n_dup_lines,
      coalesce(n,0) as n_repeat_words, len(regexp_extract_all(t,'[A-Z]')) as n_capitals, len(regexp_extract_all(t,'(?i)\b({abuse})\b')) as n_abuse, coalesce(n_toxic_terms,0) as n_toxic_terms from m left join cov using (r) left join tox using (r)),
    b as (select *, cast({bits} as bigint) as fail_bits from a)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words<50 or 100*n_repeat_words>50*n_words as base_failed, fail_bits=0 as kept, n_toxic_terms, fail_bits from b"""


def _op6_ablations() -> str:
    rules = ", ".join(f"('{r.name}', {1 << r.bit})" for r in (*RULES, TOXIC))
    mask = sum(1 << r.bit for r in (*RULES, TOXIC))
    return f"""with entries as ({_op6()}), rules(rule, bit) as (values {rules})
    select '{LABELLED.version}' as version, rule, cast(sum((fail_bits & bit <> 0)::int) as bigint) as n_failed, cast(sum((fail_bits = bit)::int) as bigint) as n_only, cast(sum((fail_bits & ({mask} - bit) = 0)::int) as bigint) as n_kept_without
    from entries, rules group by rule"""


def _op7() -> str:
    """By all shortest runs of 50 words, forwards and backwards: a line goes if one that covers it occurs at an earlier place.

    A blank line goes with its neighbours, which is right as long as two repeated runs don't meet at one.
    """
    within = f"a.r=b.r and b.i between a.i and a.i+{MIN_WORDS - 1} and b.cum-a.cum+a.w>={MIN_WORDS}"
    return rf"""with d as (select doc_id, row_number() over (order by doc_id) as r, text, string_split(text,chr(10)) as ls from documents),
    l as (select r, unnest(ls) as line, generate_subscripts(ls,1) as no from d),
    w as (select *, len(regexp_extract_all(line,'{WORD}')) as w from l),
    c as (select *, row_number() over x as i, sum(w) over x as cum from w where w>0 window x as (partition by r order by no)),
    span as (select a.r, a.i as a, min(b.i) as b from c a join c b on {within} group by a.r, a.i union select b.r, max(a.i), b.i from c a join c b on {within} group by b.r, b.i),
    keyed as (select s.r, s.a, s.b, string_agg(line, chr(10) order by c.i) as key from span s join c on c.r=s.r and c.i between s.a and s.b group by s.r, s.a, s.b),
    firsts as (select key, min((r, a)) as f from keyed group by key),
    again as (select r, a, b from keyed join firsts using (key) where (r, a) > f),
    gone as (select distinct c.r, c.i, c.no from again g join c on c.r=g.r and c.i between g.a and g.b),
    blank as (select w.r, w.no from w join gone x on x.r=w.r and x.no<w.no join gone y on y.r=w.r and y.no>w.no and y.i=x.i+1 where w.w=0),
    out as (select r, no from gone union select r, no from blank),
    left_over as (select l.r, string_agg(line, chr(10) order by no) as text, count(*) as n from l anti join out using (r, no) group by l.r)
    select doc_id, case when whole is not null then coalesce(k.text,'') end as text, cast(coalesce(len(ls),0) as int) as n_lines, cast(coalesce(len(ls),0)-coalesce(k.n,0) as int) as n_deleted
    from (select doc_id, r, ls, text as whole from d) left join (select r, text, n from left_over) k using (r)"""


def _op9() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text,''),{ASCII}),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    leads = ", ".join(f"lead(w,{k}) over x" for k in range(1, 8))
    windows = lambda t: f"select *, [w, {leads}] as a from {t} window x as (partition by r order by i)"
    return f"""with d as (select doc_id, row_number() over () as r, {words} as ws from documents), b as (select cast(item_id as varchar) as item, row_number() over () as r, {words} as ws from benchmark where item_id is not null),
    dt as (select r, unnest(ws) as w, generate_subscripts(ws,1) as i from d), bt as (select r, item, unnest(ws) as w, generate_subscripts(ws,1) as i, len(ws) as n from b where len(ws)>0),
    dw as ({windows('dt')}), bw as ({windows('bt')}),
    win as (select distinct item, list_slice(a,1,least(8,n)) as a, least(8,n) as len from bw where i<=greatest(1,n-7)),
    hit as (select dw.r, dw.i, win.item, win.len from (select distinct len from win) l cross join dw join win on win.len=l.len and win.a=list_slice(dw.a,1,l.len)),
    cov as (select r, count(distinct p) as n from (select r, unnest(range(i, i+len)) as p from hit) group by r),
    it as (select r, list_sort(list(distinct item)) as items from hit group by r)
    select doc_id, len(ws) as n_words, coalesce(n,0) as n_hit, coalesce(len(items),0) as n_items, sha256(coalesce(array_to_string(items,','),'')) as items_sha256, coalesce(len(items),0)>=2 as contaminated
    from d left join cov using (r) left join it using (r)"""


def _op9_proximity() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text,''),{ASCII}),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""with d as (select row_number() over () as r, doc_id, {words} as ws from (select distinct doc_id, text from documents)), dt as (select r, unnest(ws) as w, generate_subscripts(ws,1) as i from (select r, ws from d)),
    all_words as (select unnest({words}) as w from documents), b as (select cast(item_id as varchar) as item, {words} as ws from benchmark where item_id is not null), own as (select distinct item, unnest(ws) as w from b),
    n as (select w, count(*) as n from all_words semi join own using (w) group by w),
    ranked as (select item, w, row_number() over (partition by item order by n, w) as k, least(3, count(*) over (partition by item)) as c from own join n using (w)),
    rare as (select item, w, k, least(2, c) as least from ranked where k<=3 and c>1),
    spots as (select r, i, item, k, least from dt join rare using (w)),
    near as (select p.r, p.item, p.i, p.least, count(distinct q.k) as n from spots p join spots q on p.r=q.r and p.item=q.item and abs(p.i-q.i)<=20 group by p.r, p.item, p.i, p.least)
    select doc_id, item, max(n) as n_terms from near join d using (r) where n>=least group by r, doc_id, item"""


def oracle_sql() -> dict[str, str]:
    planted = "select page_id, length(regexp_extract(url,'://([^/?#]*)',1))%2=0 as bad from pages where page_id is not null"
    return {"op1_url_reputation": _op1(), "op1_planted_hosts": _op1(planted), "op6_ablations": _op6_ablations(), "op4_ngram_jaccard": _op4(), "op6_quality_ledger": _op6(), "op7_line_dedup": _op7(), "op9_decontamination": _op9(), "op9_proximity": _op9_proximity()}
