"""Oracles over the driver's own tables, and over the policies derived from them."""

from . import constants as P
from .constants import CITIES, DEPARTMENTS, EVENT_STATES, EXPENSE_TYPES
from .claims import CLAIMS, FIRST_TIER, RATIO, array, lit, over

WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MEANINGFUL = WS[:-1] + r'''\x{4e00}-\x{9fff}A-Za-z0-9，。：；、（）()%¥￥—.,:;/\\''"*#&+-]'''


def strip(c):
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def fold(c):
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


HEADING = r"^\s*(?:第\s*[一二三四五六七八九十百零\d]+\s*[章节条款]|\d+(?:\.\d+)*[、.\s]|[一二三四五六七八九十]+、)\s*(\S.*)$"
CHAPTER = r"^\s*(?:第\s*[一二三四五六七八九十百零\d]+\s*章|[一二三四五六七八九十]+、|\d+\s*[、.]?\s*(?:[^\d.]|$))"
CHUNKS = f"""with src as (
  select 'D' || doc_id as policy_id, v.version, case v.version when 'V1' then text else '第一章 总则' || chr(10) || text || chr(10) || '1.1 附则' || chr(10)
    || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || doc_id || ' | x |' end as text from documents, (values ('V1'), ('V2')) v(version)),
cut as (select policy_id, version, string_split(text, chr(10)) as l from src),
raw as (select policy_id, version, i - 1 as n, {strip("l[i]")} as body, l[i] as line from (select *, unnest(range(1, len(l) + 1)) as i from cut)),
marked as (
  select *, case when regexp_matches(line, '{HEADING}') then left(body, 60) end as heading, contains(line, '|') as tab,
    contains(line, '|') and regexp_full_match(body, '[-|: ]+') as rule from raw),
chaptered as (select *, case when regexp_matches(heading, '{CHAPTER}') then heading end as chapter from marked),
placed as (
  select *, count(heading) over w as section, last_value(heading ignore nulls) over w as own, last_value(chapter ignore nulls) over w as parent,
    lead(rule) over (partition by policy_id, version order by n) as next_rule, lead(heading) over (partition by policy_id, version order by n) as next_heading
  from chaptered window w as (partition by policy_id, version order by n rows between unbounded preceding and current row)),
sectioned as (
  select *, case when own is null then '正文' when regexp_matches(own, '{CHAPTER}') or parent is null then own else parent || '·' || own end as path,
    first_value(case when tab and not rule then body end ignore nulls) over (partition by policy_id, version, section order by n
      rows between unbounded preceding and 1 preceding) as header,
    count_if(tab or body = '') over (partition by policy_id, version, section order by n) as paragraph from placed),
pieces as (
  select policy_id, version, section, path, n, tab, case when tab then -n - 1 else paragraph end as unit,
    case when tab and header is not null then header || chr(10) || body else body end as piece from sectioned
  where (tab and not rule and not (header is null and coalesce(next_rule, false) and next_heading is null) and coalesce(header <> body, true)) or (not tab and body <> '')),
units as (
  select policy_id, version, section, path, tab, min(n) as n, string_agg(piece, ' ' order by n) as unit_text from pieces
  group by policy_id, version, section, path, unit, tab),
numbered as (
  select *, count_if(tab or length(unit_text) >= 12) over (partition by policy_id, version order by n) as chunk_no,
    count_if(tab or length(unit_text) >= 12) over (partition by policy_id, version, section order by n) as in_section from units)
select policy_id, chunk_no::int as chunk_no, policy_id || '-' || version || '-' || format('{{:03d}}', chunk_no::bigint) as chunk_id,
  arg_min(case when tab then path || '·表格行' else path end, n) as section_path, string_agg(unit_text, ' ' order by n) as content
from numbered where in_section > 0 group by policy_id, version, chunk_no"""


POLICIES = f"""
asking as (select claim_id, k, travel_city as city, department, strftime(submitted_at, '%Y-%m-%d') as as_of from claims),
in_force as (
  select a.*, t.etype, c.chunk_id, c.content, c.policy_id, c.version from asking a, lateral (select unnest({array(EXPENSE_TYPES)}) as etype) t, clauses c
  where c.expense_type = t.etype and (a.department = 'ALL' or c.department in ('ALL', a.department))
    and (c.effective_from = '' or a.as_of >= c.effective_from) and (c.effective_to = '' or a.as_of <= c.effective_to)),
typed as (select *, ['EXPENSE', 'MEDICAL', 'PURCHASE'][(k % 3) + 1] as etype from asking)
"""


def with_policies(select):
    return "with " + CLAIMS + "," + POLICIES + select


TOKENS = r"regexp_extract_all(lower({0}), '[a-z0-9]+|[\x{{4e00}}-\x{{9fff}}]{{1,4}}')"


def tokens(c):
    return (f"flatten(list_transform({TOKENS.format(c)}, lambda t: case when regexp_full_match(t, '[\\x{{4e00}}-\\x{{9fff}}]{{3,4}}') "
            f"then list_concat([t], list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) else [t] end))")


def keyword_hits(queries, corpus, k, order, factor="1.0"):
    return f"""
q as ({queries}), d as ({corpus}),
dt as (select doc_id, token, count(*) as tf from (select doc_id, unnest({tokens('text')}) as token from d) group by all),
qt as (select query_id, token, count(*) as qtf from (select query_id, unnest({tokens('text')}) as token from q) group by all),
idf as (select token, ln(((select count(*) from d) + 1) / (count(*) + 1)) + 1 as idf from dt group by token),
raw as (select query_id, doc_id, sum(qtf * (1 + ln(tf)) * idf) as score from qt join dt using (token) join idf using (token) group by all),
adjusted as (select raw.query_id, raw.doc_id, raw.score * {factor} as score, d.*exclude(doc_id) from raw join d using (doc_id) join (select query_id, text as query_text from q) using (query_id)),
hits as (select *, row_number() over (partition by query_id order by round(score, 9) desc, {order}) as rank from adjusted where score > 0 qualify rank <= {k})
"""


FACTOR = f"""(case when query_id in {FIRST_TIER} then (case when contains(content, query_id) then 1.15 else 1.0 end)
  when contains(content, '其他城市') then 1.5 when contains(content, '的住宿标准') and ({' or '.join(f"contains(content, '{c}')" for c in P.FIRST_TIER_CITIES)}) then 0.4 else 1.0 end)"""
CITY_QUERIES = "select distinct travel_city as query_id, travel_city || ' 住宿标准 差旅 报销 酒店' as text from claims where travel_city is not null"
CHUNK_CORPUS = ("select chunk_id as doc_id, content || ' ' || section as text, content, printf('0%06d', ord) as ord from chunks "
                "union all select chunk_id, content || ' 4.2', content, '1' || chunk_id from clauses")


def city_hits(k, select):
    return with_policies("," + keyword_hits(CITY_QUERIES, CHUNK_CORPUS, k, "ord", FACTOR) + select)


def reranked(k, keep):
    tier = f"case when contains(content, query_id) then 0 when contains(content, '其他城市') and query_id not in {FIRST_TIER} then 1 else 2 end"
    return city_hits(k, f""", ranked as (select *, row_number() over (partition by query_id order by {tier}, rank) as new_rank from hits)
        select c.claim_id, new_rank as rank, doc_id as chunk_id, round_even(score, 4) as score from ranked join claims c on c.travel_city = query_id where new_rank <= {keep}""")


VECTORS = """
corpus as (select vec_id, label, embedding::double[] as v from embeddings),
dims as (select label, i, round(avg(v[i]), 6) as m from corpus, range(1, 65) r(i) group by label, i),
centers as (select label, list(m order by i) as q from dims group by label),
dist as (select c.label as query_id, vec_id as doc_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (q[i] - v[i]) * (q[i] - v[i])))) as x,
  list_sum(list_transform(range(1, 65), lambda i: case when q[i] > 0.02 and v[i] > 0.1 then q[i] * v[i] end)) as p from centers c join corpus e on e.label = c.label),
every as (select c.label + 100 as query_id, vec_id as doc_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (q[i] - v[i]) * (q[i] - v[i])))) as x
  from centers c, corpus e),
free as (select *, round_even(x, 4) as score, row_number() over (partition by query_id order by round(x, 9), doc_id) as rank from every),
near as (select *, round_even(x, 4) as score, row_number() over (partition by query_id order by round(x, 9), doc_id) as rank from dist),
alike as (select *, round_even(p, 4) as score, row_number() over (partition by query_id order by round(p, 9) desc, doc_id) as rank from dist where p is not null)
"""

FILE_SUFFIX = "case when doc_id % 20 = 1 then '.exe' when doc_id % 20 = 2 then '.PDF' else '.txt' end"
EN_MAIL, EN_LICENSE, EN_RIGHTS = r"[a-z0-9._]+@[a-z0-9.]+", r"licen[cs]e[^\n]{0,20}", r"all rights[^\n]{0,12}reserved"
NOTE_LABELS = "忽略指令|系统指令伪造|要求直接判合规|要求跳过检查|越权特批"


def all_of(pattern):
    return f"regexp_extract_all(text, '(?i){pattern}')"


def text_share():
    t = strip("text")
    return f"length(regexp_replace({t}, '{MEANINGFUL}', '', 'g')) / greatest(length({t}), 1)"


def markup(c):
    c = rf"regexp_replace({c}, '!\[[^\]]*\]\([^)]*\)', ' ', 'g')"
    c = rf"regexp_replace({c}, '(?i)</t[dh]\s*>', chr(10), 'g')"
    c = rf"regexp_replace({c}, '(?i)</tr\s*>', chr(10), 'g')"
    c = rf"regexp_replace({c}, '(?i)<br\s*/?>', chr(10), 'g')"
    c = rf"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{char}')"
    lines = rf"regexp_split_to_array({c}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    clean = f"list_transform({lines}, lambda ln: {fold(f'''regexp_replace(ln, '^{WS}*#{{1,6}}{WS}*', '')''')})"
    return f"array_to_string(list_filter({clean}, lambda ln: ln <> ''), chr(10))"


STATES = " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_STATES.items())
EVENT_STEPS = """
steps as (
  select s, policy_id, u.n * 1000000 + s as event_no, action from policies, lateral (select * from (values
    (1, 'create', true), (2, 'chunk', s % 8 <> 0), (3, 'publish', true), (4, 'disable', s % 5 = 0), (5, 'create', s % 10 = 0), (6, 'publish', s % 20 = 0)) v(n, action, happens)
    where happens) u),
states as (
  select s, policy_id, case when s % 9 = 0 then '' else name end as name, version,
    s % 9 <> 0 and s % 8 <> 0 as first_ok,
    case when s % 10 = 0 then 'draft' when s % 5 = 0 then 'disabled' when s % 9 <> 0 and s % 8 <> 0 then 'published' else 'draft' end as status,
    case when s % 10 = 0 then 0 when s % 8 = 0 then 0 else 2 end as chunk_count,
    case when s % 10 <> 0 and s % 9 <> 0 and s % 8 <> 0 then 3000000 + s end as published_at,
    (case when s % 9 = 0 or s % 8 = 0 then 1 else 0 end + case when s % 20 = 0 then 1 else 0 end)::bigint as refused,
    case when s % 20 = 0 then (case when s % 9 = 0 then '制度元数据不完整（名称/版本/生效时间/部门/费用类型），不允许发布' else '制度尚未切片，不允许发布' end)
      when s % 9 = 0 then '制度元数据不完整（名称/版本/生效时间/部门/费用类型），不允许发布' when s % 8 = 0 then '制度尚未切片，不允许发布' end as last_refusal
  from policies)
"""

GATES = {t: " or ".join(f"contains(content, '{w}')" for w in words) for t, words in P.EXPENSE_GATES.items()}

TABLE_ORACLES = {
    "material_scan": f"""select file_name, case when reason is null then substr(sha256(raw), 1, 16) end as document_id,
        case when reason is null then (case when doc_id % 20 = 2 then 'pdf_text' else 'text' end) end as kind,
        case when reason is null then strlen(raw)::int end as size, case when reason is null and doc_id % 20 <> 2 then length(text)::int end as chars, reason from (
        select doc_id, text, 'doc_' || doc_id || ({FILE_SUFFIX}) as file_name, case when doc_id % 10 = 0 then chr(65279) || text else text end as raw,
          case when doc_id % 40 = 3 then '文件不能为空且不得超过8MB' when doc_id % 20 = 1 then '仅支持PDF、TXT、DOCX、XLSX及图片文件'
            when doc_id % 40 = 4 then '文本不是有效的UTF-8' end as reason from documents)""",
    "policy_scan": f"""with base as (
          select s_suppkey as s, ['TRAVEL', 'EXP', 'PHARM', 'OFFICE'][(s_suppkey % 4) + 1] || '-V' || (s_suppkey % 2 + 1) || '-' || s_suppkey as kid,
            ['TRAVEL', 'EXPENSE', 'MEDICAL', 'PURCHASE'][(s_suppkey % 4) + 1] as kind, {array(DEPARTMENTS)}[(s_suppkey % 5) + 1] as dept from supplier)
        select printf('policy_%06d.json#%09d#%06d', s::bigint, u.r::bigint, u.p::bigint) as ord, kid || u.suffix as chunk_id, '4.3' as section_path, u.content, kind as policy_id,
          'V' || (s % 2 + 1) as version, u.department, kind as expense_type
        from base, lateral (select * from (values
          (0, 0, '-T-R1', '费用类型 ｜ 上限 ｜ 适用部门｜住宿 ｜ ' || (s % 500) || ' ｜ ' || dept, dept),
          (0, 1, '-T-R2', '费用类型 ｜ 上限 ｜ 适用部门｜餐补 ｜ ' || (s % 90) || ' ｜ 全员', 'ALL'),
          (1, 0, '-P', '逾期须说明' || s, 'ALL')) v(r, p, suffix, content, department)) u""",
    "document_text": "select conv_id, string_agg(text, chr(10) order by turn) as text from conversations group by conv_id",
    "markup_normalize": f"select page_id, {markup('html')} as plain from pages",
    "text_quality": f"""select doc_id, case when {strip('text')} = '' then 0.0 else round_even(0.6 * (1 - {text_share()})
        + 0.4 * least((contains(text, 'the')::int + contains(text, 'tion')::int + contains(text, 'que')::int + contains(text, 'und')::int) / 3.0, 1.0), 4) end as quality from documents""",
    "region_assess": f"""select doc_id, level, case when n < 10 then '识别文本过少(' || n || '字符)' when level = 'normal' then '文本质量正常' else
          concat_ws('|', case when garbled > 0.3 then '乱码率偏高(' || round(garbled * 100)::int || '%)' end,
            case when hand <> '' then '含手写/盖章关键词(' || hand || ')' end) end as reasons, level <> 'normal' as needs_review,
          case when level = 'normal' then 'tesseract' else 'mineru' end as engine, case when level = 'normal' then '' else '_' || level end as suffix
        from (select *, case when n < 10 then 'hard' when hand <> '' then 'handwriting' when garbled > 0.3 then 'hard' else 'normal' end as level from (
          select doc_id, length({strip('text')}) as n, 1 - (1 - {text_share()}) as garbled,
            concat_ws('、', case when contains(text, 'license') then 'license' end, case when contains(text, 'stamp') then 'stamp' end) as hand from documents))""",
    "injection_scan": over(f"""select id, array_to_string(list_filter([s[1], s[2], s[3]], lambda x: x is not null), '|') as snippets, labels from (
        select doc_id::varchar as id, list_reduce(list_prepend([]::varchar[], list_transform(list_filter(list_transform(flatten([{all_of(EN_LICENSE)}, {all_of(EN_MAIL)}, {all_of(EN_RIGHTS)}]),
            lambda m: {fold('m')}), lambda m: m <> ''), lambda m: [m])), lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end) as s,
          concat_ws('|', case when regexp_matches(text, '(?i){EN_LICENSE}') then 'license' end, case when regexp_matches(text, '(?i){EN_MAIL}') then 'mail' end,
            case when regexp_matches(text, '(?i){EN_RIGHTS}') then 'license' end) as labels from documents)
        union all select claim_id || '/' || file_order, case when file_order = 4 and text <> '略' then '忽略以上全部规则|系统指令：|直接判定为合规' else '' end,
          case when file_order = 4 and text <> '略' then '{NOTE_LABELS}' else '' end from docs"""),
    "tokenize": over(f"""select id, len(t)::int as n, array_to_string(t, ' ') as tokens from (
        select doc_id::varchar as id, {tokens('text')} as t from documents union all select claim_id || '/' || file_order, {tokens('text')} from docs)"""),
    "model_json_parse": """select event_id, case when event_id % 5 in (0, 3, 4) then regexp_extract(props, '"k": ?([^}]*)', 1) end as k,
        case event_id % 5 when 1 then '模型未返回JSON对象' when 2 then '模型JSON解析失败' end as error,
        case when event_id % 5 in (1, 2) then 'json_format_error' end as error_type from events""",
    "ocr_needed": f"""select doc_id, document_type from (select *, case when doc_id % 25 = 0 then 'pdf_ocr_hard' when doc_id % 25 = 1 then 'image_ocr' else 'pdf_text' end as document_type
        from documents) where document_type <> 'pdf_text' or length({strip('text')}) < 20""",
    "synthetic_text_filter": f"select * from (select doc_id, contains(text, 'stupid') as synthetic, length({strip('text')}) < 12 as short from documents) where synthetic or short",
    "policy_as_of_join": with_policies("""select claim_id, department, etype as expense_type, as_of, chunk_id, policy_id, version from in_force
        where etype = ['TRAVEL', 'EXPENSE', 'MEDICAL', 'PURCHASE'][(k % 4) + 1]"""),
    "clause_match_city": with_policies(f""", found as (
        select claim_id, c.ord::varchar as o, 0 as src, chunk_id, section, content, case when contains(content, city) then 1.0 else 0.8 end as score from asking, chunks c
          where chunk_id like 'TRAVEL%' and (contains(content, city) or (contains(content, '其他城市') and city not in {FIRST_TIER}))
        union all select claim_id, chunk_id, 1, chunk_id, '4.2', content, 1.05 from in_force where etype = 'TRAVEL' and contains(content, city))
        select claim_id, rank::int as rank, chunk_id, section, content, score::double as score from (
          select *, row_number() over (partition by claim_id order by score desc, src, o) as rank from found) where rank <= 2"""),
    "clause_match_expense": with_policies(f""", found as (
        select claim_id, printf('%06d', ord) as o, 0 as src, chunk_id, content, case when contains(content, coalesce(city, '~')) then 1.0 else 0.8 end as score from typed, chunks c
          where (etype = 'EXPENSE' or (etype = 'MEDICAL' and ({GATES['MEDICAL']})) or (etype = 'PURCHASE' and ({GATES['PURCHASE']})))
            and (city is null or contains(content, city) or (contains(content, '其他城市') and city not in {FIRST_TIER}))
        union all select f.claim_id, chunk_id, 1, chunk_id, content, case when contains(content, coalesce(f.city, '~')) then 1.05 else 0.9 end
          from in_force f join typed t on t.claim_id = f.claim_id and t.etype = f.etype)
        select claim_id, rank::int as rank, chunk_id, content, score::double as score from (
          select *, row_number() over (partition by claim_id order by score desc, src, o) as rank from found) where rank <= 2"""),
    "doc_frequency": f"select token, count(*) as df from (select distinct doc_id, unnest({tokens('text')}) as token from documents) group by token",
    "tfidf_search": "with " + keyword_hits("select item_id as query_id, text from benchmark", "select doc_id, text from documents", 5, "doc_id")
                    + "select query_id, rank, doc_id, round_even(score, 4) as score from hits",
    "vector_topk": "with " + VECTORS + """select query_id, rank, doc_id, score from near where rank <= 6
        union all select query_id, rank, doc_id, score from free where rank <= 6""",
    "hybrid_topk": "with " + VECTORS + """, d as (select query_id, doc_id, case when max(score) over w = min(score) over w then 1.0
          else (score - max(score) over w) / (min(score) over w - max(score) over w) end as v from near where rank <= 15 window w as (partition by query_id)),
        s as (select query_id, doc_id, case when max(score) over w = min(score) over w then 1.0
          else (score - min(score) over w) / (max(score) over w - min(score) over w) end as v from alike where rank <= 15 window w as (partition by query_id)),
        f as (select query_id, doc_id, coalesce(d.v, 0) + 0.3 * coalesce(s.v, 0) as fused from d full join s using (query_id, doc_id))
        select query_id, rank, doc_id, round_even(fused, 4) as score from (
          select *, row_number() over (partition by query_id order by round(fused, 9) desc, doc_id) as rank from f) where rank <= 5""",
    "entity_rerank": reranked(P.RERANK_POOL, P.CLAUSES_KEPT),
    "city_rerank": reranked(P.CLAUSES_KEPT, P.CLAUSES_KEPT),
    "retrieval_hit_rate": city_hits(P.CLAUSES_KEPT, f""" select n as total_cases, e as evaluated_cases, h as passed_cases, e - h as failed_cases, {RATIO.format('h', 'e')} as hit_rate from (
        select count(*) as n, count(wanted_clause) as e, count(*) filter (exists(select 1 from hits where query_id = travel_city and doc_id = wanted_clause)) as h from cases)"""),
    "chunk_text": CHUNKS,
    "table_row_split": """select p_partkey, u.* from part, lateral (select * from (values
          ('', '部件 ' || p_name || ' | 无表格', true), ('-R1', '名称 ｜ 品牌 ｜ 尺寸｜' || p_name || ' ｜ ' || p_brand || ' ｜ ' || p_size, false),
          ('-R2', '名称 ｜ 品牌 ｜ 尺寸｜' || p_type || ' ｜  ｜ ALL', false)) v(suffix, content, plain)) u(suffix, content, plain)
        where plain = (p_partkey % 5 = 0)""".replace("select p_partkey, u.*", "select p_partkey, suffix, content"),
    "task_state": f"""select user_id as task_id, arg_max(state, (ts, event_id)) as state, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as updated_at
        from (select *, case event_type {STATES} end as state from events) where state is not null group by user_id""",
    "event_timeline": """select user_id as task_id, event_id, event_type, row_number() over w as position, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as created_at,
        strftime(lag(ts) over w, '%Y-%m-%d %H:%M:%S.%f') as previous_at from events window w as (partition by user_id order by ts, event_id)""",
    "policy_status": with_policies("," + EVENT_STEPS + "select policy_id, name, version, status, chunk_count, published_at, refused, last_refusal from states"),
    "policy_version_switch": with_policies("," + EVENT_STEPS + """select policy_id, name, version, case when off then 'disabled' else status end as status, off as switched_off from (
        select *, status = 'published' and exists(select 1 from states o where o.name = t.name and o.status = 'published' and (o.published_at, o.policy_id) > (t.published_at, t.policy_id)) as off from states t)"""),
    "nearest_rank_percentile": """select event_type, n, """ + ", ".join(
        f"round_even((select list(value order by value) from events i where i.event_type = o.event_type)[round_even({q} * (n - 1), 0)::bigint + 1], 1) as {name}"
        for name, q in (("p50", 0.5), ("p95", 0.95), ("pmax", 1.0))) + " from (select event_type, count(*) as n from events group by event_type) o",
    "dedupe_documents": "select substr(sha256(text), 1, 16) as document_id, min(doc_id) as kept, count(*) as copies from documents group by text",
    "stream_event_counts": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n from events group by all",
}
