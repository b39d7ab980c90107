"""The core queries in SQL, for a second engine over the same tables."""

from __future__ import annotations

from unifold.functions.normalize import CALLING_CODES, COUNTRIES, MONTHS, SKILL_NAMES
from unifold.functions.trust import TRUST_WEIGHTS
from unifold.operators.extract import DEGREE_WORDS, HEADINGS
from unifold.plans.core_queries import AS_OF

_WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def in_list(table: dict[str, list[str]], key: str) -> str:
    whens = " ".join(f"when {key} in ({', '.join(map(q, keys))}) then {q(v)}" for v, keys in table.items())
    return f"case {whens} end"


def country(x: str) -> str:
    key = f"lower({strip(x)})"
    return f"case when {x} <> '' then coalesce({in_list(COUNTRIES, key)}, upper(substr({key}, 1, 2))) end"


def skill(x: str) -> str:
    return f"coalesce({in_list(SKILL_NAMES, f'lower({strip(x)})')}, {strip(x)}, '')"


def weight(x: str) -> str:
    return f"case {' '.join(f'when {x} = {q(k)} then {v}::double' for k, v in TRUST_WEIGHTS.items())} else 0.5::double end"


def possible(d: str) -> str:
    tests = [f"(substr({d}, 1, {len(k)}) = {q(k)} and length({d}) - {len(k)} in ({', '.join(map(str, v))}))" for k, v in CALLING_CODES.items()]
    return "(" + " or ".join(tests) + ")"


def phone(source: str, value: str, keep: str) -> str:
    """A subquery that adds ``e164`` to the rows of ``source``."""
    return f"""(
      select {keep}, case
        when plus and {possible("digits")} then '+' || digits
        when not plus and length(digits) in (7, 10) then '+1' || digits
        when not plus and length(digits) = 11 and digits like '1%' then '+' || digits
        when s not like '+%' and {possible("digits")} then '+' || digits
        when length(filled) >= 10 then case when s like '+%' then '+' || filled else '+1' || right(filled, 10) end
      end as e164
      from (select *, case when length(every) = 7 then '650' || every when length(every) = 8 and every like '1%' then '650' || substr(every, 2) else every end as filled
        from (select *, body like '+%' as plus, regexp_replace(body, '\\D', '', 'g') as digits, regexp_replace(s, '\\D', '', 'g') as every
          from (select *, regexp_replace(regexp_replace(s, '^[^+\\d]+', ''), '(?i)\\s*(?:ext\\.?|extension|x)\\s*\\d+\\s*$', '') as body
            from (select *, {strip(value)} as s from {source}) t1) t2) t3) t4)"""


def date(x: str) -> str:
    s = f"lower({strip(x)})"
    year = rf"regexp_extract({s}, '\b(\d{{4}})\b', 1)"
    named = " ".join(f"when contains({s}, {q(m)}) then '{k:02d}'" for k, m in enumerate(MONTHS, 1))
    forms = [("%Y-%m-%d", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("%m/%d/%Y", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("%d/%m/%Y", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("%Y/%m/%d", r"^\d{4}/\d{1,2}/\d{1,2}$")]
    parsed = ", ".join(f"strftime(try_strptime(case when regexp_matches({s}, '{p}') then {s} end, '{f}'), '%Y-%m')" for f, p in forms)
    return rf"""case when {s} in ('present', 'current', 'now') then '{AS_OF}'
      when regexp_matches({s}, '^(\d{{4}})[-/](\d{{1,2}})$') then regexp_extract({s}, '^(\d{{4}})', 1) || '-' || lpad(regexp_extract({s}, '(\d{{1,2}})$', 1), 2, '0')
      when regexp_matches({s}, '^(\d{{1,2}})[-/](\d{{4}})$') then regexp_extract({s}, '(\d{{4}})$', 1) || '-' || lpad(regexp_extract({s}, '^(\d{{1,2}})[-/]', 1), 2, '0')
      when regexp_matches({s}, '^(\d{{4}})$') then {s} || '-01'
      when {year} <> '' and (case {named} end) is not null then {year} || '-' || (case {named} end)
      else coalesce({parsed}) end"""


def handle_key(x: str) -> str:
    s = strip(f"lower({x})")
    path = f"regexp_replace(regexp_replace({s}, '[?#].*$', ''), '^[a-z][a-z0-9+.-]*://', '')"
    parts = f"list_filter(string_split({path}, '/'), lambda p: {strip('p')} <> '')"
    url = f"(contains({s}, '://') or contains({path}, '/'))"
    return f"case when {url} and len({parts}) <= 1 then null else nullif({strip(f'{parts}[-1]')}, '') end"


def github_handle(x: str) -> str:
    s = f"lower({strip(x)})"
    last = f"case when contains({s}, 'github.com/') then list_filter(string_split({s}, '/'), lambda p: p <> '')[-1] else {s} end"
    return f"nullif({strip(f'split_part(split_part({last}, $q$?$q$, 1), $q$#$q$, 1)')}, '')"


def joined(x: str) -> str:
    return f"coalesce(array_to_string(list_transform({x}, lambda v: coalesce(v, '~')), '|'), '')"


def place(value: str, part: str) -> str:
    parts = f"list_transform(string_split({value}, ','), lambda p: {strip('p')})"
    n = f"len({parts})"
    return {
        "city": f"case when {n} >= 2 then {parts}[1] else '' end",
        "region": f"case when {n} >= 3 then {parts}[2] else '' end",
        "country": f"case when {n} >= 3 then {parts}[3] when {n} = 2 then {parts}[2] else {parts}[1] end",
    }[part]


_GAP = 1_000_000_000_000
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
_DOCS = "(select 'd' as src, doc_id, text from documents where text is not null)"
_HEAD_IN = ", ".join(map(q, HEADINGS))


def listed(array: str, value: str) -> str:
    """Texts of an array's elements ``x``, one below the other."""
    return f"coalesce(array_to_string(list_transform({array}, lambda x: {value}), chr(10)), '')"


_PLACE = "concat_ws(', ', location.city, location.region, location.country)"
_NL = "chr(10)"
_SCHOOLING = f"'Course: ' || coalesce(x.degree, '') || ' in ' || coalesce(x.field, '') || ' ' || coalesce(x.end_year::varchar, '') || {_NL} || coalesce(x.institution, '?') || ', CGPA: 9'"
_WORK = f"coalesce(x.title, '') || ' | ' || coalesce(x.company, '') || {_NL} || '- ' || coalesce(x.summary, '')"
_TEXTS = f"""(select 'd' as src, doc_id, text from documents where text is not null union all
  select 'p', record_no, concat_ws({_NL}, full_name, headline, 'Phone: ' || coalesce(array_to_string(phones, ' / '), ''), 'Mail: ' || coalesce(array_to_string(emails, ' '), ''),
    case when {_PLACE} <> '' then 'LOCATION: ' || {_PLACE} end, 'Education:', {listed("education", _SCHOOLING)}, 'SKILLS',
    'Main: ' || coalesce(array_to_string(list_transform(skills, lambda x: x.name), '; '), ''), 'Projects', {listed("experience", _WORK)}) from output_default)"""


def sections(texts: str) -> str:
    """CTEs ``lines`` and ``sections`` of rows (src, doc_id, text)."""
    return f"""
  lines as (select src, doc_id, unnest(l) as line, unnest(range(len(l))) as i, len(l) as n from (select src, doc_id, {_LINES} as l from {texts} t) x),
  marked as (select *, case when lower(line) like '%:' then {strip("left(lower(line), length(line) - 1)")} else lower(line) end as h from lines),
  heads as (select src, doc_id, h as heading, i, n, lead(i) over (partition by src, doc_id order by i) as nxt from marked where h in ({_HEAD_IN})),
  last as (select src, doc_id, heading, max(i) as i, max_by(coalesce(nxt, n), i) as upto from heads group by src, doc_id, heading),
  sections as (select s.src, s.doc_id, s.heading, list(l.line order by l.i) filter (where l.line is not null) as block
    from last s left join lines l on l.src = s.src and l.doc_id = s.doc_id and l.i > s.i and l.i < s.upto group by s.src, s.doc_id, s.heading)"""


def skills_of(sections_cte: str = "sections") -> str:
    """CTEs ``tails``, ``parts``, ``kept`` of the skills sections' skills."""
    tail = "case when contains(line, ':') then regexp_replace(line, '^[^:]*:', '') else line end"
    return f"""tails as (select src, doc_id, unnest(block) as line, unnest(range(len(block))) as i from {sections_cte} where heading = 'skills'),
  parts as (select src, doc_id, i, unnest(string_split_regex({tail}, '[,;]')) as p, unnest(range(len(string_split_regex({tail}, '[,;]')))) as j from tails),
  kept as (select src, doc_id, i, j, regexp_replace({strip("p")}, '{_WS}+', ' ', 'g') as skill, {strip("p")} as s from parts where {strip("p")} <> '' and length({strip("p")}) < 50)"""


def years(x: str) -> str:
    return rf"regexp_extract_all({x}, '\b(\d{{4}})\b', 1)[-1]::int"


#: Degree lines in a row alternate between a degree and what follows it.
_EDU = rf"""
  edu_lines as (select src, doc_id, unnest(block) as line, unnest(range(len(block))) as i from sections where heading = 'education'),
  degree_lines as (select *, regexp_matches(lower(line), '{"|".join(w.replace(".", chr(92) + ".") for w in DEGREE_WORDS)}') as is_degree, lead(line) over (partition by src, doc_id order by i) as following from edu_lines),
  edu_runs as (select *, i - row_number() over (partition by src, doc_id, is_degree order by i) as run from degree_lines),
  degrees as (select *, row_number() over (partition by src, doc_id, is_degree, run order by i) as place from edu_runs),
  edu_entries as (select src, doc_id, i, {strip(f"regexp_replace(regexp_replace(line, '[0-9]{{4}}', '', 'g'), '(?:[-?–]|{_WS})+$', '')")} as degree, line, following,
    {strip(f"regexp_replace({strip("regexp_replace(following, '(?:CGPA:|Percentage:).*$', '')")}, '(?:[,?-]|{_WS})+$', '')")} as institution from degrees where is_degree and place % 2 = 1),
  schooling as (select src, doc_id, (row_number() over (partition by src, doc_id order by i) - 1)::int as pos, coalesce(institution, '') as institution, degree,
    {strip(f"regexp_extract(degree, '(?i)in{_WS}+([^(\n?]+)', 1)")} as field, coalesce({years("line")}, {years("following")}) as end_year from edu_entries)"""

_PROJECTS = rf"""
  work as (select b.src, b.doc_id, case when len(coalesce(p.block, [])) > 0 then p.block else e.block end as block
    from (select distinct src, doc_id from sections) b left join sections p on p.src = b.src and p.doc_id = b.doc_id and p.heading = 'projects' left join sections e on e.src = b.src and e.doc_id = b.doc_id and e.heading = 'experience'),
  work_lines as (select src, doc_id, unnest(block) as line, unnest(range(len(block))) as i from work),
  entries as (select *, sum(contains(line, '|')::int) over (partition by src, doc_id order by i) as k from work_lines),
  projects as (select src, doc_id, (k - 1)::int as pos, 'Personal/Academic Project' as company,
    regexp_replace({strip("split_part(min_by(line, i), '|', 1)")}, '({_WORD}){_WS}+({_WORD})', '\1\2', 'g') as title,
    'Technologies: ' || {strip("regexp_replace(min_by(line, i), '(?s)^[^|]*[|]', '')")} || '. ' ||
    coalesce(string_agg(case when regexp_matches(line, '^[?•-]') then {strip("substr(line, 2)")} else line end || ' ', '' order by i) filter (where not contains(line, '|')), '') as summary
    from entries where k > 0 group by src, doc_id, k)"""

_STATED = rf"(?i)Location:{_WS}*(.*)"


def mails(texts: str) -> str:
    return rf"select distinct src, doc_id, unnest(regexp_extract_all(text, '(?:{_WORD}|[.-])+@(?:{_WORD}|[.-])+\.{_WORD}+')) as email from {texts} t"


def numbers(texts: str) -> str:
    found = rf"'(?:\+?\d{{1,4}}(?:[-.]|{_WS})?)?\(?\d{{2,5}}\)?(?:[-.]|{_WS})?\d{{3,5}}(?:[-.]|{_WS})?\d{{3,5}}'"
    return rf"""select distinct src, doc_id, regexp_replace(p, '^[^+\d]+|[^0-9]+$', '', 'g') as phone from (select src, doc_id, unnest(regexp_extract_all(text, {found})) as p from {texts} t) x
          where length(regexp_replace(p, '\D', '', 'g')) between 8 and 15"""


def guessed(inst: str, part: str) -> str:
    """City or country of an institution's last part."""
    if part == "city":
        return f"case when coalesce({inst}, '') <> '' then {strip(f'string_split({inst}, $q$,$q$)[-1]')} else '' end"
    return f"case when len(string_split(coalesce({inst}, ''), ',')) >= 2 and (contains(lower({inst}), 'ballari') or contains(lower({inst}), 'india')) then 'IN' else '' end"


def headline(base: str) -> str:
    fallback = f"case when lower(l[2]) not in ({_HEAD_IN}) and length(l[2]) < 100 then l[2] end"
    chosen = strip(f"replace(coalesce(nullif(array_to_string(s.block, chr(10)), ''), nullif(array_to_string(o.block, chr(10)), ''), {fallback}), chr(10), ' ')")
    return f"""select b.src, b.doc_id, {chosen} as headline
          from {base} b left join sections s on s.src = b.src and s.doc_id = b.doc_id and s.heading = 'summary' left join sections o on o.src = b.src and o.doc_id = b.doc_id and o.heading = 'objective'"""


_TOWN = f"""
  prof as (select *, coalesce(location.city, '#' || (record_no + {_GAP})) as component_id, record_no + {_GAP} as idx, coalesce(provenance[1].source, 'unknown') as source from output_default),
  ranked as (select *, {weight("source")} as weight from prof)"""
_RK = "struct_pack(w := -weight, i := idx)"
_EMAILS = f"list_filter(list_transform(list_filter(coalesce(emails, []), lambda e: e is not null), lambda e: lower({strip('e')})), lambda e: e <> '')"


def first(value: str, present: str) -> str:
    return f"arg_min({value}, {_RK}) filter (where {present})"


def text(x: str) -> str:
    return f"coalesce({strip(x)}, '')"


def merged() -> str:
    """CTEs that merge the rows of ``ranked`` into ``m``, one row per component."""
    parts = (("city", text("location.city")), ("region", text("location.region")), ("country", country("location.country")), ("linkedin", text("links.linkedin")), ("github", text("links.github")), ("portfolio", text("links.portfolio")))
    picked = ", ".join(f"coalesce({first(x, f'coalesce({x}, $q$$q$) <> $q$$q$')}, '') as {n}" for n, x in parts)
    months = "greatest(coalesce((left(t, 4)::int * 12 + right(t, 2)::int) - (left(f, 4)::int * 12 + right(f, 2)::int), 0), 0)"
    entries = [
        ("name_s is not null", "full_name", "name_s", "source_trust_hierarchy"), ("n_mails > 0", "emails", "prime", "union_all_sources"), ("n_phones > 0", "phones", "prime", "union_all_sources"),
        ("located", "location", "prime", "merge_properties"), ("linked", "links", "prime", "merge_properties"), ("head_s is not null", "headline", "head_s", "source_trust_hierarchy"),
        ("years_s is not null", "years_experience", "years_s", "source_trust_hierarchy"), ("repos_s is not null", "repository_count", "repos_s", "source_trust_hierarchy"),
        ("n_jobs > 0", "experience", "prime", "union_all_sources"), ("computed", "years_experience", "'calculated'", "date_diff_sum"), ("n_schools > 0", "education", "prime", "union_all_sources"), ("n_skills > 0", "skills", "prime", "merge_properties"),
    ]
    named = ", ".join(f"case when {c} then '{f}/' || {s} || '/{m}' end" for c, f, s, m in entries)
    weights = ", ".join(f"case when {c} then {weight(s)} end" for c, _, s, _ in entries)
    flags = ("name_s is not null", "n_mails > 0", "n_phones > 0", "located", "linked", "head_s is not null", "n_skills > 0", "n_jobs > 0", "n_schools > 0")
    complete = "(" + " + ".join(f"({f})::int" for f in flags) + ") / 9.0::double"
    return f"""
  s1 as (select component_id, arg_min(source, {_RK}) as prime, {first("full_name", "full_name <> ''")} as full_name, {first("source", "full_name <> ''")} as name_s, {first("source", "headline <> ''")} as head_s,
    {first("years_experience", "years_experience is not null")} as given, {first("source", "years_experience is not null")} as years_s, {first("repository_count", "repository_count is not null")} as repository_count, {first("source", "repository_count is not null")} as repos_s, {picked} from ranked group by component_id),
  m_mails as (select component_id, list_sort(list(distinct k)) as emails from (select component_id, unnest({_EMAILS}) as k from ranked) t group by component_id),
  m_phones as (select component_id, list_sort(list(distinct e164)) as phones from {phone("(select component_id, unnest(phones) as phone from ranked) t", "phone", "component_id")} x where e164 is not null group by component_id),
  m_other as (select component_id, count(distinct v) as n_other from (select component_id, unnest(links.other) as v from ranked) t where v <> '' group by component_id),
  m_job1 as (select component_id, weight, idx, unnest(experience) as x, unnest(range(len(experience))) as pos from ranked),
  m_job2 as (select component_id, {date("x.start_month")} as f, {date("x.end_month")} as t, row_number() over (partition by component_id, lower({text("x.company")}), lower({text("x.title")}) order by -weight, idx, pos) as rn from m_job1 where {text("x.company")} <> ''),
  m_jobs as (select component_id, count(*) as n_jobs, sum({months}) as months from m_job2 where rn = 1 group by component_id),
  m_schools as (select component_id, count(distinct [lower({text("x.institution")}), lower({text("x.degree")})]) as n_schools from (select component_id, unnest(education) as x from ranked) t where {text("x.institution")} <> '' group by component_id),
  m_skills as (select component_id, count(distinct {skill("x.name")}) as n_skills from (select component_id, unnest(skills) as x from ranked) t where {skill("x.name")} <> '' group by component_id),
  m1 as (select s1.*, coalesce(emails, []) as emails, coalesce(phones, []) as phones, coalesce(len(emails), 0) as n_mails, coalesce(len(phones), 0) as n_phones, coalesce(n_jobs, 0) as n_jobs, coalesce(n_schools, 0) as n_schools, coalesce(n_skills, 0) as n_skills,
    city <> '' or region <> '' or country <> '' as located, linkedin <> '' or github <> '' or portfolio <> '' or coalesce(n_other, 0) > 0 as linked, case when months > 0 then round_even(months / 12.0::double, 1) end as worked
    from s1 left join m_mails using (component_id) left join m_phones using (component_id) left join m_other using (component_id) left join m_jobs using (component_id) left join m_schools using (component_id) left join m_skills using (component_id)),
  m2 as (select *, coalesce(given, 0) = 0 and worked is not null as computed from m1),
  m3 as (select *, list_filter([{named}], lambda x: x is not null) as provenance, list_filter([{weights}], lambda x: x is not null) as weights from m2),
  m as (select *, case when computed then worked else given end as years, format('{{:.2f}}', {complete} * case when len(weights) > 0 then list_sum(weights) / len(weights) else 0.5 end)::double as confidence from m3)"""


_KEYS = f"""
  raw as (
    select csv_row_id as idx, {strip("email")} as email, {strip("phone")} as phone, null as handle from sample_csv
    union all select record_no + {_GAP}, unnest(emails), null, null from output_default
    union all select record_no + {_GAP}, null, unnest(phones), null from output_default
    union all select record_no + {_GAP}, null, null, links.github from output_default
    union all select profile_id + {2 * _GAP}, user_profile.email, null, coalesce(user_profile.html_url, 'https://github.com/' || user_profile.login) from github_mock
  ),
  keyed as (select distinct idx, 'email' as kind, lower({strip("email")}) as key from raw where {strip("email")} <> ''
    union select distinct idx, 'phone', e164 from {phone("(select idx, phone from raw where phone is not null) p", "phone", "idx")} where e164 is not null
    union select distinct idx, 'github', {handle_key("handle")} from raw where {handle_key("handle")} is not null)"""

_ALL_IDS = f"select csv_row_id as idx from sample_csv union all select record_no + {_GAP} from output_default union all select profile_id + {2 * _GAP} from github_mock"


_LANGS = f"list_filter(list_transform(coalesce(repos, []), lambda r: {strip('r.repo_language')}), lambda x: x is not null and x <> '')"
_HOST_PLACE = ", ".join(f"{part} := case when coalesce(u.location, '') <> '' then {place(strip('u.location'), part)} else '' end" for part in ("city", "region", "country"))
#: Rows of the three tables in one form.
_RAW = f"""
  rows_of_all as (
    select csv_row_id as idx, 'recruiter_csv' as source, {text("name")} as full_name, [{text("email")}] as emails, [{text("phone")}] as phones, null as location, null as links, null as headline, null::double as years_experience, null as skills,
      case when {text("current_company")} <> '' or {text("title")} <> '' then [struct_pack(company := {text("current_company")}, title := {text("title")}, start_month := null::varchar, end_month := 'Present', summary := 'x')] end as experience, null as education, null::int as repository_count from sample_csv
    union all select record_no + {_GAP}, coalesce(provenance[1].source, 'unknown'), full_name, emails, phones, location, links, headline, years_experience, list_transform(skills, lambda x: struct_pack(name := x.name, confidence := x.confidence)), experience, education, repository_count from output_default
    union all select profile_id + {2 * _GAP}, 'github', case when coalesce(u.name, '') <> '' then {strip("u.name")} else coalesce(u.login, '') end, [{text("u.email")}], [], struct_pack({_HOST_PLACE}),
      struct_pack(linkedin := '', github := coalesce(u.html_url, 'https://github.com/' || coalesce(u.login, '')), portfolio := {text("u.blog")}, other := []::varchar[]), case when coalesce(u.bio, '') <> '' then u.bio end, null,
      list_transform(langs, lambda x: struct_pack(name := x, confidence := null::double)), null, null, coalesce(u.public_repos, len(coalesce(repos, []))) from (select profile_id, user_profile as u, repos, {_LANGS} as langs from github_mock where user_profile is not null) t)"""


def oracle_sql() -> dict[str, str]:
    lower_title = f"{text('current_company')} <> '' or {text('title')} <> ''"
    langs = f"list_filter(list_transform(coalesce(repos, []), lambda r: {strip('r.repo_language')}), lambda x: x is not null and x <> '')"
    jobs = "select component_id, weight, idx, unnest(experience) as x, unnest(range(len(experience))) as pos from ranked"
    edu = "select component_id, weight, idx, unnest(education) as x, unnest(range(len(education))) as pos from ranked"
    skills = "select component_id, weight, idx, source, unnest(skills) as x, unnest(range(len(skills))) as pos from ranked"
    order = "struct_pack(w := -weight, i := idx, p := pos)"
    return {
        "s1_sheet_records": f"""select csv_row_id as ingest_idx, 'recruiter_csv' as source, {text("name")} as full_name, nullif({text("email")}, '') as email, nullif({text("phone")}, '') as phone,
          case when {lower_title} then {text("current_company")} end as company, case when {lower_title} then {text("title")} end as title, case when {lower_title} then 'Present' end as job_end from sample_csv""",
        "s9_github_records": f"""select profile_id + {2 * _GAP} as ingest_idx, case when coalesce(u.name, '') <> '' then {strip("u.name")} else coalesce(u.login, '') end as full_name, nullif({text("u.email")}, '') as email,
          case when coalesce(u.location, '') <> '' then {place(strip("u.location"), "city")} else '' end as city, case when coalesce(u.location, '') <> '' then {place(strip("u.location"), "region")} else '' end as region,
          case when coalesce(u.location, '') <> '' then {place(strip("u.location"), "country")} else '' end as country, coalesce(u.html_url, 'https://github.com/' || coalesce(u.login, '')) as github, {text("u.blog")} as portfolio,
          case when coalesce(u.bio, '') <> '' then u.bio end as headline, array_to_string(list_filter(langs, lambda x, i: list_position(list_transform(langs, lambda y: lower(y)), lower(x)) = i), '|') as skills,
          coalesce(u.public_repos, len(coalesce(repos, []))) as repository_count from (select profile_id, user_profile as u, repos, {langs} as langs from github_mock where user_profile is not null) t""",
        "t1_emails": f"select doc_id, email from ({mails(_DOCS)}) m",
        "t2_phones": numbers(_TEXTS),
        "t3_links": rf"""select src, doc_id, coalesce(regexp_extract(text, '(?i)(?:https?://)?(?:www\.)?github\.com/[a-zA-Z0-9_-]+'), '') as github, coalesce(regexp_extract(text, '(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[a-zA-Z0-9_-]+'), '') as linkedin
          from (select 'd' as src, doc_id, text from {_DOCS} t union all select 'p', record_no, concat_ws(' ', replace(links.linkedin, 'example', 'com'), replace(lower(links.github), 'example', 'com')) from output_default) x""",
        "t4_names": f"select doc_id, coalesce({_LINES}[1], '') as full_name from {_DOCS} t",
        "t5_sections": f"with {sections(_DOCS)} select doc_id, heading, {joined('block')} as block from sections",
        "t6_skills": f"with {sections(_TEXTS)}, {skills_of()} select src, doc_id, (row_number() over (partition by src, doc_id order by i, j) - 1)::int as pos, skill from kept",
        "t7_locations": f"""select src, doc_id, {place('v', 'city')} as city, {place('v', 'region')} as region, {place('v', 'country')} as country from (
          select 'h' as src, profile_id as doc_id, {strip('user_profile.location')} as v from github_mock where user_profile.location <> ''
          union all select src, doc_id, {strip(f"regexp_extract(text, '{_STATED}', 1)")} from {_TEXTS} t where regexp_matches(text, '{_STATED}')) u""",
        "t8_places": f"""with {sections(_DOCS)}, {_EDU}, firsts as (select src, doc_id, institution from schooling where pos = 0),
          schools as (select record_no, concat_ws(', ', education[1].institution, location.city, location.country) as inst from output_default)
          select t.src, t.doc_id, {", ".join(f"case when regexp_matches(text, '{_STATED}') then {place(strip(f"regexp_extract(text, '{_STATED}', 1)"), part)} else {guessed('f.institution', part) if part != 'region' else "''"} end as {part}" for part in ("city", "region", "country"))}
          from {_DOCS} t left join firsts f on f.src = t.src and f.doc_id = t.doc_id where text <> ''
          union all select 'p', record_no, {guessed("inst", "city")}, '', {guessed("inst", "country")} from schools""",
        "t9_education": f"with {sections(_TEXTS)}, {_EDU} select * from schooling",
        "t10_projects": f"with {sections(_TEXTS)}, {_PROJECTS} select * from projects",
        "t11_headlines": f"with {sections(_DOCS)}, base as (select src, doc_id, {_LINES} as l from {_DOCS} t) select doc_id, headline from ({headline('base')}) h",
        "t12_resume_records": f"""with {sections(_TEXTS)}, {skills_of()}, {_EDU}, {_PROJECTS}, base as (select src, doc_id, text, {_LINES} as l from {_TEXTS} t where text <> ''), heads1 as ({headline('base')}),
          firsts as (select src, doc_id, institution from schooling where pos = 0),
          {", ".join(f"{name} as (select src, doc_id, count(*)::int as n from {rows} group by src, doc_id)" for name, rows in (("c1", f"({mails(_TEXTS)}) m"), ("c2", f"(select distinct * from ({numbers(_TEXTS)}) m) m"), ("c3", "kept"), ("c4", "projects"), ("c5", "schooling")))}
          select case when src = 'd' then doc_id else doc_id + {_GAP} end as ingest_idx, 'resume' as source, coalesce(l[1], '') as full_name, coalesce(c1.n, 0)::int as n_emails, coalesce(c2.n, 0)::int as n_phones,
          {", ".join(f"case when regexp_matches(text, '{_STATED}') then {place(strip(f"regexp_extract(text, '{_STATED}', 1)"), part)} else {guessed('f.institution', part)} end as {part}" for part in ("city", "country"))},
          headline, coalesce(c3.n, 0)::int as n_skills, coalesce(c4.n, 0)::int as n_jobs, coalesce(c5.n, 0)::int as n_education
          from base left join heads1 using (src, doc_id) left join firsts f using (src, doc_id) {" ".join(f"left join c{k} using (src, doc_id)" for k in range(1, 6))}""",
        "n1_phones": f"select csv_row_id, e164 as phone from {phone('sample_csv', 'phone', 'csv_row_id')} t",
        "n2_dates": f"select record_no, pos::int as pos, {date('x.start_month')} as start_month, {date('x.end_month')} as end_month from (select record_no, unnest(experience) as x, unnest(range(len(experience))) as pos from output_default) t",
        "n3_countries": f"select record_no, {country('location.country')} as country from output_default",
        "n4_skills": f"select record_no, pos::int as pos, {skill('x.name')} as skill from (select record_no, unnest(skills) as x, unnest(range(len(skills))) as pos from output_default) t",
        "n6_handles": f"select record_no, {github_handle('links.github')} as handle from output_default",
        "n8_ids": f"""select csv_row_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id
          from (select csv_row_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(lower({strip("email")}))) as h from sample_csv where lower({strip("email")}) <> '') t""",
        "j1_shared_identifiers": f"with {_KEYS} select kind, key, count(*) as n_records, min(idx) as first from keyed group by kind, key",
        "j2_components": f"""with recursive {_KEYS}, ids as ({_ALL_IDS}),
          edges as (select distinct a.idx as a, b.idx as b from keyed a join (select kind, key, min(idx) as idx from keyed group by kind, key) b on a.kind = b.kind and a.key = b.key),
          both_ways as (select a, b from edges union select b, a from edges),
          reach as (select idx as a, idx as b from ids union select r.a, e.b from reach r join both_ways e on r.b = e.a)
          select a as ingest_idx, min(b) as component_id from reach group by a""",
        "a1_scalars": f"""with {_TOWN} select component_id, arg_min(source, {_RK}) as primary, {first("full_name", "full_name <> ''")} as full_name, {first("source", "full_name <> ''")} as name_source, {first("headline", "headline <> ''")} as headline,
          {first("source", "headline <> ''")} as headline_source, {first("repository_count", "repository_count is not null")} as repository_count from ranked group by component_id""",
        "a2_emails": f"""with {_TOWN}, e as (select component_id, list_sort(list(distinct k)) as emails from (select component_id, unnest({_EMAILS}) as k from ranked) t group by component_id),
          p as (select component_id, list_sort(list(distinct e164)) as phones from {phone("(select component_id, unnest(phones) as phone from ranked) t", "phone", "component_id")} x where e164 is not null group by component_id)
          select component_id, {joined("emails")} as emails, emails[1] as first_email, {joined("phones")} as phones from e full join p using (component_id)""",
        "a3_places_and_links": f"""with {_TOWN}, others as (select component_id, v, min(struct_pack(w := -weight, i := idx, p := pos)) as seen from (select component_id, weight, idx, unnest(links.other) as v, unnest(range(len(links.other))) as pos from ranked) t where v <> '' group by component_id, v),
          o as (select component_id, list(v order by seen) as other from others group by component_id)
          select component_id, {", ".join(f"coalesce({first(x, f'coalesce({x}, $q$$q$) <> $q$$q$')}, '') as {n}" for n, x in (("city", text("location.city")), ("region", text("location.region")), ("country", country("location.country")), ("linkedin", text("links.linkedin")), ("github", text("links.github")), ("portfolio", text("links.portfolio"))))},
          coalesce(any_value({joined("other")}), '') as other from ranked left join o using (component_id) group by component_id""",
        "a5_experience": f"""with {_TOWN}, j as ({jobs}), k as (select *, row_number() over (partition by component_id, lower({text("x.company")}), lower({text("x.title")}) order by -weight, idx, pos) as rn from j where {text("x.company")} <> '')
          select component_id, (row_number() over (partition by component_id order by -weight, idx, pos) - 1)::int as pos, {text("x.company")} as company, {text("x.title")} as title, {date("x.start_month")} as start, {date("x.end_month")} as "end", {text("x.summary")} as summary from k where rn = 1""",
        "a6_education": f"""with {_TOWN}, j as ({edu}), k as (select *, row_number() over (partition by component_id, lower({text("x.institution")}), lower({text("x.degree")}) order by -weight, idx, pos) as rn from j where {text("x.institution")} <> '')
          select component_id, (row_number() over (partition by component_id order by -weight, idx, pos) - 1)::int as pos, {text("x.institution")} as institution, {text("x.degree")} as degree, {text("x.field")} as field, x.end_year as end_year from k where rn = 1""",
        "a7_skills": f"""with {_TOWN}, j as ({skills}), g as (select component_id, {skill("x.name")} as name, max(coalesce(x.confidence, weight)) as confidence, list_sort(list(distinct source)) as sources, min({order}) as seen from j group by component_id, {skill("x.name")})
          select component_id, (row_number() over (partition by component_id order by seen) - 1)::int as pos, name, confidence, {joined("sources")} as sources from g where name <> ''""",
        "a8_profiles": f"with {_TOWN}, {merged()} select component_id, years as years_experience, {joined('provenance')} as provenance, confidence as overall_confidence from m",
        "profile_pipeline": f"""with recursive {_KEYS}, {_RAW}, ids as (select idx from rows_of_all),
          edges as (select distinct a.idx as a, b.idx as b from keyed a join (select kind, key, min(idx) as idx from keyed group by kind, key) b on a.kind = b.kind and a.key = b.key),
          both_ways as (select a, b from edges union select b, a from edges),
          reach as (select idx as a, idx as b from ids union select r.a, e.b from reach r join both_ways e on r.b = e.a),
          comps as (select a as idx, min(b) as component_id from reach group by a),
          ranked as (select r.*, component_id, {weight("source")} as weight from rows_of_all r join comps using (idx)), {merged()}
          select component_id, coalesce(full_name, '') as full_name, {joined('emails')} as emails, {joined('phones')} as phones, country, n_jobs::int as n_jobs, n_skills::int as n_skills, repository_count, confidence as overall_confidence from m""",
        "project_projection": f"""select full_name, emails[1] as primary_email, p.e164 as phone, {joined("case when len(skills) > 0 then list_transform(skills, lambda s: " + skill("s.name") + ") end")} as skills, coalesce(overall_confidence, 0.0) as overall_confidence
          from output_default o left join {phone("(select record_no, phones[1] as phone from output_default) t", "phone", "record_no")} p using (record_no) where full_name <> '' and emails[1] <> ''""",
        "project_required_missing": "select candidate_id, full_name, '''' || case when coalesce(full_name, '') = '' then 'full_name' else 'primary_email' end || ''' is required and missing' as reason from output_default where coalesce(full_name, '') = '' or coalesce(emails[1], '') = ''",
        "project_metadata": """select nullif(candidate_id, '') as candidate_id, nullif(headline, '') as headline, len(list_filter(coalesce(provenance, []), lambda p: p.field in ('candidate_id', 'headline', 'skills_named')))::int as n_provenance,
          coalesce(len(skills), 0)::int as n_skills from output_default where coalesce(len(list_filter(skills, lambda s: s.name is null)), 0) = 0""",
        "u1_sources": f"""select source, count(*) as n_records, min(idx) as first from (select 'recruiter_csv' as source, csv_row_id as idx from sample_csv
          union all select coalesce(provenance[1].source, 'unknown'), record_no + {_GAP} from output_default union all select 'github', profile_id + {2 * _GAP} from github_mock where user_profile is not null) t group by source""",
        "j4_enrichment": f"""with wanted as (select distinct {handle_key("links.github")} as handle from output_default),
          seen as (select lower(user_profile.login) as handle from github_mock where user_profile.public_repos = 0),
          cand as (select unnest(list_distinct([lower(user_profile.login), {handle_key("user_profile.html_url")}])) as handle, lower(user_profile.login) as login, user_profile as u, repos, profile_id from github_mock),
          best as (select *, row_number() over (partition by handle order by (login <> handle), profile_id) as rn from cand where handle <> '')
          select case when coalesce(u.name, '') <> '' then {strip("u.name")} else coalesce(u.login, '') end as full_name, coalesce(u.html_url, 'https://github.com/' || u.login) as github, coalesce(u.public_repos, len(coalesce(repos, []))) as repository_count
          from best join wanted using (handle) where rn = 1 and handle not in (select handle from seen where handle is not null)""",
        "u5_wanted_handles": f"""select handle, min(record_no) + {_GAP} as first from (select record_no, {handle_key("links.github")} as handle from output_default) t
          where handle is not null and handle not in (select lower(user_profile.login) from github_mock where user_profile.login is not null) group by handle""",
    }
