"""DuckDB SQL of the longer oracles: trigram blocks, a plain longest common subsequence, the pair score, the resolver."""

from __future__ import annotations

#: Distinct trigrams of the words of `{n}`, padded with two spaces in front and one behind.
GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({n}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def blocks(probes: str, targets: str, floor: float = 0.3, top: int = 25) -> str:
    """(q, scope, target) of the first `top` targets (target, name, country) of each distinct probe (q, scope)."""
    return f"""(with pr as (select distinct q, scope from ({probes}) p where q <> ''), ta as (select * from ({targets}) t),
 gq as (select q, unnest({GRAMS.format(n='q')}) as g from (select distinct q from pr) x), gt as (select name, unnest({GRAMS.format(n='name')}) as g from (select distinct name from ta) x),
 nq as (select q, count(*) as n from gq group by q), nt as (select name, count(*) as n from gt group by name),
 o as (select q, name, count(*) as c from gq join gt using (g) group by all),
 s as (select o.q, o.name, c / cast(nq.n + nt.n - c as double) as sim from o join nq using (q) join nt using (name)),
 r as (select pr.q, pr.scope, ta.target, row_number() over (partition by pr.q, pr.scope order by sim desc, ta.target) as rank from pr join s using (q) join ta using (name) where sim >= {floor} and (pr.scope is null or pr.scope = ta.country))
 select q, scope, target from r where rank <= {top})"""


def subsequences(pairs: str) -> str:
    """(x, y, n): the length of the longest common subsequence of each distinct pair, by the plain table of prefixes."""
    hits = "list_transform(string_split(y, ''), lambda c: list_transform(string_split(x, ''), lambda d: case when c = d then 1 else 0 end))"
    row = "list_transform(range(1, len(m) + 1), lambda j: greatest(r[j], list_max(list_transform(range(1, j + 1), lambda i: m[i] * (coalesce(r[i - 1], 0) + 1)))))"
    start = "[list_transform(string_split(x, ''), lambda d: 0)]"
    return f"(select x, y, case when x = '' or y = '' then 0 else list_max(list_reduce(list_concat({start}, {hits}), lambda r, m: {row})) end as n from (select distinct x, y from ({pairs}) u) v)"


def scores(pairs: str) -> str:
    """(q, c, score, method) of distinct pairs of normalised names."""
    join = lambda of: f"array_to_string(list_sort(list_distinct({of})), ' ')"
    windows = lambda x, y: f"unnest(list_distinct(list_transform(range(1 - least(length({x}), length({y})), greatest(length({x}), length({y}))), lambda i: substr(case when length({x}) <= length({y}) then {y} else {x} end, greatest(0, i) + 1, least(i, 0) + least(length({x}), length({y}))))))"
    short = lambda x, y: f"case when length({x}) <= length({y}) then {x} else {y} end"
    ratio = lambda n, x, y: f"200.0 * {n} / (length({x}) + length({y}))"
    return f"""(with d as (select distinct q, c, string_split(q, ' ') as wq, string_split(c, ' ') as wc from ({pairs}) p where q <> '' and c <> ''),
 t as materialized (select *, array_to_string(list_sort(wq), ' ') as sq, array_to_string(list_sort(wc), ' ') as sc, {join('list_filter(wq, lambda w: list_contains(wc, w))')} as same,
  {join('list_filter(wq, lambda w: not list_contains(wc, w))')} as oq, {join('list_filter(wc, lambda w: not list_contains(wq, w))')} as oc, greatest(length(q), length(c)) / least(length(q), length(c)) as far from d),
 e as materialized (select *, trim(same || ' ' || oq) as aq, trim(same || ' ' || oc) as ac from t),
 w as materialized (select q, c, 1 as k, {short('q', 'c')} as x, {windows('q', 'c')} as y from e where far >= 1.5
  union all select q, c, 2, {short('sq', 'sc')}, {windows('sq', 'sc')} from e where far >= 1.5
  union all select q, c, 3, {short('oq', 'oc')}, {windows('oq', 'oc')} from e where far >= 1.5 and same = '' and oq <> '' and oc <> ''),
 l as materialized {subsequences('select q as x, c as y from e union all select sq, sc from e union all select aq, ac from e union all select x, y from w')},
 p as (select q, c, k, max({ratio('l.n', 'w.x', 'w.y')}) as best from w join l using (x, y) group by all),
 f as (select e.*, {ratio('a.n', 'q', 'c')} as whole, {ratio('b.n', 'sq', 'sc')} as by_sort,
  case when same <> '' and (oq = '' or oc = '') then 100.0 else greatest({ratio('z.n', 'aq', 'ac')}, case when same <> '' then greatest({ratio('length(same)', 'same', 'aq')}, {ratio('length(same)', 'same', 'ac')}) else 0 end) end as by_set
  from e join l a on a.x = q and a.y = c join l b on b.x = sq and b.y = sc join l z on z.x = aq and z.y = ac),
 g as (select f.*, case when far < 1.5 then greatest(whole, 0.95 * greatest(by_set, by_sort)) else greatest(whole, (case when far <= 8 then 0.9 else 0.6 end) * coalesce(p1.best, 0),
  0.95 * (case when far <= 8 then 0.9 else 0.6 end) * greatest(coalesce(p2.best, 0), case when same <> '' then 100 else coalesce(p3.best, 0) end)) end as weighted
  from f left join p p1 on (p1.q, p1.c, p1.k) = (f.q, f.c, 1) left join p p2 on (p2.q, p2.c, p2.k) = (f.q, f.c, 2) left join p p3 on (p3.q, p3.c, p3.k) = (f.q, f.c, 3)),
 h as (select *, len(wq) <> len(wc) and wq[1:least(len(wq), len(wc))] = wc[1:least(len(wq), len(wc))] as prefix,
  (length(q) >= 2 and len(wc) > 1 and replace(q, ' ', '') = array_to_string(list_transform(wc, lambda w: w[1]), '')) or (length(c) >= 2 and len(wq) > 1 and replace(c, ' ', '') = array_to_string(list_transform(wq, lambda w: w[1]), '')) as short from g),
 i as (select *, 0.45 * greatest(by_set, weighted) / 100 + 0.55 * by_sort / 100 + case when prefix then 0.1 else 0 end as blend from h)
 select q, c, case when q = c then 1.0 else cast(least(case when short then greatest(blend, 0.86) else blend end, 0.94) as double) end as score,
  case when q = c then 'exact_normalized' when short then 'acronym' when prefix then 'token_prefix' else 'fuzzy' end as method from i)"""


def candidates(queries: str, companies: str, aliases: str, domains: str) -> str:
    """(query_id, q, scope, company_id): what a query (query_id, name, q, scope, domain) may be."""
    own = f"select company_id as target, normalized_name as name, country from ({companies}) c"
    other = f"select {{'company_id': a.company_id, 'alias': normalized_alias}} as target, normalized_alias as name, c.country from ({aliases}) a join ({companies}) c using (company_id)"
    return f"""(with u as (select * from ({queries}) q where q <> ''), n as (select q, scope, target as company_id from {blocks(queries, own)} x union select q, scope, target.company_id from {blocks(queries, other)} x)
 select query_id, u.q, u.scope, company_id from u join n on n.q = u.q and n.scope is not distinct from u.scope
 union select query_id, q, scope, d.company_id from u join ({domains}) d on d.domain = u.domain join ({companies}) c on c.company_id = d.company_id where scope is null or scope = c.country)"""


def resolved(queries: str, companies: str, aliases: str, domains: str, marks: str) -> str:
    """A row per query with a match. `marks` tells from `normalized` whether a name is an intermediary's."""
    staffing = lambda c: "(" + marks.replace("normalized", c) + ")"
    return f"""(with u as materialized (select * from ({queries}) q where q <> ''), k as materialized (select * from {candidates(queries, companies, aliases, domains)} x),
 m as (select company_id, 0 as place, canonical_name as name, normalized_name as c from ({companies}) c union all select company_id, 1, alias, normalized_alias from ({aliases}) a),
 r as materialized (select k.query_id, k.q, m.* from k join m using (company_id)),
 s as materialized (select * from {scores('select q, c from r')} x),
 o as (select query_id, min(d.company_id) as owner from u join ({domains}) d on d.domain = u.domain join ({companies}) c on c.company_id = d.company_id where scope is null or scope = c.country group by 1),
 b as (select query_id, company_id, name, score, method from (select r.*, s.score, s.method, row_number() over (partition by query_id order by s.score desc, r.company_id, place, name) as k from r join s using (q, c) where s.score >= 0.70) x where k = 1),
 t as (select u.query_id, u.q, coalesce(owner, b.company_id) as company_id, case when owner is not null then 1.0 else score end as score, case when owner is not null then 'domain' else method end as method, owner, b.name from u left join o using (query_id) left join b using (query_id) where owner is not null or b.company_id is not null),
 z as (select t.*, canonical_name, normalized_name, case when owner is not null then canonical_name else name end as matched_name, case when t.score >= 0.95 then 'high' when t.score >= 0.85 then 'probable' else 'possible' end as confidence from t join ({companies}) c using (company_id))
 select query_id, company_id, matched_name, cast(round(score, 4) as double) as score, method, confidence,
  concat_ws(',', case when {staffing('normalized_name')} or {staffing('q')} then 'staffing_agency' end, case when lower(matched_name) <> lower(canonical_name) then 'matched_via_alias' end, case when confidence = 'possible' then 'low_confidence' end) as warnings from z)"""


def clauses(postings: str) -> str:
    """(posting_id, sentence_no, clause_no, clause, interrogative) of (posting_id, text)."""
    return f"""(with s as (select posting_id, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') as ss from ({postings}) p),
 t as (select posting_id, generate_subscripts(ss, 1) - 1 as sentence_no, trim(unnest(ss)) as s from s),
 c as (select posting_id, sentence_no, ends_with(s, '?') as interrogative, string_split_regex(s, '(?i);|,\\s+(?:but|however|although|though|whereas|while)\\b') as cs from t where s <> ''),
 d as (select posting_id, sentence_no, interrogative, generate_subscripts(cs, 1) - 1 as clause_no, trim(unnest(cs)) as clause from c)
 select posting_id, cast(sentence_no as int) as sentence_no, cast(clause_no as int) as clause_no, clause, interrogative from d where length(clause) >= 3)"""


def constructions(clauses_sql: str, tables: list[tuple[int, dict[str, str]]]) -> str:
    """(posting_id, sentence_no, clause_no, clause, k, cue, polarity, weight) of whole constructions."""
    quoted = lambda t: t.replace("'", "''")
    rows, k = [], 0
    for sign, table in tables:
        for name, pattern in table.items():
            k += 1
            # this engine has no look-ahead: what may not follow is made unlike the pattern first
            head, ahead, tail = pattern.partition("(?!")
            text = "clause" if not ahead else f"regexp_replace(clause, '(sponsors?)({quoted(tail[:-1])})', '\\1x\\2', 'gi')"
            rows.append(f"select *, {k} as k, 'hard:{name}' as cue, {sign} as polarity, 4 as weight from c where regexp_matches({text}, '(?i){quoted(head)}')")
    return f"(with c as (select posting_id, sentence_no, clause_no, clause from {clauses_sql} x where not interrogative) " + " union all ".join(rows) + ")"


def anchors(clauses_sql: str, ordered: list[tuple[list[str], int, int]], token: str, negations: set[str], barriers: set[str], window: int, first: int) -> str:
    """(posting_id, sentence_no, clause_no, clause, k, cue, polarity, weight) of anchors with their negations."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    listed = ", ".join(f"({i}, {len(a)}, [{', '.join(map(quoted, a))}], {w}, {s})" for i, (a, w, s) in enumerate(ordered))
    no, bar = (f"[{', '.join(sorted(map(quoted, x)))}]" for x in (negations, barriers))
    near = lambda part: f"list_bool_or(list_transform(range(1, len({part}) + 1), lambda i: list_contains({no}, replace(({part})[i], '’', chr(39))) and not list_has_any(({part})[1:i], {bar})))"
    same = "(o.posting_id, o.sentence_no, o.clause_no) = (m.posting_id, m.sentence_no, m.clause_no)"
    overlaps = "o.pos < m.pos + m.n and m.pos < o.pos + o.n"
    free = lambda n: f"not exists (select 1 from kept{n} o where {same} and {overlaps})"
    # of two words each: the earlier in order wins
    earlier = f"not exists (select 1 from m o where o.n = 2 and {same} and o.k < m.k and {overlaps})"
    return f"""(with c as materialized (select posting_id, sentence_no, clause_no, clause, regexp_extract_all(lower(clause), {quoted(token)}) as w from {clauses_sql} x where not interrogative),
 a(k, n, ws, weight, sign) as (values {listed}), i as (select *, unnest(range(1, len(w) + 1)) as pos from c),
 m as materialized (select i.*, a.k, a.n, a.ws, a.weight, a.sign from i join a on i.w[pos:pos + n - 1] = a.ws),
 kept3 as materialized (select * from m where n = 3), kept2 as materialized (select * from m where n = 2 and {free(3)} and {earlier} union all select * from kept3), kept1 as (select * from m where n = 1 and {free(2)} union all select * from kept2),
 f as (select *, coalesce({near(f'list_reverse(w[greatest(1, pos - {window}):pos - 1])')}, false) or coalesce({near(f'w[pos + n:pos + n + {window - 1}]')}, false) as flip from kept1)
 select posting_id, sentence_no, clause_no, clause, cast({first} - 1 + row_number() over (partition by posting_id, sentence_no, clause_no order by k, pos) as int) as k, array_to_string(ws, '-') || case when flip then ':negated' else '' end as cue, case when flip then -sign else sign end as polarity, weight from f)"""


def signals(postings: str, hits: str) -> str:
    """(posting_id, polarity, weight, evidence, cues), lists joined."""
    return f"""(with h as materialized (select distinct posting_id, sentence_no, clause_no, k, clause, cue, polarity, weight from {hits} x),
 t as (select posting_id, max(weight) as weight from h group by 1), g as (select h.posting_id, t.weight, case when min(polarity) < 0 then -1 else 1 end as sign from h join t on t.posting_id = h.posting_id and t.weight = h.weight group by 1, 2),
 e as (select h.posting_id, h.clause, min((sentence_no, clause_no, k)) as o from h join g on g.posting_id = h.posting_id and h.polarity = g.sign group by 1, 2), u as (select h.posting_id, h.cue, min((sentence_no, clause_no, k)) as o from h join g on g.posting_id = h.posting_id and h.polarity = g.sign group by 1, 2),
 ee as (select posting_id, array_to_string((list(clause order by o))[1:3], ' / ') as evidence from e group by 1), uu as (select posting_id, string_agg(cue, ',' order by o) as cues from u group by 1)
 select p.posting_id, case g.sign when -1 then 'negative' when 1 then 'positive' else 'none' end as polarity, coalesce(g.weight, 0) as weight, coalesce(evidence, '') as evidence, coalesce(cues, '') as cues
 from (select distinct posting_id from ({postings}) p) p left join g using (posting_id) left join ee using (posting_id) left join uu using (posting_id))"""


def sections(postings: str, heading: str, title: str, bullet: str) -> str:
    """(posting_id, line_no, line, in_requirements): a heading opens the section, a short title closes it."""
    return f"""(with l as (select posting_id, cast(generate_subscripts(str_split(text, chr(10)), 1) - 1 as int) as line_no, trim(unnest(str_split(text, chr(10)))) as line from ({postings}) p),
 e as (select *, case when regexp_matches(line, '{heading}') then true when regexp_matches(line, '{title}') and not regexp_matches(line, '{bullet}') then false end as ev from l where line <> '')
 select posting_id, line_no, line, coalesce(last_value(ev ignore nulls) over (partition by posting_id order by line_no rows unbounded preceding), false) as in_requirements from e)"""


def keywords(sections_sql: str, coverage, bullet: str, lexicon: list[str]) -> str:
    """(posting_id, term, occurrences, in_requirements, evidence, weight, rank) by the plain way: every term in every line."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    listed = lambda words: "[" + ", ".join(map(quoted, words)) + "]"
    none, fragments = listed(coverage._NONE), listed(coverage.FRAGMENTS)
    tokens = lambda x: f"list_filter(list_transform(regexp_extract_all(lower({x}), {quoted(coverage.TOKEN)}), lambda t: regexp_replace(regexp_replace(t, {quoted(coverage.TAIL)}, ''), {quoted(coverage.EDGES)}, '', 'g')), lambda t: length(t) >= 2 and not list_contains({fragments}, t))"
    pairs = lambda ws: f"flatten(list_transform(range(1, len({ws}) + 1), lambda i: case when list_contains({none}, ({ws})[i]) then [] when i = len({ws}) or list_contains({none}, ({ws})[i + 1]) then [({ws})[i]] else [({ws})[i], ({ws})[i] || ' ' || ({ws})[i + 1]] end))"
    frames = " union all ".join(f"select posting_id, line_no, in_requirements, {k} as frame, generate_subscripts(m, 1) as nth, unnest(m) as piece from (select *, regexp_extract_all(line, {quoted(f)}, 1) as m from l) x" for k, f in enumerate(coverage.FRAMES))
    known = f"list_filter({listed(sorted(set(lexicon)))}, lambda t: instr(lower(line), t) > 0 and not regexp_matches(case when instr(lower(line), t) > 1 then substr(lower(line), instr(lower(line), t) - 1, 1) else '' end, '[a-z0-9]') and not regexp_matches(substr(lower(line), instr(lower(line), t) + length(t), 1), '[a-z0-9]'))"
    return f"""(with l as materialized (select * from {sections_sql} s),
 f as (select *, {tokens('piece')} as ws from ({frames}) z), g as (select posting_id, line_no, in_requirements, frame, nth, {pairs('ws')} as ps from f),
 b as (select posting_id, line_no, in_requirements, {tokens('line')} as ws from l where in_requirements and regexp_matches(line, '{bullet}')), c as (select posting_id, line_no, in_requirements, list_filter({pairs('ws')}, lambda p: contains(p, ' ')) as ps from b),
 r as (select posting_id, line_no, in_requirements, unnest({known}) as term, 3 as base, 'lexicon' as name, 0 as frame, 0 as nth, 0 as pos from l
  union all select posting_id, line_no, in_requirements, unnest(ps), 2, 'frame', frame + 1, nth, generate_subscripts(ps, 1) from g union all select posting_id, line_no, in_requirements, unnest(ps), 2, 'bullet_phrase', 99, 0, generate_subscripts(ps, 1) from c),
 k as (select * from r where length(term) >= 2 and len(list_filter(string_split(term, ' '), lambda w: list_contains({none}, w))) = 0),
 d as (select posting_id, term, count(*) as occurrences, bool_or(in_requirements) as in_requirements, first(name order by base desc, line_no, frame, nth, pos) as evidence, max(base) as base from k group by 1, 2),
 w as (select *, cast(base * least(occurrences, {coverage.MOST}) * case when in_requirements then 2 else 1 end as bigint) as weight from d), o as (select *, row_number() over (partition by posting_id order by weight desc, term) as rank from w)
 select posting_id, term, occurrences, in_requirements, evidence, weight, rank from o where rank <= {coverage.LIMIT})"""


def covered(postings: str, resumes: str, keywords_sql: str, coverage) -> str:
    """A row for each posting and the resume of its id."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    fragments = "[" + ", ".join(map(quoted, coverage.FRAGMENTS)) + "]"
    share = lambda w: f"case when total_weight = 0 then 0 else cast(floor(({w}) / total_weight * 100 + 0.5) as int) end"
    return f"""(with t as materialized (select * from {keywords_sql} k),
 u as (select resume_id, lower(coalesce(text, '')) as raw, list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), {quoted(coverage.TOKEN)}), lambda t: regexp_replace(regexp_replace(t, {quoted(coverage.TAIL)}, ''), {quoted(coverage.EDGES)}, '', 'g')), lambda t: length(t) >= 2 and not list_contains({fragments}, t)) as ws from ({resumes}) r),
 h as (select t.*, coalesce(case when contains(term, ' ') then contains(raw, term) or list_contains(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), term) else list_contains(ws, term) end, false) as hit from t left join u on u.resume_id = t.posting_id),
 m as (select *, row_number() over (partition by posting_id, hit order by rank) as k from h),
 s as (select posting_id, sum(weight) as total_weight, coalesce(sum(weight) filter (where hit), 0) as matched_weight, count(*) as total_terms, count(*) filter (where hit) as matched_terms, coalesce(string_agg(term, ',' order by rank) filter (where hit), '') as matched, coalesce(string_agg(term, ',' order by rank) filter (where not hit), '') as missing,
  coalesce(sum(weight) filter (where not hit and k <= {coverage.SUGGESTED}), 0) as more, max(term) filter (where not hit and k = 1) as best, max(weight) filter (where not hit and k = 1) as best_weight from m group by 1),
 v as (select p.posting_id, coalesce(total_weight, 0) as total_weight, coalesce(matched_weight, 0) as matched_weight, coalesce(total_terms, 0) as total_terms, coalesce(matched_terms, 0) as matched_terms, coalesce(matched, '') as matched, coalesce(missing, '') as missing, coalesce(more, 0) as more, best, best_weight from ({postings}) p left join s using (posting_id)),
 x as (select *, {share('matched_weight')} as score, {share('matched_weight + more')} as projected_with_all, {share('matched_weight + best_weight')} as alone from v)
 select posting_id, posting_id as resume_id, score, case when score >= {coverage.STRONG} then 'strong' when score >= {coverage.MODERATE} then 'moderate' else 'weak' end as band, matched, missing, total_terms, matched_terms, cast(total_weight as bigint) as total_weight, cast(matched_weight as bigint) as matched_weight, projected_with_all,
 case when total_terms < {coverage.FEW} then 'This posting does not name enough specific skills to score reliably.' else 'Your resume covers ' || matched_terms || ' of the ' || total_terms || ' skills this posting asks for (' || score || '%).' || case when best is not null then ' Adding “' || best || '” alone would take it to ' || alone || '%.' else '' end || ' This models common keyword screening, not any specific employer’s system.' end as summary from x)"""
