"""Named queries over the driver's tables, and DuckDB SQL for each that SQL can express.

Registers of employers do not exist among the tables, so names, facts, postings and locations are built from them by
rules on their keys. Those rules are the SQL strings in capitals below, which both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .functions import links, names, places, skills
from .functions.similarity import score_pairs, trigrams
from .operators import coverage, facts, fit, gates, history, phrases, resolve, store
from .operators.spread import spread
from .sources import pages, registers
from .streaming import caches, usage

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

NAMES = """select c_custkey as id, case c_custkey % 8 when 0 then concat('A.B. ', p_name, ' Inc.') when 1 then concat('  ', p_name, ' & Sons  Ltd')
 when 2 then concat('Société ', p_name, ' S.A.') when 3 then concat(p_name, ' | Careers') when 4 then concat(upper(p_name), ' GmbH & Co. KG')
 when 5 then concat(p_name, ' Holdings Group') when 6 then concat('The ', p_name, ' Staffing, Inc') else p_name end as name
 from customer join part on p_partkey = c_custkey % 200"""
COMPANIES = """select s_suppkey as company_id, concat(p_name, case s_suppkey % 5 when 0 then ' Inc.' when 1 then ' LLC' when 2 then ', Ltd' when 3 then ' works plc' else ' Staffing' end) as canonical_name,
 concat(p_name, case s_suppkey % 5 when 3 then ' works' when 4 then ' staffing' else '' end) as normalized_name,
 case s_nationkey % 3 when 0 then 'US' when 1 then 'GB' else 'CA' end as country from supplier join part on p_partkey = s_suppkey"""
QUERIES = """select c_custkey as query_id, case c_custkey % 4 when 0 then p_name when 1 then concat(p_name, ' Limited') when 2 then concat(substr(p_name, 2), ' corp') else concat('zq', c_custkey) end as name,
 case c_custkey % 4 when 0 then 'US' when 1 then 'DE' else null end as country, case when c_custkey % 10 = 0 then concat('https://www.s', c_custkey % 100, '.example.com/jobs') else null end as domain
 from customer join part on p_partkey = c_custkey % 200"""
STATS = """select l_suppkey as company_id, case s_nationkey % 3 when 0 then 'US' when 1 then 'GB' else 'CA' end as country, cast(year(l_shipdate) as int) as year, l_quantity, l_extendedprice,
 l_returnflag as source_id, cast(l_shipdate as date) as published_date from lineitem join supplier on s_suppkey = l_suppkey"""
LONG = f"""select company_id, country, year, 'approvals' as metric, cast(l_quantity as decimal(14,2)) as value, source_id, published_date from ({STATS}) a
 union all select company_id, country, year, 'amount' as metric, cast(l_extendedprice as decimal(14,2)) as value, source_id, published_date from ({STATS}) b"""
POSTINGS = """select p_partkey as posting_id, concat(case p_partkey % 7 when 0 then 'We are happy to sponsor visas for this role.' when 1 then 'Unfortunately, we do not offer visa sponsorship, but relocation support exists.'
 when 2 then 'Do you need sponsorship? Tell us.' when 3 then 'Must be a US citizen; security clearance required.' when 4 then 'Relocation package available.' when 5 then 'Right to work is not required, as we arrange a work permit.' else 'Build things with us.' end,
 chr(10), 'Requirements', chr(10), '- Python and ', p_name, chr(10), 'About The Team', chr(10), 'We ship ', p_name, '.') as text from part"""
LOCATIONS = """select c_custkey as id, case c_custkey % 9 when 0 then 'Austin, TX' when 1 then 'Toronto, ON' when 2 then 'London, United Kingdom' when 3 then 'Berlin, Germany' when 4 then 'Remote' when 5 then 'USA'
 when 6 then 'Dublin, Ireland' when 7 then 'Sydney Australia' else 'Montreal, QC, Canada' end as location from customer"""
URLS = """select page_id, concat('https://www.linkedin.com', case page_id % 5 when 0 then concat('/jobs/view/', page_id) when 1 then concat('/jobs/search/?currentJobId=', page_id) when 2 then concat('/company/firm-', page_id, '/')
 when 3 then '/feed/' else concat('/company/firm-', page_id, '/jobs/') end) as url from pages"""


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for t in TABLES:
        if t in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


REGISTRY: dict = {}
ORACLES: dict[str, str] = {}


def query(base: str, oracle: str | None = None):
    """Registers a function of the rows of `base` as a query of its name."""

    def wrap(f):
        REGISTRY[f.__name__] = lambda spark, sf_dir: f(sql(spark, sf_dir, base), lambda text: sql(spark, sf_dir, text))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return wrap


_ALTERNATIVES = "|".join(sorted(names.SUFFIXES, key=lambda s: (-s.count(" "), s)))
_SPACED = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(name, '(?i)\s*[|\-–—]\s*(careers?|jobs?|hiring|we['' ]?re hiring|official)\s*$', ''))), '\s*&\s*', ' and ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
NORM = rf"""with w as (select id, generate_subscripts(str_split({_SPACED}, ' '), 1) as pos, unnest(str_split({_SPACED}, ' ')) as tok from ({NAMES}) n),
 g as (select *, length(tok) = 1 as one, pos - row_number() over (partition by id, length(tok) = 1 order by pos) as grp from w),
 j as (select id, min(pos) as pos, string_agg(tok, case when one then '' else ' ' end order by pos) as part from g group by id, one, grp),
 m as (select id, string_agg(part, ' ' order by pos) as joined from j group by id)
 select id, regexp_replace(joined, '^(\S+(?:\s\S+)*?)(?:\s(?:{_ALTERNATIVES}))+$', '\1') as normalized from m"""
_MARKS = " or ".join(f"contains(normalized, '{m}')" for m in names.STAFFING)


@query(NAMES, NORM.replace("string_agg(tok, case when one then '' else ' ' end order by pos)", "case when one then string_agg(tok, '' order by pos) else string_agg(tok, ' ' order by pos) end"))
def normalize_names(rows, _):
    return spread(rows).select("id", names.normalize(F.col("name")).alias("normalized"))


@query(f"select id, lower(name) as name from ({NAMES}) n", f"select id, regexp_replace(lower(name), '^(\\S+(?:\\s\\S+)*?)(?:\\s(?:{_ALTERNATIVES}))+$', '\\1') as stripped from ({NAMES}) n")
def strip_suffixes(rows, _):
    return rows.select("id", names.strip_suffixes(F.col("name")).alias("stripped"))


@query(NAMES, f"select id, case when len(str_split(normalized, ' ')) >= 2 then array_to_string(list_transform(str_split(normalized, ' '), lambda t: t[1]), '') else '' end as acronym from ({ORACLES['normalize_names']}) z")
def acronyms(rows, _):
    return spread(rows).select("id", names.acronym(names.normalize(F.col("name"))).alias("acronym"))


@query(NAMES, f"select id, ({_MARKS}) as staffing from ({ORACLES['normalize_names']}) z")
def staffing_flags(rows, _):
    return spread(rows).select("id", names.is_staffing(names.normalize(F.col("name"))).alias("staffing"))


@query("select page_id, url from pages", r"select page_id, nullif(str_split(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://', ''), '^www\.', ''), '/')[1], '') as domain from pages")
def clean_domains(rows, _):
    return rows.select("page_id", names.clean_domain(F.col("url")).alias("domain"))


@query("select p_partkey, replace(p_name, ' ', '-') as slug from part", "select p_partkey, array_to_string(list_transform(str_split(p_name, ' '), lambda w: concat(upper(w[1]), substr(w, 2))), ' ') as name from part")
def deslugify(rows, _):
    return rows.select("p_partkey", names.deslugify(F.col("slug")).alias("name"))


@query("select p_partkey, case p_partkey % 9 when 0 then '1,234' when 1 then ' 7 ' when 2 then '-' when 3 then 'N/A' when 4 then '' when 5 then '3.9' when 6 then '-2.5' when 7 then 'nan' else null end as cell from part",
       "select p_partkey, cast(case p_partkey % 9 when 0 then 1234 when 1 then 7 when 5 then 3 when 6 then -2 else 0 end as bigint) as value from part")
def to_int_cells(rows, _):
    return rows.select("p_partkey", names.to_int(F.col("cell")).alias("value"))


_GRAMS = "(select {k} as k, unnest(list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({n}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))) as g from ({t}) t)"


def _jaccard(q: str, qk: str, t: str, tk: str, floor: float, top: int | None) -> str:
    a, b = _GRAMS.format(k=qk, n="name", t=q), _GRAMS.format(k=tk, n="name", t=t)
    ranked = f"""with a as {a}, b as {b}, na as (select k, count(*) as n from a group by k), nb as (select k, count(*) as n from b group by k),
 o as (select a.k as query_id, b.k as target_id, count(*) as c from a join b on a.g = b.g group by all),
 s as (select query_id, target_id, c / cast(na.n + nb.n - c as double) as similarity from o join na on na.k = query_id join nb on nb.k = target_id)
 select query_id, target_id, similarity, cast(row_number() over (partition by query_id order by similarity desc, target_id) as int) as rank from s where similarity >= {floor}"""
    return f"select * from ({ranked}) r where rank <= {top}" if top else ranked


_PROBES = "select distinct c_custkey as query_id, concat(p_name, ' ', substr(p_name, 2, 4)) as name from customer join part on p_partkey = c_custkey % 200"
_TARGETS = "select company_id as target_id, normalized_name as name from (" + COMPANIES + ") c"


@query(_PROBES, _jaccard(_PROBES, "query_id", _TARGETS, "target_id", 0.3, 25))
def trigram_block_topk(rows, read):
    return resolve.trigram_matches(rows, read(_TARGETS))


@query(_PROBES, _jaccard(_PROBES, "query_id", _TARGETS, "target_id", 0.6, None))
def trigram_similarity(rows, read):
    return resolve.trigram_matches(rows, read(_TARGETS), floor=0.6, top=None)


ALIASES = "select company_id, concat(canonical_name, ' trading') as alias, concat(normalized_name, ' trading') as normalized_alias from (" + COMPANIES + ") c where company_id % 6 = 0"
DOMAINS = "select company_id, concat('s', company_id, '.example.com') as domain from (" + COMPANIES + ") c where company_id % 10 = 0"


ASKED = f"""select query_id, name, regexp_replace(lower(name), ' (limited|corp)$', '') as q, case when upper(country) in ('US', 'GB', 'CA') then upper(country) end as scope,
 nullif(str_split(regexp_replace(regexp_replace(lower(trim(domain)), '^[a-z][a-z0-9+.\\-]*://', ''), '^www\\.', ''), '/')[1], '') as domain from ({QUERIES}) z"""
_MATCHES = oracles.resolved(ASKED, COMPANIES, ALIASES, DOMAINS, _MARKS)


@query(QUERIES, f"select query_id, company_id from {oracles.candidates(ASKED, COMPANIES, ALIASES, DOMAINS)} x")
def candidate_union(rows, read):
    return resolve.candidates(rows, read(COMPANIES), read(ALIASES), read(DOMAINS))


@query(QUERIES, f"select * from {_MATCHES} x")
def resolve_full(rows, read):
    return resolve.resolve(rows, read(COMPANIES), read(ALIASES), read(DOMAINS)).withColumn("warnings", F.array_join("warnings", ","))


_SCORED = f"select distinct q.q, c.normalized_name as c from ({ASKED}) q join ({COMPANIES}) c on substr(q.q, 1, 3) = substr(c.normalized_name, 1, 3) where q.q <> ''"

@query(QUERIES, f"select q, c, round(score, 6) as score, method from {oracles.scores(_SCORED)} x")
def scored_pairs(rows, read):
    """Every distinct asked name with every company whose name begins alike. Both sides are distinct before they meet."""
    asked = spread(rows.select("name").distinct()).select(names.normalize(F.col("name")).alias("q"), F.expr("substr(regexp_replace(lower(name), ' (limited|corp)$', ''), 1, 3)").alias("begins"))
    held = read(COMPANIES).select(F.col("normalized_name").alias("c")).distinct()
    pairs = asked.join(held, F.col("begins") == F.substring("c", 1, 3)).select("q", "c").where("q <> ''").distinct()
    return pairs.withColumn("s", score_pairs("q", "c")).select("q", "c", F.round("s.score", 6).alias("score"), "s.method")


@query(QUERIES, f"select q.query_id, min(c.company_id) as company_id from ({QUERIES}) q join ({COMPANIES}) c on regexp_replace(lower(q.name), ' (limited|corp)$', '') = c.normalized_name group by 1")
def resolve_exact(rows, read):
    first = read(COMPANIES).groupBy("normalized_name").agg(F.min("company_id").alias("company_id"))
    exact = rows.withColumn("normalized_name", names.normalize(F.col("name"))).join(first, "normalized_name")
    return exact.groupBy("query_id").agg(F.min("company_id").alias("company_id"))


@query("select p_partkey, (p_partkey % 101) / 100.0 as score from part", "select p_partkey, case when (p_partkey % 101) >= 95 then 'high' when (p_partkey % 101) >= 85 then 'probable' else 'possible' end as band from part")
def confidence_bands(rows, _):
    return rows.select("p_partkey", resolve.band(F.col("score").cast("double")).alias("band"))


_SUMS = f"select company_id, country, metric, cast(round(sum(value), 2) as double) as value from ({LONG}) l group by all"


@query(STATS, f"select company_id, country, year, metric, cast(sum(value) as double) as value, count(*) as n from ({LONG}) l group by all")
def facts_unpivot(rows, _):
    wide = rows.withColumn("approvals", F.col("l_quantity").cast("decimal(14,2)")).withColumn("amount", F.col("l_extendedprice").cast("decimal(14,2)"))
    long = wide.unpivot(["company_id", "country", "year"], ["approvals", "amount"], "metric", "value")
    return long.groupBy("company_id", "country", "year", "metric").agg(F.sum("value").cast("double").alias("value"), F.count("*").alias("n"))


@query(LONG, _SUMS)
def facts_by_country_metric(rows, _):
    return facts.totals(rows).withColumn("value", F.col("value").cast("double"))


@query(LONG, f"select company_id, country, min(year) as first_year, max(year) as last_year, count(distinct year) as n_years from ({LONG}) l group by all")
def facts_years(rows, _):
    return facts.years(rows)


@query(LONG, f"select company_id, country, source_id, max(published_date) as published_date from ({LONG}) l group by all")
def facts_sources_latest(rows, _):
    return facts.sources(rows)


_METRICS = "case p_partkey % 9 when 0 then 'initial_approvals' when 1 then 'initial_denials' when 2 then 'perm_certified' when 3 then 'positions' when 4 then 'licensed_sponsor' when 5 then 'assessments' when 6 then 'perm_denied' when 7 then 'continuing_approvals' else 'odd_metric' end"
_HISTORY = f"select p_partkey % 60 as company_id, case p_partkey % 3 when 0 then 'US' when 1 then 'GB' else 'CA' end as country, case when p_partkey % 60 < 6 then null else cast(2000 + p_partkey % 11 as int) end as year, {_METRICS} as metric, cast(case when p_partkey % 60 < 12 then 0 else p_partkey * 1.25 end as decimal(14,2)) as value, 'r' as source_id, date'2024-01-01' as published_date from part"
_SPAN = "case when len(ys) = 0 then '' when len(ys) > 1 and ys[-1] - ys[1] + 1 = len(ys) then ys[1] || '–' || ys[-1] else array_to_string(ys, ', ') end"


@query(_HISTORY, f"""with h as (select company_id, country, coalesce(list_sort(list_distinct(list(year) filter (where year is not null))), []) as ys, sum(case when metric in ('initial_approvals', 'continuing_approvals', 'perm_certified', 'positions') then value else 0 end) as volume from ({_HISTORY}) p group by 1, 2)
 select company_id, string_agg(country || ' ' || {_SPAN}, '; ' order by country) as spans, case when max(ys[-1]) is null then 'they hold a current sponsor licence' when sum(volume) <= 0 then 'they last appear in the data for ' || max(ys[-1]) else 'about ' || format('{{:,}}', cast(floor(sum(volume) + 0.5) as bigint)) || ' approvals, most recently in ' || max(ys[-1]) end as history from h group by 1""")
def history_summary(rows, _):
    """The clause on each company's history, with the span of its years in each country."""
    held = facts.records(rows).withColumn("years", F.filter("years", lambda y: y.isNotNull())).groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("country", "years"))).alias("s"), F.collect_list(F.struct("country", "metrics", "years")).alias("r"))
    spans = F.array_join(F.transform("s", lambda x: F.concat(x["country"], F.lit(" "), history.span(x["years"]))), "; ")
    return held.select("company_id", spans.alias("spans"), history.describe(F.col("r")).alias("history"))


@query(f"select distinct {_METRICS} as metric, cast(p_retailprice * 1000 as decimal(20,2)) as value, p_partkey, date_add(date'2024-01-31', cast(p_partkey as int)) as at from part", f"""select p_partkey, case {_METRICS} when 'initial_approvals' then 'H-1B initial approvals' when 'initial_denials' then 'H-1B initial denials' when 'perm_certified' then 'PERM certifications' when 'positions' then 'Positive LMIA positions' when 'licensed_sponsor' then 'Licensed sponsor'
 when 'assessments' then 'Approved LMIAs' when 'perm_denied' then 'PERM denials' when 'continuing_approvals' then 'H-1B continuing approvals' else 'odd metric' end as label, format('{{:,}}', cast(floor(p_retailprice * 1000 + 0.5) as bigint)) as shown, strftime(date'2024-01-31' + cast(p_partkey as int), '%b %-d, %Y') as day from part""")
def metric_labels(rows, _):
    return rows.select("p_partkey", history.metric_label(F.col("metric")).alias("label"), history.number(F.col("value")).alias("shown"), history.day(F.col("at")).alias("day"))


_REGISTRY = "select l_returnflag as id, concat('Register ', l_returnflag) as label, 'Office' as publisher, concat('https://register.example/', lower(l_returnflag)) as url from lineitem group by l_returnflag"
_CHECKED = "case when scope is null then ['US', 'GB', 'CA'] else [scope] end"
_RECORDS = f"""select company_id, country, cast(sum(case when metric = 'approvals' then value end) as decimal(24,2)) as approvals, cast(sum(case when metric = 'amount' then value end) as decimal(24,2)) as amount, list_sort(list_distinct(list(year))) as years, max(year) as latest from ({LONG}) l group by all"""
_CITED = f"select company_id, country, string_agg(id || ' ' || label || ' ' || published || ' ' || url, '; ' order by id) as cited from (select company_id, country, r.id, r.label, r.url, max(published_date) as published from ({LONG}) l join ({_REGISTRY}) r on r.id = l.source_id group by all) x group by all"


@query(QUERIES, f"""with m as materialized (select * from {_MATCHES} x), r as materialized ({_RECORDS}), d as materialized ({_CITED}), u as (select *, {_CHECKED} as checked from ({ASKED}) a),
 v as (select u.*, m.company_id, m.matched_name, m.score, m.method, m.confidence, m.warnings from (select z.query_id, z.name, coalesce(u.checked, case when upper(z.country) in ('US', 'GB', 'CA') then [upper(z.country)] else ['US', 'GB', 'CA'] end) as checked from ({QUERIES}) z left join u using (query_id)) u left join m using (query_id)),
 g as (select query_id, string_agg(r.country || ' amount=' || amount || ' approvals=' || approvals || ' ' || array_to_string(years, ',') || ' (' || cited || ')', ' | ' order by r.country) as records, max(latest) as latest, sum(approvals) as approvals from v join r on r.company_id = v.company_id and list_contains(checked, r.country) join d on d.company_id = r.company_id and d.country = r.country group by 1),
 h as (select distinct company_id from r)
 select v.query_id, v.name as queried_name, case when h.company_id is null then 'no_record' else 'verified' end as kind, array_to_string(checked, ',') as countries_checked, h.company_id, case when h.company_id is not null then matched_name end as matched_name,
  case when h.company_id is not null then v.score end as score, case when h.company_id is not null then v.confidence end as confidence, case when h.company_id is not null then v.method end as method, case when h.company_id is not null then v.warnings end as warnings,
  case when h.company_id is not null then coalesce(g.records, '') end as records,
  case when h.company_id is not null then case when latest is null then 'they hold a current sponsor licence' when approvals <= 0 then 'they last appear in the data for ' || latest else 'about ' || format('{{:,}}', cast(floor(approvals + 0.5) as bigint)) || ' approvals, most recently in ' || latest end end as history
 from v left join h using (company_id) left join g using (query_id)""")
def verdicts(rows, read):
    """From a free-text name to its verdict: resolved, countries checked, records with their sources, the history clause."""
    companies = read(COMPANIES)
    matches = resolve.resolve(rows, companies, read(ALIASES), read(DOMAINS)).join(companies.select("company_id", "canonical_name"), "company_id")
    found = facts.verdicts(rows, matches, read(LONG), read(_REGISTRY))
    cited = lambda s: F.concat_ws(" ", s["id"], s["label"], s["published_date"].cast("string"), s["url"])
    told = lambda r: F.concat(r["country"], F.array_join(F.transform(F.map_entries(r["metrics"]), lambda m: F.concat(F.lit(" "), m["key"], F.lit("="), m["value"].cast("decimal(24,2)").cast("string"))), ""), F.lit(" "), F.array_join(r["years"].cast("array<string>"), ","), F.lit(" ("), F.array_join(F.transform(r["sources"], cited), "; "), F.lit(")"))
    return found.select(
        "query_id", "queried_name", "kind", F.array_join("countries_checked", ",").alias("countries_checked"), "match.company_id", "match.matched_name", "match.score", "match.confidence", "match.method",
        F.array_join("match.warnings", ",").alias("warnings"), F.array_join(F.transform("records", told), " | ").alias("records"), F.when(F.col("kind") == "verified", history.describe(F.col("records"))).alias("history"),
    )


@query(LONG, f"""with o as (select company_id, country, nullif(year, 1995) as year, metric, source_id, sum(value) as value, max(published_date) as published_date from ({LONG}) l where company_id % 2 = 0 group by all),
 n as (select company_id, country, nullif(year, 1995) as year, metric, source_id, sum(value) + 1 as value, max(published_date) as published_date from ({LONG}) l where company_id % 3 = 0 or company_id % 2 = 1 group by all),
 b as (select *, 0 as late from o union all select *, 1 as late from n), r as (select *, row_number() over (partition by company_id, country, year, metric, source_id order by late desc) as k from b)
 select company_id, country, year, metric, source_id, cast(value as double) as value, published_date from r where k = 1""")
def upsert_facts(rows, _):
    keyed = rows.withColumn("year", F.nullif("year", F.lit(1995))).groupBy(*facts.KEY).agg(F.sum("value").alias("value"), F.max("published_date").alias("published_date"))
    old, new = keyed.where("company_id % 2 = 0"), keyed.where("company_id % 3 = 0 or company_id % 2 = 1").withColumn("value", F.col("value") + 1)
    return facts.upsert(old, new).withColumn("value", F.col("value").cast("double"))


@query("select o_custkey, o_orderkey, o_orderstatus from orders", "select o_custkey, min(o_orderkey) as o_orderkey, arg_min(o_orderstatus, o_orderkey) as o_orderstatus from orders group by 1")
def dedupe_first(rows, _):
    return facts.first_of(rows, ["o_custkey"], "o_orderkey")


@query(COMPANIES, f"select normalized_name, country, arg_min(canonical_name, company_id) as canonical_name, min(company_id) as company_id from ({COMPANIES}) c where company_id % 3 <> 0 and not exists (select 1 from ({COMPANIES}) o where o.company_id % 3 = 0 and o.normalized_name = c.normalized_name and o.country = c.country) group by 1, 2")
def company_dim_upsert(rows, _):
    first = facts.first_of(rows.where("company_id % 3 <> 0"), ["normalized_name", "country"], "company_id")
    return first.join(rows.where("company_id % 3 = 0").select("normalized_name", "country"), ["normalized_name", "country"], "left_anti")


_SEEDS = "select distinct concat(p_name, case p_partkey % 2 when 0 then ' Inc.' else ' unknownco' end) as canonical_name, concat('alias of ', p_name) as alias, 'US' as country from part"


@query(_SEEDS, f"select c.company_id, s.alias from ({_SEEDS}) s join ({COMPANIES}) c on c.country = s.country and c.normalized_name = regexp_replace(s.canonical_name, ' Inc\\.$', '')")
def alias_seed_join(rows, read):
    return rows.withColumn("normalized_name", names.normalize(F.col("canonical_name"))).join(read(COMPANIES).select("company_id", "normalized_name", "country"), ["normalized_name", "country"]).select("company_id", "alias")


@query(_SEEDS, f"select s.canonical_name, s.alias from ({_SEEDS}) s where not exists (select 1 from ({COMPANIES}) c where c.country = s.country and c.normalized_name = regexp_replace(s.canonical_name, ' Inc\\.$', ''))")
def alias_seed_skipped(rows, read):
    return rows.withColumn("normalized_name", names.normalize(F.col("canonical_name"))).join(read(COMPANIES), ["normalized_name", "country"], "left_anti").select("canonical_name", "alias")


@query("select n_nationkey, n_name from nation", "select n_nationkey, n_name, max(case when o_orderstatus = 'F' then cast(o_orderdate as date) end) as last_ingest from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1, 2")
def last_ingest_by_source(rows, read):
    runs = read("select c_nationkey as n_nationkey, cast(o_orderdate as date) as published from orders join customer on c_custkey = o_custkey where o_orderstatus = 'F'")
    return rows.join(runs.groupBy("n_nationkey").agg(F.max("published").alias("last_ingest")), "n_nationkey", "left")


EVENTS = "select ts, user_id, event_type as name, event_id from events"


@query(EVENTS, "select cast(ts as date) as day, event_type as name, count(*) as n from events group by all")
def lookup_counters_daily(rows, _):
    return usage.daily_counts(rows)


@query(EVENTS, "select date_trunc('hour', ts) as window_start, user_id, count(*) as n from events group by all having count(*) > 2")
def rate_limit_hour(rows, _):
    return usage.over_limit(rows, "1 hour", 2)


@query(EVENTS, "select date_trunc('minute', ts) as window_start, user_id, count(*) as n from events group by all having count(*) > 1")
def rate_limit_minute(rows, _):
    return usage.over_limit(rows, "1 minute", 1)


@query(EVENTS, """with a as (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 2 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as b from events),
 s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as g from a) select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from s group by user_id, g""")
def debounce_sessions(rows, _):
    return usage.sessions(rows, "2 hours")


@query(EVENTS, "select user_id, event_type as name, min(event_id) as event_id from events group by 1, 2")
def render_dedupe(rows, _):
    return rows.groupBy("user_id", "name").agg(F.min("event_id").alias("event_id"))


@query(EVENTS, "select event_id, user_id from events where ts > (select max(ts) from events) - interval 24 hour")
def cache_ttl_filter(rows, read):
    newest = read("select max(ts) as newest from events")
    return rows.crossJoin(F.broadcast(newest)).where("ts > newest - interval 24 hours").select("event_id", "user_id")  # one row


@query("select event_id as key, ts as stored_at, event_type as store from events", """select event_id as key, event_type as store from (select *, count(*) over (partition by event_type) as n, row_number() over (partition by event_type order by ts, event_id) as r from events) e
 where n < 500 or r > 125""")
def cache_evict_oldest(rows, _):
    return facts.oldest_beyond(rows).select("key", "store")


_SAID = [
    "We are glad to sponsor visas for this post.", "Sadly we do not provide visa sponsorship; relocation support is on offer.", "Will you need sponsorship now or later?", "Applicants must already hold the right to work in the UK.",
    "A relocation package is available, but not for interns.", "The right to work is not required, as we arrange a work permit.", "Sponsorship is not available for this role", "H1B transfers welcome!", "Only US citizens or green card holders can apply.",
    "An active security clearance is required.", "We sponsor events in the city, although no sponsorship of people is planned.", "You can join without the need for employer sponsorship.", "Our team is unable to offer help with papers.",
    "Valid visa support, relocation assistance and lunch.", "We can not consider OPT or CPT.", "Candidates requiring sponsorship cannot be considered", "Visa sponsorship will be provided to the right person", "You aren’t asked for a work permit: we help with your visa.",
    "No ITAR, never citizenship checks (and no sponsorship either).", "Must be authorised to work; eligible to work at once", "Our employer sponsors staff regularly - relocation too", "Build things with us.", "We ship often; we test more", "Permanent resident? Good. Entitled to work, not excluded",
]
_QUOTED = ", ".join("'" + x.replace("'", "''") + "'" for x in _SAID)
# Spark reads array(...) with places from 0, DuckDB lists with places from 1
_PHRASED = "select doc_id as posting_id, concat({0}, case doc_id % 3 when 0 then ' ' when 1 then chr(10) else '  ' end, {1}, chr(10), chr(10), {2}) as text from documents"
_PICKS = [f"doc_id % {len(_SAID)}", f"(doc_id * 7 + 5) % {len(_SAID)}", f"(doc_id * 11 + doc_id % 13) % {len(_SAID)}"]
PHRASED = _PHRASED.format(*[f"element_at(array({_QUOTED}), cast({x} as int) + 1)" for x in _PICKS])
_PHRASED_SQL = _PHRASED.format(*[f"([{_QUOTED}])[{x} + 1]" for x in _PICKS])
_CLAUSES = oracles.clauses(_PHRASED_SQL)
_HARD = oracles.constructions(_CLAUSES, [(-1, phrases.NEGATIVE), (1, phrases.POSITIVE)])
_SOFT = oracles.anchors(_CLAUSES, phrases._ORDERED, phrases.TOKEN, phrases.NEGATIONS, phrases.BARRIERS, phrases.WINDOW, len(phrases.NEGATIVE) + len(phrases.POSITIVE) + 1)
_HITS = f"(select * from {_HARD} h union all select * from {_SOFT} s)"


@query(PHRASED, f"select * from {oracles.signals(_PHRASED_SQL, _HITS)} x")
def posting_signals(rows, _):
    return phrases.signals(rows).withColumn("evidence", F.array_join("evidence", " / ")).withColumn("cues", F.array_join("cues", ","))


@query(PHRASED, f"select posting_id, sentence_no, clause_no, k, cue, polarity, weight from {_HITS} x")
def phrase_hits(rows, _):
    """Every cue in every clause: constructions, and anchors with the negations near them."""
    return phrases.hits(rows).drop("clause")


@query(PHRASED, f"select * from {_CLAUSES} x")
def clauses(rows, _):
    return phrases.clauses(rows)


@query(PHRASED, f"select posting_id, sentence_no, clause_no, cue, polarity from {_HARD} x")
def hard_pattern_hits(rows, _):
    return phrases.hard_hits(phrases.clauses(rows)).select("posting_id", "sentence_no", "clause_no", "cue", "polarity")


@query("select doc_id, text from documents", "select doc_id, cast(len(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''’\\-]*|[,;:—–()]')) as int) as n from documents")
def phrase_tokens(rows, _):
    return rows.select("doc_id", F.size(phrases.tokens(F.col("text"))).alias("n"))


_SECTIONS = lambda postings: oracles.sections(postings, fit.HEADING, fit.TITLE, fit.BULLET)


@query(POSTINGS, f"select * from {_SECTIONS(POSTINGS)} s")
def requirement_sections(rows, _):
    return fit.sections(rows)


_STOP = ", ".join(f"'{w}'" for w in fit.STOP)
_TERMS = "unnest(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.\\-/]*[a-z0-9+#]|[a-z]'), lambda t: regexp_replace(t, '^[.\\-/]+|[.\\-/]+$', '', 'g')), lambda t: length(t) >= 2 and t not in (" + _STOP + "))) as term"


def _terms_oracle(keep: str, least: int, limit: int) -> str:
    return f"""with a as (select item_id as id, {_TERMS} from benchmark), h as (select distinct term from (select {_TERMS} from documents) d), c as (select id, term, count(*) as n from a group by 1, 2 having count(*) >= {least}),
 r as (select id, term, n, cast(row_number() over (partition by id order by n desc, term) as int) as rank from c where term {keep} (select term from h)) select * from r where rank <= {limit}"""


@query("select item_id as id, text from benchmark", _terms_oracle("not in", 1, 6))
def term_gaps(rows, read):
    return fit.term_gaps(rows, read("select text from documents"), least=1)


@query("select item_id as id, text from benchmark", _terms_oracle("in", 1, 5))
def term_overlaps(rows, read):
    return fit.term_overlaps(rows, read("select text from documents"))


_PAIRS = "select a.vec_id, b.vec_id as other, a.embedding as x, b.embedding as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"


@query(_PAIRS, f"select vec_id, other, round(list_cosine_similarity(cast(x as double[]), cast(y as double[])), 6) as similarity from ({_PAIRS}) p")
def cosine_scores(rows, _):
    return rows.select("vec_id", "other", F.round(fit.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("select p_partkey, (p_partkey % 100) / 100.0 as s from part", "select p_partkey, cast(floor((least(0.75, greatest(0.25, (p_partkey % 100) / 100.0)) - 0.25) / 0.5 * 100 + 0.5) as int) as score from part")
def fit_bands(rows, _):
    return rows.select("p_partkey", fit.fit_score(F.col("s").cast("double")).alias("score"))


@query(LOCATIONS, "select c_custkey as id, case c_custkey % 9 when 0 then 'US' when 1 then 'CA' when 2 then 'GB' when 3 then 'DE' when 5 then 'US' when 6 then 'IE' when 7 then 'AU' when 8 then 'CA' end as country from customer")
def infer_country(rows, _):
    return rows.select("id", places.infer_country(F.col("location")).alias("country"))


@query(URLS, f"select page_id, case when regexp_matches(url, 'com/company/[^/?#]+') then 'company' when regexp_matches(url, 'com/jobs(/|$)') then 'job_posting' end as page_type, coalesce(nullif(regexp_extract(url, 'currentJobId=(\\d+)', 1), ''), nullif(regexp_extract(url, '/jobs/view/(\\d+)', 1), '')) as job_key from ({URLS}) u")
def page_types(rows, _):
    key = F.replace(pages.job_key(F.col("url"), F.lit(None).cast("string")), F.lit("linkedin:job:"))
    return rows.select("page_id", F.when(pages.board(F.col("url")).isNotNull(), pages.page_type(F.col("url"))).alias("page_type"), key.alias("job_key"))


_FILLER = "We build things and look for people who like to build them with us. "
PAGES = f"""select page_id, url, concat(case when page_id % 3 = 0 then concat('<div class="job-details-jobs-unified-top-card__container--two-pane"><div class="job-details-jobs-unified-top-card__job-title"><h1>Engineer ', page_id,
 '</h1></div><div class="job-details-jobs-unified-top-card__company-name"><a href="/company/rail-', page_id, '/life/">Rail ', page_id, ' Rail ', page_id, '</a></div><div class="job-details-jobs-unified-top-card__primary-description-container"> Austin, TX · 2 days ago</div></div>
 <div class="org-top-card"><div class="org-top-card-summary__title">Org  ', page_id, '</div><div class="org-top-card-primary-actions"><a href="https://www.linkedin.com/redir?url=https%3A%2F%2Fwww.org', page_id, '.example.com%2F">site</a><a href="http://org', page_id, '.example.com/x">site</a></div></div>
 <div class="jobs-description__content"><p>Mind the', chr(10), 'gap.</p><ul><li>Tea &amp; rails</li><li>Night trains too</li></ul><script>var a = 1</script></div>')
 when page_id % 3 = 1 then concat('<aside><a href="/company/other/">Other</a></aside><main><div><h1 class="x1">Lead ', page_id, '</h1><a href="/company/firm-', page_id, '"><img></a><a href="/company/firm-', page_id, '/?trk=x">Firm ', page_id, '</a></div><div class="x2"><p>', repeat('{_FILLER}', 8), '</p></div></main>')
 else '' end, html) as html from ({URLS}) u join (select page_id as id, html from pages) p on id = page_id"""
_PAGE = f"select *, page_id % 3 as t, regexp_matches(url, '/company/') as firm, concat('firm-', page_id) as own from ({URLS}) u where url not like '%/feed/'"


@query(PAGES, f"""select page_id, 'linkedin' as board, case when firm then 'company' else 'job_posting' end as page_type, case when firm and t = 0 then concat('Org ', page_id) when t = 0 then concat('Rail ', page_id) else concat('Firm ', page_id) end as company,
 case when t = 0 and not firm then concat('rail-', page_id) else own end as slug, case when not firm then concat(case t when 0 then 'Engineer ' else 'Lead ' end, page_id) end as title,
 case when not firm then case t when 0 then concat('Mind the gap.', chr(10), 'Tea & rails', chr(10), 'Night trains too') else trim(repeat('{_FILLER}', 8)) end end as description, case when not firm and t = 0 then 'US' end as country,
 case when firm and t = 0 then concat('org', page_id, '.example.com') end as website, case when firm then concat('linkedin:company:', own) else concat('linkedin:job:', page_id) end as key from ({_PAGE}) p where firm or t < 2""")
def page_contexts(rows, _):
    return pages.contexts(rows, "page_id")


@query(PAGES, f"""select 'linkedin' as board, case when firm then 'company' else 'job_posting' end as page_type, count(*) as n, count(*) as slug, count(case when not firm then 1 end) as title, count(case when not firm then 1 end) as description,
 count(case when not firm and t = 0 then 1 end) as country, count(case when firm and t = 0 then 1 end) as website from ({_PAGE}) p where firm or t < 2 group by firm""")
def page_field_rates(rows, _):
    return pages.field_rates(rows)


_ROLES = " union all ".join(f"select '{a}' as role, '{b}' as keywords" for a, b in links.ROLES)


@query(f"select s_suppkey, replace(lower(s_name), '#', '-') as slug from supplier", f"select s_suppkey, role, concat('https://www.linkedin.com/company/', replace(lower(s_name), '#', '-'), '/people/?keywords=', replace(keywords, ' ', '+')) as url from supplier, ({_ROLES}) r")
def referral_links(rows, _):
    return rows.select("s_suppkey", F.inline(links.referrals(F.col("slug"), F.lit(None).cast("string"))))


_US = "select cast(1990 + s_suppkey % 30 as string) as `Fiscal Year`, s_name as `Employer (Petitioner) Name`, cast(s_suppkey % 4 as string) as `Initial Approval`, '-' as `Initial Denial`, '1,000' as `Continuing Approval`, cast(s_nationkey as string) as `Continuing Denial` from supplier"


@query(_US, "select s_name as company_name, 'US' as country, cast(1990 + s_suppkey % 30 as int) as year, m as metric, cast(case m when 'initial_approvals' then s_suppkey % 4 when 'initial_denials' then 0 when 'continuing_approvals' then 1000 else s_nationkey end as double) as value, 'us_petitions' as source_id from supplier, (select unnest(['initial_approvals', 'initial_denials', 'continuing_approvals', 'continuing_denials']) as m) x")
def ingest_us(rows, _):
    return registers.petitions(rows, "2024-12-31").drop("published_date", "extra").withColumn("value", F.col("value").cast("double"))


_GB = "select c_name as `Organisation Name`, case c_custkey % 3 when 0 then 'Skilled Worker' when 1 then 'Creative Worker' else '' end as Route from customer"


@query(_GB, "select distinct c_name as company_name, 'licensed_sponsor' as metric from customer where c_custkey % 3 <> 1")
def ingest_gb(rows, _):
    return registers.register(rows, "2024-12-31").select("company_name", "metric")


_CA = "select c_mktsegment as Employer, cast(c_custkey % 7 as string) as `Approved Positions`, cast(c_custkey % 2 as string) as `Approved LMIAs` from customer union all select 'Total', '99', '9'"


@query(_CA, "select c_mktsegment as company_name, m as metric, cast(sum(case m when 'positions' then c_custkey % 7 else c_custkey % 2 end) as double) as value from customer, (select unnest(['positions', 'assessments']) as m) x group by all")
def ingest_ca(rows, _):
    return registers.assessments(rows, "2024-12-31").select("company_name", "metric", F.col("value").cast("double").alias("value"))


@query(PHRASED, f"select posting_id, case when posting_id % 2 = 0 then 'verified' else 'no_record' end as kind, case when polarity = 'negative' then 'posting_negative' when posting_id % 2 = 0 then 'verified' else 'no_record' end as shown from {oracles.signals(_PHRASED_SQL, _HITS)} x")
def conflict_verdict(rows, _):
    """What is shown where a posting's own words and its employer's history differ."""
    history_of = rows.select("posting_id", F.when(F.col("posting_id") % 2 == 0, "verified").otherwise("no_record").alias("kind"))
    return phrases.shown(history_of, phrases.signals(rows))


ASKING = """select p_partkey as posting_id, concat('Python wanted', chr(10), case p_partkey % 4 when 0 then 'Requirements' when 1 then 'What you''ll need:' when 2 then 'Who we are' else 'Minimum qualifications' end, chr(10), '- 5+ years of experience with ', p_name, ' and SQL', chr(10), '- Machine learning, C++; knowledge of ', p_name,
 ' or ', p_type, chr(10), case p_partkey % 5 when 0 then '* You''re fluent in JavaScript, java and node.js.' when 1 then '2) hands-on background in ci/cd/.net tooling' when 2 then 'Ability to ship ' else 'We don''t mind ' end, p_brand, case when p_partkey % 3 = 0 then concat(chr(10), 'About The Team', chr(10), '- We ship ', p_name, ' on AWS') else '' end) as text from part"""
RESUMES = "select p_partkey as resume_id, case when p_partkey % 11 = 0 then null else concat('Built ', p_name, case p_partkey % 3 when 0 then ' in Python' when 1 then ' with SQL & C++' else ' by machine learning' end, ', ', lower(p_type), '.') end as text from part"
_KEYWORDS = oracles.keywords(_SECTIONS(ASKING), coverage, fit.BULLET, skills.TERMS)


@query(ASKING, f"select posting_id, term, occurrences, in_requirements, evidence, weight, rank from {_KEYWORDS} k")
def keyword_requirements(rows, _):
    return coverage.requirements(rows)


@query(ASKING, f"select * from {oracles.covered(ASKING, RESUMES, _KEYWORDS, coverage)} c")
def keyword_coverage(rows, read):
    pairs = rows.select("posting_id", F.col("posting_id").alias("resume_id"))
    found = coverage.analyze(pairs, rows, read(RESUMES))
    return found.drop("suggestions").withColumn("matched", F.array_join("matched", ",")).withColumn("missing", F.array_join(F.transform("missing", lambda m: m["term"]), ","))


_INTERVIEWS = """select s_suppkey, 'Glassdoor interviews' as label, concat('https://www.glassdoor.com/Search/results.htm?keyword=', replace(s_name, '#', '%23')) as url from supplier
 union all select s_suppkey, 'Blind discussions', concat('https://www.google.com/search?q=site%3Ateamblind.com+%22', replace(s_name, '#', '%23'), '%22+interview') from supplier
 union all select s_suppkey, 'Interview write-ups on the web', concat('https://www.google.com/search?q=%22', replace(s_name, '#', '%23'), '%22+interview+process+questions') from supplier"""


@query("select s_suppkey, s_name from supplier", _INTERVIEWS)
def interview_links(rows, _):
    return rows.select("s_suppkey", F.inline(links.interviews(F.col("s_name"))))


@query("select s_suppkey, concat('s', s_suppkey, '.example.com') as domain from supplier", "select s_suppkey, concat('https://s', s_suppkey, '.example.com', unnest(['/team', '/about/team', '/leadership', '/about/leadership', '/about', '/company/team'])) as url from supplier")
def leadership_pages(rows, _):
    return rows.select("s_suppkey", F.explode(links.leadership_pages(F.col("domain"))).alias("url"))


@query("select c_custkey, c_name, concat('Firm ', c_custkey % 9) as firm from customer", "select c_custkey, concat('https://www.linkedin.com/search/results/people/?keywords=', replace(c_name, '#', '%23'), '+Firm+', c_custkey % 9) as url from customer")
def person_search(rows, _):
    return rows.select("c_custkey", links.person_search(F.col("c_name"), F.col("firm")).alias("url"))


_BODY = "'**Company name on the job board:** Firm ' || page_id || chr(10) || '**Name we matched it to:** FIRM ' || page_id || chr(10) || '**Page type:** ' || case when contains(url, '/company/') then 'company page' else 'job posting' end || chr(10) || chr(10) || '**What is wrong:**' || chr(10) || '<!-- e.g. this is a different company, or a subsidiary, or a staffing agency -->' || chr(10) || chr(10) || '---' || chr(10) || '_No page contents are included._'"
# form encoding: a space is a plus, an asterisk stays, a tilde does not
_FORM = "replace(replace(replace(url_encode({0}), '%20', '+'), '%2A', '*'), '~', '%7E')"
_TITLE = "'Wrong match: \"Firm ' || page_id || '\" → \"FIRM ' || page_id || '\"'"


@query(URLS, f"select page_id, 'https://github.com/owner/repo/issues/new?labels=entity-resolution&title=' || {_FORM.format(_TITLE)} || '&body=' || {_FORM.format(_BODY)} as url from ({URLS}) u")
def mismatch_report(rows, _):
    name = F.concat(F.lit("Firm "), "page_id")
    return rows.select("page_id", links.mismatch_report("owner/repo", name, F.upper(name), F.col("url"), "_No page contents are included._").alias("url"))


_GATED = "select doc_id, case doc_id % 3 when 0 then 'job_posting' when 1 then 'company' end as page_type, case when doc_id % 4 = 0 then '' else text end as text from documents"


@query(_GATED, f"select doc_id, page_type = 'job_posting' and coalesce(text, '') <> '' as comparable, length(trim(coalesce(text, ''))) >= 50 as resume_ok from ({_GATED}) g")
def text_gates(rows, _):
    """Which pages are compared with a resume, and which texts are long enough to be one."""
    return rows.select("doc_id", gates.comparable_page(F.col("page_type"), F.col("text")).alias("comparable"), gates.resume_long_enough(F.col("text")).alias("resume_ok"))


_LOOKED = "select concat(event_type, ':', user_id % 20) as key, cast(ts as timestamp) as ts, event_id % 4 = 0 as `write`, cast(event_id as string) as payload, event_id from events"


@query(_LOOKED, """with e as (select event_type || ':' || user_id % 20 as key, cast(ts as timestamp) as ts, event_id % 4 = 0 as w, cast(event_id as varchar) as payload from events),
 j as (select e.key, e.ts, e.payload as id, arg_max(o.payload, (o.ts, o.payload)) as payload, max(o.ts) as stored from e left join e o on o.key = e.key and o.w and o.ts <= e.ts where not e.w group by 1, 2, 3)
 select key, ts, count(*) as n, bool_or(coalesce(ts <= stored + interval 6 hour, false)) as hit, max(case when ts <= stored + interval 6 hour then payload end) as payload from j group by 1, 2""")
def cache_lookups(rows, _):
    """Each lookup's hit or miss in a cache whose entries live six hours. The same plan runs on a stream."""
    told = caches.lookups(rows, ttl=21_600)
    return told.groupBy("key", "ts").agg(F.count("*").alias("n"), F.bool_or("hit").alias("hit"), F.max("payload").alias("payload"))


_RESULTS = "select cast(user_id as string) as session, event_id % 50 as generation, cast(ts as timestamp) as ts, cast(event_id as string) as payload from events"


@query(_RESULTS, f"""select session, generation, ts, payload from (select *, max(generation) over (partition by session order by ts, generation, payload rows between unbounded preceding and 1 preceding) as newest
 from ({_RESULTS.replace('string', 'varchar')}) r) x where newest is null or generation >= newest""")
def current_results(rows, _):
    """Results that are still wanted when they come: older generations of a session are dropped."""
    return caches.current(rows)


@query("select cast(user_id as string) as session, event_type as key, cast(ts as timestamp) as ts from events", "select cast(user_id as varchar) as session, event_type as key, min(cast(ts as timestamp)) as ts from events group by 1, 2")
def rendered_once(rows, _):
    return caches.rendered(rows)


_STORED = """select c_custkey as resume_id, cast(case c_custkey % 5 when 0 then null else c_custkey % 5 - 1 end as int) as version, case c_custkey % 5 when 2 then concat('{"text":"', c_mktsegment, '","updatedAt":', c_custkey, '000}')
 when 3 then case when c_custkey % 7 = 0 then '{broken' else concat('{"text":"', c_mktsegment, '","updatedAt":', c_custkey, '000,"embedding":[1.0,', c_custkey % 10, '.5]}') end else c_mktsegment end as payload from customer"""


@query(_STORED, """select c_custkey as resume_id, c_mktsegment as text, case when c_custkey % 5 < 2 then 0 else c_custkey end as seconds, case when c_custkey % 5 = 3 then cast(1.0 + c_custkey % 10 + 0.5 as double) end as total from customer where c_custkey % 5 < 3 or c_custkey % 5 = 3 and c_custkey % 7 <> 0""")
def migrated_resumes(rows, _):
    """Resumes that older versions stored, as the current one reads them."""
    sums = F.aggregate("vector", F.lit(0.0), lambda x, v: x + v)
    return store.migrate_resumes(rows).select("resume_id", "text", F.unix_timestamp("updated_at").alias("seconds"), sums.alias("total"))


@query(COMPANIES, f"select count(*) as n from ({COMPANIES}) c")
def company_count(rows, _):
    return rows.agg(F.count("*").alias("n"))


@query(_SEEDS, f"select c.company_id, lower(s.alias) as normalized_alias, s.alias from ({_SEEDS}) s join ({COMPANIES}) c on c.country = s.country and c.normalized_name = regexp_replace(s.canonical_name, ' Inc\\.$', '') where c.company_id % 5 <> 0")
def alias_seeds_new(rows, read):
    """Curated aliases that a company does not have yet."""
    held = read(COMPANIES).where("company_id % 5 = 0").select("company_id", F.concat(F.lit("alias of "), names.strip_suffixes(F.lower("normalized_name"))).alias("normalized_alias"))
    return store.seeded(rows, read(COMPANIES), held).select("company_id", "normalized_alias", "alias")


_TOWNS = "select concat('Org ', c_custkey % 50) as `Organisation Name`, concat('Worker (', case c_custkey % 50 % 2 when 0 then 'A' else 'B' end, ' rating)') as `Type & Rating`, case c_custkey % 50 % 3 when 0 then '' else concat('Town ', c_custkey % 50) end as `Town/City` from customer"


@query(_TOWNS, "select distinct concat('Org ', c_custkey % 50) as company_name, concat('Worker (', case c_custkey % 50 % 2 when 0 then 'A' else 'B' end, ' rating)') as rating, case c_custkey % 50 % 3 when 0 then null else concat('Town ', c_custkey % 50) end as city, null::varchar as route from customer")
def register_extras(rows, _):
    """A register without a route column: every organisation qualifies, and its other cells are kept."""
    extra = registers.register(rows, "2024-12-31")
    return extra.select("company_name", *[F.col("extra")[k].alias(k) for k in ("rating", "city", "route")])


_PROVINCES = "select concat('Firm ', c_custkey % 40) as Employer, cast(c_custkey % 7 as string) as `Approved Positions`, case when c_custkey % 40 % 4 = 0 then 'nan' else concat('P', c_custkey % 40 % 4) end as Province from customer"


@query(_PROVINCES, "select concat('Firm ', c_custkey % 40) as company_name, 'positions' as metric, cast(sum(c_custkey % 7) as double) as value, case when c_custkey % 40 % 4 = 0 then null else concat('P', c_custkey % 40 % 4) end as province from customer group by all having sum(c_custkey % 7) > 0")
def assessment_extras(rows, _):
    """A file without assessment counts: positions only, with the first province."""
    return registers.assessments(rows, "2024-12-31").select("company_name", "metric", F.col("value").cast("double").alias("value"), F.col("extra")["province"].alias("province"))


_SHOWN = "select s_suppkey as id, case s_suppkey % 5 when 0 then concat('Firm ', s_suppkey, ' Firm ', s_suppkey) when 1 then concat('  Firm   ', s_suppkey, ' · Berlin') when 2 then concat('Firm 12,', s_suppkey + 100, ' followers on board') when 3 then concat('Firm ', s_suppkey, ' (Verified) ') else concat('Firm ', s_suppkey, ' Works') end as shown from supplier"


@query(_SHOWN, "select s_suppkey as id, case s_suppkey % 5 when 2 then 'Firm' when 4 then concat('Firm ', s_suppkey, ' Works') else concat('Firm ', s_suppkey) end as name from supplier")
def clean_company_names(rows, _):
    return rows.select("id", names.clean_company(F.col("shown")).alias("name"))


@query(COMPANIES, f"select company_id, concat('company:', normalized_name, ':', country, ':*') as server_key, concat('verdict:', lower(canonical_name), ':', country) as client_key from ({COMPANIES}) c")
def cache_keys(rows, _):
    return rows.select("company_id", store.server_key(F.col("canonical_name"), F.col("country"), F.lit("")).alias("server_key"), store.client_key(F.col("canonical_name"), F.col("country")).alias("client_key"))


_BATCH = f"select name as company_name, coalesce(country, 'US') as country, 'us_petitions' as source_id, domain, 7919 * query_id % 100003 as seq from ({QUERIES}) q"
_PLAIN = "regexp_replace(lower(company_name), ' (limited|corp)$', '')"
_LOADED = f"""r as (select {_PLAIN} as normalized_name, country, arg_min(trim(company_name), seq) as canonical_name from ({_BATCH}) b group by all), c as ({COMPANIES}),
 n as (select * from r where not exists (select 1 from c where c.normalized_name = r.normalized_name and c.country = r.country))"""


@query(_BATCH, f"""with {_LOADED} select normalized_name, country, canonical_name, company_id from c union all select normalized_name, country, canonical_name, null from n""")
def company_batch_load(rows, read):
    """Companies after a batch: known ones as they were, new ones named by the first record that came."""
    before = read(COMPANIES)
    after = store.upsert_companies(before, rows).join(before.select("company_id", F.lit(True).alias("old")), "company_id", "left")
    return after.select("normalized_name", "country", "canonical_name", F.when(F.col("old"), F.col("company_id")).alias("company_id"))


@query(_BATCH, f"with {_LOADED} select country, count(*) as n_new, (select count(*) from n) as ids, (select max(company_id) from c) + 1 as first_id, (select max(company_id) from c) + (select count(*) from n) as last_id from n group by 1")
def company_numbering(rows, read):
    """New companies by country, and that their ids go on from the largest one without a gap."""
    before = read(COMPANIES)
    fresh = store.upsert_companies(before, rows).join(before.select("company_id"), "company_id", "left_anti")
    span = fresh.agg(F.count_distinct("company_id").alias("ids"), F.min("company_id").alias("first_id"), F.max("company_id").alias("last_id"))
    return fresh.groupBy("country").agg(F.count("*").alias("n_new")).crossJoin(F.broadcast(span))  # one row


_ALIASED = f"select canonical_name as company_name, country, 'us_petitions' as source_id, array(concat(' alias ', normalized_name, ' Inc'), canonical_name, ' ') as aliases, array(concat(' WWW.S', company_id, '.example.com'), '') as domains from ({COMPANIES}) c"


@query(_ALIASED, f"select company_id, concat('alias ', normalized_name, ' Inc') as alias, concat('alias ', normalized_name) as normalized_alias, 'etl:us_petitions' as source from ({COMPANIES}) c where company_id % 3 <> 0")
def alias_inserts(rows, read):
    held = read(COMPANIES).where("company_id % 3 = 0").selectExpr("company_id", "concat('alias ', normalized_name) as normalized_alias")
    return store.new_aliases(rows, read(COMPANIES), held)


@query(_ALIASED, f"select distinct c.company_id, concat('s', r.company_id, '.example.com') as domain from ({COMPANIES}) r join ({COMPANIES}) c using (normalized_name, country) where not (c.company_id % 4 = 0 and r.company_id = c.company_id)")
def domain_inserts(rows, read):
    held = read(COMPANIES).where("company_id % 4 = 0").selectExpr("company_id", "concat('s', company_id, '.example.com') as domain")
    return store.new_domains(rows, read(COMPANIES), held)


_SOURCES = "select l_returnflag as id, concat('Register ', l_returnflag) as label, case l_returnflag when 'A' then 'US' when 'N' then 'GB' else 'CA' end as country from lineitem group by l_returnflag"


@query(LONG, f"select company_id, source_id, concat('Register ', source_id) as label, count(*) as n from ({LONG}) l group by all")
def facts_with_source(rows, read):
    return store.known_sources(rows, read(_SOURCES)).groupBy("company_id", "source_id", "label").agg(F.count("*").alias("n"))


@query("select l_returnflag as source_id, cast(l_shipdate as date) as published_date, case when l_returnflag = 'R' and l_linenumber = 7 then 'bad row' end as failure from lineitem", "select l_returnflag as source_id, case l_returnflag when 'R' then 'failed' else 'success' end as status, case l_returnflag when 'R' then 0 else count(*) end as rows_ingested, case l_returnflag when 'R' then null else max(cast(l_shipdate as date)) end as published_date, case l_returnflag when 'R' then 'bad row' end as notes from lineitem group by l_returnflag")
def run_audits(rows, _):
    return store.run_audit(rows, F.current_timestamp(), F.col("failure")).drop("started_at")


_ASKS = "select c_custkey as id, case c_custkey % 6 when 0 then '' when 1 then repeat('x', 301) when 2 then null else c_name end as name, case c_custkey % 5 when 0 then 'USA' when 1 then 'U' when 2 then 'US' end as country, case when c_custkey % 11 = 0 then repeat('d', 256) else 'a.example' end as domain from customer"


@query(_ASKS, f"select id, case when name is null or length(name) not between 1 and 300 then 'name' when length(country) <> 2 then 'country' when length(domain) > 255 then 'domain' end as fault from ({_ASKS}) a")
def request_faults(rows, _):
    return rows.select("id", gates.request_fault(F.col("name"), F.col("country"), F.col("domain")).alias("fault"))


_VERDICTS = "select o_orderkey as id, case o_orderkey % 5 when 0 then 'verified' when 1 then 'no_record' when 2 then 'does_not_sponsor' when 3 then 'error' else 'odd' end as kind, o_orderkey % 7 as a, o_orderkey % 3 as b from orders"


@query(_VERDICTS, f"""select id, case kind when 'verified' then case when a = 0 or b = 0 then 'unexpected response' when b = 1 then 'data without a source' end when 'no_record' then case when a = 0 then 'unexpected response' end
 when 'does_not_sponsor' then case when a = 0 or b = 0 then 'unexpected response' end when 'error' then null else 'unexpected response' end as fault from ({_VERDICTS}) v""")
def verdict_faults(rows, _):
    given = F.when(F.col("a") != 0, F.lit("x"))
    records = F.when(F.col("b") != 0, F.array(F.array(F.lit("s")), F.when(F.col("b") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("s")))))
    return rows.select("id", gates.verdict_fault(F.col("kind"), given, records, given, F.when(F.col("b") != 0, F.array(F.lit("s")))).alias("fault"))


_TRIES = "select doc_id, doc_id % 5 <> 0 as enabled, case when doc_id % 3 = 0 then null else 'resume' end as resume, case when doc_id % 7 = 0 then null else text end as text from documents"


@query(_TRIES, f"select doc_id, case when not enabled then 'disabled' when resume is null then 'no_resume' when length(trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13) || chr(11) || chr(12) || chr(160) || chr(65279))) < 200 then 'no_description' end as reason from ({_TRIES}) t")
def match_reasons(rows, _):
    return rows.select("doc_id", gates.match_reason(F.col("enabled"), F.col("resume"), F.col("text")).alias("reason"))


_ADDRESSES = "select s_suppkey as id, case s_suppkey % 6 when 0 then concat('https://s', s_suppkey, '.example.com/x') when 1 then 'http://localhost:8080/api' when 2 then 'http://127.0.0.1/' when 3 then concat('http://s', s_suppkey, '.example.com') when 4 then 'not a url' else 'ftp://x.example' end as url from supplier"


@query(_ADDRESSES, f"select id, (url like 'https://%' or url like 'http://localhost%' or url like 'http://127.0.0.1%') as safe from ({_ADDRESSES}) a")
def safe_urls(rows, _):
    return rows.select("id", gates.safe_url(F.col("url")).alias("safe"))


@query("select doc_id, text from documents", "select doc_id, md5(substr(trim(regexp_replace(text, '[\\s\\x{00A0}\\x{FEFF}\\x{000B}]+', ' ', 'g')), 1, 4000)) as digest from documents")
def embedding_texts(rows, _):
    return rows.select("doc_id", F.md5(gates.for_embedding(F.col("text")).cast("binary")).alias("digest"))


_FITS = "select s_suppkey as id, concat('alpha beta gamma ', case when s_suppkey % 2 = 0 then 'delta' else 'omega' end) as resume, 'alpha alpha delta delta kappa kappa lambda lambda' as posting, array(1.0d, 0.0d) as resume_vector, case s_suppkey % 3 when 0 then array(1.0d, 0.0d) when 1 then array(1.0d, 1.5d) else array(0.0d, 1.0d) end as posting_vector from supplier"


@query(_FITS, """select s_suppkey as id, case s_suppkey % 3 when 0 then 100 when 1 then 61 else 0 end as score, case s_suppkey % 3 when 0 then 'strong' when 1 then 'moderate' else 'weak' end as band,
 concat(case s_suppkey % 3 when 0 then 'Your resume reads as closely related to this posting.' when 1 then 'Your resume overlaps with this posting in places.' else 'Your resume and this posting have little language in common.' end,
 case s_suppkey % 2 when 0 then ' Shared emphasis: alpha, delta. The posting stresses kappa, lambda, which' else ' Shared emphasis: alpha. The posting stresses delta, kappa, lambda, which' end, ' your resume does not mention. This compares wording, not qualifications.') as rationale,
 case s_suppkey % 2 when 0 then 'kappa lambda' else 'delta kappa lambda' end as gaps from supplier""")
def fit_matches(rows, _):
    return fit.matches(rows).withColumn("gaps", F.array_join("gaps", " "))


_RESUMES = "select c_custkey as resume_id, c_name as text, timestamp'2024-01-01 00:00:00' as updated_at, array(1.0d) as vector from customer"


@query(_RESUMES, "select c_custkey as resume_id, case when c_custkey % 4 = 0 then concat(c_name, ' edited') else c_name end as text, c_custkey % 4 <> 0 as has_vector from customer where c_custkey % 9 <> 0")
def resume_states(rows, _):
    edits = rows.where("resume_id % 4 = 0").select("resume_id", F.concat("text", F.lit(" edited")).alias("text"), F.lit("2024-02-01").cast("timestamp").alias("updated_at"))
    saved = store.save_resumes(rows, edits)
    kept, _ = store.delete_resumes(saved, saved.select("resume_id"), rows.where("resume_id % 9 = 0").select("resume_id"))
    return kept.select("resume_id", "text", F.col("vector").isNotNull().alias("has_vector"))


_ANALYSES = "select o_orderkey % 50 as job_key, o_custkey as resume_id, timestamp'2024-01-01 00:00:00' as resume_version, o_orderkey as stored_at, o_orderkey as score from orders"


@query(_ANALYSES, "select o_orderkey % 50 as job_key, o_custkey as resume_id, max(o_orderkey) as score from orders where o_custkey % 4 <> 0 group by all")
def fresh_analyses(rows, read):
    """Analyses of resumes that were edited since do not count."""
    resumes = read(_RESUMES).withColumn("updated_at", F.when(F.col("resume_id") % 4 == 0, F.lit("2024-02-01").cast("timestamp")).otherwise(F.col("updated_at")))
    return store.current_analyses(rows, resumes).select("job_key", "resume_id", "score")


@query("select user_id, event_type as name, cast(ts as timestamp) as ts from events", "select concat('verdict:', event_type, ':*') as key, max(cast(ts as timestamp)) as stored_at, max(cast(ts as timestamp)) + interval 1 day as expires_at from events group by 1")
def cache_writes(rows, _):
    return store.cache_entries(rows, store.client_key(F.col("name"), F.lit(None).cast("string")), "ts").drop("payload")


@query("select event_id as key, event_id % 3 as version from events", "select event_id as key, event_id % 3 as version from events where event_id % 3 = 2")
def migrated_caches(rows, _):
    return store.migrate(rows, 2)


@query("select s_suppkey, case s_nationkey % 4 when 0 then 'US' when 1 then 'GB' when 2 then 'DE' else null end as code from supplier", "select s_suppkey, s_nationkey % 4 in (0, 1) as covered, case s_nationkey % 4 when 0 then 'United States' when 1 then 'United Kingdom' when 2 then 'DE' end as label from supplier")
def country_labels(rows, _):
    return rows.select("s_suppkey", places.has_register(F.col("code")).alias("covered"), places.country_label(F.col("code")).alias("label"))


@query("select s_suppkey, concat('Firm ', s_suppkey, ' & Co') as firm from supplier", f"select s_suppkey, role, concat('https://www.linkedin.com/search/results/people/?keywords=Firm+', s_suppkey, '+%26+Co+', replace(keywords, ' ', '+')) as url from supplier, ({_ROLES}) r")
def referral_links_unscoped(rows, _):
    """Without a company page: a search for the name and the role."""
    return rows.select("s_suppkey", F.inline(links.referrals(F.lit(None).cast("string"), F.col("firm"))))


@query(QUERIES, f"""with m as materialized (select * from {_MATCHES} x), l as ({LONG}) select u.query_id, l.country, cast(round(sum(case when metric = 'approvals' then value else 0 end), 2) as double) as approvals, count(distinct year) as n_years, count(distinct source_id) as n_sources
 from ({ASKED}) u join m using (query_id) join l on l.company_id = m.company_id where scope is null or scope = l.country group by all""")
def verdict_records(rows, read):
    """The nested records of the countries that a query asks for, a row each; an unsupported country asks for all."""
    matches = resolve.resolve(rows, read(COMPANIES), read(ALIASES), read(DOMAINS)).join(read(COMPANIES).select("company_id", "canonical_name"), "company_id")
    found = facts.verdicts(rows, matches, read(LONG), read(_REGISTRY)).select("query_id", F.inline("records"))
    return found.select("query_id", "country", F.col("metrics")["approvals"].cast("double").alias("approvals"), F.size("years").cast("long").alias("n_years"), F.size("sources").cast("long").alias("n_sources"))


def queries() -> dict:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
