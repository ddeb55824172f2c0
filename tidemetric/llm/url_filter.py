"""URL filters: explicit rules, then empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host. A host's good rate is
shrunk through beta-binomial priors, from suffix to registered domain to host: each
level's posterior mean is the prior mean of the level below, and the prior's strength
at a level comes from the spread of rates at that level (the moment estimate of the
intra-class correlation). A page is blocked when the lower posterior bound
``mean - z * sd`` of its host is under ``least``; hosts without labels fall back on
their domain's and suffix's posterior in the same formula.

All work is grouping and joining on host keys. Counts are pre-aggregated before any
shuffle, so a host that owns a third of the pages costs one row per task, and its pages
meet its verdict where they are (``join_by_key``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemetric.llm.common import cut, join_by_key, table

# The rules of the contract, as (action, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# registries' own second labels under country domains, as in ac.uk or com.br,
# and hosting domains below which everybody may register.
SECOND_LABELS = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "govt", "mil", "ne", "net", "nhs", "nom", "or", "org", "sch")
SHARED_DOMAINS = ("appspot.com", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com")
SUFFIX_PATTERN = rf"^((?:{'|'.join(SECOND_LABELS)})\.[a-z]{{2}}|{'|'.join(d.replace('.', '[.]') for d in SHARED_DOMAINS)})$"

LEAST = 0.5
Z = 1.0
STRENGTH = (2.0, 200.0)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NAME = r"(?s)^(?:.*@)?(\[[^\]]*\]|[^:\[]*)"
ADDRESS = r"^(?:\[.*\]|[0-9]{1,3}(?:[.][0-9]{1,3}){3}|[0-9]+|0x[0-9a-f]+)$"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def bare_host(host: Column) -> Column:
    """The host without user name, port and the dot of the root at its end."""
    return F.regexp_replace(F.regexp_extract(host, NAME, 1), r"[.]$", "")


def is_address(bare: Column) -> Column:
    """Whether a bare host is an address (four numbers, one number, or in brackets) and no name."""
    return bare.rlike(ADDRESS)


def suffix_of(host: Column, suffixes: str = SUFFIX_PATTERN) -> Column:
    """The last two labels where they fit the pattern ``suffixes``, else the last one; an address is its own."""
    bare = bare_host(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(is_address(bare), bare).when(two.rlike(suffixes), two).otherwise(F.substring_index(two, ".", -1))


def domain_of(host: Column, suffixes: str = SUFFIX_PATTERN) -> Column:
    """The suffix and one label before it; an address is its own."""
    bare = bare_host(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(is_address(bare), bare).when(two.rlike(suffixes), F.substring_index(bare, ".", -3)).otherwise(two)


def last_labels(bare: Column, n: Column) -> Column:
    return F.call_function("substring_index", bare, F.lit("."), -n)


def registered_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts`` (host, ...; a row a host) with ``suffix`` and ``domain`` by a public suffix list.

    ``rules`` has a column ``rule``: suffixes of any number of labels, ``*.`` before those whose
    every child is one, ``!`` before exceptions from such. The last labels of a host, as many as
    the longest rule has, meet the rules as runs; an exception wins, then the longest rule, and
    without one the last label is the suffix. Rules are lower case. Addresses are their own.
    """
    kinds = rules.filter("rule is not null and rule <> ''").select(
        F.regexp_replace("rule", r"^(?:!|[*][.])", "").alias("run"), F.when(F.col("rule").startswith("!"), 2).when(F.col("rule").startswith("*."), 1).otherwise(0).alias("kind")
    ).distinct()
    longest = (kinds.agg(F.coalesce(F.max(F.size(F.split("run", "[.]"))), F.lit(1)).alias("most")).first()["most"]) + 1
    bare = bare_host(F.col("host"))
    count = F.size(F.split(F.substring_index(bare, ".", -(longest + 1)), "[.]"))
    named = hosts.withColumns({"__bare": bare, "__labels": count})
    runs = named.filter(~is_address(F.col("__bare"))).select("host", "__bare", "__labels", F.explode(F.sequence(F.lit(1), F.least(F.col("__labels"), F.lit(longest)))).alias("n"))
    met = runs.withColumn("run", last_labels(F.col("__bare"), F.col("n"))).join(kinds, "run")
    # labels that the suffix has: a wildcard takes one more where there is one, an exception one less
    fits = met.withColumn("size", F.when(F.col("kind") == 1, F.when(F.col("__labels") > F.col("n"), F.col("n") + 1)).when(F.col("kind") == 2, F.col("n") - 1).otherwise(F.col("n")))
    best = fits.filter("size > 0").groupBy("host").agg(F.max(F.struct((F.col("kind") == 2).alias("exception"), "size")).alias("best")).select("host", F.col("best.size").alias("__size"))
    size = F.coalesce("__size", F.lit(1))
    placed = named.join(best, "host", "left")
    last = lambda n: F.when(is_address(F.col("__bare")), F.col("__bare")).otherwise(last_labels(F.col("__bare"), n))
    return placed.withColumns({"suffix": last(size), "domain": last(size + 1)}).drop("__bare", "__labels", "__size")


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, action) of the longest rule that fits, null where none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        action = F.when(fits, F.lit(kind)).otherwise(action)
    return text, action


def level_strength(counts: DataFrame) -> DataFrame:
    """One row: mean rate and prior strength of groups with counts (n, good)."""
    p = F.col("good") / F.col("n")
    sums = counts.filter("n > 0").agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total"),
        F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("total_good"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("n_sq"),
        F.sum(F.col("good") * p).alias("good_p"),
    )
    rate = F.col("total_good") / F.col("total")
    between = (F.col("good_p") - F.col("total") * rate * rate) / (F.col("groups") - 1)
    within = (F.col("total_good") - F.col("good_p")) / (F.col("total") - F.col("groups"))
    size = (F.col("total") - F.col("n_sq") / F.col("total")) / (F.col("groups") - 1)
    sound = (F.col("groups") > 1) & (F.col("total") > F.col("groups"))
    out = sums.select(
        F.when(F.col("total") > 0, rate).otherwise(0.5).alias("rate"),
        F.when(sound, between).alias("between"),
        F.when(sound, within).alias("within"),
        F.when(sound, size).alias("size"),
    )
    spread = F.col("between") - F.col("within")
    strength = F.try_divide(F.col("size") * F.col("within"), spread)
    return out.select(
        "rate",
        F.when(spread.isNull() | (spread <= 0), STRENGTH[1]).otherwise(F.least(F.greatest(strength, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).alias("strength"),
    )


def host_reputation(hosts: DataFrame, z: float = Z, suffixes: str | DataFrame = SUFFIX_PATTERN) -> DataFrame:
    """Posterior of the good rate per host from counts ``host, n, good`` (n may be 0).

    ``suffixes`` is the pattern of two-label public suffixes, or a public suffix list as a
    table (``registered_domains``); the default knows country registries and some hosting
    domains. Ports and user names are no part of domain and suffix. Returns host, mean,
    bound. Empty input gives no rows.
    """
    own = hosts.select("host", "n", "good")
    named = registered_domains(own, suffixes) if isinstance(suffixes, DataFrame) else own.withColumns({"suffix": suffix_of(F.col("host"), suffixes), "domain": domain_of(F.col("host"), suffixes)})
    domains = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    def shrunk(level: DataFrame, counts: DataFrame, prior: Column, name: str) -> DataFrame:
        own = level_strength(counts).select(F.col("rate").alias("rate_all"), F.col("strength").alias("s"))
        return level.crossJoin(F.broadcast(own)).withColumn(name, (F.col("good") + F.col("s") * prior) / (F.col("n") + F.col("s")))

    top = shrunk(suffixes, suffixes, F.col("rate_all"), "suffix_mean").select("suffix", "suffix_mean")
    middle = shrunk(domains.join(top, "suffix"), domains, F.col("suffix_mean"), "domain_mean").select("domain", "domain_mean")
    low = shrunk(named.join(middle, "domain"), named, F.col("domain_mean"), "mean")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("s") + 1))
    return low.select("host", F.round("mean", 12).alias("mean"), F.round(F.col("mean") - z * sd, 12).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, least: float = LEAST, z: float = Z, suffixes: str | DataFrame = SUFFIX_PATTERN) -> DataFrame:
    """Verdict for every row of ``pages`` (page_id, url).

    ``outcomes`` (host, good 0/1) are labelled pages; null outcomes do not count. A null
    url, or one without ``://``, has empty host and path and is judged as host ''.
    Repeated rows are judged each. Returns page_id, host, path, rule, verdict, bound.
    """
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    seen = parsed.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("good"), F.count("*").alias("pages"))
    counted = outcomes.filter("good is not null and host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.lit(0).cast("long").alias("pages"))
    hosts = cut(seen.unionByName(counted).groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("pages").alias("pages")))
    known = cut(host_reputation(hosts, z, suffixes).join(hosts.select("host", F.col("pages").alias("rows_of_key")), "host"))
    judged = join_by_key(parsed, known, "host", hosts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0])
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") >= least, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"), "bound")


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcome of each page whose url path names a labelled document: ``/<lang>/<doc_id>``."""
    named = F.regexp_extract(url_path(F.col("url")), r"^/[a-z]+/([0-9]{1,18})(?:[./]|$)", 1)
    linked = pages.select(url_host(F.col("url")).alias("host"), F.when(named != "", named).cast("long").alias("doc_id"))
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    return linked.filter("doc_id is not null").join(marks, "doc_id").select("host", "good")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, labelled_outcomes(pages, table(spark, sf_dir, "labels"))).drop("bound")


_FITS = "\n".join(
    f"    when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{a}|{h + p}'"
    for a, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
)


def _strength_sql(source: str) -> str:
    return f"""
  (select case when total > 0 then total_good / total else 0.5 end as rate,
    case when groups > 1 and total > groups then
      case when (good_p - total_good * total_good / total) / (groups - 1) - (total_good - good_p) / (total - groups) <= 0 then {STRENGTH[1]}
      else least(greatest(((total - n_sq / total) / (groups - 1)) * ((total_good - good_p) / (total - groups))
        / ((good_p - total_good * total_good / total) / (groups - 1) - (total_good - good_p) / (total - groups)), {STRENGTH[0]}), {STRENGTH[1]}) end
    else {STRENGTH[1]} end as s
   from (select count(*) as groups, coalesce(sum(n), 0)::double as total, coalesce(sum(good), 0)::double as total_good,
     sum(n * n)::double as n_sq, sum(good * good / n::double) as good_p from {source} where n > 0))"""


SQL = f"""
with parsed as (
  select page_id,
    coalesce(translate(regexp_extract(url, '{URL}', 1), '{UPPER}', '{LOWER}'), '') as host,
    coalesce(regexp_extract(url, '{URL}', 2), '') as path
  from pages),
outcome as (
  select p.host, l.good from (
    select host, try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})(?:[./]|$)', 1), '') as bigint) as doc_id from parsed) p
  join (select doc_id, max(quality) as good from labels where doc_id is not null and quality is not null group by doc_id) l using (doc_id)),
hosts as (
  select p.host, coalesce(any_value(o.n), 0) as n, coalesce(any_value(o.good), 0) as good,
    regexp_extract(p.host, '{NAME}', 1) as bare, regexp_extract(bare, '([^.]*\\.)?[^.]*$') as two, regexp_matches(two, '{SUFFIX_PATTERN}') as public,
    case when public then two else regexp_extract(two, '[^.]*$') end as suffix,
    case when public then regexp_extract(bare, '([^.]*\\.)?([^.]*\\.)?[^.]*$') else two end as domain
  from parsed p left join (select host, count(*) as n, sum(good) as good from outcome group by host) o using (host) group by p.host),
domains as (select domain, suffix, sum(n) as n, sum(good) as good from hosts group by domain, suffix),
suffixes as (select suffix, sum(n) as n, sum(good) as good from domains group by suffix),
top as (select suffix, (good + s * rate) / (n + s) as suffix_mean from suffixes, {_strength_sql("suffixes")}),
middle as (select domain, (good + s * suffix_mean) / (n + s) as domain_mean from domains join top using (suffix), {_strength_sql("domains")}),
low as (select host, n, s, (good + s * domain_mean) / (n + s) as mean from hosts join middle using (domain), {_strength_sql("hosts")}),
judged as (select host, round(mean - {Z} * sqrt(mean * (1 - mean) / (n + s + 1)), 12) as bound from low),
ruled as (
  select page_id, host, path, bound, case
{_FITS}
    end as fit
  from parsed left join judged using (host))
select page_id, host, path, split_part(fit, '|', 2) as rule,
  case when fit is not null then split_part(fit, '|', 1) when bound >= {LEAST} then 'allow' else 'block' end as verdict
from ruled"""
