"""URL filters: explicit rules, then host reputation by empirical Bayes.

Labelled pages are counted per host, registered domain and suffix. Each level's rates are shrunk
towards the posterior of the level above, and a host is blocked when even the lower bound of
its posterior rate of bad pages is too high.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrid.llm.common import ascii_lower, stored
from crashgrid.llm.quality_rules import beta_prior

# Fixed values of the contract: (verdict, host and path prefix).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

# Suffixes of more than one label under which names are registered, next to single labels.
DEEP_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.za", "com.mx")

MAX_BAD = 0.5
Z = 1.645


def host_of(url: Column) -> Column:
    """Lower-cased text between the first ``://`` and ``/``, ``?``, ``#``; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct ``(rule, verdict)``, or null.

    A rule fits its host and every subdomain if the path starts with the rule's path. The list is
    short and becomes one expression; of equally long rules the later one in code point order wins.
    """
    fitting = []
    for verdict, rule in rules:
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + prefix)
        entry = F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fitting.append(F.when(fits, entry))
    return F.array_max(F.array_compact(F.array(*fitting)))


def suffix_of(host: Column) -> Column:
    deep = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    return F.when((F.size(F.split(host, r"\.")) > 2) & deep.isin(*DEEP_SUFFIXES), deep).otherwise(
        F.substring_index(host, ".", -1)
    )


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and the label before it."""
    labels = F.size(F.split(suffix_of(host), r"\.")) + 1
    names = F.split(host, r"\.")
    return F.when(F.size(names) < labels, host).otherwise(F.array_join(F.slice(names, -labels, labels), "."))


def host_reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """Posterior of each host: adds ``bad_rate`` and ``bad_bound`` (lower bound) to the counts.

    ``hosts`` has one row per host with ``host, n, bad``; hosts without a label get what is known
    of their domain, or of their suffix. The prior of a level is centred on the posterior of the
    level above; its strength comes from the spread of the level's own rates.
    """
    rows = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = stored(rows.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    mean, top = beta_prior(suffixes, "bad")
    _, middle = beta_prior(domains, "bad")
    _, low = beta_prior(hosts, "bad")

    def shrunk(centre: Column, strength: float) -> Column:
        return (F.col("bad") + centre * strength) / (F.col("n") + strength)

    suffixes = suffixes.select("suffix", shrunk(F.lit(mean), top).alias("_suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("_suffix_rate"), middle).alias("_domain_rate"))
    rate, trials = F.col("bad_rate"), F.col("n") + low + 1
    return (
        rows.join(domains, "domain")
        .withColumn("bad_rate", shrunk(F.col("_domain_rate"), low))
        .withColumn("bad_bound", F.greatest(F.lit(0.0), rate - z * F.sqrt(rate * (1 - rate) / trials)))
        .select("host", "domain", "suffix", "n", "bad", "bad_rate", "bad_bound")
    )


def url_filter(
    pages: DataFrame,
    outcomes: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    max_bad: float = MAX_BAD,
    z: float = Z,
) -> DataFrame:
    """Verdict on every url: ``page_id, host, path, rule, verdict, bad_rate, bad_bound``.

    ``outcomes`` (``page_id, bad``) labels some pages; a page with several labels is bad if one
    says so, null labels do not count. A page whose url names no host has no reputation and is
    allowed. Repeated pages each keep their row and count each; an empty table gives no rows. Only
    hosts are shuffled between the levels; joins of pages with hosts are plain, so that Spark
    broadcasts a small side or splits a crowded host.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels = outcomes.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("_bad"))
    rows = stored(rows.join(labels, "page_id", "left"), "urls")
    hosts = rows.where(F.col("host") != "").groupBy("host").agg(
        F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad")
    )
    known = stored(host_reputation(stored(hosts, "hosts"), z).select("host", "bad_rate", "bad_bound"), "reputation")
    judged = rows.drop("_bad").join(known, "host", "left")
    fit = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return judged.withColumn("_fit", fit).select(
        "page_id", "host", "path", F.col("_fit.rule").alias("rule"),
        F.coalesce("_fit.verdict", own).alias("verdict"), "bad_rate", "bad_bound",
    )
