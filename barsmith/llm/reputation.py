"""URL filters with empirical-Bayes host reputation.

Fixed rules come first; the longest that fits decides.  Every other page goes
by its host: labelled outcomes are counted per host, registered domain and
suffix, and each level is shrunk towards the level above it through a beta
prior whose strength is estimated from the data (how much children differ
beyond binomial noise).  A host is blocked if the lower bound of its posterior
share of bad pages is over ``max_bad``, so a host with little evidence follows
its domain and suffix.

Rules and posteriors are attached to the table of hosts, and pages meet it in
one join; hosts are counted with map-side aggregation.  Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import cut, passes_columns, small
from barsmith.llm.lines import lower_ascii

#: Suffixes of two labels under which names are registered.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp",
            "co.nz", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.tr", "com.ar")
LEVELS = ("suffix", "domain", "host")


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    two = F.substring_index(host, ".", -2)
    deep = two.isin(*SUFFIXES)
    return (F.when(deep, F.substring_index(host, ".", -3)).otherwise(two),
            F.when(deep, two).otherwise(F.substring_index(host, ".", -1)))


def with_rules(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``rules``: those whose host is the host or above it, longest first.
    ``rules`` are ``(verdict, "host/path")``; a list, so its size is known."""
    spark = hosts.sparkSession
    rows = [(i, v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for i, (v, r) in enumerate(rules)]
    table = spark.createDataFrame(rows, "place int, verdict string, rule string, above string, start string")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    table = F.broadcast(table) if len(rules) <= 10_000 else table
    fits = hosts.select("host", F.explode(F.array_distinct(above)).alias("above")).join(table, "above")
    key = F.struct((-F.length("rule")).alias("a"), (-F.length("above")).alias("b"), "place", "rule", "start", "verdict")
    fits = fits.groupBy("host").agg(F.sort_array(F.collect_list(key)).alias("rules"))
    return hosts.join(fits, "host", "left")


def reputation(hosts: DataFrame, z: float) -> DataFrame:
    """Adds ``bad_mean`` and ``bad_low`` to hosts with ``n, bad``: posterior
    mean and lower bound of the share of bad pages."""
    domain, suffix = levels(F.col("host"))
    h = cut(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    total = h.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    start = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)
    above = None
    for i, level in enumerate(LEVELS):
        names = ["suffix", "domain", "host"][:i + 1]
        part = h.groupBy(*names).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        part = part.withColumn("m", F.lit(start)) if above is None else part.join(
            above.select(*names[:-1], F.col("mean").alias("m")), names[:-1])
        part = cut(part)
        # children scatter around their parent's mean by 1 + (n - 1) rho each
        share = F.col("bad") / F.col("n")
        s = part.where("n > 0").agg(
            F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"),
            F.sum(F.col("n") * (share - F.col("m")) ** 2 / (F.col("m") * (1 - F.col("m")))).alias("s")).first()
        rho = (s["s"] - s["c"]) / (s["n"] - s["c"]) if s["c"] and s["n"] > s["c"] else 0.0
        k = 1.0 / min(max(rho, 1e-3), 0.5) - 1.0
        above = part.withColumn("k", F.lit(k)).withColumn("mean", (F.col("m") * k + F.col("bad")) / (F.lit(k) + F.col("n")))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("k") + F.col("n") + 1))
    return above.select("host", "n", "bad", F.col("mean").alias("bad_mean"), (F.col("mean") - F.lit(z) * spread).alias("bad_low"))


@passes_columns
def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], *, url: str = "url",
          max_bad: float = 0.3, z: float = 1.645) -> DataFrame:
    """Adds ``host, path, rule, verdict, bad_low`` to the pages.

    ``outcomes`` has ``url`` and ``bad`` (boolean) per labelled page; a null
    ``bad`` is no label.  Null urls and such without ``://`` have an empty host
    and path, fit no rule, and are judged by the empty host's own record.
    Repeated rows stay and count.  Columns of the added names are replaced, all
    others passed on."""
    host, path = parse_url(F.col(url))
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "bad_low")]
    p = pages.select(*names, host.alias("__host"), path.alias("__path"))
    o = outcomes.where(F.col("bad").isNotNull()).select(parse_url(F.col("url"))[0].alias("host"), F.col("bad").cast("int").alias("bad"))
    seen = p.groupBy(F.col("__host").alias("host")).agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    hosts = o.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")).unionByName(seen)
    hosts = hosts.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    table = cut(with_rules(reputation(hosts, z), rules).select(
        F.col("host").alias("__of"), F.col("rules").alias("__rules"), F.col("bad_low").alias("__low")))
    fits = F.filter("__rules", lambda r: F.startswith(F.col("__path"), r["start"]))
    out = p.join(small(table), F.col("__host") == F.col("__of"), "left").withColumn("__fit", F.when(F.size(fits) > 0, fits[0]))
    by_host = F.when(F.col("__low") > max_bad, "block").otherwise("allow")
    return out.select(*names, F.col("__host").alias("host"), F.col("__path").alias("path"),
                      F.col("__fit.rule").alias("rule"), F.coalesce(F.col("__fit.verdict"), by_host).alias("verdict"),
                      F.col("__low").alias("bad_low"))
