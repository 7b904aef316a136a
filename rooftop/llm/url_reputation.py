"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes are counted for each host, registered domain and public
suffix.  Small counts say little, so each level's rate is shrunk towards the
level above by a beta-binomial prior: the suffix towards all pages, the domain
towards its suffix, the host towards its domain.  A prior's strength is learnt
from the data at its level by moments: the more the true rates of its units
differ beyond chance, the weaker the pull.  A host is blocked if the lower
bound of its posterior bad rate is over the limit, that is, only on evidence;
a host without a label has what its domain says.  A unit's prior leaves out the
unit's own pages, so no page counts twice.

Explicit rules go first: a rule fits its host and all subdomains, if the path
starts with the rule's; the longest fitting rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, stash

# Second-level labels under which country domains are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path`` (from its slash) that a url must fit, and the verdict it then has."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next of ``/?#``, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL_PATTERN, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to ``?`` or ``#``; empty without a ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PATTERN, 2)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Position in ``rules`` of the longest fitting one, or null.

    Of rules of one length the one with the longer host wins, then a block.
    """
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), -len(rules[i].host),
                                                     rules[i].verdict != "block"))
    out = F.lit(None).cast("int")
    for i in reversed(order):
        r = rules[i]
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def reputation_keys(host: Column) -> tuple[Column, Column, Column]:
    """(host without user and port, registered domain, suffix); an address is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(:[0-9]*)?\.?$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    two = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(*SECOND_LEVEL)

    def last(k: int) -> Column:
        return F.when(two, F.substring_index(name, ".", -(k + 1))).otherwise(F.substring_index(name, ".", -k))

    address = name.rlike(r"^[0-9]+(\.[0-9]+){3}$") | name.contains("[")
    suffix = F.when(address, F.lit("(address)")).otherwise(last(1))
    domain = F.when(address, name).otherwise(last(2))
    return name, domain, suffix


# Suffix rules that a caller may give; they are sent to every task.
MAX_SUFFIX_RULES = 100_000


def _last_labels(n: Column) -> Column:
    return F.call_function("substring_index", F.col("host_key"), F.lit("."), (-n).cast("int"))


def with_suffixes(hosts: DataFrame, rules: Sequence[str]) -> DataFrame:
    """``hosts`` (host_key, ...) with ``domain`` and ``suffix`` by a table of public suffixes.

    Rules are written as in the public list: ``co.uk`` (a suffix), ``*.ck`` (every
    name under ck is one) and ``!www.ck`` (but this name is a domain).  An exception
    decides, else the longest rule that fits, else the last label.  A host that is
    a suffix itself is its own domain; so is an address.
    """
    rules = sorted({r.strip().lower().strip(".") for r in rules if r.strip()})
    if len(rules) > MAX_SUFFIX_RULES:
        raise ValueError(f"over {MAX_SUFFIX_RULES} suffix rules")
    table = [(r.lstrip("!").removeprefix("*."), 1 if r.startswith("!") else 0, -1 if r.startswith("!") else int(r.startswith("*.")))
             for r in rules]
    known = F.broadcast(hosts.sparkSession.createDataFrame(table, "rule string, exception int, more int"))
    labels = F.split("host_key", r"\.")
    ends = hosts.select("host_key", F.size(labels).alias("n")).distinct() \
        .select("host_key", "n", F.explode(F.sequence(F.lit(1), "n")).alias("j")) \
        .select("host_key", "n", "j", _last_labels(F.col("j")).alias("end"))
    length = F.col("j") + F.col("more")
    fits = ends.join(known, F.col("end") == F.col("rule")).filter(length <= F.col("n")) \
        .groupBy(F.col("host_key").alias("hk")).agg(F.max(F.struct("exception", length.alias("length")))["length"].alias("length"))
    address = F.col("host_key").rlike(r"^[0-9]+(\.[0-9]+){3}$") | F.col("host_key").contains("[")
    tail = F.coalesce("length", F.lit(1))
    return hosts.join(fits, F.col("host_key") == F.col("hk"), "left").withColumns({
        "suffix": F.when(address, F.lit("(address)")).otherwise(_last_labels(tail)),
        "domain": F.when(address, F.col("host_key")).otherwise(_last_labels(tail + 1))}) \
        .drop("hk", "length")


def _strength(groups: DataFrame, parent: Column, least: float, most: float) -> DataFrame:
    """One row: the prior's strength (pseudo-pages) by moments of the groups' counts around their prior means."""
    n, k = F.col("n"), F.col("k")
    var = n * parent * (1 - parent)
    over = F.sum(F.pow(k - n * parent, F.lit(2)) - var)
    room = F.sum(var * (n - 1))
    rho = F.least(F.greatest(F.try_divide(over, room), F.lit(1 / (1 + most))), F.lit(1 / (1 + least)))
    return groups.agg(F.coalesce(1 / rho - 1, F.lit(most)).alias("m"))


def _one(df: DataFrame) -> float:
    return float(df.first()[0])


def host_posteriors(outcomes: DataFrame, least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """(host key, domain, suffix, n, k, a, b): the beta posterior of each host's bad rate.

    ``outcomes(host_key, domain, suffix, n, k)``: counts of labelled pages and
    of bad ones for each host; a host without labels has zeros.  Without any
    label every prior mean is one half: one bad and one good page are added at
    the top.  A prior weighs as much as ``least`` to ``most`` pages, whatever the
    moments say.
    """
    hosts = outcomes
    all_n, all_k = (x or 0 for x in hosts.agg(F.sum("n"), F.sum("k")).first())

    def less(parent_k: Column, parent_n: Column, strength: float, mean: Column) -> Column:
        """The parent's rate without the unit's own n and k."""
        return (parent_k - F.col("k") + strength * mean) / (parent_n - F.col("n") + strength)

    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")) \
        .withColumn("mean", less(F.lit(float(all_k)), F.lit(float(all_n)), 2.0, F.lit(0.5)))
    ms = _one(_strength(suffixes.filter("n > 0"), F.col("mean"), least, most))
    suffixes = suffixes.select(F.col("suffix").alias("sx"), F.col("n").alias("sn"), F.col("k").alias("sk"), "mean")

    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")) \
        .join(suffixes, F.col("suffix") == F.col("sx")) \
        .withColumn("s_rate", less(F.col("sk"), F.col("sn"), ms, F.col("mean")))
    md = _one(_strength(domains.filter("n > 0"), F.col("s_rate"), least, most))
    domains = domains.select(F.col("suffix").alias("sx"), F.col("domain").alias("dx"), F.col("n").alias("dn"),
                             F.col("k").alias("dk"), "s_rate")

    placed = hosts.join(domains, (F.col("domain") == F.col("dx")) & (F.col("suffix") == F.col("sx"))) \
        .withColumn("d_rate", less(F.col("dk"), F.col("dn"), md, F.col("s_rate")))
    mh = _one(_strength(placed.filter("n > 0"), F.col("d_rate"), least, most))
    return placed.select("host_key", "domain", "suffix", "n", "k",
                         (F.col("k") + mh * F.col("d_rate")).alias("a"),
                         (F.col("n") - F.col("k") + mh * (1 - F.col("d_rate"))).alias("b"))


def lower_bound(a: Column, b: Column, z: float) -> Column:
    """The posterior mean less z posterior standard deviations."""
    return a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], id_col: str = "page_id",
               url_col: str = "url", limit: float = 0.5, z: float = 1.645, suffixes: Sequence[str] | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, bad_rate_low) for every row of ``pages``.

    ``outcomes(page, bad)`` has labelled pages, ``bad`` 0 or 1; a page labelled
    twice is bad if one label says so, null labels count nothing, labels of
    unknown pages are ignored.  A null url, or one without ``://``, has an empty
    host and path, and such rows share one reputation.  Repeated rows are
    judged, and counted, each; null ids have no label.  Other columns are ignored.
    ``suffixes``: a table of public suffixes (see ``with_suffixes``); without one,
    seven second-level labels under country domains count as suffixes.
    """
    url = col(url_col)
    name, domain, suffix = reputation_keys(F.col("host"))
    judged = pages.select(col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    judged = judged.withColumns({"host_key": name, "domain": domain, "suffix": suffix})
    labels = outcomes.filter(F.col("page").isNotNull() & F.col("bad").isNotNull()) \
        .groupBy("page").agg(F.max("bad").alias("bad"))
    hosts = stash(judged.join(labels, F.col("id") == F.col("page"), "left")
                  .groupBy("host_key", "domain", "suffix")
                  .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k")), "hosts")
    if suffixes is not None:
        hosts = stash(with_suffixes(hosts.drop("domain", "suffix"), suffixes), "host-suffixes")
    known = host_posteriors(hosts).select(F.col("host_key").alias("hk"),
                                          lower_bound(F.col("a"), F.col("b"), z).alias("bad_rate_low"))
    fits = fitting_rule(F.col("host"), F.col("path"), rules)
    texts = F.array(*(F.lit(r.text) for r in rules)) if rules else F.array().cast("array<string>")
    verdicts = F.array(*(F.lit(r.verdict) for r in rules)) if rules else F.array().cast("array<string>")
    out_id = id_col if fresh(("host", "path", "rule", "verdict", "bad_rate_low"), id_col) == id_col else f"{id_col}_"
    return judged.join(known, F.col("host_key") == F.col("hk")).withColumn("at", fits).select(
        F.col("id").alias(out_id), "host", "path", F.get(texts, F.col("at")).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("at")),
                   F.when(F.col("bad_rate_low") > limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "bad_rate_low")
