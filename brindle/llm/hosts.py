"""URL filter by host reputation: empirical Bayes over suffix, registered domain and host, in DataFrame functions only.

Labelled pages are trials of their host, bad or not. A host's share of bad pages gets a beta prior whose mean is the
share of the rest of its registered domain, shrunk towards the rest of the domain's suffix, shrunk towards all other
suffixes. So a prior never counts the host's own pages, and a host without labels is judged by its relatives. The
weight of each prior, in pages, is estimated from the data: the overdispersion of the children around their parent
(moments of the beta-binomial law), summed over all parents of the level. A page is blocked if the lower posterior
bound of its host, mean less z standard deviations, exceeds max_bad: at z = 3 the true share is above that bound with
a probability of 90 % at least, whatever the shape of the posterior (Cantelli), and 99.9 % where it is near normal.

Rules come first: a rule (host, path, verdict) fits its host and all subdomains where the path starts with the rule's,
and the longest rule wins. Rules are written by people and become expressions, so they are no table and no join.

Only hosts are aggregated and joined, with partial sums before every shuffle; the join of pages with their hosts is a
sort-merge join whose page side adaptive execution can split, as one host may hold a third of all pages.

Defined results: a null url, or one without ://, has an empty host and path and shares the reputation of all such; a
port or a user stays in the host, but not in its domain; addresses of digits and single labels are their own domain
with an empty suffix; a null page_id has no label; a page with several labels is one trial, bad if any is; repeated
pages each count; without any label nothing is known and nothing is blocked but by rules; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import written

#: Public suffixes of two labels that are told apart by default; a parameter of reputations().
WIDE_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: A prior weighs between 1 and 1,000 pages, and 10 where no parent has two children with labels.
_SPREAD_MOST, _SPREAD_LEAST, _SPREAD_UNKNOWN = 1 / 2, 1 / 1001, 1 / 11


def lowered(c: Column) -> Column:
    """A-Z lower-cased, no other letters."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what stands after the first ://, up to / ? # or the end. Path: on from there, up to ? # or the end."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return lowered(F.regexp_extract(text, "://([^/?#]*)", 1)), F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1)


def suffix_and_domain(host: Column, wide_suffixes: tuple[str, ...] = WIDE_SUFFIXES) -> tuple[Column, Column]:
    """The public suffix and the registered domain under it."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(bare, "\\.", -1)
    alone = (F.size(labels) < 2) | bare.rlike("^[0-9.]+$")
    wide = (F.size(labels) > 2) & F.array_join(F.slice(labels, -2, 2), ".").isin(*wide_suffixes) if wide_suffixes else F.lit(False)
    n = F.when(wide, 2).otherwise(1)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), F.size(labels)), ".")
    return F.when(alone, "").otherwise(last(n)), F.when(alone, bare).otherwise(last(n + 1))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (its host and path joined, or null), and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for own, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        rule, verdict = F.when(fits, own + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _prior_weight(children: DataFrame, parent: str) -> float:
    """Pages that the parent's share is worth: from how far its children's shares lie beyond binomial chance."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    sums = children.filter("n > 0").groupBy(parent).agg(F.sum(k * k / n).alias("kk"), F.sum(n * n).alias("nn"), F.sum(n).alias("n"), F.sum(k).alias("k"), (F.count(F.lit(1)) - 1).alias("free"))
    share = F.col("k") / F.col("n")
    mixed = sums.filter("free > 0 and k > 0 and k < n")
    beyond = (F.col("kk") - F.col("k") * share) / (share * (1 - share)) - F.col("free")
    total = mixed.agg(F.sum(beyond), F.sum(F.col("n") - F.col("nn") / F.col("n") - F.col("free"))).first()
    spread = total[0] / total[1] if total[1] else _SPREAD_UNKNOWN
    return 1 / min(_SPREAD_MOST, max(_SPREAD_LEAST, spread)) - 1


def reputations(pages: DataFrame, labels: DataFrame, *, z: float = 3.0, wide_suffixes: tuple[str, ...] = WIDE_SUFFIXES) -> DataFrame:
    """host, n, k (labelled pages, and bad ones among them), bad_share (posterior mean), bound (lower), of every host.

    pages: (page_id, host). labels: (page_id, bad).
    """
    bad = labels.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    hosts = pages.join(bad, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    suffix, domain = suffix_and_domain(F.col("host"), wide_suffixes)
    hosts = written(hosts.select("host", "n", "k", suffix.alias("suffix"), domain.alias("domain")), "hosts")
    domains = written(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    all_n, all_k = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    of_suffix = _prior_weight(suffixes.withColumn("all", F.lit(0)), "all")
    of_domain, of_host = _prior_weight(domains, "suffix"), _prior_weight(hosts, "domain")

    others = (F.lit(float(all_k)) - F.col("s.k") + 1) / (F.lit(float(all_n)) - F.col("s.n") + 2)  # one bad and one good page more, so that no share is 0 or 1
    rest_of_suffix = (F.col("s.k") - F.col("d.k") + of_suffix * others) / (F.col("s.n") - F.col("d.n") + of_suffix)
    rest_of_domain = (F.col("d.k") - F.col("h.k") + of_domain * rest_of_suffix) / (F.col("d.n") - F.col("h.n") + of_domain)
    joined = hosts.alias("h").join(domains.alias("d"), (F.col("h.suffix") == F.col("d.suffix")) & (F.col("h.domain") == F.col("d.domain"))).join(suffixes.alias("s"), F.col("h.suffix") == F.col("s.suffix"))
    mean = joined.select("h.host", "h.n", "h.k", ((F.col("h.k") + of_host * rest_of_domain) / (F.col("h.n") + of_host)).alias("bad_share"))
    sd = F.sqrt(F.col("bad_share") * (1 - F.col("bad_share")) / (F.col("n") + of_host + 1))
    return mean.withColumn("bound", F.when(F.lit(all_n > 0), F.col("bad_share") - z * sd))


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str, str]] = (),
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    max_bad: float = 0.5,
    z: float = 3.0,
    wide_suffixes: tuple[str, ...] = WIDE_SUFFIXES,
) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), bad_share and bound of the host, for every page.

    labels: (page_id, bad). rules: (host, path, verdict).
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = reputations(rows.select("page_id", "host"), labels.select(F.col("page_id").cast("long").alias("page_id"), "bad"), z=z, wide_suffixes=wide_suffixes)
    known = written(known.select("host", "bad_share", "bound"), "reputations")
    rule, verdict = rule_of(F.col("host"), F.col("path"), list(rules))
    by_host = F.when(F.coalesce(F.col("bound") > max_bad, F.lit(False)), "block").otherwise("allow")
    joined = rows.join(known.hint("merge"), "host")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "bad_share", "bound")
