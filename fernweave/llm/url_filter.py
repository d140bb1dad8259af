"""URL filters from dated lists: a temporal join.

Every dated entry of a domain holds from its time until the domain's next entry, which
makes validity intervals. A capture is evaluated against the entries of its host and of
all parent domains that are active when it was fetched: an as-of join on domain and time.
The most specific active entry decides.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fernweave.llm.store import stored

#: Entries up to which the whole list is broadcast (a domain has 253 characters at most).
BROADCAST_ENTRIES = 200_000
#: With a longer list, domains that at least one in HOT of all asked names are apart from the others.
HOT = 1_000

def host(url: Column) -> Column:
    """The lower-case host of a URL, without user, port or final dot; null if it has none."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    bare = F.regexp_replace(found, r"\.+$", "")
    return F.when(bare != "", bare)


def intervals(entries: DataFrame) -> DataFrame:
    """entries: domain, listed_at, action. Adds valid_to: the domain's next later time, null
    if none. Of entries of one domain and time the greatest action holds; rows without a
    domain or time say nothing."""
    own = entries.select(F.lower("domain").alias("domain"), "listed_at", "action").where("domain is not null and listed_at is not null")
    one = own.groupBy("domain", "listed_at").agg(F.max("action").alias("action"))
    return one.withColumn("valid_to", F.lead("listed_at").over(W.partitionBy("domain").orderBy("listed_at")))


def listed_names(suffixes: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The suffixes that may be listed, and the intervals, broadcast where they are few.

    A hot name is one of at least a HOT-th of the suffixes, so there are fewer than HOT of
    them: those among them without an entry go by a broadcast of bounded size. The others
    are spread well enough to be joined by name.
    """
    if held.count() <= BROADCAST_ENTRIES:
        return suffixes, F.broadcast(held)
    names = stored(suffixes.groupBy("domain").agg(F.count("*").alias("n")), "names")
    least = names.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n / HOT
    hot = names.where(F.col("n") >= least).select("domain")
    idle = stored(hot.join(held.select("domain"), "domain", "left_anti"), "idle")
    return suffixes.join(F.broadcast(idle), "domain", "left_anti").select(suffixes.columns), held


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """captures with host, n_active (active entries of the host and its parents), rule_domain
    and rule_action (of the most specific), and blocked (that action is "block").

    A URL without a host or a capture without a time has no active entry; an entry is active
    from its very instant on. Repeated captures are evaluated alike; columns named like the
    added ones are replaced; with an empty list nothing is blocked. Each pair of host and time
    is evaluated once, so a hot host costs one. A list that is too long to broadcast is joined
    by domain, but names that no entry has, as top-level domains mostly, never get there: the
    distinct names are compared with the list first, and the hot ones are looked up apart.
    """
    added = ["host", "n_active", "rule_domain", "rule_action", "blocked"]
    own = F.struct(*[F.col(f"`{c}`") for c in captures.columns if c not in added])
    named = captures.select(own.alias("_row"), host(F.col(url_col)).alias("host"), F.col(time_col).alias("_time"))
    asked = named.select("host", F.col("_time").alias("_at")).where("host is not null and _at is not null").distinct()
    parts = F.split("host", r"\.")
    depth = F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    suffixes = asked.select("host", "_at", depth.alias("_cut", "domain"))
    suffixes, held = listed_names(suffixes, stored(intervals(entries), "intervals"))
    active = suffixes.join(held, (suffixes.domain == held.domain) & (held.listed_at <= suffixes._at) & (held.valid_to.isNull() | (suffixes._at < held.valid_to)))
    found = active.groupBy("host", "_at").agg(
        F.count("*").alias("n_active"),
        F.min_by(F.struct(suffixes.domain.alias("domain"), "action"), "_cut").alias("_rule"),
    )
    rules = found.select(F.col("host").alias("_host"), "_at", "n_active", F.col("_rule.domain").alias("rule_domain"), F.col("_rule.action").alias("rule_action"))
    joined = named.join(rules, (F.col("host") == F.col("_host")) & (F.col("_time") == F.col("_at")), "left")
    return joined.select("_row.*", "host", F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"), "rule_domain", "rule_action", F.coalesce(F.col("rule_action") == "block", F.lit(False)).alias("blocked"))
