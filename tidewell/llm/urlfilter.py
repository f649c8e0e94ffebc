"""URL filters by a sort-merge range join, in DataFrame operations only.

A host becomes a canonical key: its labels reversed, each closed by a dot (``www.example.com`` -> ``com.example.www.``).
A rule's host then stands for the interval of keys that start with the rule's key: the host and all its subdomains.
Such intervals are nested or apart, so a sweep over hosts and interval starts in one sorted order needs a stack of
active rules only. In a window that stack is the chain of the last interval that was opened, with the members that are
closed by then (they no longer prefix the host's key) taken off.

Hosts are made distinct before the sweep, so one host with a third of all pages is one row in it. The sweep runs side by
side in ranges: the first two labels of the key, and for a range with many hosts a salt, each with its own copy of the rules.
On the way back to the pages, hosts with more than one page in 4,096 are dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import free_names, salted_join, written

#: Host, path prefix and verdict of the rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Verdict of a url that no rule fits.
DEFAULT = "allow"
HOSTS_A_RANGE = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> F.Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: str) -> F.Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> F.Column:
    """What follows the first ``://``; nothing for null or where there is none."""
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: F.Column) -> F.Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _top(key: str, labels: int) -> F.Column:
    return F.substring_index(F.substring(F.col(key), F.lit(1), F.length(key) - 1), ".", labels)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """The rules as a table of literals: no row of it passes through a Python worker."""
    if not rules:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS verdict WHERE false")
    row = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*row)))


def _chains(rules: DataFrame) -> DataFrame:
    """(key, chain): for every rule host, the rules of that host and of all hosts above it."""
    nodes = (
        rules.select(
            host_key(F.col("host")).alias("key"),
            F.struct(
                F.length(F.concat("host", "path")).alias("long"), F.length("host").alias("host_long"),
                F.concat("host", "path").alias("rule"), "path", "verdict",
            ).alias("r"),
        )
        .groupBy("key")
        .agg(F.sort_array(F.collect_set("r")).alias("own"))
    )
    # a host above has a key of the first labels: joined by equality on each of a key's own prefixes
    depth = F.size(F.split("key", r"\.")) - 1
    above = nodes.select("key", F.explode(F.sequence(F.lit(1), depth)).alias("n"))
    above = above.select("key", F.concat(F.expr("substring_index(key, '.', n)"), F.lit(".")).alias("up"))
    held = nodes.select(F.col("key").alias("up"), "own")
    return above.join(held, "up").groupBy("key").agg(F.collect_list(F.struct(F.col("up").alias("key"), "own")).alias("chain"))


def sweep(hosts: DataFrame, rules: DataFrame, hosts_a_range: int = HOSTS_A_RANGE) -> DataFrame:
    """(key) distinct -> (key, chain): the stack of rule intervals that hold each host."""
    chains = _chains(rules)
    hosts = hosts.withColumns({"_area": _top("key", 2), "_tld": _top("key", 1)})
    areas = hosts.groupBy("_area", "_tld").agg(F.count("*").alias("_n"))
    areas = areas.withColumn("_salts", F.ceil(F.col("_n") / hosts_a_range).cast("int"))
    salted = hosts.join(areas.select("_area", "_salts"), "_area").withColumn(
        "_salt", F.pmod(F.xxhash64("key"), F.col("_salts")).cast("int")
    )
    opens = chains.withColumns({"_area": _top("key", 2), "_tld": _top("key", 1)})
    # a rule on a whole top-level label opens every range below it; other rules open the range of their own area
    wide = opens.where(F.col("_area") == F.col("_tld")).drop("_area").join(areas, "_tld")
    narrow = opens.where(F.col("_area") != F.col("_tld")).drop("_tld").join(areas, "_area")
    starts = wide.select("key", "chain", "_area", "_salts").unionByName(narrow.select("key", "chain", "_area", "_salts"))
    starts = starts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    events = starts.select("_area", "_salt", "key", F.lit(0).alias("_kind"), "chain").unionByName(
        salted.select("_area", "_salt", "key", F.lit(1).alias("_kind"), F.lit(None).cast(chains.schema["chain"].dataType).alias("chain"))
    )
    order = Window.partitionBy("_area", "_salt").orderBy("key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    stack = F.last("chain", ignorenulls=True).over(order)
    return (
        events.withColumn("chain", stack)
        .where("_kind = 1")
        .select("key", F.filter("chain", lambda c: F.startswith(F.col("key"), c["key"])).alias("chain"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The longest rule that fits (host and path together; then the longer host, then the later text) decides;
    where none fits, ``rule`` is null and the verdict is ``default``. Null urls and such without ``://`` have an empty
    host and path, which no rule fits. Repeated rows stay; a column of one of the four names is replaced, and all others pass
    through; an empty table of pages or rules gives no rows or no rule.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    key, chain = free_names([*kept, "host", "path"], "key", "chain")
    parsed = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path")).withColumn(key, host_key(F.col("host")))
    hosts = written(parsed.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("_n")), "url-hosts")
    stacks = sweep(hosts.select("key"), rules).select(F.col("key").alias(key), F.col("chain").alias(chain))
    fits = F.flatten(F.transform(chain, lambda c: F.filter(c["own"], lambda r: F.startswith(F.col("path"), r["path"]))))
    best = F.array_max(fits)
    judged = salted_join(parsed, stacks, [key], hosts.select(F.col("key").alias(key), "_n"), F.monotonically_increasing_id())
    return judged.select(*kept, "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))
