"""Routing by a table of rules: thousands of them, changed without code.

A rule takes pages whose host is its ``host`` or a subdomain of it, and whose path is its ``path`` or lies below it; an
empty path takes all. Of several the one with the least ``priority`` wins, then the one with the longer host, the
longer path, and the lesser name. Hosts and paths become keys: a URL has one key for each suffix of its host with each prefix
of its path, and these meet the rules in an equi-join.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.functions import urls

#: Columns of a table of rules.
RULES = "rule string, shop_base_url string, host string, path string, priority int"
_FIELDS = ["rule", "shop_base_url", "priority"]
#: Priority of a rule without one.
_LEAST = 2**31 - 1


def _clean_path(path: str) -> str:
    """Without slashes at its ends, repeated ones put together."""
    return f"trim(BOTH '/' FROM regexp_replace({path}, '/+', '/'))"


def clean_host(host: str) -> str:
    return f"trim(BOTH '.' FROM lower({host}))"


def host_suffixes(host: str) -> str:
    """The host and the domains it lies in: ``a.b.c``, ``b.c``, ``c``; none for an empty host."""
    labels = f"split({host}, '[.]')"
    return (
        f"CASE WHEN {host} = '' THEN array() ELSE"
        f" transform(sequence(1, size({labels})), i -> array_join(slice({labels}, i, size({labels})), '.')) END"
    )


def path_prefixes(path: str) -> str:
    """The path and the folders it lies in, as segments: ``a/b``, ``a`` and the empty one."""
    parts = f"split({path}, '/')"
    return (
        f"CASE WHEN {path} = '' THEN array('') ELSE"
        f" transform(sequence(0, size({parts})), i -> array_join(slice({parts}, 1, i), '/')) END"
    )


def _keyed(rules: DataFrame) -> DataFrame:
    """One rule for each host and path; rules without a name or a host take nothing."""
    found = rules.where("rule IS NOT NULL").selectExpr(
        f"{clean_host('host')} AS host", _clean_path("coalesce(path, '')") + " AS path", *_FIELDS
    )
    best = F.min(F.struct(F.coalesce("priority", F.lit(_LEAST)).alias("priority"), "rule", "shop_base_url"))
    return found.where("host <> ''").groupBy("host", "path").agg(best.alias("found"))


def route_urls(page_urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_url, rule, shop_base_url) of the distinct URLs that a rule takes.

    Paths longer than any rule's have no more keys than the longest rule has segments, and hosts likewise.
    """
    keyed = _keyed(rules)
    deepest = keyed.agg(
        F.coalesce(F.max(F.size(F.split("path", "/"))), F.lit(0)).alias("segments"),
        F.coalesce(F.max(F.size(F.split("host", "[.]"))), F.lit(0)).alias("labels"),
    ).first()
    parts = page_urls.select("page_url").where("page_url IS NOT NULL").distinct().selectExpr(
        "page_url", f"{clean_host(urls.host('page_url'))} AS _host", f"{_clean_path(urls.path('page_url'))} AS _path"
    )
    # No rule's key is longer, so the keys of a URL are bounded by the rules and not by its own length.
    parts = parts.withColumns(
        {
            "_host": F.substring_index("_host", ".", -deepest["labels"]) if deepest["labels"] else F.lit(""),
            "_path": F.substring_index("_path", "/", deepest["segments"]) if deepest["segments"] else F.lit(""),
        }
    )
    keys = parts.selectExpr("page_url", f"explode({host_suffixes('_host')}) AS host", "_path")
    keys = keys.selectExpr("page_url", "host", f"explode({path_prefixes('_path')}) AS path").distinct()
    ranked = F.struct(
        F.col("found.priority").alias("priority"),
        (-F.length("host")).alias("h"),
        (-F.length("path")).alias("p"),
        F.col("found.rule").alias("rule"),
        F.col("found.shop_base_url").alias("shop_base_url"),
    )
    best = keys.join(keyed, ["host", "path"]).groupBy("page_url").agg(F.min(ranked).alias("best"))
    return best.select("page_url", "best.rule", "best.shop_base_url")


def route_by_table(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages with ``rule`` and ``shop_base_url``, nulls where no rule takes them; all pages stay, repeated ones too.

    Distinct URLs are routed, so bodies are in the last join only; there a URL with very many pages is on the left, which
    adaptive execution splits.
    """
    return pages.join(route_urls(pages, rules), "page_url", "left").select(*pages.columns, "rule", "shop_base_url")
