"""Which extraction rule a page URL belongs to."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from pricetrail.functions import fixed, quoted, urls


@dataclass(frozen=True)
class Rule:
    """One entry of the rule list: the first rule whose predicate holds takes the page."""

    name: str
    shop_name: str
    shop_base_url: str
    host_part: str
    path_part: str = ""
    path_prefix: str = ""

    def supports(self, page_url: str) -> str:
        return (
            f"contains({urls.host(page_url)}, {quoted(self.host_part)})"
            f" AND contains({urls.path(page_url)}, {quoted(self.path_part)})"
            f" AND startswith({urls.path(page_url)}, {quoted(self.path_prefix)})"
        )


PRODUCT_RULES = [Rule("magnit_product", *fixed.MAGNIT, fixed.MAGNIT_HOST)]
CATALOG_RULES = [
    Rule("magnit_catalog", *fixed.MAGNIT, fixed.MAGNIT_HOST, path_part=fixed.CATALOG_PATH),
    Rule("pyaterochka_catalog", *fixed.PYATEROCHKA, fixed.PYATEROCHKA_HOST, path_part=fixed.CATALOG_PATH),
    Rule(
        "perekrestok_catalog",
        *fixed.PEREKRESTOK,
        fixed.PEREKRESTOK_HOST,
        path_prefix=fixed.PEREKRESTOK_CATALOG_PREFIX,
    ),
]
RULES = {"product": PRODUCT_RULES, "catalog": CATALOG_RULES}


def matching_rule(page_url: str, rules: list[Rule]) -> str:
    """Name of the first rule that supports the URL, else null; a CASE, so no shuffle."""
    cases = " ".join(f"WHEN {rule.supports(page_url)} THEN {quoted(rule.name)}" for rule in rules)
    return f"CASE {cases} END"


def of_rule(rule: str, rules: list[Rule], field: str) -> str:
    """``field`` of a rule given by name; null for no rule."""
    cases = " ".join(f"WHEN {quoted(r.name)} THEN {quoted(getattr(r, field))}" for r in rules)
    return f"CASE {rule} {cases} END"


def route(pages: DataFrame, kind: str, rules: list[Rule] | None = None) -> DataFrame:
    """Pages with ``rule`` and ``shop_base_url``; pages no rule takes keep nulls there."""
    rules = rules or RULES[kind]
    routed = pages.selectExpr("*", f"{matching_rule('page_url', rules)} AS rule")
    return routed.selectExpr("*", f"{of_rule('rule', rules, 'shop_base_url')} AS shop_base_url")
