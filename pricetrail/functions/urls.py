"""URL parts, absolute links, product ids."""

from pricetrail.functions import fixed, group_or_null, quoted, removed

# scheme, authority and path by position; query and fragment are cut off.
_PATH = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_HOST = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)"
_EDGE_SPACE = r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$"


def host(url: str) -> str:
    """Host without user and port; empty when the URL has none."""
    return f"coalesce(regexp_extract({url}, {quoted(_HOST)}, 1), '')"


def path(url: str) -> str:
    """Path without query and fragment; empty when the URL has none."""
    return f"coalesce(regexp_extract({url}, {quoted(_PATH)}, 1), '')"


def absolute(href: str, page_url: str, origin: str) -> str:
    """``href`` as an absolute URL: root-relative on ``origin``, other relative below the page URL."""
    return (
        f"CASE WHEN startswith({href}, 'http://') OR startswith({href}, 'https://') THEN {href}"
        f" WHEN startswith({href}, '/') THEN concat(trim(TRAILING '/' FROM {origin}), {href})"
        f" ELSE concat(trim(TRAILING '/' FROM {page_url}), '/', trim(LEADING '/' FROM {href})) END"
    )


def page_origin(page_url: str) -> str:
    return f"concat('https://', {host(page_url)})"


def trimmed_href(href: str) -> str:
    return removed(href, _EDGE_SPACE)


def is_usable_href(href: str) -> str:
    """False for an empty href and for a mere fragment."""
    return f"({href} <> '' AND NOT startswith({href}, '#'))"


def magnit_catalog_id(url: str) -> str:
    return group_or_null(url, fixed.MAGNIT_CATALOG_ID)


def magnit_product_id(url: str) -> str:
    return group_or_null(url, fixed.MAGNIT_PRODUCT_ID)


def perekrestok_id(url: str) -> str:
    return group_or_null(path(url), fixed.PEREKRESTOK_ID)


def is_magnit_product(url: str) -> str:
    return f"contains({path(url)}, {quoted(fixed.MAGNIT_PRODUCT_PATH)})"


def is_perekrestok_product(url: str) -> str:
    return f"rlike({path(url)}, {quoted(fixed.PEREKRESTOK_PRODUCT_PATH)})"
