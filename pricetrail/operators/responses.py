"""Rules over captured network responses: matching, block detection, diagnostics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.functions import fixed, quoted
from pricetrail.operators.routing import Rule, matching_rule

PAGE = ["page_url", "fetched_at"]
# Network lines come behind the head lines of a page's report.
_NETWORK_LINES_FROM = 1000


def _contains_any(text: str, parts) -> str:
    tests = " OR ".join(f"contains({text}, {quoted(part)})" for part in parts)
    return f"coalesce({tests}, false)"


def _opens_with(body: str, start: str) -> str:
    """Does the body start so, white space aside? Reads the first characters only."""
    return f"coalesce(rlike({body}, {quoted(r'(?i)^[ \t\n\r\x00\x0B]*+' + start)}), false)"


def is_page_blocked(body: str) -> str:
    return _contains_any(body, fixed.BLOCK_MARKERS)


def is_api_blocked(body: str) -> str:
    """The body is an HTML page or holds a block marker."""
    return f"({_opens_with(body, '<html')} OR {is_page_blocked(body)})"


def is_refused(status: str, body: str) -> str:
    """A matched response that must not be used; other error statuses pass."""
    statuses = ", ".join(str(status) for status in fixed.BLOCK_STATUSES)
    return f"(coalesce({status} IN ({statuses}), false) OR {is_api_blocked(body)})"


def response_kind(body: str) -> str:
    return (
        f"CASE WHEN {is_api_blocked(body)} THEN 'block page'"
        f" WHEN {_opens_with(body, r'[{\[]')} THEN 'json' ELSE 'unknown' END"
    )


def body_preview(body: str) -> str:
    return f"substring({body}, 1, {fixed.PREVIEW_CHARS})"


def logged(responses: DataFrame) -> DataFrame:
    """Responses worth keeping in the log, by URL."""
    return responses.where(_contains_any("url", fixed.LOGGED_URL_PARTS))


def first_matching(responses: DataFrame, url_part: str = fixed.CAPTURE_URL_PART) -> DataFrame:
    """First response per page whose URL holds ``url_part``.

    The place of the first one is a hash aggregate over fixed-width values; bodies are met again only
    by the join for that one row. Where a page has several responses of one place, the least by URL
    counts, chosen among those few rows.
    """
    fitting = responses.where(F.col("url").contains(url_part))
    place = F.coalesce(F.col("seq"), F.lit(-1))
    first = fitting.select(*PAGE, place.alias("_seq")).groupBy(*PAGE).agg(F.min("_seq").alias("_seq"))
    rows = fitting.withColumn("_seq", place).join(first, [*PAGE, "_seq"])
    whole = F.struct("seq", "url", "status", "content_type", "body")
    return rows.groupBy(*PAGE).agg(F.min_by(whole, "url").alias("matched"))


def capture(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """Pages with their matched response, its kind, the block stage and the reject.

    A blocked page ends before the capture; a page without a match is a timeout; a refused
    response ends after it.
    """
    # The block test comes before the join, so that page bodies need not go through its shuffle.
    flagged = pages.selectExpr("*", f"{is_page_blocked('body')} AS _page_blocked")
    joined = flagged.join(first_matching(responses), PAGE, "left")
    judged = joined.withColumnRenamed("matched", "_first").selectExpr(
        "*",
        "_first IS NOT NULL AS _has_match",
        f"_first IS NOT NULL AND {is_refused('_first.status', '_first.body')} AS _refused",
    )
    return judged.selectExpr(
        *pages.columns,
        "CASE WHEN NOT _page_blocked THEN _first END AS matched",
        f"CASE WHEN _page_blocked THEN 'block page' WHEN _has_match THEN {response_kind('_first.body')} END"
        " AS response_kind",
        "CASE WHEN _page_blocked THEN 'page' WHEN _refused THEN 'api' END AS block_stage",
        "CASE WHEN _page_blocked THEN 'page is blocked before the catalogue loads'"
        " WHEN NOT _has_match THEN 'timeout waiting for the catalogue response'"
        " WHEN _refused THEN 'catalogue API is blocked after the page loads' END AS capture_reject",
    )


def with_payload(captured: DataFrame) -> DataFrame:
    """Captured pages as input for extraction: the body is the matched response's body."""
    return captured.selectExpr(
        "page_url", "fetched_at", "http_status", "content_type", "matched.body AS body", "capture_reject"
    )


def _is_captured(capture_rules: list[Rule]) -> str:
    names = ", ".join(quoted(rule.name) for rule in capture_rules)
    return f"coalesce({matching_rule('page_url', capture_rules)} IN ({names}), false)"


def captured_pages(pages: DataFrame, responses: DataFrame, capture_rules: list[Rule]) -> DataFrame:
    """The pages of capture rules, judged by their responses."""
    return capture(pages.where(_is_captured(capture_rules)), responses)


def catalog_payloads(pages: DataFrame, responses: DataFrame, capture_rules: list[Rule]) -> DataFrame:
    """All catalogue pages ready for extraction; only pages of capture rules take part in the join."""
    is_captured = _is_captured(capture_rules)
    plain = pages.where(f"NOT {is_captured}").selectExpr(
        "page_url", "fetched_at", "http_status", "content_type", "body", "cast(NULL AS string) AS capture_reject"
    )
    return plain.unionByName(with_payload(capture(pages.where(is_captured), responses)))


def diagnostics(captured: DataFrame, responses: DataFrame) -> DataFrame:
    """Report lines per page: head lines, the match, then one line per logged response.

    Lines are rows, not a collected list, so a page with any number of responses stays spread out.
    """
    lines = {
        "page": "page_url",
        "kind": "coalesce(response_kind, '-')",
        "block stage": "coalesce(block_stage, '-')",
        "matched": "concat(matched.url, ' [status ', coalesce(cast(matched.status AS string), '-'), ']')",
        "content type": "matched.content_type",
        "preview": f"nullif({body_preview('matched.body')}, '')",
    }
    structs = ", ".join(
        f"named_struct('line_no', {number}L, 'label', {quoted(label)}, 'text', {value})"
        for number, (label, value) in enumerate(lines.items())
    )
    heads = captured.selectExpr(*PAGE, f"inline(array({structs}))").where("text IS NOT NULL")
    network = logged(responses).selectExpr(
        *PAGE,
        f"cast(seq AS bigint) + {_NETWORK_LINES_FROM} AS line_no",
        "'network' AS label",
        "concat(url, ' [', coalesce(cast(status AS string), '-'), '] ', coalesce(content_type, '')) AS text",
    )
    return heads.unionByName(network)
