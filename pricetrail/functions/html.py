"""HTML scans with Spark's regular expressions.

Loops use possessive quantifiers, which Java runs without recursion, so long pages cannot
overflow the stack. One scan of the body returns whole elements; details are read from those.
"""

from html.entities import name2codepoint

from pricetrail.functions import let, quoted, removed

# The inside of a tag: anything up to '>', with quoted values allowed to hold '>'.
_TAG_BODY = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
_COMMENT = r"(?s)<!--.*?-->"
_CODE = rf"(?is)<(script|style)(?:\s{_TAG_BODY})?>.*?</\1\s*+>"
_ANY_TAG = rf"(?s)<!--.*?-->|</?[A-Za-z!]{_TAG_BODY}>"
_ANCHOR = rf"(?is)<a\s{_TAG_BODY}>.*?(?:</a\s*+>|(?=<a[\s>])|\z)"
_OPEN_TAG = rf"(?s)^<[A-Za-z][A-Za-z0-9]*+({_TAG_BODY})>"
_LD_JSON = rf"(?is)<script(\s{_TAG_BODY})>(.*?)</script\s*+>"
_VOID_TAGS = ("meta", "link", "input", "img", "br", "hr", "source")
# "|name=character" for every named reference.
_CHARACTERS = "".join(f"|{name}={chr(code)}" for name, code in (name2codepoint | {"apos": ord("'")}).items())


def _all(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {quoted(pattern)}, 0)"


def without_comments_and_code(body: str) -> str:
    """Body without comments, scripts and styles: what they hold are not elements."""
    return removed(removed(body, _COMMENT), _CODE)


def attribute(attributes: str, name: str) -> str:
    """Raw value of one attribute from the inside of a tag; empty when missing."""
    skip = rf"(?:\s*+(?!{name}\s*+=)(?:[^\s=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"']\S*+))?+|=))*+"
    value = r"""["']?+((?<=")[^"]*+|(?<=')[^']*+|(?<!["'])[^\s"']\S*+)"""
    pattern = rf"(?is)^{skip}\s*+{name}\s*+=\s*+{value}"
    return f"regexp_extract({attributes}, {quoted(pattern)}, 1)"


def tag_attributes(element: str) -> str:
    """Attributes of the element's own opening tag."""
    return f"regexp_extract({element}, {quoted(_OPEN_TAG)}, 1)"


def decode_entities(text: str) -> str:
    """Named and numeric character references become characters, each decoded once."""
    code = (
        "CASE WHEN rlike(e, '^#[0-9]') THEN try_cast(nullif(regexp_extract(e, '^#0*([0-9]{1,10})(?![0-9])', 1), '') AS int)"
        " WHEN rlike(e, '^#[xX][0-9a-fA-F]')"
        " THEN try_cast(conv(nullif(regexp_extract(e, '^#[xX]0*([0-9a-fA-F]{1,8})(?![0-9a-fA-F])', 1), ''), 16, 10) AS int) END"
    )
    # Code, looked-up name and the text behind the reference, worked out once per reference.
    name = "regexp_extract(e, '^([A-Za-z][A-Za-z0-9]*);', 1)"
    parts = (
        f"named_struct('code', {code}, 'name', {name}, 'at', instr({quoted(_CHARACTERS)}, concat('|', {name}, '=')),"
        " 'raw', e, 'rest', regexp_replace(e, '^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)', ''))"
    )
    character = (
        "CASE WHEN d.code BETWEEN 1 AND 55295 OR d.code BETWEEN 57344 AND 1114111"
        " THEN decode(unhex(lpad(hex(d.code), 8, '0')), 'UTF-32')"
        f" WHEN d.name <> '' AND d.at > 0 THEN substring({quoted(_CHARACTERS)}, d.at + length(d.name) + 2, 1) END"
    )
    decoded = (
        f"transform(transform(pieces, (e, i) -> CASE WHEN i > 0 THEN {parts} END),"
        f" (d, i) -> CASE WHEN i = 0 THEN pieces[0]"
        f" ELSE coalesce(concat({character}, d.rest), concat('&', d.raw)) END)"
    )
    joined = let("pieces", "split(coded, '&')", f"array_join({decoded}, '')")
    return let("coded", text, f"CASE WHEN contains(coded, '&') THEN {joined} ELSE coded END")


def attribute_text(attributes: str, name: str) -> str:
    return decode_entities(attribute(attributes, name))


def text_content(markup: str) -> str:
    """Text of the markup: tags dropped without adding spaces, entities decoded."""
    return decode_entities(removed(markup, _ANY_TAG))


def elements(body: str, tag: str) -> str:
    """All ``tag`` elements in document order, as markup."""
    return _all(body, rf"(?is)<{tag}(?:\s{_TAG_BODY})?>.*?</{tag}\s*+>")


def void_elements(body: str, tag: str) -> str:
    """All tags ``tag`` that hold no content, such as meta."""
    return _all(body, rf"(?is)<{tag}\s{_TAG_BODY}>")


def first_with_attribute(items: str, name: str, value: str) -> str:
    """First of the elements whose attribute has the value, else null."""
    return f"get(filter({items}, t -> {attribute(tag_attributes('t'), name)} = {quoted(value)}), 0)"


def anchors(body: str) -> str:
    """Array of (position, attributes, markup) for every ``a[href]``; positions follow the document."""
    found = _all(without_comments_and_code(body), _ANCHOR)
    parts = f"named_struct('position', i, 'attributes', {tag_attributes('a')}, 'markup', a)"
    return f"filter(transform({found}, (a, i) -> {parts}), a -> {attribute('a.attributes', 'href')} <> '')"


def opening_tags_naming(body: str, name: str) -> str:
    """Opening tags of any kind that mention the attribute."""
    return _all(body, rf"(?is)<[a-z][a-z0-9]*+\s(?=[^<]*?{name}){_TAG_BODY}>")


def inner_markup(body: str, opening: str) -> str:
    """Markup between an opening tag found in the body and its matching closing tag.

    Nested tags of the same kind are counted. Void tags hold nothing. The markup starts with a blank.
    """
    # The blank keeps the first piece apart from the tags; every other piece starts with one.
    rest = f"concat(' ', substr({body}, instr({body}, {opening}) + length({opening})))"
    # Only the depth and the length so far are carried; the markup is cut out once at the end.
    step = (
        "CASE WHEN s.depth <= 0 THEN s"
        " WHEN startswith(p, '</') AND s.depth = 1 THEN named_struct('depth', 0, 'size', s.size)"
        " WHEN startswith(p, '</') THEN named_struct('depth', s.depth - 1, 'size', s.size + length(p))"
        " WHEN startswith(p, '<') THEN named_struct('depth', s.depth + 1, 'size', s.size + length(p))"
        " ELSE named_struct('depth', s.depth, 'size', s.size + length(p)) END"
    )
    void = ", ".join(quoted(name) for name in _VOID_TAGS)
    pieces = "split(rest, concat('(?i)(?=</?', tag, '[\\\\s/>])'))"
    size = f"aggregate({pieces}, named_struct('depth', 1, 'size', 0), (s, p) -> {step}, s -> s.size)"
    return let(
        "tag",
        f"lower(regexp_extract({opening}, '^<([A-Za-z][A-Za-z0-9]*)', 1))",
        f"CASE WHEN tag IN ({void}) THEN '' ELSE {let('rest', rest, f'substring(rest, 1, {size})')} END",
    )


def ld_json_scripts(body: str) -> str:
    """Contents of all JSON-LD scripts in document order."""
    scripts = _all(removed(body, _COMMENT), _LD_JSON)
    is_ld = f"{attribute(tag_attributes('t'), 'type')} = 'application/ld+json'"
    return f"transform(filter({scripts}, t -> {is_ld}), t -> regexp_extract(t, {quoted(_LD_JSON)}, 2))"
