"""Text normalisation, prices and product names."""

from pricetrail.functions import fixed, group_or_null, let, quoted, removed

# Wide enough that an oversized price is still seen and can be rejected later.
RAW_PRICE = "decimal(38,2)"
_NUMERIC = r"^[ \t\n\r\x0B\f]*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[ \t\n\r\x0B\f]*$"
_NUMERIC_SPACE = r"[ \t\n\r\x0B\f]"
_NO_BREAK_SPACE = "\u00a0"


def normalize(text: str) -> str:
    """Every run of Unicode white space becomes one space; trimmed; empty becomes null."""
    return let("normal", f"trim({removed(text, r'(?U)\s+', ' ')})", "nullif(normal, '')")


def dotted(number: str) -> str:
    return f"translate({number}, ',', '.')"


def _to_price(number: str) -> str:
    return f"try_cast({dotted(number)} AS {RAW_PRICE})"


def is_numeric(text: str) -> str:
    return f"rlike({text}, {quoted(_NUMERIC)})"


def _numeric_value(text: str) -> str:
    return f"try_cast({removed(text, _NUMERIC_SPACE)} AS {RAW_PRICE})"


def numeric_price(text: str) -> str:
    """Price when the whole text is a number (comma allowed), else null."""
    return let("num", dotted(text), f"CASE WHEN {is_numeric('num')} THEN {_numeric_value('num')} END")


def first_price(text: str) -> str:
    """First number before the rouble sign."""
    return _to_price(group_or_null(text, fixed.PRICE_ANY_DECIMALS))


def has_price(text: str) -> str:
    return f"rlike({text}, {quoted(fixed.PRICE_ANY_DECIMALS)})"


def first_positive_price(text: str) -> str:
    """First number above zero before a rouble sign."""
    numbers = f"regexp_extract_all({text}, {quoted(fixed.PRICE_TWO_DECIMALS)}, 1)"
    return f"get(filter(transform({numbers}, n -> {_to_price('n')}), p -> p > 0), 0)"


def scalar_price(text: str) -> str:
    """Price from an attribute or a JSON scalar: a number, else the first number in the cleaned text."""
    bare = f"translate(scalar, {quoted(', ' + _NO_BREAK_SPACE)}, '.')"
    for word in fixed.CURRENCY_WORDS:
        bare = f"replace({bare}, {quoted(word)})"
    first_number = group_or_null(bare, r"([0-9]+(?:\.[0-9]+)?)")
    return let(
        "scalar",
        text,
        f"CASE WHEN {is_numeric('scalar')} THEN {_numeric_value('scalar')}"
        f" ELSE try_cast({first_number} AS {RAW_PRICE}) END",
    )


def first_of(prices: str) -> str:
    """First price of an array that is not null."""
    return f"get(filter({prices}, p -> p IS NOT NULL), 0)"


def name_after_price(text: str) -> str:
    """Name from the text behind the first price, without discount, second price, rating and one label."""
    labels = "|".join(label.replace("+", r"\+") for label in fixed.PROMO_LABELS)
    tail = f"trim({removed(text, fixed.UP_TO_FIRST_PRICE)})"
    for step in (
        fixed.DISCOUNT,
        fixed.LEADING_PRICE,
        fixed.RATING_TAIL,
        fixed.NO_REVIEWS_TAIL,
        rf"(?U)^({labels})\s*",
    ):
        tail = removed(tail, step)
    return let("tail", f"trim({tail})", "nullif(tail, '')")


def cleaned_name(text: str) -> str:
    """Name left when price words, prices and shop labels are taken out of the text."""
    for step in fixed.CLEAN_STEPS:
        text = removed(text, step, " ")
    return normalize(text)
