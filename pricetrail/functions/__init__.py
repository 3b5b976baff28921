"""Building blocks over SQL expressions: URLs, text, prices, HTML and JSON-LD.

Every function takes SQL expression text and returns SQL expression text, to be used with
``selectExpr`` or ``functions.expr``. Deep array expressions are parsed once by Spark this way,
where the same tree built call by call costs thousands of round trips to the JVM.
"""


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def group_or_null(text: str, pattern: str, group: int = 1) -> str:
    """A regular-expression group, null when empty or not found."""
    return f"nullif(regexp_extract({text}, {quoted(pattern)}, {group}), '')"


def removed(text: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(replacement)})"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"
