"""Column expressions on line text and secret values.

All of them are built-in expressions, so they run inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java classes for the Unicode properties the scan semantics are defined on.
WS = r"\p{IsWhite_Space}"
ALNUM = r"\p{IsAlphabetic}\p{N}"

# What makes a (lower-case) value a placeholder.
PLACEHOLDER_WORDS = [
    "xxx", "xxxx", "xxxxx", "your_key", "your_api_key", "your-api-key", "your_secret",
    "your_token", "changeme", "change_me", "todo", "fixme", "replace_me", "placeholder",
    "example", "sample", "test", "testing", "dummy", "fake", "none", "null", "undefined",
    "insert_here", "enter_key_here", "password", "secret", "admin", "root",
]
PLACEHOLDER_STARTS = ["${", "{{", "<", "your_", "your-", "my_", "my-", "env(", "getenv("]
PLACEHOLDER_PARTS = [
    "...", "_here", "-here", "process.env", "os.getenv", "os.environ",
    ":password@", ":secret@", ":pass@", ":passwd@", "://user:user@", "://admin:admin@",
    "://root:root@", "@example.com", "@example.org",
]
PLACEHOLDER_ENDS = ["_example", "-example"]
MASKED_TOKEN_HEADS = [
    "ghp_", "gho_", "ghu_", "ghr_", "glpat-", "sk-", "sk_", "npm_", "pypi-", "hf_",
]
# What makes a value code rather than a literal.
CODE_PARTS = [".get(", ".value", "->", "::", "['", '["']
CODE_STARTS = [
    "self.", "this.", "request.", "req.", "config.", "conf.", "settings.", "env.",
    "data.", "form.",
]
DOTTED_TOKEN_HEADS = ["ya29.", "MTI", "MTA", "xox", "eyJ"]
# Loopback hosts.
LOOPBACK_PARTS = ["localhost", "127.0.0.1", "0.0.0.0", "[::1]", "//lo"]


def quote(literal: str) -> str:
    """A literal as a regular expression."""
    return "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|/&#'\"" else c for c in literal)


def any_of(literals) -> str:
    return "(?:" + "|".join(quote(s) for s in literals) + ")"


def sql_string(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


PLACEHOLDER_PATTERN = (
    r"\A(?:" + any_of(PLACEHOLDER_WORDS) + r"\z|" + any_of(PLACEHOLDER_STARTS)
    + r"|[xX]{3,}\z|" + any_of(MASKED_TOKEN_HEADS) + r"[xX]{8,}\z)"
    + "|" + any_of(PLACEHOLDER_PARTS) + "|" + any_of(PLACEHOLDER_ENDS) + r"\z"
)
CODE_PATTERN = r"\A" + any_of(CODE_STARTS) + "|" + any_of(CODE_PARTS)
NAME_PATTERN = r"\A[\p{IsLowercase}_]++\z"
ACCESS_PATTERN = r"[\[(]|\A[$@#*]"


# The tests exist as SQL text as well, for use inside lambda functions.


def placeholder_sql(value: str) -> str:
    """``value`` in lower case is a stand-in for a secret."""
    return f"lower({value}) rlike {sql_string(PLACEHOLDER_PATTERN)}"


def code_pattern_sql(value: str) -> str:
    return (f"({value} rlike {sql_string(CODE_PATTERN)}"
            f" or (contains({value}, '(') and contains({value}, ')')))")


def looks_like_code_sql(value: str) -> str:
    """The stricter test that applies to unquoted values only."""
    heads = sql_string(r"\A(?:http|" + any_of(DOTTED_TOKEN_HEADS) + ")")
    return (f"((contains({value}, '.') and not {value} rlike {heads})"
            f" or (contains({value}, '_') and {value} rlike {sql_string(NAME_PATTERN)})"
            f" or {value} rlike {sql_string(ACCESS_PATTERN)})")


def localhost_sql(value: str) -> str:
    return f"lower({value}) rlike {sql_string(any_of(LOOPBACK_PARTS))}"


def is_placeholder(value: Column) -> Column:
    return F.lower(value).rlike(PLACEHOLDER_PATTERN)


def is_code_pattern(value: Column) -> Column:
    return value.rlike(CODE_PATTERN) | (value.contains("(") & value.contains(")"))


def looks_like_code(value: Column) -> Column:
    dotted = value.contains(".") & ~value.rlike(
        r"\A(?:http|" + any_of(DOTTED_TOKEN_HEADS) + ")")
    name_like = value.contains("_") & value.rlike(NAME_PATTERN)
    return dotted | name_like | value.rlike(ACCESS_PATTERN)


def is_localhost(value: Column) -> Column:
    return F.lower(value).rlike(any_of(LOOPBACK_PARTS))


def redact(secret: Column) -> Column:
    """Stars up to ten characters, else both ends around an ellipsis."""
    n = F.length(secret)
    shown = F.least(F.lit(4), F.floor(n / 4)).cast("int")
    return F.when(n <= 10, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(secret, F.lit(1), shown), F.lit("..."),
                 F.substring(secret, n - shown + 1, shown))
    )


def preview(secret: Column, chars: int = 20) -> Column:
    return F.concat(F.substring(secret, 1, chars), F.lit("..."))


def elide(text: Column, max_chars: int = 500) -> Column:
    """Cut the middle out so that ``max_chars`` characters remain."""
    if max_chars <= 1:
        return F.when(F.length(text) <= max_chars, text).otherwise(F.lit("…"))
    head = (max_chars - 1) // 2
    tail = max_chars - 1 - head
    return F.when(F.length(text) <= max_chars, text).otherwise(
        F.concat(F.substring(text, 1, head), F.lit("…"),
                 F.substring(text, F.length(text) - tail + 1, F.lit(tail)))
    )


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\u001b\\[[0-9;]*m", "")


def json_escape(text: Column) -> Column:
    """The body of a JSON string literal."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(3), F.length(quoted) - 4)
