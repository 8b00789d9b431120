"""Column functions on names, log text and attribute text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Step classes and the words that select them, first match wins.
STEP_CATEGORIES = [
    ("step_checkout", ["checkout", "clone"]),
    ("step_setup", ["setup", "install", "cache"]),
    ("step_build", ["build", "compile", "make"]),
    ("step_test", ["test", "spec", "coverage"]),
    ("step_lint", ["lint", "format", "check"]),
    ("step_deploy", ["deploy", "publish", "release"]),
    ("step_artifact", ["upload", "artifact", "store"]),
    ("step_security", ["security", "scan", "audit"]),
    ("step_notify", ["notification", "slack", "email"]),
]
OTHER_STEP = "step_other"

_CSI = "\x1b\\[[0-9;]*[a-zA-Z]"
_TERMINAL = (
    "(?s)\x1b\\[[^a-zA-Z@]*(?:[a-zA-Z@]|$)"
    "|\x1b\\].*?(?:\x07|\x1b\\\\|$)"
    "|[\x00-\x08\x0b\x0c\x0e-\x1f]"
)


def first_case(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    """``CASE`` over (condition, value) pairs, first true condition wins."""
    if not pairs:
        return default
    out = F.when(*pairs[0])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out.otherwise(default)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_ansi(text: Column) -> Column:
    """Drop colour codes from a log line; lines without ESC stay untouched."""
    return F.when(text.contains("\x1b"), trim_space(F.regexp_replace(text, _CSI, ""))).otherwise(text)


def strip_terminal(text: Column) -> Column:
    """Drop CSI codes, OSC links and control characters (tab and newlines stay)."""
    return F.regexp_replace(text, _TERMINAL, "")


def truncate(text: Column, size: int | None) -> Column:
    """Trim and cut to ``size`` bytes, the last three being dots; None only trims."""
    clean = trim_space(text)
    if size is None:
        return clean
    keep = size if size <= 3 else size - 3
    dots = "" if size <= 3 else "..."
    head = F.make_valid_utf8(F.substring(F.encode(clean, "UTF-8"), 1, keep).cast("string"))
    return F.when(F.octet_length(clean) <= size, clean).otherwise(F.concat(head, F.lit(dots)))


def glob(value: Column, pattern: str) -> Column:
    """``*``, ``p*``, ``*s``, ``*m*`` or exact text; the kind is chosen at plan time."""
    if pattern == "*":
        return value.isNotNull()
    if pattern.startswith("*") and pattern.endswith("*"):
        return value.contains(pattern[1:-1])
    if pattern.startswith("*"):
        return value.endswith(pattern[1:])
    if pattern.endswith("*"):
        return value.startswith(pattern[:-1])
    return value == F.lit(pattern)


def step_category(name: Column) -> Column:
    low = F.lower(name)
    return first_case(
        [(any_of([low.contains(w) for w in words]), F.lit(label)) for label, words in STEP_CATEGORIES],
        F.lit(OTHER_STEP),
    )


def job_group(name: Column) -> Column:
    return F.split_part(name, F.lit(" / "), F.lit(1))


def is_boilerplate(content: Column) -> Column:
    """Workflow commands, parameter blocks and shell echoes never name a span."""
    return (
        (content == "")
        | content.startswith("##[")
        | content.isin("with:", "env:")
        | (content.startswith("  ") & content.contains(": "))
        | content.startswith("[command]")
    )


def is_noise_name(name: Column) -> Column:
    """Empty, or longer than three bytes with under a fifth letters and digits."""
    letters = F.length(F.regexp_replace(name, r"[^\p{L}\p{Nd}]", ""))
    size = F.octet_length(name)
    return (name == "") | ((size > 3) & (letters / size < F.lit(0.2)))


def leading_word(name: Column) -> Column:
    """First word when the text starts with a letter and has more than one word."""
    return F.regexp_extract(trim_space(name), r"^(\p{L}[^ ]*) ", 1)


def format_duration_ms(ms: Column) -> Column:
    return (
        F.when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(F.rint(ms / 1000.0).cast("bigint").cast("string"), F.lit("s")))
        .otherwise(F.concat(F.format_string("%.1f", F.rint(ms / 6000.0) / 10.0), F.lit("m")))
    )


def format_bytes(size: Column) -> Column:
    def scaled(unit: int, label: str) -> Column:
        return F.concat(F.format_string("%.1f", F.rint(size * 10.0 / unit) / 10.0), F.lit(label))

    return (
        F.when(size >= 1 << 30, scaled(1 << 30, " GB"))
        .when(size >= 1 << 20, scaled(1 << 20, " MB"))
        .when(size >= 1 << 10, scaled(1 << 10, " KB"))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


def format_count(number: Column) -> Column:
    return F.format_number(number, 0)


def ship_it(body: Column) -> Column:
    return F.lower(body).rlike("ship ?it")


def log_deep_link(step_url: Column, line: Column) -> Column:
    """Point a step URL at a log line: the part after the last colon is replaced."""
    return F.when(
        F.locate(":", step_url) > 1,
        F.concat(F.regexp_extract(step_url, "(?s)^(.*:)[^:]*$", 1), line.cast("string")),
    ).otherwise(step_url)
