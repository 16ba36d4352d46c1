"""Text column functions: goal tokenizer, substring relevance score,
whitespace trim and JSON block extraction.  All native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Stop words dropped by the goal tokenizer.
STOP_WORDS = [
    "the", "a", "an", "is", "in",
    "on", "at", "to", "and", "or",
    "for", "of", "with", "i", "my",
    "need", "want", "should",
]
# Tokens of this many BYTES or fewer are dropped.
MIN_TOKEN_BYTES_EXCLUSIVE = 2
# Fences tried, in order, by the JSON block extractor.
JSON_FENCES = ["```json", "```JSON", "```"]
# White space removed by the trim used before extraction (ASCII white space
# plus NEL, NBSP and the Unicode space separators).
WHITESPACE_CLASS = (r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
                    r"\x{202F}\x{205F}\x{3000}")
# Characters whose context-free lower case differs from what Spark's lower()
# gives (full case mapping): dotted capital I and capital sigma.
SIMPLE_LOWER_FROM = "İΣ"
SIMPLE_LOWER_TO = "iσ"
# ---------------------------------------------------------------------------

# Anything that is not a Unicode letter or decimal digit separates tokens.
TOKEN_SPLIT = r"[^\p{L}\p{Nd}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lower_simple(text) -> Column:
    """Per-character lower case (no context rules, no length change)."""
    return F.lower(F.translate(_c(text), SIMPLE_LOWER_FROM, SIMPLE_LOWER_TO))


def tokenize(text) -> Column:
    """array<string> of lower-cased tokens, duplicates kept, in text order."""
    parts = F.split(lower_simple(text), TOKEN_SPLIT)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(
        parts,
        lambda t: (F.octet_length(t) > MIN_TOKEN_BYTES_EXCLUSIVE) & ~F.array_contains(stop, t),
    )


def relevance_haystack(relative_path, summary) -> Column:
    """The text goal tokens are looked for in: lower(path + ' ' + summary).
    Compute it once per document (a column), not inside the token lambda."""
    return lower_simple(F.concat(_c(relative_path), F.lit(" "), _c(summary)))


def relevance_score(tokens, haystack) -> Column:
    """Number of goal tokens found as substrings of ``haystack``; a repeated
    token counts each time."""
    hay = _c(haystack)
    return F.size(F.filter(_c(tokens), lambda t: F.contains(hay, t))).cast("bigint")


def trim_space(text) -> Column:
    """Trim leading and trailing white space (Unicode-aware)."""
    return F.regexp_replace(_c(text), rf"^[{WHITESPACE_CLASS}]+|[{WHITESPACE_CLASS}]+$", "")


def _fenced_body(s: Column, fence: str) -> Column:
    """Text between the first ``fence`` and the next triple back-tick, trimmed;
    NULL when the fence or its closing fence is missing."""
    start = F.instr(s, fence)
    rest = F.substring(s, start + F.lit(len(fence)), F.lit(1 << 30))
    close = F.instr(rest, "```")
    return F.when((start > 0) & (close > 0), trim_space(F.substring(rest, F.lit(1), close - 1)))


def extract_json_block(raw) -> Column:
    """Trim, take the body of the first fence that has a closing fence, then
    cut from the first '{' to the last '}' (text returned as-is when absent)."""
    s0 = trim_space(_c(raw))
    s = F.coalesce(*[_fenced_body(s0, f) for f in JSON_FENCES], s0)
    first = F.instr(s, "{")
    last_rev = F.instr(F.reverse(s), "}")
    last = F.length(s) - last_rev + 1
    ok = (first > 0) & (last_rev > 0) & (last > first)
    return F.when(ok, F.substring(s, first, last - first + 1)).otherwise(s)


def first_line(text) -> Column:
    return F.substring_index(_c(text), "\n", 1)
