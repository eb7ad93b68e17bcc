"""Text functions of retrieval, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that keyword scoring leaves out.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "was", "are", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "shall", "can", "need", "dare",
    "ought", "used", "it", "its", "he", "she", "they", "them", "their",
    "his", "her", "we", "us", "our", "you", "your", "i", "me", "my",
    "this", "that", "these", "those", "what", "which", "who", "whom",
    "where", "when", "why", "how", "not", "no", "nor", "if", "then",
    "than", "too", "very", "just", "about", "above", "after", "again",
    "all", "also", "am", "any", "because", "before", "below", "between",
    "both", "each", "few", "further", "get", "got", "here", "into",
    "more", "most", "other", "out", "over", "own", "same", "so", "some",
    "such", "there", "through", "under", "until", "up", "while",
)
# Words that the keyword-overlap rerank leaves out.
RERANK_STOP_WORDS = (
    "a", "an", "the", "is", "was", "are", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "what", "where", "when", "who", "how",
    "why", "which", "it", "its", "this", "that", "in", "on", "at", "to",
    "for", "of", "with", "by", "from", "and", "or", "but", "not", "i",
)

#: Runs of ASCII letters and digits between ASCII word boundaries; Java's own boundary knows all of Unicode.
_TOKEN = r"(?<![A-Za-z0-9_])[a-z0-9]+(?![A-Za-z0-9_])"
_BLANK = r"\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
RECENT = r"(?i)(?<![A-Za-z0-9_])(current|now|latest|recently|today)(?![A-Za-z0-9_])"
PAST = r"(?i)(?<![A-Za-z0-9_])(first|originally|ever|history|used\s+to)(?![A-Za-z0-9_])"
#: Name of the marks round injected context.
TAG = "MEMORY"


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def _without(tokens: Column, words: tuple[str, ...]) -> Column:
    # Parsed as one expression: a column for each word costs more to build than small stores take to search.
    listed = ", ".join(f"'{w}'" for w in words)
    return F.call_function("filter", tokens, F.expr(f"w -> w not in ({listed})"))


def tokenize(text: Column) -> Column:
    """Tokens of keyword scoring, repeats included."""
    return _without(raw_tokens(text), STOP_WORDS)


def rerank_tokens(text: Column) -> Column:
    """Distinct tokens of the overlap rerank."""
    return F.array_distinct(_without(raw_tokens(text), RERANK_STOP_WORDS))


def overlap(content: Column, tokens: Column) -> Column:
    """Share of the tokens that the content holds as substrings; null without tokens."""
    low = F.lower(content)
    return F.size(F.filter(tokens, lambda t: F.contains(low, t))) / F.nullif(F.size(tokens), F.lit(0))


def intent(text: Column) -> Column:
    """recency, historical or default; recency wins where both are asked."""
    return F.when(text.rlike(RECENT), "recency").when(text.rlike(PAST), "historical").otherwise("default")


def trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^[{_BLANK}]+|[{_BLANK}]+$", "")


def strip_blocks(text: Column, tag: str = TAG) -> Column:
    """Without injected context blocks."""
    return trim(F.regexp_replace(text, rf"\[{tag}\][\s\S]*?\[/{tag}\]", ""))


def strip_envelope(prompt: Column) -> Column:
    """The message within a first prompt's envelope; null if nothing is left."""
    body = trim(F.regexp_replace(prompt, r"(?i)^Sender\s*\(untrusted metadata\)\s*:\s*```json[\s\S]*?```\s*", ""))
    return F.nullif(trim(F.regexp_replace(body, r"^\[.*?\]\s*\[.*?\]\s*\n?", "")), F.lit(""))


def join_blocks(blocks: Column) -> Column:
    """The trimmed, non-empty text blocks of a message, joined by spaces."""
    return F.array_join(F.filter(F.transform(blocks, trim), lambda x: x != ""), " ")


def sections(text: Column) -> Column:
    """Second-level markdown sections, headings included. What stands before the first heading is dropped; a
    text without headings is one section."""
    parts = F.split(text, r"(?m)^##\s+", -1)
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(F.lit("## "), x))
    return F.when(F.size(parts) <= 1, F.array(text)).otherwise(rest)


def excerpt(text: Column, size: int, mark: str = "") -> Column:
    cut = F.substring(text, 1, size)
    return F.when(F.length(text) > size, F.concat(cut, F.lit(mark))).otherwise(cut)


def exchange_text(user_message: Column, agent_response: Column) -> Column:
    return F.concat(F.lit("User: "), user_message, F.lit("\nAssistant: "), agent_response)


def upsert_section(document: Column, body: Column, begin: str, end: str) -> Column:
    """The document with the text between its markers replaced; with markers and text appended where they are
    missing or out of order."""
    block = F.concat(F.lit(begin + "\n"), body, F.lit("\n" + end))
    i, j = F.locate(begin, document), F.locate(end, document)
    replaced = F.concat(F.substring(document, F.lit(1), i - 1), block, F.substring(document, j + len(end), F.length(document)))
    gap = F.when(document == "", "").when(document.endswith("\n"), "\n").otherwise("\n\n")
    return F.when((i > 0) & (j > i), replaced).otherwise(F.concat(document, gap, block, F.lit("\n")))


def append_section(document: Column, section: str, marker: str) -> Column:
    """The document with the section at its end, unless it holds the marker already."""
    gap = F.when(document == "", "").when(document.endswith("\n"), "\n").otherwise("\n\n")
    return F.when(F.contains(document, F.lit(marker)), document).otherwise(F.concat(document, gap, F.lit(section)))
