"""Column functions over text: tokens, markdown structure, keywords."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FENCE = "```"
# Substrings of which two make a text markdown.
MARKDOWN_SIGNS = ("# ", "## ", "### ", "```", "- ", "* ", "1. ", "[", "](", "**", "|")
# Words that say nothing about a query.
STOP_WORDS = (
    "的", "了", "是", "在", "有", "和", "与", "或", "但", "不", "没", "也", "都", "要", "会", "能", "可以", "什么", "怎么", "为什么", "如何",
    "the", "is", "in", "and", "or", "but", "not", "to", "a", "an", "what", "how", "why", "can", "could", "should", "would",
)


def tokens(text: Column) -> Column:
    """Lower-case words: anything that is no word character or white space separates, in any script."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda x: x != "")


def is_markdown(text: Column) -> Column:
    """At least two of the signs occur; false for null."""
    hits = sum((F.contains(text, F.lit(s)).cast("int") for s in MARKDOWN_SIGNS), F.lit(0))
    return F.coalesce(hits >= 2, F.lit(False))


def tidy_markdown(text: Column) -> Column:
    """Line ends as \\n, at most one blank line in a row, one space after a heading's signs."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"(?m)^(#{1,6})[ \t]*([^#\s])", "$1 $2"))


def structure(text: Column) -> dict[str, Column]:
    """Counts and flags of a text's layout."""
    return {
        "n_words": F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")),
        "n_chars": F.length(text),
        "n_lines": F.size(F.split(text, "\n")),
        "has_code": F.contains(text, F.lit(FENCE)),
        "n_code": F.floor(F.regexp_count(text, F.lit(FENCE)) / 2).cast("int"),
        "n_titles": F.regexp_count(text, F.lit(r"(?m)^#{1,6}\s")),
        "n_list_items": F.regexp_count(text, F.lit(r"(?m)^\s*(?:[-*+]|\d+\.)\s")),
        "n_links": F.regexp_count(text, F.lit(r"\[[^\]]*\]\([^)]*\)")),
    }


def quick_structure(text: Column) -> dict[str, Column]:
    """Whether a text has code, a table row, a list; how many titles; the languages of its fences."""
    return {
        "has_code": F.contains(text, F.lit(FENCE)),
        "has_table": F.rlike(text, F.lit(r"\|[^\n]*\|")),
        "has_list": F.rlike(text, F.lit(r"(?m)^\s*(?:[-*+]|\d+\.)\s")),
        "n_titles": F.regexp_count(text, F.lit(r"(?m)^#{1,6}\s")),
        "languages": F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"```(\w+)"), F.lit(1)))),
    }


def longest_words(words: Column, most: int = 8) -> Column:
    """Distinct words without stop words and single characters: the longest ``most``, in alphabetical order.
    Words of equal length go by the alphabet."""
    useful = F.array_distinct(F.filter(words, lambda x: (F.length(x) > 1) & ~x.isin(*STOP_WORDS)))
    by_length = F.array_sort(F.transform(useful, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("word"))))
    return F.array_sort(F.transform(F.slice(by_length, 1, most), lambda x: x["word"]))


def cache_keywords(text: Column, most: int = 8) -> Column:
    return longest_words(tokens(text), most)


def spaced_words(text: Column) -> Column:
    """What white space separates, unchanged."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def cache_key(text: Column, most: int = 8, before: Column | None = None, most_before: int = 3) -> Column:
    """Hash of a question's keywords, and of the longest words of the exchange ``before`` it where that has any."""
    key = F.array_join(cache_keywords(text, most), "|")
    if before is not None:
        context = longest_words(spaced_words(F.coalesce(before, F.lit(""))), most_before)
        key = F.when(F.size(context) > 0, F.concat(key, F.lit("|ctx:"), F.array_join(context, "|"))).otherwise(key)
    return F.sha2(key, 256)
