"""Tokenizers, identifiers and templates as Column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and marks that say nothing about a piece of code.
STOPWORDS = (
    "self", "cls", "return", "import", "from", "def", "class", "if", "else",
    "elif", "for", "while", "try", "except", "finally", "with", "as", "in",
    "is", "not", "and", "or", "none", "true", "false", "pass", "break",
    "continue", "raise", "yield", "lambda", "global", "nonlocal", "assert",
    "del", "print", "the", "a", "an", "of", "to", "this", "that",
    "(", ")", "{", "}", "[", "]", ":", ",", ".", "=", "==", "!=",
    "->", "**", "//", "+=", "-=", "*=", "/=",
)
# The patterns that define code tokens, identifiers and keywords.
SPLIT = r"""[\s\(\)\{\}\[\]:,;=\+\-\*/\<\>\!\&\|\^\~\%\#\"\'\`]+"""
CAMEL = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
SNAKE = r"_+"
IDENTIFIER = r"(?U)\b[a-zA-Z_]\w+\b"
KEYWORD = r"(?U)\b[a-zA-Z]+\b"
#: Two or more letters, digits or underscores; written without \w, which engines read differently.
WORD = r"[\p{L}\p{N}_]{2,}"

CHARS_PER_TOKEN = 4


def _empty() -> Column:
    return F.array().cast("array<string>")


def _telling(parts: Column) -> Column:
    """Lower-cased parts of two letters or more that are no stopwords."""
    return F.filter(F.transform(parts, F.lower), lambda p: (F.length(p) > 1) & ~p.isin(*STOPWORDS))


def tokenize_code(text: Column) -> Column:
    """Code tokens: each word as a whole, then its camel-case parts, then its snake-case parts; duplicates stay."""

    def of(word: Column) -> Column:
        camel = F.split(word, CAMEL)
        snake = F.split(word, SNAKE)
        whole = F.when(F.length(word) > 1, F.array(F.lower(word))).otherwise(_empty())
        return F.concat(
            whole,
            F.when(F.size(camel) > 1, _telling(camel)).otherwise(_empty()),
            F.when(F.contains(word, F.lit("_")), _telling(snake)).otherwise(_empty()),
        )

    words = F.filter(F.split(text, SPLIT), lambda w: (w != "") & ~F.lower(w).isin(*STOPWORDS))
    return F.coalesce(F.flatten(F.transform(words, of)), _empty())


def word_tokens(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Lower-cased words of two characters or more, duplicates kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(*stopwords)) if stopwords else words
    return F.coalesce(words, _empty())


def identifiers(text: Column) -> Column:
    """Distinct words that could name something in code, in the order of their first place."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))), _empty())


def keywords(text: Column) -> Column:
    """Alphabetic words of four letters or more, lower-cased, duplicates kept."""
    words = F.filter(F.regexp_extract_all(text, F.lit(KEYWORD), F.lit(0)), lambda w: F.length(w) > 3)
    return F.coalesce(F.transform(words, F.lower), _empty())


def search_string(text: Column) -> Column:
    """What the lexical index is asked: keywords, then identifiers (words that are both count twice)."""
    return F.concat_ws(" ", keywords(text), identifiers(text))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / CHARS_PER_TOKEN).cast("int")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def symbol_id(path: Column, name: Column, line: Column) -> Column:
    """Sixteen hex digits that name a symbol."""
    return F.substring(F.sha2(F.concat(path, F.lit("::"), name, F.lit("::"), line.cast("string")), 256), 1, 16)


def file_page_id(path: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("file::"), path), 256), 1, 16)


def slug(text: Column) -> Column:
    return F.translate(F.lower(text), " +", "__")


def normalized(text: Column) -> Column:
    """Lower case with single spaces, for comparing answers."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def fenced_json(text: Column) -> Column:
    """What stands in the first json fence, else in the first fence, else the text itself."""
    named = F.regexp_extract(text, r"(?s)```json(.*?)(?:```|$)", 1)
    plain = F.regexp_extract(text, r"(?s)```(.*?)(?:```|$)", 1)
    return F.trim(F.when(F.contains(text, F.lit("```json")), named).when(F.contains(text, F.lit("```")), plain).otherwise(text))


def parse_json(text: Column, schema: str) -> Column:
    """A struct of ``schema`` from a model's answer, null where it holds no JSON."""
    found = F.from_json(fenced_json(text), f"struct<{schema}, _corrupt:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return F.when(found["_corrupt"].isNull(), found.dropFields("_corrupt"))
