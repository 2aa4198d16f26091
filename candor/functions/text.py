"""Text measures as column expressions: no Python worker is needed for any of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candor.functions.stats import ratio

#: Words as Unicode sees them; Java needs the flag, or \w would stay ASCII.
WORD = r"(?U)\w+"
SENTENCE_END = r"[.!?]+"
CAPITAL = r"[A-Z]"
#: The first-person pronouns counted.
FIRST_PERSON = r"(?iU)\b(?:I|me|my|mine|we|us|our|ours)\b"
LETTERS = r"\b[a-zA-Z']+\b"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def char_length(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def friend_count(friends: Column) -> Column:
    """Entries of a comma-separated list; none if null, empty or the word None."""
    return F.when(friends.isNull() | friends.isin("", "None"), 0).otherwise(_count(friends, ",") + 1)


def features(text: Column) -> dict[str, Column]:
    """Length, words, sentences and ratios; zero where there is no text."""
    text = F.coalesce(text, F.lit(""))
    n, words = F.length(text), _count(text, WORD)
    return {
        "char_length": n,
        "word_count": words,
        "sentence_count": _count(text, SENTENCE_END),
        "exclamation_ratio": ratio(_count(text, "!").cast("double"), n),
        "caps_ratio": ratio(_count(text, CAPITAL).cast("double"), n),
        "first_person_ratio": ratio(_count(text, FIRST_PERSON).cast("double"), words),
    }


#: A later group of vowels of a lower-case word, but for a silent e that ends the word.
LATER_GROUP = "(?<=[aeiouy])[^aeiouy ]++[aeiouy]++(?:(?<!e)|(?=[^ ]))"


def later_groups(words: Column) -> Column:
    """Of lower-case words with a space between them: the syllables beyond the one that every word has."""
    return _count(words, LATER_GROUP)


def flesch(text: Column) -> Column:
    """Reading ease; zero for null text and text without words. Sentence ends are counted one by one, at least one.

    No part stands under a condition, so the generated code takes the words apart once.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))
    n = F.size(words)
    ends = F.greatest(F.lit(1), _count(text, "[.!?]")).cast("double")
    spoken = (n + later_groups(F.lower(F.array_join(words, " ")))).cast("double")
    return F.coalesce(206.835 - 1.015 * n.cast("double") / ends - 84.6 * spoken / F.nullif(n.cast("double"), F.lit(0.0)), F.lit(0.0))


def snippet(text: Column, n: int = 200) -> Column:
    """The first n characters on one line, with an ellipsis if there are more."""
    line = F.regexp_replace(F.substring(text, 1, n), r"\n", " ")
    return F.when(F.length(text) > n, F.concat(line, F.lit("…"))).otherwise(line)


def category_list(categories: Column, n: int = 8) -> Column:
    """The first n categories of a comma-separated list."""
    return F.slice(F.filter(F.transform(F.split(categories, ","), lambda c: F.trim(c)), lambda c: c != ""), 1, n)
