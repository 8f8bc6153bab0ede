"""Text helpers: whitespace and word splitting, tags, completeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that str.strip() and str.split() treat as blank.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
BLANKS = r"(?U)[\s\x1c-\x1f]+"

# A word is a run of letters, digits and underscores in any script.
WORD = r"[\p{L}\p{N}_]+"

# The tag vocabulary, in output order.
PEOPLE_TAGS = ("man", "woman", "person", "people", "child", "baby", "couple", "group", "individual")
OBJECT_TAGS = (
    "dog", "cat", "animal", "car", "building", "tree", "mountain", "water", "snow",
    "beach", "forest", "city", "house", "bridge", "flower", "food", "table",
)
SCENE_TAGS = ("sunny", "cloudy", "sky", "outdoor", "indoor", "landscape", "portrait")
TAGS = PEOPLE_TAGS + OBJECT_TAGS + SCENE_TAGS


def strip(text: Column) -> Column:
    """Trim every Unicode blank from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank_split(text: Column) -> Column:
    """Words separated by runs of Unicode blanks, without empty strings."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def words(text: Column) -> Column:
    """Every run of word characters, in order, case kept."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def description_length(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    return F.size(blank_split(text))


def tag_keywords(description: Column, vocabulary: tuple[str, ...] = TAGS) -> Column:
    """Vocabulary terms found anywhere in the lowercased text, in vocabulary order."""
    lowered = F.lower(description)
    found = [F.when(F.contains(lowered, F.lit(term)), F.lit(term)) for term in dict.fromkeys(vocabulary)]
    return F.array_compact(F.array(*found))


def is_incomplete(description: Column) -> Column:
    """True for missing or blank text and for text that does not end a sentence."""
    return F.coalesce(~F.right(strip(description), F.lit(1)).isin(".", "!", "?"), F.lit(True))
