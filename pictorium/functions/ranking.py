"""Query-side expressions of the hybrid search: words, expansions, weights, lexical factor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pictorium.functions import text as T

# Query expansions, in the order in which keys are tried.
EXPANSIONS = (
    ("family dinner", "group of people gathered around table eating food together meal dining family"),
    ("family photo", "group of relatives family members posing together portrait"),
    ("green mountains", "mountains covered with green trees vegetation forested hills lush greenery"),
    ("blue sky", "clear sky bright blue cloudless sunny day"),
    ("bright hat", "colorful hat vibrant headwear cap"),
    ("old building", "ancient historic aged architecture old structure weathered building"),
    ("young child", "kid baby toddler infant small child young boy girl"),
    ("adult person", "grown-up adult man woman mature person"),
    ("sad people", "unhappy person crying melancholic distressed face sorrowful upset tears"),
    ("sad", "unhappy crying melancholic distressed sorrowful upset tears"),
    ("angry", "frustrated mad furious annoyed irritated scowling aggressive hostile"),
    ("happy", "joyful smiling cheerful delighted pleased excited laughing"),
    ("happy moment", "joyful celebration smiling cheerful happy people laughing"),
    ("peaceful", "calm serene tranquil quiet relaxed soothing"),
    ("peaceful scene", "calm serene tranquil quiet landscape relaxed soothing nature"),
    ("birthday party", "celebration cake candles birthday presents gifts gathering people"),
    ("wedding", "bride groom marriage ceremony wedding dress celebration"),
    ("vacation", "travel holiday trip beach tourist sightseeing relaxation getaway"),
    ("hiking", "trail walking mountains nature outdoors trekking adventure"),
    ("cooking", "kitchen food preparing meal chef cooking stove"),
    ("beach", "ocean sea sand shore waves coast seaside water"),
    ("city", "urban buildings streets downtown metropolitan skyline"),
    ("forest", "trees woods nature woodland greenery leaves"),
    ("home", "house residence living room interior domestic"),
    ("puppy", "young dog small dog baby dog cute puppy"),
    ("kitten", "young cat small cat baby cat cute kitten"),
    ("pet", "dog cat animal companion domestic pet"),
)

# Raw phrase weights, boosts and penalties of the ranking.
LONG_PHRASE, PAIR_PHRASE, WORD_PHRASE = 0.6, 0.3, 0.2
BOOST = 1.10
SCATTERED = 0.60
MISSING_PENALTY = 0.50
MIN_WORD_LENGTH = 3


def expand_query(query: Column, rules: tuple[tuple[str, str], ...] = EXPANSIONS) -> Column:
    """The query followed by the expansion of its key: an exact key, else the first key it contains."""
    asked = T.strip(F.lower(query))
    exact = [(asked == key, expansion) for key, expansion in rules]
    partial = [(F.contains(asked, F.lit(key)), expansion) for key, expansion in rules]
    expansion = F.when(F.lit(False), F.lit(None).cast("string"))
    for test, value in exact + partial:
        expansion = expansion.when(test, F.lit(value))
    return F.concat_ws(" ", query, expansion)


def individual_words(query: Column) -> Column:
    """Lower-case words of three or more characters, repeats kept."""
    return F.filter(T.blank_split(F.lower(query)), lambda w: F.length(w) >= MIN_WORD_LENGTH)


def full_phrase(query: Column) -> Column:
    """The lower-case query when it has several words, else NULL."""
    return F.when(F.size(T.blank_split(query)) > 1, F.lower(query))


def raw_weight(token_count: Column) -> Column:
    return F.when(token_count >= 3, LONG_PHRASE).when(token_count == 2, PAIR_PHRASE).otherwise(WORD_PHRASE)


def adj_noun_match(words: Column, pairs: Column) -> Column:
    """Some (adjective, noun) pair of the text stands in the relation that the query words name.

    The last word is taken as the noun, or the first one when the words are
    turned around. Words match by prefix. One word passes, a text without
    pairs does not.
    """
    size = F.size(words)
    first, last = F.element_at(words, 1), F.element_at(words, -1)

    def prefix_of(value: Column, choices: Column) -> Column:
        return F.exists(choices, lambda w: F.startswith(value, w))

    def related(pair: Column) -> Column:
        forward = F.startswith(pair["noun"], last) & prefix_of(pair["adj"], F.slice(words, 1, size - 1))
        reverse = F.startswith(pair["noun"], first) & prefix_of(pair["adj"], F.slice(words, 2, size - 1))
        return forward | reverse

    return F.when(size < 2, True).otherwise(F.coalesce(F.exists(pairs, related), F.lit(False)))


def lexical_factor(phrase_matched: Column, matched: Column, asked: Column, grammatical: Column) -> Column:
    """Multiplier of the semantic score from the word evidence."""
    return (
        F.when(phrase_matched, BOOST)
        .when((matched == asked) & (asked > 0), F.when(grammatical, BOOST).otherwise(SCATTERED))
        .when((matched > 0) & (asked > 1), 1.0 - MISSING_PENALTY * (1.0 - matched / asked))
        .otherwise(1.0)
    )
