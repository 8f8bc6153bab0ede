"""Boolean and proximity keyword matching on a tokenised text, and its highlighted snippets.

All functions work on one row: ``tokens`` is the array of words as written,
``lowered`` the same array in lower case. Positions count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pictorium.functions import text

WINDOW = 3  # fixed value: words of context on each side of a hit
DEFAULT_DISTANCE = 3  # fixed value: words allowed between two keywords

_OR = text.BLANKS + r"or[\s\x1c-\x1f]+"
_AND = text.BLANKS + r"and[\s\x1c-\x1f]+"


def lower_all(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def parse_query(query: Column) -> Column:
    """``array<struct<group_no, items>>``: OR groups of AND items, empty ones dropped.

    An item with several words asks for them close together, one with a single
    word asks for it anywhere.
    """

    def item(part: Column) -> Column:
        keywords = text.blank_split(part)
        return F.struct(
            F.when(F.size(keywords) > 1, "proximity").otherwise("standalone").alias("kind"),
            keywords.alias("keywords"),
        )

    def items(group: Column) -> Column:
        parsed = F.transform(F.split(text.strip(group), _AND), item)
        return F.filter(parsed, lambda i: F.size(i["keywords"]) > 0)

    groups = F.transform(F.split(F.lower(query), _OR), lambda g: F.struct(items(g).alias("items")))
    kept = F.filter(groups, lambda g: F.size(g["items"]) > 0)
    return F.transform(kept, lambda g, i: F.struct(i.cast("int").alias("group_no"), g["items"].alias("items")))


def term_match(keyword: Column, word: Column) -> Column:
    """Both in lower case. Keywords under three characters must equal the word, longer ones occur in it."""
    return F.when(F.length(keyword) < 3, keyword == word).otherwise(F.contains(word, keyword))


def _nth(tokens: Column, position: Column) -> Column:
    return F.element_at(tokens, (position + 1).cast("int"))


def _last_index(tokens: Column) -> Column:
    return F.size(tokens) - 1


def _index_range(tokens: Column, first: Column, last: Column) -> Column:
    """Positions ``first..last`` cut to the text."""
    return F.sequence(F.greatest(first, F.lit(0)), F.least(last, _last_index(tokens)))


def keyword_positions(lowered: Column, keyword: Column) -> Column:
    equal = F.transform(lowered, lambda word, i: F.when(word == keyword, i))
    within = F.transform(lowered, lambda word, i: F.when(F.contains(word, keyword), i))
    return F.array_compact(F.when(F.length(keyword) < 3, equal).otherwise(within))


def any_keyword_positions(lowered: Column, keywords: Column) -> Column:
    marked = F.transform(
        lowered, lambda word, i: F.when(F.exists(keywords, lambda k: term_match(k, word)), i)
    )
    return F.array_compact(marked)


def _render(tokens: Column, start: Column, end: Column, is_hit) -> Column:
    """Words ``start..end`` joined by blanks, hits in bold."""
    window = F.slice(tokens, start + 1, end - start + 1)
    bold = F.transform(
        window,
        lambda word, i: F.when(is_hit(word, i + start), F.concat(F.lit("**"), word, F.lit("**"))).otherwise(word),
    )
    return F.array_join(bold, " ")


def snippet_around(tokens: Column, position: Column) -> Column:
    """Context of one hit; what one side lacks is given to the other side.

    When both sides are short only the right side is extended.
    """
    right_room = _last_index(tokens) - position
    before = F.least(position, F.lit(WINDOW))
    after = F.least(right_room, F.lit(WINDOW))
    after_wide = F.when(before < WINDOW, F.least(right_room, 2 * WINDOW - before)).otherwise(after)
    before_wide = F.when(
        (before >= WINDOW) & (after < WINDOW), F.least(position, 2 * WINDOW - after)
    ).otherwise(before)
    return _render(tokens, position - before_wide, position + after_wide, lambda _, i: i == position)


def standalone_snippets(tokens: Column, lowered: Column, keyword: Column) -> Column:
    """One snippet for each position of the keyword."""
    return F.transform(keyword_positions(lowered, keyword), lambda p: snippet_around(tokens, p))


def pair_snippets(tokens: Column, lowered: Column, keywords: Column, distance: Column) -> Column:
    """Snippets of two keywords at most ``distance`` apart; the same word may serve both.

    Looks only at the words near each hit of the first keyword, so the work does
    not grow with the product of the hit counts.
    """
    second = F.element_at(keywords, 2)

    def partners(p1: Column) -> Column:
        near = _index_range(tokens, p1 - distance, p1 + distance)
        return F.filter(near, lambda p2: term_match(second, _nth(lowered, p2)))

    def render(p1: Column, p2: Column) -> Column:
        start = F.greatest(F.least(p1, p2) - WINDOW, F.lit(0))
        end = F.least(F.greatest(p1, p2) + WINDOW, _last_index(tokens))
        return _render(tokens, start, end, lambda _, i: (i == p1) | (i == p2))

    first_hits = keyword_positions(lowered, F.element_at(keywords, 1))
    snippets = F.transform(first_hits, lambda p1: F.transform(partners(p1), lambda p2: render(p1, p2)))
    return F.array_distinct(F.flatten(snippets))


def group_anchor(lowered: Column, keywords: Column, distance: Column) -> Column:
    """First keyword position from which every keyword occurs within the span; NULL when there is none.

    The span is ``distance`` for each keyword after the first, counted to the right
    only. Repeated keywords never satisfy it.
    """
    span = distance * (F.size(keywords) - 1)

    def covers(anchor: Column) -> Column:
        near = F.slice(lowered, anchor + 1, span + 1)
        return F.forall(keywords, lambda k: F.exists(near, lambda word: term_match(k, word)))

    anchors = any_keyword_positions(lowered, keywords)
    first = F.aggregate(
        anchors,
        F.lit(None).cast("int"),
        lambda found, a: F.coalesce(found, F.when(covers(a), a)),
    )
    return F.when(F.size(F.array_distinct(keywords)) == F.size(keywords), first)


def group_snippets(tokens: Column, lowered: Column, keywords: Column, distance: Column) -> Column:
    """At most one snippet for three or more keywords: from the anchor to the last keyword in its span."""
    span = distance * (F.size(keywords) - 1)

    def is_any(word: Column) -> Column:
        return F.exists(keywords, lambda k: term_match(k, F.lower(word)))

    def render(anchor: Column) -> Column:
        near = _index_range(tokens, anchor, anchor + span)
        last = F.array_max(F.filter(near, lambda p: is_any(_nth(tokens, p))))
        start = F.greatest(anchor - WINDOW, F.lit(0))
        end = F.least(last + WINDOW, _last_index(tokens))
        return _render(tokens, start, end, lambda word, _: is_any(word))

    anchors = F.array_compact(F.array(group_anchor(lowered, keywords, distance)))
    return F.transform(anchors, render)


def item_snippets(tokens: Column, lowered: Column, keywords: Column, distance: Column) -> Column:
    """Snippets of one AND item; an empty array means that the item does not match."""
    return (
        F.when(F.size(keywords) == 1, standalone_snippets(tokens, lowered, F.element_at(keywords, 1)))
        .when(F.size(keywords) == 2, pair_snippets(tokens, lowered, keywords, distance))
        .otherwise(group_snippets(tokens, lowered, keywords, distance))
    )


def standalone_matches(lowered: Column, keyword: Column) -> Column:
    within = F.exists(lowered, lambda word: F.contains(word, keyword))
    return F.when(F.length(keyword) < 3, F.array_contains(lowered, keyword)).otherwise(within)


def pair_matches(lowered: Column, keywords: Column, distance: Column) -> Column:
    """Some hit of the second keyword lies within ``distance`` of some hit of the first."""
    second = F.element_at(keywords, 2)

    def has_partner(p1: Column) -> Column:
        start = F.greatest(p1 - distance, F.lit(0))
        near = F.slice(lowered, start + 1, p1 + distance - start + 1)
        return F.exists(near, lambda word: term_match(second, word))

    return F.exists(keyword_positions(lowered, F.element_at(keywords, 1)), has_partner)


def group_matches(lowered: Column, keywords: Column, distance: Column) -> Column:
    return group_anchor(lowered, keywords, distance).isNotNull()


def item_matches(lowered: Column, keywords: Column, distance: Column) -> Column:
    return (
        F.when(F.size(keywords) == 1, standalone_matches(lowered, F.element_at(keywords, 1)))
        .when(F.size(keywords) == 2, pair_matches(lowered, keywords, distance))
        .otherwise(group_matches(lowered, keywords, distance))
    )


def all_items_match(lowered: Column, items: Column, distance: Column) -> Column:
    return F.forall(items, lambda i: item_matches(lowered, i["keywords"], distance))


GROUP = "struct<group_no:int,items:array<struct<kind:string,keywords:array<string>>>>"


def first_matching_group(lowered: Column, groups: Column, distance: Column) -> Column:
    """The first OR group whose items all match, or NULL; later groups are not evaluated."""
    return F.aggregate(
        groups,
        F.lit(None).cast(GROUP),
        lambda found, g: F.coalesce(found, F.when(all_items_match(lowered, g["items"], distance), g)),
    )


def label(keywords: Column) -> Column:
    return F.array_join(keywords, " ")


def snippet_map(tokens: Column, lowered: Column, items: Column, distance: Column) -> Column:
    """Label -> snippets for the items of a matching group; equal labels fall together."""
    entries = F.transform(
        items,
        lambda i: F.struct(
            label(i["keywords"]).alias("key"),
            item_snippets(tokens, lowered, i["keywords"], distance).alias("value"),
        ),
    )
    return F.map_from_entries(F.array_distinct(entries))


def word_proximity(tokens: Column, query_words: Column, distance: Column | int = DEFAULT_DISTANCE) -> Column:
    """All words close together among the blank-separated lower-case ``tokens``, by substring.

    Two words: any pair of hits at most ``distance`` apart. More: some hit of the
    first word has every other word within ``distance`` on either side. Fewer
    than two words: always true.
    """
    distance = F.lit(distance) if isinstance(distance, int) else distance
    first = F.element_at(query_words, 1)
    others = F.slice(query_words, 2, F.greatest(F.size(query_words) - 1, F.lit(0)))

    def near(position: Column) -> Column:
        start = F.greatest(position - distance, F.lit(0))
        window = F.slice(tokens, start + 1, position + distance - start + 1)
        return F.forall(others, lambda o: F.exists(window, lambda word: F.contains(word, o)))

    hits = F.array_compact(F.transform(tokens, lambda word, i: F.when(F.contains(word, first), i)))
    return F.when(F.size(query_words) <= 1, True).otherwise(F.exists(hits, near))
