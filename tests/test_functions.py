"""Column functions against small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pictorium.functions import keywords as K
from pictorium.functions import names as N
from pictorium.functions import ranking as R
from pictorium.functions import text as T


def one(spark, value, schema, column):
    return spark.createDataFrame([(value,)], f"v {schema}").select(column(F.col("v")).alias("r")).first()["r"]


def many(spark, values, schema, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r["r"] for r in rows.select("i", column(F.col("v")).alias("r")).orderBy("i").collect()]


def test_file_extension(spark):
    names = ["a.jpg", "IMG.tar.GZ", ".hidden", "..jpg", "a.", "x", "é.HEIC", "a.b c"]
    assert many(spark, names, "string", N.file_extension) == [".jpg", ".gz", "", ".jpg", "", "", ".heic", ".b c"]


def test_thumbnail_and_upload_names(spark):
    assert many(spark, ["IMG_1.HEIC", "IMG_1.png", "x"], "string", N.thumbnail_name) == [
        "IMG_1_HEIC.jpg", "IMG_1_png.jpg", "x_.jpg",
    ]
    name = lambda v: N.upload_name(v, F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"))
    assert one(spark, "my pic (1).JPG", "string", name) == "upload_20240506_070809_my_pic__1_.jpg"
    trash = lambda v: N.trash_name(v, F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"))
    assert one(spark, "a.PNG", "string", trash) == "a_20240506_070809.PNG"


def test_valid_names(spark):
    assert many(spark, ["a.jpg", "..", "a/b", "a\\b", ".", None], "string", N.is_valid_name) == [
        True, False, False, False, False, False,
    ]
    albums = ["trip", "/etc", "/photos/trip", "a/../b", "/photosx"]
    assert many(spark, albums, "string", lambda v: N.is_valid_album(v, "/photos")) == [True, False, True, False, False]


def test_blanks_and_completeness(spark):
    texts = ["ok.", "ok. \n", "ok. ", "no", "", "  ", None, "what? ", "x!"]
    assert many(spark, texts, "string", T.is_incomplete) == [False, False, False, True, True, True, True, False, False]
    assert one(spark, "a b  c\n\x1fd ", "string", T.word_count) == 4
    assert len(T.WHITESPACE) == len(set(T.WHITESPACE)) and all(c.isspace() for c in T.WHITESPACE)
    every_blank = {chr(i) for i in range(0x11000) if chr(i).isspace()}
    assert set(T.WHITESPACE) == every_blank


def test_tags_follow_the_vocabulary_order(spark):
    assert one(spark, "A woman walks her DOG in the city; carpet", "string", T.tag_keywords) == [
        "man", "woman", "dog", "car", "city",
    ]


@pytest.mark.parametrize(
    "keyword, word, expected",
    [("hair", "chair", True), ("dog", "dogs", True), ("ox", "fox", False), ("ox", "ox", True),
     ("mountain", "mount", False), ("car", "scarf", True)],
)
def test_term_match(spark, keyword, word, expected):
    assert one(spark, keyword, "string", lambda v: K.term_match(v, F.lit(word))) is expected


def positions_text(places):
    """Words ``w0 w1 …`` with keywords put at given positions."""
    last = max(p for _, p in places)
    words = [f"w{i}" for i in range(last + 1)]
    for keyword, place in places:
        words[place] = keyword
    return " ".join(words)


@pytest.mark.parametrize(
    "keywords, places, expected",
    [
        (["a1x", "b1x"], [("a1x", 0), ("b1x", 3)], True),
        (["a1x", "b1x"], [("a1x", 0), ("b1x", 4)], False),
        (["dog", "dogs"], [("dogs", 5)], True),
        (["x1x", "y1y", "z1z"], [("x1x", 0), ("y1y", 3), ("z1z", 6)], True),
        (["x1x", "y1y", "z1z"], [("x1x", 0), ("y1y", 3), ("z1z", 7)], False),
        (["x1x", "y1y", "z1z"], [("x1x", 6), ("y1y", 0), ("z1z", 3)], True),
        (["x1x", "x1x", "y1y"], [("x1x", 0), ("y1y", 1)], False),
        (["x1x", "x1x"], [("x1x", 0)], True),
    ],
)
def test_proximity(spark, keywords, places, expected):
    df = spark.createDataFrame([(keywords, positions_text(places))], "k array<string>, t string")
    df = df.select("k", T.words(F.col("t")).alias("w")).withColumn("l", K.lower_all(F.col("w")))
    got = df.select(
        K.item_matches(F.col("l"), F.col("k"), F.lit(3)).alias("m"),
        F.size(K.item_snippets(F.col("w"), F.col("l"), F.col("k"), F.lit(3))).alias("n"),
    ).first()
    assert got["m"] is expected
    assert (got["n"] > 0) is expected


@pytest.mark.parametrize(
    "count, hit, expected",
    [(10, 0, "**w0** w1 w2 w3 w4 w5 w6"), (10, 8, "w3 w4 w5 w6 w7 **w8** w9"),
     (10, 5, "w2 w3 w4 **w5** w6 w7 w8"), (3, 1, "w0 **w1** w2")],
)
def test_snippet_of_one_hit(spark, count, hit, expected):
    words = [f"w{i}" for i in range(count)]
    assert one(spark, words, "array<string>", lambda v: K.snippet_around(v, F.lit(hit))) == expected


def test_pair_snippets_are_distinct_and_ordered(spark):
    text = "red dog red dog far far far far far far red dog"
    df = spark.createDataFrame([(text,)], "t string").select(T.words(F.col("t")).alias("w"))
    df = df.withColumn("l", K.lower_all(F.col("w")))
    keywords = F.array(F.lit("red"), F.lit("dog"))
    snippets = df.select(K.pair_snippets(F.col("w"), F.col("l"), keywords, F.lit(1)).alias("s")).first()["s"]
    assert snippets == [
        "**red** **dog** red dog far",
        "red **dog** **red** dog far far",
        "red dog **red** **dog** far far far",
        "far far far **red** **dog**",
    ]


def test_group_snippet_marks_all_keywords_in_the_window(spark):
    text = "Zed one two three four zed five six seven"
    df = spark.createDataFrame([(text,)], "t string").select(T.words(F.col("t")).alias("w"))
    df = df.withColumn("l", K.lower_all(F.col("w")))
    keywords = F.array(F.lit("two"), F.lit("three"), F.lit("zed"))
    snippets = df.select(K.group_snippets(F.col("w"), F.col("l"), keywords, F.lit(2)).alias("s")).first()["s"]
    # First anchor is position 0: zed, two and three lie within four words of it.
    assert snippets == ["**Zed** one **two** **three** four **zed** five"]


def test_parse_query(spark):
    def shape(text):
        groups = one(spark, text, "string", K.parse_query)
        return [[(i["kind"], i["keywords"]) for i in g["items"]] for g in groups]

    assert shape("red hair") == [[("proximity", ["red", "hair"])]]
    assert shape("red or hair") == [[("standalone", ["red"])], [("standalone", ["hair"])]]
    assert shape("Red Hair and dog") == [[("proximity", ["red", "hair"]), ("standalone", ["dog"])]]
    assert shape("order") == [[("standalone", ["order"])]]
    assert shape("or dog") == [[("proximity", ["or", "dog"])]]
    assert shape("a OR b And c") == [[("standalone", ["a"])], [("standalone", ["b"]), ("standalone", ["c"])]]


def test_word_proximity(spark):
    def near(words, places):
        df = spark.createDataFrame([(words, positions_text(places).split())], "q array<string>, t array<string>")
        return df.select(K.word_proximity(F.col("t"), F.col("q")).alias("r")).first()["r"]

    assert near(["xx", "yy", "zz"], [("xx", 6), ("yy", 0), ("zz", 3)]) is False
    assert near(["xx", "yy", "zz"], [("xx", 3), ("yy", 0), ("zz", 6)]) is True
    assert near(["qq"], [("xx", 0)]) is True
    assert near(["xx", "qq"], [("xx", 0)]) is False
    assert near(["pink", "hair"], [("pink", 1), ("hair", 2)]) is True


def test_expand_query(spark):
    rules = dict(R.EXPANSIONS)
    asked = ["Sad People", "two sad people", "a happy moment", "happy moment", "carpet", "xyz"]
    keys = ["sad people", "sad people", "happy", "happy moment", "pet", None]
    expected = [q if k is None else f"{q} {rules[k]}" for q, k in zip(asked, keys)]
    assert many(spark, asked, "string", R.expand_query) == expected


FACTORS = [
    ("pink hair", "vibrant pink hair", [("vibrant", "hair")], 1.10),
    ("pink hair", "dark brown hair and a pink shirt", [("dark", "hair"), ("brown", "hair"), ("pink", "shirt")], 0.60),
    ("pink hair", "hair that is pinkish, pinkish curly hair", [("pinkish", "hair"), ("curly", "hair")], 1.10),
    ("hair pink", "pink curly hair", [("pink", "hair"), ("curly", "hair")], 1.10),
    ("pink hair", "long hair", [], 0.75),
    ("pink hair", "a red car", [], 1.00),
    ("dog", "two dogs", [], 1.10),
    ("a dog", "the dog", [], 1.10),
    ("at", "at home", [], 1.00),
    ("red hair dog", "red hair only", [], 1.0 - 0.5 * (1.0 - 2 / 3)),
    ("pink hair", "pink and hair", [], 0.60),
]


@pytest.mark.parametrize("max_literal", [64, 0])
def test_lexical_factor(spark, library, queries, max_literal):
    """Case by case, and always one of the values that the rule can give."""
    from pictorium.operators import hybrid as H

    annotated = [(i, a, n) for i, (_, _, pairs, _) in enumerate(FACTORS) for a, n in pairs]
    pairs = spark.createDataFrame(annotated, "photo_id long, adj string, noun string")
    asked, texts = queries(*[f[0] for f in FACTORS]), library(*[f[1] for f in FACTORS])
    found = {(r["query_id"], r["photo_id"]): r["factor"]
             for r in H.lexical_factors(asked, texts, pairs, max_literal=max_literal).collect()}
    for i, (_, _, _, expected) in enumerate(FACTORS):
        assert found.get((i, i), 1.0) == pytest.approx(expected, abs=1e-12)
    assert all(f in (0.6, 1.0, 1.1) or 0.5 <= f < 1 for f in found.values())
