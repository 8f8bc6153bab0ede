import math
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pictorium.llm import pii, quality, toxicity, url_filter

from .samples import noise, prose

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PARTS = [
    "a@b.co", "x_", "@", "1.2.3.4", ".5", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-1", " ", "-", "+1 (555) 123-4567", "+",
    "9", "00", "é", "🙂", "a.b", "@mail.x-y.org", "++", "(", "0810992847249404", "\n", "01.002.3.4",
]


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = (int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if valid(k, m.group())]


def base(row):
    return [(s.kind, s.start, s.stop) for s in row.pii_spans if s.kind != "term"]


def test_base_spans_equal_plain_search(documents, odd_documents):
    chosen = random.Random(4)
    rows = [(100 + i, "".join(chosen.choice(PARTS) for _ in range(chosen.randint(0, 12)))) for i in range(1500)]
    rows += [(5, "a@" + "b." * 20_000 + "c"), (6, "1" * 50_000), (7, "+1" + "(" * 20_000), (8, "x@y.zz " * 2_000), (9, "a" * 50_000 + " @")]
    found = pii.detect(documents(*rows).union(odd_documents)).collect()
    assert len(found) == len(rows) + odd_documents.count()
    assert all(base(r) == plain_spans(r.text) for r in found)


def test_redaction_replaces_spans_only(documents):
    docs = documents((1, "write to a@b.co or +1 555 123 4567!"), (2, None), (3, "🙂 é 1.2.3.4"), (4, "nothing"))
    found = pii.redact(docs)
    assert found.columns == docs.columns
    assert pii.redact(docs.limit(0)).collect() == []
    assert {r.doc_id: r.text for r in found.collect()} == {1: "write to [EMAIL] or [PHONE]!", 2: None, 3: "🙂 é [IP]", 4: "nothing"}


def test_terms_that_give_an_entity_away_go(documents):
    rows = [(i, f"{prose(i, 6)} agent Zorblatt uses zz@spy.org with the {prose(50 + i, 6)}") for i in range(12)]
    rows += [(100 + i, "the agent uses tools with care " + prose(200 + i, 30)) for i in range(40)]
    found = {r.doc_id: r for r in pii.detect(documents(*rows)).collect()}
    for i in range(12):
        terms = [rows[i][1][s.start:s.stop] for s in found[i].pii_spans if s.kind == "term"]
        assert terms == ["Zorblatt"]
    assert not any(s.kind == "term" for i in range(100, 140) for s in found[i].pii_spans)


def test_terms_beside_an_entity_in_few_texts_and_far_away_go(documents):
    rows = [(i, f"{prose(i, 5)} Quixbury {prose(20 + i, 60)} qq@spy.org {prose(40 + i, 5)}") for i in range(4)]
    rows += [(100 + i, prose(200 + i, 80)) for i in range(400)]
    found = {r.doc_id: r for r in pii.detect(documents(*rows)).collect()}
    for i in range(4):
        assert "Quixbury" in [rows[i][1][s.start:s.stop] for s in found[i].pii_spans if s.kind == "term"]
    # One text and its copies are one context.
    once = {r.doc_id: r for r in pii.detect(documents(*([rows[0]] * 4 + rows[4:]))).collect()}
    assert not any(s.kind == "term" for r in once.values() for s in r.pii_spans)


def test_revealing_terms_go_from_texts_without_the_entity(documents):
    rows = [(i, f"{prose(i, 6)} Quixbury is at qq@spy.org {prose(40 + i, 6)}") for i in range(30)]
    rows += [(50, f"{prose(50, 6)} QUIXBURY has no address here")] + [(100 + i, prose(200 + i, 80)) for i in range(100)]
    found = {r.doc_id: r.text for r in pii.redact(documents(*rows, (51, None))).collect()}
    assert "QUIXBURY" not in found[50] and "has no address here" in found[50] and found[51] is None


def test_running_totals_of_long_arrays(spark):
    df = spark.range(1).select(pii.running_totals(F.sequence(F.lit(1).cast("long"), F.lit(500).cast("long"))).alias("t"))
    assert df.first().t == np.cumsum(np.arange(1, 501)).tolist()


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines))


def test_measures_equal_plain_counts(documents, odd_documents):
    rows = [(100 + i, noise(i, 60) + "\n" + "a b c d e " * (i % 4) + "#*") for i in range(60)] + [(900, prose(1, 40) + "\n" + prose(1, 40)), (901, "x " * 3000)]
    found = quality.measure(documents(*rows).union(odd_documents)).collect()
    expected = [plain_measures(t) for _, t in rows] + [plain_measures(r.text) for r in odd_documents.collect()]
    assert sorted(tuple(r)[1:] for r in found) == sorted(expected)


def test_policies_read_stored_bits_and_ablations_count_them(documents, odd_documents):
    docs = documents((1, prose(1, 60)), (2, "# " * 40), (3, "word"), (4, None)).union(odd_documents)
    entries = quality.ledger(docs)
    rows = entries.collect()
    for policy, bits in quality.POLICIES.items():
        kept = quality.judge(entries, policy).filter("kept").count()
        assert kept == sum(r.fail_bits & bits == 0 for r in rows)
        for r in quality.ablations(entries, policy).collect():
            bit = quality.mask(r.rule)
            assert r.n_fail == sum(bool(x.fail_bits & bit) for x in rows)
            assert r.n_only == sum(x.fail_bits & bits == bit for x in rows)
    assert quality.judge(entries).filter("kept and doc_id = 1").count() >= 1
    assert quality.ledger(odd_documents.limit(0)).collect() == []


def test_long_texts_are_judged_in_linear_time(documents):
    entries = quality.ledger(documents((1, " ".join(f"w{i}" for i in range(100_000))), (2, "a b c d e " * 20_000), (3, "few")))
    start = time.perf_counter()
    assert [r.doc_id for r in quality.judge(entries).filter("kept").collect()] == [1]
    assert [r.n_repeat_words for r in entries.filter("n_words > 10 and fail_bits > 0").collect()] == [100_000]
    assert time.perf_counter() - start < 60


def test_listed_rules(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    cases = {
        "http://example.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"), "https://a.EXAMPLE.org/en/12?x": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"), "http://x.com/de/#a": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com": ("x.com", "", None, "allow"), "x.org/es/": ("", "", None, "allow"), "": ("", "", None, "allow"), "://org/?a=/es/": ("org", "/", "org/", "allow"),
        "http://a\nb.org/x\ny?z": ("a\nb.org", "/x\ny", "org/", "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] + [(99, None), (99, None)], "page_id long, url string").withColumn("n", F.lit(1))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = url_filter.judge(pages, labels, rules).collect()
    expected = [*cases.values(), ("", "", None, "allow"), ("", "", None, "allow")]
    assert sorted(((r.host, r.path, r.rule, r.verdict) for r in found), key=repr) == sorted(expected, key=repr)
    assert url_filter.judge(pages.limit(0), labels, rules).collect() == []


def test_mined_rules_equal_counting_all_combinations(spark):
    chosen = random.Random(3)
    rows = []
    for i in range(400):
        bad_host, lang = chosen.random() < 0.2, chosen.choice(["en", "de"])
        host = chosen.choice(["spam", "junk"]) if bad_host else chosen.choice(["a", "b", "c"])
        label = 0 if (bad_host and chosen.random() < 0.9) or (lang == "de" and host == "b") else 1
        rows.append((i, f"http://{host}.example.com/{lang}/{i}?ref=x", label))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows] + [(1000, "http://spam.example.com/en/9?ref=x"), (1001, "http://a.example.com/en/9")], "page_id long, url string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5000, 0), (None, 0), (3, None)], "doc_id long, quality int")
    mined = url_filter.mine(pages, labels)
    of = {r.token: r["class"] for r in mined.classes.collect()}
    got = {tuple(r.classes): (r.n, r.n_all) for r in mined.rules.collect()}
    sets = {r.page_id: r.t for r in pages.select("page_id", url_filter.tokens(F.col("url")).alias("t")).collect()}
    total, bad = Counter(), Counter()
    for i, _, label in rows:
        for size in range(1, len(sets[i]) + 1):
            for c in combinations(sets[i], size):
                total[c] += 1
                bad[c] += label == 0
    expected = {c for c, n in bad.items() if n >= url_filter.MIN_COUNT and n >= url_filter.MIN_CONFIDENCE * total[c]}
    assert all(got[c] == (bad[c], total[c]) and c in expected for c in got) and ("h:spam",) in got
    # Every combination is there by its classes, or holds a class that is a rule by itself.
    assert all(any((of[t],) in got for t in c) or tuple(sorted({of[t] for t in c})) in got for c in expected)
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, []).collect()}
    assert verdicts == {i: "block" if any(set(c) <= set(t) for c in expected) else "allow" for i, t in sets.items()}
    assert verdicts[1000] == "block" and verdicts[1001] == "allow"


def test_rules_of_more_than_three_tokens_are_mined(spark):
    # Only all four bits together are unwanted, in 15 of 6,015 labelled URLs.
    bits = [[k >> j & 1 for j in range(4)] for k in range(15)] * 401 + [[1, 1, 1, 1]] * 15
    rows = [(i, "http://x.y/?" + "&".join(f"{'abcd'[j]}{v}" for j, v in enumerate(b)), int(not all(b))) for i, b in enumerate(bits)]
    pages, labels = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string"), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, []).collect()}
    assert verdicts == {i: "allow" if q else "block" for i, _, q in rows}


@pytest.mark.parametrize("wanted_too", [False, True])
def test_urls_of_many_shared_keys_are_mined(spark, wanted_too):
    # Sixty keys that always come together are one class; with them in wanted URLs as well, the host decides.
    keys = "&".join(f"k{j}=1" for j in range(60))
    rows = [(i, f"http://h{i % 3}.x/?{keys}", int(wanted_too and i % 3 > 0)) for i in range(60)] + [(100 + i, f"http://h0.y/{'a' * i}", 1) for i in range(60)]
    pages, labels = spark.createDataFrame([r[:2] for r in rows] + [(500, "http://new.x/?k7=2")], "page_id long, url string"), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    start = time.perf_counter()
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, []).collect()}
    assert time.perf_counter() - start < 60
    assert all(verdicts[i] == ("block" if q == 0 else "allow") for i, _, q in rows)
    assert verdicts[500] == ("allow" if wanted_too else "block")


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = prose(i, 60).split(" ")
        if toxic:
            for k in range(4):
                words[random.Random(i + k).randrange(60)] = random.Random(7 * i + k).choice(["trash", "moron", "vile", "scum"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, toxic int"), dict(labels)


def test_toxic_texts_of_the_held_out_fold_are_found(labelled, odd_documents):
    docs, labels, truth = labelled
    model = toxicity.learn(docs, labels)
    found = toxicity.score(docs.union(odd_documents.select("doc_id", "text").filter("doc_id is null")), model).collect()
    held = [r for r in found if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    odd = toxicity.score(odd_documents, model).collect()
    assert len(odd) == odd_documents.count() and all(0 <= r.score <= 1 for r in odd)
    left = toxicity.reject(odd_documents, model)
    assert left.columns == odd_documents.columns and left.count() == sum(r.predicted == 0 for r in odd)
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_rare_words_count_at_every_share(spark):
    rows, labels = [], []
    for i in range(600):
        # Each sign stands in two or three of the texts that are counted.
        sign = f"sign{i % 100 // 4 + 25 * (i // 4 % 3)}" if i % 4 == 0 else f"calm{i % 100}"
        rows.append((i, f"{prose(i, 12)} {sign} {prose(1000 + i, 12)}"))
        labels.append((i, int(i % 4 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    # All strings in the tasks, some, and none.
    found = [{r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, labels, head=n)).collect()} for n in (toxicity.HEAD_STRINGS, 300, 0)]
    assert len(found[0]) == len(rows) and found[1] == pytest.approx(found[0], abs=1e-9) and found[2] == pytest.approx(found[0], abs=1e-9)
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((found[0][i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.85 * len(held)
    assert sum(found[0][i] >= 0.5 for i in held) >= 0.6 * sum(i % 4 == 0 for i in held)


def plain_strings(word):
    letters = "\x02" + word + "\x03"
    return [letters[max(0, i - toxicity.ORDER + 1):i + 1] for i in range(1, len(letters))]


def plain_differences(counts, wanted):
    """Log-likelihood differences of words by counting strings in dictionaries, from ``{word: (toxic, ordinary)}``."""
    orders = {toxicity.ORDER: Counter()}, {toxicity.ORDER: Counter()}
    for word, both in counts.items():
        for string in plain_strings(word):
            for table, n in zip(orders, both):
                table[toxicity.ORDER][string] += n
    for order in range(toxicity.ORDER - 1, 0, -1):
        longer = [{g for g, n in table[order + 1].items() if n > 0} for table in orders]
        every = set(orders[0][order + 1]) | set(orders[1][order + 1])
        for table, own in zip(orders, longer):
            table[order] = Counter(g[-order:] for g in (own if order > toxicity.SHARED else every))
    letters = len(set(orders[0][1]) | set(orders[1][1])) + 1
    follows = [{order: {} for order in table} for table in orders]
    for table, after in zip(orders, follows):
        for order, strings in table.items():
            for g, n in strings.items():
                if n > 0:
                    total, kinds = after[order].get(g[:-1], (0, 0))
                    after[order][g[:-1]] = total + n, kinds + 1

    def likely(which, string):
        p = 1 / letters
        for order in range(1, toxicity.ORDER + 1):
            g = string[-order:]
            total, kinds = follows[which][order].get(g[:-1], (0, 0))
            if total:
                p = max(orders[which][order][g] - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * kinds / total * p
        return p

    return {w: sum(math.log(likely(0, g)) - math.log(likely(1, g)) for g in plain_strings(w)) for w in wanted}


def test_differences_equal_plain_counting(spark, documents, odd_documents):
    rows = [(i, prose(i, 15) + (" vile vilest" if i % 3 == 0 else " mild")) for i in range(60)]
    labels = [(i, int(i % 3 == 0)) for i, _ in rows]
    docs = documents(*rows).unionByName(odd_documents)
    model = toxicity.learn(docs, spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int"))
    counts, named = {}, {}
    texts = rows + [(r.doc_id, r.text) for r in odd_documents.collect()]
    label = dict(labels)
    for doc, text in texts:
        own = set(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (text or "").lower()))
        named |= dict.fromkeys(own)
        if doc in label and zlib.crc32(str(doc).encode()) % 5 not in (toxicity.HELD_OUT, toxicity.CALIBRATE):
            for w in own:
                toxic, ordinary = counts.get(w, (0, 0))
                counts[w] = toxic + label[doc], ordinary + 1 - label[doc]
    expected = plain_differences(counts, named)
    vocabulary = spark.createDataFrame([(i, w) for i, w in enumerate(named)], "key long, word string")
    joined = {r.key: r.diff / toxicity.UNIT for r in model.differences(vocabulary).collect()}
    inside, whole = model.head.differences([w.encode() for w in named])
    assert len(joined) == len(named) and whole.all()
    # Each string is rounded once.
    for i, w in enumerate(named):
        assert abs(joined[i] - expected[w]) < 1e-5 * (len(w) + 2) and inside[i] / toxicity.UNIT == joined[i]
    assert expected["vile"] > 2 and expected["mild"] < -1


def test_words_that_no_document_had_are_judged_by_their_spelling(spark, documents):
    rows = [(i, f"{prose(i, 20)} {'grumph' + 'aeiou'[i % 5] if i % 4 == 0 else ''}") for i in range(400)]
    model = toxicity.learn(documents(*rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    new = documents((1, prose(1, 20) + " grumphation grumphy"), (2, prose(2, 20) + " gladly"))
    assert {r.doc_id: r.predicted for r in toxicity.score(new, model).collect()} == {1: 1, 2: 0}


def test_toxicity_without_both_classes(labelled, odd_documents):
    docs, labels, _ = labelled
    scores = toxicity.score(odd_documents, toxicity.learn(docs, labels.limit(0))).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in scores)
