"""Registered queries of the operators, by the result that each is to give."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pictorium.llm import bpe, common, conversations, exact_dedup, fingerprints, merkle, near_dedup, packing, pii, quality, suffix_dedup, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query("op6_exact_dedup", check=f"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
         g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.owners(documents(spark, sf_dir))


@query("op9_quality_rules", check=r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                      list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
               FROM documents),
         p AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
         g AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER s || ' ' || lead(x, 2) OVER s || ' ' || lead(x, 3) OVER s
                      || ' ' || lead(x, 4) OVER s AS gram FROM p WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
         c AS (SELECT doc_id, gram FROM g WHERE gram IS NOT NULL GROUP BY doc_id, gram HAVING count(*) > 1),
         r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g JOIN c USING (doc_id, gram), range(5) AS o(j) GROUP BY doc_id),
         m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                      len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
                      len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0) AS n_repeat_words
               FROM d LEFT JOIN r USING (doc_id)),
         f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                      CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
                      + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
                      + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
                      AS fail_bits FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_bits = 0 AS kept,
           CAST(fail_bits AS BIGINT) AS fail_bits FROM f""")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = quality.POLICIES["base/1"]
    found = quality.judge(quality.ledger(documents(spark, sf_dir)))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "fail_bits",
    )


@query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added_tokens=True)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op10_near_dedup", check=rf"""
    WITH RECURSIVE d AS (
           SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'),
                                      lambda w: w <> '') AS w FROM documents),
         p AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d WHERE len(w) >= 5),
         g AS (SELECT doc_id, x || ' ' || lead(x, 1) OVER s || ' ' || lead(x, 2) OVER s || ' ' || lead(x, 3) OVER s
                      || ' ' || lead(x, 4) OVER s AS gram FROM p WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
         h AS (SELECT DISTINCT doc_id, gram FROM g WHERE gram IS NOT NULL
               UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
         n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
         j AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM h a JOIN h b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
         e AS (SELECT u, v FROM j JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
         r AS (SELECT doc_id AS s, doc_id AS t FROM d UNION SELECT r.s, e.v FROM r JOIN e ON e.u = r.t),
         k AS (SELECT s AS doc_id, min(t) AS component_id FROM r GROUP BY s)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM k LEFT JOIN n USING (doc_id)""")
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), percent=85)


# A hexadecimal digest in bare upper-case base32: five hexadecimal digits are four letters.
_BASE32 = """list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda b:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr({hex}, CAST(5 * g + 1 AS INT), 5) AS INT) >> CAST(b AS INT)) & 31) + 1 AS INT), 1)),
    'string_agg', '')), 'string_agg', '')"""


@query("op1_warc", check=f"""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
         f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
    SELECT page_id, octet_length(b) AS payload_bytes, {_BASE32.format(hex="h")} AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM p JOIN f USING (h)""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = warc.archive_folder(spark)
    files = warc.write_archives(pages, folder, min_bytes=0)
    return warc.page_records(warc.read_archives(spark, files, folder))


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("pii_spans", lambda s: s["kind"] != "term")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.span_list(base).cast("binary"), 256).alias("base_sha256"), pii.span_list(F.col("pii_spans")).alias("spans"),
    )


URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@query("op8_url_filter", check=rf"""
    WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url,
                      translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host,
                      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
         t AS (SELECT page_id, host, path, CASE WHEN contains(url, '://') THEN list_sort(list_distinct(
                 list_transform(list_filter([lower(split_part(url, '://', 1))], lambda x: x <> ''), lambda x: 's:' || x)
                 || list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x)
                 || list_transform(list_filter(string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/'), lambda x: x <> ''), lambda x: 'p:' || x)
                 || list_transform(list_filter(list_transform(string_split(regexp_extract(url, '(?s)^[^#?]*\?([^#]*)', 1), '&'),
                      lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'q:' || x)
                 || list_transform(list_filter([regexp_extract(url, '(?s)^[^#]*#(.*)$', 1)], lambda x: x <> ''), lambda x: 'f:' || x)))
               ELSE [] END AS tokens FROM u),
         l AS (SELECT doc_id, bool_or(quality = 0) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
         i AS (SELECT tokens, bad FROM t JOIN l ON doc_id = page_id),
         e AS (SELECT row_number() OVER () AS r, bad, tokens FROM i),
         c AS (SELECT r, bad, tokens, 0 AS k, CAST([] AS VARCHAR[]) AS s FROM e
               UNION ALL SELECT r, bad, tokens, k + 1, CASE WHEN held THEN list_append(s, tokens[k + 1]) ELSE s END
               FROM c, (SELECT unnest([true, false]) AS held) WHERE k < len(tokens)),
         m AS (SELECT s FROM c WHERE k = len(tokens) AND len(s) > 0 GROUP BY s
               HAVING count_if(bad) >= {url_filter.MIN_COUNT} AND count_if(bad) >= {url_filter.MIN_CONFIDENCE} * count(*)),
         v AS (SELECT page_id, host, path, CASE
                 WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
               EXISTS (SELECT 1 FROM m WHERE list_has_all(t.tokens, m.s)) AS mined FROM t)
    SELECT page_id, host, path, rule, mined,
           CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR mined THEN 'block' ELSE 'allow' END AS verdict FROM v""")
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return url_filter.judge(pages, labels, URL_RULES)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = common.crc_fold(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


# CRC-32 of an ASCII text, bit by bit.
_CRC32 = """list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in merkle.FIELDS) + ")"


@query("op11_merkle_manifest", check=f"""
    WITH RECURSIVE d AS (
           SELECT doc_id, lang, {_LEAF} AS leaf,
                  {_LEAF.replace("n_chars", f"(n_chars + CASE WHEN xor({_CRC32.format(text='CAST(doc_id AS VARCHAR)')}, 4294967295) % 7 = 0 THEN 1 ELSE 0 END)")} AS claimed
           FROM documents),
         o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos FROM d),
         t AS (SELECT lang, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM o
               UNION ALL
               SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2),
         s AS (SELECT lang, h AS subroot, lvl AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM t WHERE n = 1),
         u AS (SELECT 0 AS lvl, place AS pos, subroot AS h, count(*) OVER () AS n FROM s
               UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, pos // 2),
         p AS (SELECT o.lang, pos AS row, 0 AS lvl, pos, '' AS proof, claimed AS f FROM o
               UNION ALL
               SELECT p.lang, p.row, p.lvl + 1, p.pos // 2, p.proof || coalesce(t.h, ''),
                      sha256(CASE WHEN p.pos % 2 = 0 THEN p.f || coalesce(t.h, '') ELSE t.h || p.f END)
               FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang AND p.lvl < s.top
               LEFT JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.lvl = p.lvl AND t.pos = xor(p.pos, 1)),
         g AS (SELECT p.lang, p.row, 0 AS lvl, s.place AS pos, p.proof, p.f FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang AND p.lvl = s.top
               UNION ALL
               SELECT g.lang, g.row, g.lvl + 1, g.pos // 2, g.proof || coalesce(u.h, ''),
                      sha256(CASE WHEN g.pos % 2 = 0 THEN g.f || coalesce(u.h, '') ELSE u.h || g.f END)
               FROM g LEFT JOIN u ON u.lvl = g.lvl AND u.pos = xor(g.pos, 1) WHERE g.lvl < (SELECT max(lvl) FROM u))
    SELECT o.doc_id, o.leaf, s.subroot, r.h AS root, sha256(g.proof) AS proof_sha256, g.f AS folded_root, g.f = r.h AS verified
    FROM o JOIN s ON s.lang IS NOT DISTINCT FROM o.lang JOIN (SELECT h FROM u WHERE n = 1) r ON true
    JOIN g ON g.lang IS NOT DISTINCT FROM o.lang AND g.row = o.pos AND g.lvl = (SELECT max(lvl) FROM u)""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    column = {c: F.col(c) for c in merkle.FIELDS}
    tampered = column | {"n_chars": F.when(common.crc_fold(F.col("doc_id"), 7) == 0, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))}
    leaves = docs.select(
        F.col("lang").alias("grp"), F.col("doc_id").alias("id"), merkle.leaf_digest(*column.values()).alias("leaf"),
        merkle.leaf_digest(*tampered.values()).alias("claimed"),
    )
    found = merkle.prove(merkle.build(leaves))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified",
    )


@query("op12_fingerprints")
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited(documents(spark, sf_dir))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")


_STATES = "[2, 2, 3, 2][{0} + 1]"
_CONV_KIND = "xor(" + _CRC32.format(text="(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))") + ", 4294967295) % 20"


@query("op13_conversation_repair", check=rf"""
    WITH RECURSIVE d AS (
           SELECT conv_id, turn, {_CONV_KIND} AS kind, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
         m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                      CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                      unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
         o AS (SELECT *, row_number() OVER w - 1 AS i, CASE WHEN role = '' THEN ' ' ELSE substr(role, 1, 1) END AS c,
                      regexp_extract(text, '(?s)([^ 	-
])[ 	-
]*$', 1) AS last,
                      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
               FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text), copy)),
         r AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN again THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                      lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM o),
         n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank,
                      count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) + 1 AS rows
               FROM r GROUP BY conv_id),
         k AS (SELECT unnest([0, 1, 2]) AS ins),
         x AS (SELECT s, ins, CASE ins WHEN 0 THEN s WHEN 1 THEN {_STATES.format("s")} ELSE {_STATES.format(_STATES.format("s"))} END AS e,
                      CASE ins WHEN 0 THEN '' WHEN 1 THEN CASE {_STATES.format("s")} WHEN 2 THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END
                        ELSE CASE {_STATES.format("s")} WHEN 2 THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE chr(10) || 'assistant:' || chr(10) || 'user:' END END AS put
               FROM k, (SELECT unnest([0, 1, 2, 3]) AS s)),
         v AS (SELECT s, ins, put, e, op, CASE op WHEN 'D' THEN e WHEN 'R' THEN {_STATES.format("e")}
                        WHEN 's' THEN CASE WHEN e = 0 THEN 1 END WHEN 'u' THEN CASE WHEN e <> 2 THEN 2 END ELSE CASE WHEN e = 2 THEN 3 END END AS z
               FROM x, (SELECT unnest(['D', 'R', 's', 'u', 'a']) AS op)),
         z AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} AS best, '' AS body FROM n
               UNION ALL
               SELECT z.conv_id, z.i + 1, v.z,
                      min({{'cost': z.best.cost + 3 * v.ins + CASE v.op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN v.op <> 'D' AND r.fault = 't' THEN 3 ELSE 0 END,
                            'audit': z.best.audit || repeat('I', v.ins) || CASE WHEN v.op IN ('D', 'R') THEN v.op ELSE 'K' END}}),
                      arg_min(z.body || v.put || CASE v.op WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || CASE v.z WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || r.text
                                ELSE chr(10) || r.role || ':' || r.text END,
                              {{'cost': z.best.cost + 3 * v.ins + CASE v.op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN v.op <> 'D' AND r.fault = 't' THEN 3 ELSE 0 END,
                                'audit': z.best.audit || repeat('I', v.ins) || CASE WHEN v.op IN ('D', 'R') THEN v.op ELSE 'K' END}})
               FROM z JOIN r ON r.conv_id IS NOT DISTINCT FROM z.conv_id AND r.i = z.i
               JOIN v ON v.s = z.s AND v.z IS NOT NULL AND (v.op = 'D' OR (r.fault NOT IN ('b', 'd') AND (v.op = 'R' OR v.op = r.c)))
               GROUP BY z.conv_id, z.i, v.z),
         f AS (SELECT z.conv_id, min({{'cost': z.best.cost + 3 * x.ins, 'audit': z.best.audit || repeat('I', x.ins)}}) AS best,
                      arg_min(z.body || x.put, {{'cost': z.best.cost + 3 * x.ins, 'audit': z.best.audit || repeat('I', x.ins)}}) AS body
               FROM z JOIN n ON n.conv_id IS NOT DISTINCT FROM z.conv_id AND z.i = n.rows JOIN x ON x.s = z.s AND x.e IN (0, 3) GROUP BY z.conv_id)
    SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
           CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(f.best.cost, 0) AS BIGINT) AS cost, coalesce(f.best.audit, '') AS audit, sha256(coalesce(substr(f.body, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
    LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id""")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repaired = conversations.repair(conversations.damage(rows))
    # Its rows are read once more: the digests of all conversations with rows.
    said = conversations.digests(repaired.rows)
    every = rows.select(F.col("conv_id").alias("every")).distinct()
    found = repaired.summary.withColumnRenamed("conv_id", "own").join(said, F.col("own").eqNullSafe(F.col("conv_id"))).drop("conv_id")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("every").eqNullSafe(F.col("own")), "left").select(
        F.col("every").alias("conv_id"), *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
