"""Manifests against trees built from one list."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pictorium.llm import merkle
from pictorium.llm.queries import QUERIES


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes, fan_out):
    """The root of a list and the siblings of each node, level by level."""
    at, siblings = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i:i + fan_out] for i in range(0, len(nodes), fan_out)]
        for leaf, place in enumerate(at):
            run, inside = runs[place // fan_out], place % fan_out
            siblings[leaf].append((run[:inside], run[inside + 1:]))
        at, nodes = [p // fan_out for p in at], [digest(*r) for r in runs]
    return nodes[0], siblings


def plain_proofs(rows, fan_out):
    """Per row (grp, id, leaf, claimed): subroot, root, proof, folded root."""
    key = lambda r: (r[1] is None, r[1] or 0, r[2], r[3])
    names = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    groups = [sorted((r for r in rows if r[0] == g), key=key) for g in names]
    trees = [plain_tree([r[2] for r in g], fan_out) for g in groups]
    root, outer = plain_tree([t[0] for t in trees], fan_out)
    found = []
    for g, (subroot, inner), above in zip(groups, trees, outer):
        for r, own in zip(g, inner):
            folded = r[3]
            for before, after in own + above:
                folded = digest(*before, folded, *after)
            proof = "".join(h for before, after in own + above for h in before + after)
            found.append((r[1], r[2], subroot, root, proof, folded, folded == root))
    return found


def leaf_rows(sizes):
    rows = []
    for g, n in sizes.items():
        for i in range(n):
            leaf = digest(str(g), str(i))
            rows.append((g, i * 3 % max(n, 1), leaf, digest(leaf) if i % 5 == 0 else leaf))
    return rows


@pytest.mark.parametrize("fan_out, height", [(2, 2), (2, 10), (3, 1), (5, 2)])
def test_proofs_equal_plain_trees(spark, fan_out, height):
    # One group with most of the rows, full superblocks, lone leaves, a null name, null and repeated ids, repeated rows.
    rows = leaf_rows({"en": 131, "de": 4, "": 1, None: 9, "é": 2, "z": fan_out ** (2 * height) if height < 3 else 16})
    rows += [("en", None, digest("n"), digest("n")), ("en", None, digest("n"), digest("n")), ("en", 5, digest("five"), digest("no"))]
    leaves = spark.createDataFrame(rows, "grp string, id long, leaf string, claimed string").repartition(5)
    manifest = merkle.build(leaves, fan_out, height)
    found = merkle.prove(manifest).collect()
    same = lambda x: tuple(map(str, x))
    got = [(r.id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in found]
    assert sorted(got, key=same) == sorted(plain_proofs(rows, fan_out), key=same)
    assert all(merkle.fold(r.leaf, r.places, r.proof) == manifest.root() for r in found)
    assert [r.grp for r in manifest.subroots().orderBy("grp").collect()] == ["", "+", "+de", "+en", "+z", "+é"]


def test_single_leaf_and_empty_table(spark):
    schema = "grp string, id long, leaf string, claimed string"
    one = merkle.build(spark.createDataFrame([(None, None, "ab", "cd")], schema))
    assert one.root() == "ab"
    (row,) = merkle.prove(one).collect()
    assert (row.id, row.subroot, row.root, row.proof, row.folded_root, row.verified) == (None, "ab", "ab", "", "cd", False)
    none = merkle.build(spark.createDataFrame([], schema))
    assert none.root() is None and merkle.prove(none).collect() == []
    with pytest.raises(ValueError):
        merkle.build(spark.createDataFrame([], schema), fan_out=1)


def test_leaf_digest_tells_values_apart(spark):
    rows = [("a", "bc"), ("ab", "c"), (None, "-"), ("-", None), (None, None), ("", ""), ("é", "x" * 100_000)]
    df = spark.createDataFrame(rows, "x string, y string")
    found = [r.h for r in df.select(merkle.leaf_digest(F.col("x"), F.col("y")).alias("h")).collect()]
    field = lambda v: "-" if v is None else f"{len(v.encode())}:{v}"
    assert found == [digest(field(x), field(y)) for x, y in rows] and len(set(found)) == len(rows)


def test_query_finds_the_tampered_rows(spark, tmp_path):
    docs = [(i, f"t{i}" if i % 4 else None, ["en", "de", None][i % 3], "s" if i % 2 else None, None if i == 7 else i) for i in range(60)] + [(None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).withColumn("root", F.lit("x")).withColumn("grp", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    from zlib import crc32
    changed = {d[0] for d in docs if d[0] is not None and crc32(str(d[0]).encode()) % 7 == 0 and d[4] is not None}
    assert len(found) == len(docs) and {r.doc_id for r in found if not r.verified} == changed
    assert all((r.folded_root == r.root) == r.verified for r in found)
