"""Sharding, source divergence and the prefix trie against brute force."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from talkmill.llm import divergence, sharding, trie
from talkmill.llm.queries import rebuilt

# --- sharding ---------------------------------------------------------------------------------------------------------


def keys(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("ü"), F.col("id")).alias("text"))


def where(df, tree):
    return {r[0]: r[1] for r in df.select("doc_id", sharding.path_of(F.col("doc_id"), tree)).collect()}


def plain(path):
    return path.split("/", 1)[1]


def test_shares_follow_the_weights(spark):
    tree = [sharding.Leaf("a", "x", 0, 1.0), sharding.Leaf("a", "y", 1, 3.0), sharding.Leaf("b", "z", 2, 4.0)]
    n = 8000
    found = collections.Counter(int(p.rsplit("/", 1)[1]) for p in where(keys(spark, n), tree).values())
    for leaf in tree:
        wanted = n * leaf.weight / 8
        assert abs(found[leaf.shard] - wanted) < 5 * wanted**0.5


def test_what_is_added_takes_rows_only_into_itself(spark):
    rows, tree = keys(spark, 4000), sharding.even_tree(2, 2, 2)
    before = where(rows, tree)
    for after_tree, target, share in (
        (sharding.grown(tree, "region0", "rack1", 8), "region0/rack1/8", 1 / 9), (sharding.grown(tree, "new", "rack", 8, 2), "new/rack/8", 2 / 10),
        (sharding.grown(tree, "region1", "rack0", 4, 3), "region1/rack0/4", 3 / 11),
    ):
        after = where(rows, after_tree)
        moved = [k for k in before if plain(before[k]) != plain(after[k])]
        assert {plain(after[k]) for k in moved} == {target}
        taken = sum(after[k].startswith("1/") for k in after)
        assert abs(taken - 4000 * share) < 5 * (4000 * share) ** 0.5


def test_what_shrinks_moves_only_its_subtree(spark):
    rows, tree = keys(spark, 4000), sharding.even_tree(2, 2, 2)
    before = where(rows, tree)
    for share in (0.25, 0.0):
        after = where(rows, sharding.shrunk(tree, 5, share))
        moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
        assert moved and all(b.startswith("0/region1") for b, _ in moved)
        for b, a in moved:  # between racks and shards of one region, rows leave only the rack and the shard that shrank
            if a.startswith("0/region1"):
                assert b.startswith("0/region1/rack0")
                if a.startswith("0/region1/rack0"):
                    assert b == "0/region1/rack0/5"
        assert share or not any(a.endswith("/5") for a in after.values())
    report = sharding.moves(rows, tree, sharding.shrunk(tree, 5, 0.25)).agg(F.sum("rows"), F.min("bytes")).first()
    assert report[0] == sum(before[k] != v for k, v in where(rows, sharding.shrunk(tree, 5, 0.25)).items()) and report[1] >= 16 + 3


def test_placed_rows(spark):
    rows = [(i % 50 if i % 3 else None, None if i % 7 == 0 else "" if i % 7 == 1 else "ä" * i, "x", "y") for i in range(300)]
    tree = sharding.even_tree(1, 2, 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string, __file string").repartition(3)
    out = sharding.placed(docs, tree, after=sharding.grown(tree, "region0", "rack0", 9)).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == collections.Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    by_shard = collections.defaultdict(list)
    for r in out:
        by_shard[r["shard"]].append(r)
        assert r["grown_shard"] in (r["shard"], 9)
    for found in by_shard.values():
        found.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in found] == list(range(len(found)))
        ids = [r["doc_id"] for r in found]
        assert ids == sorted(ids, key=lambda k: (k is not None, k))
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    assert sharding.placed(docs.limit(0), tree).collect() == []


def test_written_shards(spark, tmp_path):
    docs = keys(spark, 200).withColumn("__doc", F.lit(1)).withColumn("_metadata", F.lit("m"))
    tree = sharding.even_tree(1, 2, 2)
    sharding.write_shards(docs, f"{tmp_path}/out", tree)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.columns == ["doc_id", "text", "__doc", "_metadata", "shard"] and back.count() == 200
    assert back.filter(F.col("shard") != sharding.shard_of(F.col("doc_id"), tree)).count() == 0


def test_trees_that_cannot_be():
    with pytest.raises(ValueError):
        sharding._children([])
    with pytest.raises(ValueError):
        sharding._children([sharding.Leaf("a", "b", 0, 0.0)])
    with pytest.raises(ValueError):
        sharding._children([sharding.Leaf("a/b", "b", 0)])


# --- divergence -------------------------------------------------------------------------------------------------------


def audited(rows, least=3, top=200):
    rows = [tuple(v or "" for v in r[:3]) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), r[2])) for r in own]
        df = collections.Counter(t for w in words for t in set(w))
        kept = sorted(t for t in df if df[t] >= least)
        by = collections.defaultdict(collections.Counter)
        for r, w in zip(own, words):
            by[r[1]].update(t for t in w if df[t] >= least)
        every = sum(by.values(), collections.Counter())

        def p(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        shares, q = {s: p(c) for s, c in by.items()}, p(every)
        for s, ps in shares.items():
            pairs = [(o, sum((ps[t] - qs[t]) ** 2 // qs[t] for t in kept)) for o, qs in shares.items() if o != s]
            terms = [(t, (ps[t] - q[t]) ** 2 // q[t]) for t in kept if by[s][t] and ps[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["Eins", "zwei", "DREI", "vier4fünf", "ÄÖ", "äö", "x_y", "汉字", "a", "B", "é́"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(None, None, None), ("", "", ""), ("alone", "s", "once once once"), ("alone", "t", None), ("de", "empty", "1 2 3")]
    for i in range(n):
        text = " ".join(rng.choice(words[:5 + i % 25]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["de", "en", "en", None]), rng.choice(["a", "a", "a", "b", "c", "Ω", None]), text))
    return rows + rows[-3:]


@pytest.mark.parametrize("group_block,term_block", [(32, 8192), (2, 3), (1, 1)])
def test_divergences(spark, group_block, term_block, monkeypatch):
    rows = corpus(group_block)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "lang string, source string, text string, term string").repartition(3)
    if term_block == 3:  # tasks hand on their counts after every few documents
        monkeypatch.setattr(divergence, "COUNT_ROWS", 5)
    found = divergence.audit(docs, top=7, group_block=group_block, term_block=term_block).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in found) == audited(rows, top=7)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_large_counts_stay_exact(spark):
    import numpy as np

    counts = [10**13, 3, 0, 2**40]
    total, terms = sum(counts), 7
    want = [1 + 10**9 * (c + 1) // (total + terms) for c in counts]
    assert divergence.shares(np.array([counts]), np.array([total]), terms).tolist() == [want]
    df = spark.createDataFrame([(c, total, terms) for c in counts], "c bigint, n bigint, v bigint")
    assert [r[0] for r in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()] == want


# --- prefix trie ------------------------------------------------------------------------------------------------------


def trie_rows(paths):
    """All nodes of a dict conv -> list of (role, text), by definition."""
    members = collections.defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[:len(node)] == node]
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(node))
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], sum(not children[n] for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shown(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def conversations(seed, n=40):
    rng = random.Random(seed)
    said = [("user", "a"), ("user", "ü"), ("assistant", "a"), (None, None), ("", ""), ("user", "long " * 30)]
    found = {}
    for c in range(n):
        kind = rng.randrange(4)
        if kind == 0 and found:
            found[c] = list(rng.choice(list(found.values())))
        elif kind == 1 and found:
            old = rng.choice(list(found.values()))
            found[c] = old[:rng.randrange(len(old) + 1)] + [rng.choice(said) for _ in range(rng.randrange(1, 6))]
        else:
            found[c] = [rng.choice(said) for _ in range(rng.randrange(1, 12))]
    return found


def as_rows(paths):
    rows = [(c, None if i == 0 and c % 3 == 0 else i, r, t, "x") for c, turns in paths.items() for i, (r, t) in enumerate(turns)]
    random.Random(5).shuffle(rows)
    return rows


def filled(paths):
    return {c: [(r or "", t or "") for r, t in turns] for c, turns in paths.items()}


@pytest.mark.parametrize("seed,block,section", [(1, 4, 256), (2, 2, 2), (3, 1, 1), (4, 7, 1)])
def test_trie(spark, seed, block, section, monkeypatch):
    monkeypatch.setattr(trie, "SECTION", section)
    paths = conversations(seed)
    rows = [*as_rows(paths), (None, 0, "user", "of no conversation", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, depth string").repartition(3)
    assert shown(trie.trie_of(df, block=block)) == trie_rows(filled(paths))


def test_trie_with_rebuilt_beginnings(spark):
    paths = conversations(9, 60)
    del paths[10], paths[15]
    paths[11] = paths[11][:1]
    df = spark.createDataFrame(as_rows(paths), "conv_id bigint, turn bigint, role string, text string, x string")
    rows = trie.turn_rows(df)
    want = {}
    for c, turns in filled(paths).items():
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = filled(paths).get(c - c % 5, [])[:h] + turns[h:]
    assert any(not t for t in want.values())
    assert shown(trie.prefix_trie(rows.filter("pos = 1").select("conv"), rebuilt(rows))) == trie_rows(want)


def test_trie_of_little(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert trie.trie_of(spark.createDataFrame([], schema)).collect() == []
    rows = trie.turn_rows(spark.createDataFrame([], schema))
    alone = spark.createDataFrame([(7,), (30,)], "conv bigint")
    assert shown(trie.prefix_trie(alone, rows)) == trie_rows({7: [], 30: []})


def test_equal_turn_numbers_have_one_order(spark):
    rows = [(1, 0, "user", t) for t in "abcdef"] + [(2, 0, "user", t) for t in "fedcba"]
    found = shown(trie.trie_of(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    assert len(found) == 7 and all(r[3] == 2 for r in found)
