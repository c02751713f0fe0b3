"""Operators over the whole corpus, against brute force: exact and near duplicates, repeated lines, packing, the pipeline."""

import collections
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.llm import exact, jaccard, lines, packing
from talkmill.llm.queries import tokenizer_path


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, file string, row string")


def corpus(n=60, seed=1):
    """Random documents with exact copies, near copies, shared passages, null and empty texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = "\n".join(" ".join(rng.choice(words) for _ in range(20)) for _ in range(4))
    texts = [None, "", " \n", "one two", "one two", "One  TWO", "a b c d e", "A b c d e f"]
    for i in range(n):
        kind = rng.randrange(6) if len(texts) > 10 else 0
        if kind == 1:
            texts.append(rng.choice(texts))
        elif kind == 2:
            old = (rng.choice(texts) or "x").split(" ")
            old[rng.randrange(len(old))] = "changed"
            texts.append(" ".join(old))
        else:
            body = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6)))
            texts.append(f"{body}\n{passage}\n{i}" if kind == 3 else body)
    return texts


def rows_of(texts):
    return [(i, t, f"s{i % 3}" if i % 7 else None, "clash", "clash") for i, t in enumerate(texts)]


def check_groups(found, rows):
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(d)
    got = collections.Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in found)
    assert got == collections.Counter((d, max(g), len(g)) for g in groups.values() for d in g)
    assert sum(r["kept"] for r in found) == len(groups)


def test_exact_groups(spark):
    rows = rows_of(corpus()) + [(3, "one two", "x", None, None), (3, "one two", "x", None, None)]
    check_groups(exact.groups(table(spark, rows)).collect(), rows)
    kept = exact.deduplicate(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "file", "row"]
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({t or "" for _, t, *_ in rows})


def test_exact_groups_when_digests_collide_and_batches_are_small(spark):
    rows = rows_of(corpus(25))
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))
    found = exact.groups(table(spark, rows).repartition(3), digest=weak, options={"maxBytesPerTrigger": "1"})
    check_groups(found.collect(), rows)


def test_exact_of_nothing(spark):
    assert exact.groups(table(spark, [])).collect() == []
    assert exact.deduplicate(table(spark, [])).collect() == []


def test_exact_state_outlives_a_call(spark, tmp_path):
    """Two deliveries, one of files and one of rows, equal one; also when digests collide, and when a delivery is repeated."""
    rows = rows_of(corpus(40, seed=3)) + [(900, "one two", "x", None, None), (901, "only later", "x", None, None)]
    first, second = rows[:25], rows[25:]
    table(spark, first).repartition(2).write.parquet(f"{tmp_path}/first.parquet")
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))
    for name, digest in (("strong", exact.sha256), ("weak", weak)):
        state = f"{tmp_path}/{name}"
        check_groups(exact.groups(spark.read.parquet(f"{tmp_path}/first.parquet"), digest=digest, state=state, delivery="a").collect(), first)
        for _ in range(2):
            check_groups(exact.groups(table(spark, second), digest=digest, state=state, delivery="b").collect(), rows)
        check_groups(exact.groups(table(spark, []), digest=digest, state=state, delivery="c").collect(), rows)


@pytest.mark.parametrize("name", ["__word", "__maybe", "__file", "__row", "__doc", "__slot", "_metadata"])
def test_columns_of_any_name_come_back(spark, tmp_path, name):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "other words in this one here", "z")]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {name} string")
    docs.write.parquet(f"{tmp_path}/docs")
    for given in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        kept = exact.deduplicate(given)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows[1:]
        kept = jaccard.one_of_each(given)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_nothing_is_left_behind(spark, tmp_path):
    """A stage leaves its result and what that result still reads, and nothing else."""
    import os

    from talkmill.llm import common

    folder = common.shared_folder(spark).removeprefix("file:")
    there = lambda: {n for n in os.listdir(folder) if not n.startswith("rdd-")}
    before = there()
    docs = table(spark, rows_of(corpus(30)))
    made = common.settled(spark, lambda: jaccard.one_of_each(exact.deduplicate(docs)), "result")
    left = there() - before
    assert [n.split("-")[0] for n in left] == ["result"] and made.count() > 0
    common.forget(made)
    assert there() == before
    with pytest.raises(ZeroDivisionError):
        common.settled(spark, lambda: (common.stored(docs, "kept"), 1 / 0), "never")
    assert [n.split("-")[0] for n in there() - before] == ["kept"]


def shingles(text, words=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    least = {x: min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in label}
    return collections.Counter((r[0], len(s), least[x]) for r, s, x in zip(rows, sets, label))


@pytest.mark.parametrize("boundary", [None, 0, 40])
def test_near_duplicates(spark, monkeypatch, boundary):
    """The result is the same with every boundary between small and large sets."""
    if boundary is not None:
        monkeypatch.setattr(jaccard, "choose_boundary", lambda *a: boundary)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    texts = corpus(30, 7)
    for _ in range(20):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = f"m{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    rows = rows_of(texts)
    found = jaccard.near_duplicates(table(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == components(rows)


def test_near_duplicates_of_repeated_and_no_rows(spark):
    rows = [(5, "a b c d e f", "s", "", ""), (5, "a b c d e f", "s", "", ""), (2, "A B C D E F", "s", "", ""), (1, None, "s", "", ""), (1, None, "s", "", "")]
    found = jaccard.near_duplicates(table(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == {(5, 2, 2): 2, (2, 2, 2): 1, (1, 0, 1): 2}
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(table(spark, rows)).collect()) == [1, 1, 2]
    assert jaccard.near_duplicates(table(spark, [])).collect() == []


def test_boundary_follows_cost():
    many_small = {n: 1000 for n in range(3, 30)}
    assert jaccard.choose_boundary(many_small, 0.0) < jaccard.choose_boundary(many_small, 1000.0)


def without_later_runs(rows, min_words):
    seqs = []
    for d, t in rows:
        seqs.append((d, t, [(at, x) for at, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]))
    seen, out = collections.defaultdict(list), {}
    for n, (d, t, own) in enumerate(seqs):
        cut = set()
        for i, (at, x) in enumerate(own):
            best = 0
            for m, j in seen[x]:
                other, k = seqs[m][2], 0
                while i + k < len(own) and j + k < len(other) and own[i + k][1] == other[j + k][1]:
                    k += 1
                best = max(best, k)
            seen[x].append((n, i))
            if best and sum(len(re.findall(r"[^\x20\x09-\x0D]+", y)) for _, y in own[i:i + best]) >= min_words:
                cut |= set(range(at, own[i + best - 1][0] + 1))
        out[d] = (len(cut), None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if at not in cut))
    return out


@pytest.mark.parametrize("min_words,alphabet", [(50, 0), (4, 3), (1, 2)])
def test_line_runs(spark, min_words, alphabet):
    rng = random.Random(min_words)
    texts = corpus(30, 3)
    if alphabet:
        lines_ = ["a b", "c", "d e f", "", " "][:alphabet + 2]
        texts = [None, ""] + ["\n".join(rng.choice(lines_) for _ in range(rng.randint(0, 25))) for _ in range(25)] + ["c\n" * 20]
    rows = rows_of(texts)
    got = {r["doc_id"]: (r["n_deleted"], r["text"]) for r in lines.deduplicate_lines(table(spark, rows), min_words=min_words).collect()}
    assert got == without_later_runs([r[:2] for r in rows], min_words)


def test_line_runs_of_nothing(spark):
    assert lines.deduplicate_lines(table(spark, [])).collect() == []
    assert lines.deduplicate_lines(table(spark, [(1, None, "s", "", "")])).first()["n_deleted"] == 0


def check_pieces(pieces, rows):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer_path())
    want = {r[0]: [*known.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(want)
    for d, own in by_doc.items():
        own.sort(key=lambda p: p["start"])
        assert [p["start"] for p in own] == np.cumsum([0, *[p["length"] for p in own]])[:-1].tolist()
        assert [i for p in own for i in np.frombuffer(p["ids"], "<u4").tolist()] == want[d]
        assert {p["doc_tokens"] for p in own} == {len(want[d])}
    sizes = []
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0, *[p["length"] for p in own]])[:-1].tolist()
        sizes.append(sum(p["length"] for p in own))
    assert all(s & (s - 1) == 0 and s <= packing.WINDOW for s in sizes)
    return by_sequence


@pytest.mark.parametrize("targets", [None, {"s0": 0.5, "s1": 0.4, "s2": 0.1}, {"s1": 1.0}])
def test_packing(spark, targets):
    rows = rows_of(corpus(80, 9) + ["long " * 4000])
    pieces = packing.pack(table(spark, rows).repartition(3), tokenizer_path(), targets=targets).collect()
    by_sequence = check_pieces(pieces, rows)
    source = {r[0]: r[2] or "null" for r in rows}
    whole = sum(p["length"] for p in pieces)
    share = targets or {s: sum(p["length"] for p in pieces if source[p["doc_id"]] == s) / whole for s in set(source.values())}
    first = collections.Counter()
    for p in by_sequence[0]:
        first[source[p["doc_id"]]] += p["length"]
    for s, w in share.items():
        assert abs(first[s] - packing.WINDOW * w) <= 2


def test_packing_many_small_sources(spark):
    """Each half of the windows has about half of every small source, and every token lies in one piece."""
    rows = [(i, "word " * 300, f"s{i % 1100}", "clash", "clash") for i in range(2200)]
    pieces = packing.pack(table(spark, rows).repartition(3), tokenizer_path()).collect()
    whole, half, spans = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    last = max(p["sequence_id"] for p in pieces)
    for p in pieces:
        source = p["doc_id"] % 1100
        whole[source] += p["length"]
        half[source] += p["length"] if 2 * p["sequence_id"] < last else 0
        spans[p["doc_id"]].append((p["start"], p["start"] + p["length"]))
    assert len(whole) == 1100 and all(abs(half[s] - n / 2) <= 128 for s, n in whole.items())
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
    for d, found in spans.items():
        found.sort()
        assert found[0][0] == 0 and all(a[1] == b[0] for a, b in zip(found, found[1:])) and found[-1][1] * 1100 * 2 == sum(whole.values())


def test_packing_targets_of_small_sources(spark):
    rows = [(0, "word " * 500, "wiki", "", ""), *((i, "word " * 60_000, "web", "", "") for i in range(1, 12))]
    docs = table(spark, rows)
    first = collections.Counter()
    for p in packing.pack(docs, tokenizer_path(), targets={"wiki": 0.3, "web": 0.7}).collect():
        if p["sequence_id"] == 0:
            first["wiki" if p["doc_id"] == 0 else "web"] += p["length"]
    assert abs(first["wiki"] - 0.3 * packing.WINDOW) <= 1 and sum(first.values()) == packing.WINDOW
    for bad in ({"wiki": 0.0001, "web": 0.9999}, {"none": 0.5, "web": 0.5}):
        with pytest.raises(ValueError):
            packing.pack(docs, tokenizer_path(), targets=bad)


def test_packing_large_vocabulary(spark, tmp_path):
    """Ids above 65,535 are kept whole."""
    from tokenizers import Tokenizer

    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"] = {w: i + 70_000 for w, i in spec["model"]["vocab"].items()}
    spec["added_tokens"] = [t | {"id": t["id"] + 70_000} for t in spec["added_tokens"]]
    path = tmp_path / "large.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    text = {1: "the quick brown fox " * 300, 2: "", 3: "jumps over"}
    docs = table(spark, [(n, t, f"s{n}", "clash", "clash") for n, t in text.items()])
    found = collections.defaultdict(list)
    for p in sorted(packing.pack(docs, str(path)).collect(), key=lambda p: p["start"]):
        found[p["doc_id"]] += np.frombuffer(p["ids"], "<u4").tolist()
    expected = Tokenizer.from_file(tokenizer_path())
    for n, t in text.items():
        assert found[n] == [i + 70_000 for i in expected.encode(t, add_special_tokens=False).ids] + [0]


def test_packed_sequences(spark):
    rows = rows_of(corpus(20, 2))
    pieces = packing.pack(table(spark, rows), tokenizer_path())
    for r in packing.sequences(pieces).collect():
        assert len(r["ids"]) == 4 * sum(p["length"] for p in r["pieces"])
    assert packing.pack(table(spark, []), tokenizer_path()).collect() == []


def test_schedule_carries_deficits():
    totals = {"a": 700_000, "b": 299_000, "c": 1_000, "d": 3}
    s = packing.plan(totals)
    for q, n in totals.items():
        spans = [(x.begin, x.end) for x in s.shares[q]] + [(s.tails[q].begin, s.tails[q].end)]
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    dealt = [x for q in totals for x in s.shares[q]]
    for k in (1, 7, 500):
        active = [x for x in dealt if x.first == 0]
        assert sum(int(x.given(k)) for x in active) == packing.WINDOW * k
    assert s.tail_tokens < 4 * packing.WINDOW


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    good = [" ".join(f"x{i}y{j}" for j in range(70)) for i in range(12)]
    near = [good[0] + " extra", good[1].replace("x1y3 ", "changed ")]
    texts = [*good, *near, good[2], "too short", None, "<> " * 100]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = [r for r in docs.collect() if quality_keeps(r["text"])]
    latest = {r["text"]: r for r in sorted(kept, key=lambda r: r["doc_id"])}
    rows = [(r["doc_id"], r["text"]) for r in latest.values()]
    stay = {d for d, _, least in components(rows) if d == least}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == stay
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, read, str(tmp_path)).columns == docs.columns
        assert stage(spark, read.limit(0), str(tmp_path)).count() == 0


def quality_keeps(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or ""))
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    again = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    return not (len(words) < 50 or 2 * len(again) > len(words) or chars < 2 * len(words) or chars > 20 * len(words) or 2 * symbols > len(words))
