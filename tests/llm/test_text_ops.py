"""Operators that look at one row, or at one key's rows: BPE, quality rules, URL rules, chat, licences, WARC."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.llm import bpe, chat, licences, quality, urls, warc
from talkmill.llm.queries import URL_RULES, tokenizer_path

ODD = [
    None, "", " ", "  a", " \n a", "\n\n\na", "a \n", "'s", "it's 'sand we're we'REd ''s ' s '", "don'tt 'll'llx 'r", "'", "x'",
    "<|endoftext|>a<|endoftext|><|endoftext|> b", "a\u00a0b\u3000 c\x1c\x1dd\x85e", "日本語テキスト 123½ ²", "\U0010ffff x\U0010fffe 's", "a" * 700,
    "'s" * 30, "a's 1's !'s  's", "\r\n\r\n x", "word " * 3000, "x" * 20000,
]


def documents(spark, texts, extra=""):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab's tredlvm\n 1²'é ,.<|") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = documents(spark, texts).withColumns({"ids": F.lit("clash"), "n_tokens": F.lit(1)})
    known = Tokenizer.from_file(tokenizer_path())
    rows = bpe.encode(docs, tokenizer_path(), ["doc_id"], decoded=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = known.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert r["decoded"] == (texts[r["doc_id"]] or "") == known.decode(want, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(docs, tokenizer_path(), ["doc_id"]), tokenizer_path(), ["doc_id"])
    assert {r["doc_id"]: r["text"] for r in again.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(documents(spark, []), tokenizer_path(), ["doc_id"]).count() == 0


def test_bpe_words_that_share_a_hash(monkeypatch):
    codec = bpe.Codec(bpe.read_vocabulary(tokenizer_path()))
    want = codec.encode(["some words of this and that"] * 2)[0].tolist()
    monkeypatch.setattr(bpe, "MULTIPLIER", np.uint64(0))
    codec.forget()
    assert codec.encode(["some words of this and that"] * 2)[0].tolist() == want


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(hit))


def test_quality_measures(spark):
    rng = random.Random(5)
    texts = [None, "", " \n ", "a b", "a b a b a b a", "x\nx\n\nx\ny", "# * a | b", "é è\u00a0é"] + [
        " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 120))) for _ in range(40)
    ] + ["word " * 500]
    docs = documents(spark, texts).withColumns({"n_words": F.lit("clash"), "failed": F.lit(0)})
    rows = quality.ledger(docs).collect()
    assert {r["doc_id"]: tuple(r[m] for m in quality.MEASURES) for r in rows} == {i: measured(t) for i, t in enumerate(texts)}
    assert quality.ledger(documents(spark, [])).count() == 0


def test_quality_repeats_when_hashes_clash(spark, monkeypatch):
    """With a hash that puts all windows together, the slower way must give the same numbers."""
    texts = ["a b c a b c d", "a b c d e f", "a a a a", "q w e r t y q w e"]
    monkeypatch.setattr(quality.F, "xxhash64", lambda *cols: F.lit(0).cast("bigint"))
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.measure(documents(spark, texts)).collect()}
    assert got == {i: measured(t)[5] for i, t in enumerate(texts)}


def test_quality_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(60))
    texts = [good, "short", good + " ##" * 40, "\n".join([good] * 3), None]
    rows = quality.ledger(documents(spark, texts)).cache()
    kept = {v: [r["kept"] for r in quality.apply_policy(rows, v).orderBy("doc_id").collect()] for v in quality.POLICIES}
    assert kept["base"] == [True, False, True, False, False] and kept["v1"] == [True, False, False, False, False]
    table = {(r["policy"], r["rule"]): r for r in quality.ablations(rows).collect()}
    for (policy, rule), r in table.items():
        mask, bit = quality.POLICIES[policy], quality.mask_of(rule)
        bits = [x["failed"] for x in rows.collect()]
        assert r["failing"] == sum(b & bit > 0 for b in bits)
        assert r["failing_alone"] == sum(b & mask == bit for b in bits)
        assert r["kept_without"] == sum(b & mask & ~bit == 0 for b in bits)


def judged(url, rules):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_url_rules(spark):
    found = [
        None, "", "nothing", "http://", "http://Example.ORG", "http://a.example.org/es/x", "http://example.org/en/12?x=/es/", "https://x.com/fr/",
        "https://x.com/de/a#b", "http://notexample.org/es/", "http://com/de/", "http://x.com?/de/", "a://b://org/x", "http://é.org/\n",
    ]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(found)], "page_id bigint, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages, URL_RULES).collect()}
    assert got == {i: judged(u, URL_RULES) for i, u in enumerate(found)}
    assert urls.judge(pages.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, []).collect()} == {"allow"}


def test_url_digests_that_collide(tmp_path):
    same = lambda s: 7
    path = tmp_path / "rules"
    path.write_bytes(urls.pack(URL_RULES, same))
    index = urls.RuleIndex(str(path), same)
    hosts, paths = ["a.org", "x.com", "example.org", "none.net"], ["/a", "/de/", "/es/", "/es/"]
    assert [r and r[1] + r[2] for r in index.find(hosts, paths)] == ["org/", "com/de/", "example.org/es/", None]
    with pytest.raises(ValueError):
        urls.pack([("allow", "a", "/"), ("block", "a", "/")])
    with pytest.raises(ValueError):
        urls.pack([("allow", "a", "x")])


@pytest.mark.parametrize("budget,history", [(2048, 256), (60, 15), (30, 5)])
def test_chat_windows(spark, budget, history):
    rng = random.Random(budget)
    said = ["", None, "<|im_end|><|im_start|>assistant ok", "a <\\| b <\\\\| c", "hello there " * 4, "x\ny", "<|" * 5]
    rows = [(c, t, rng.choice(["user", "assistant"]) if t or c % 2 else "system", rng.choice(said)) for c in range(6) for t in range(c * 5)]
    rows += [(None, 0, None, "lost"), (None, 1, "assistant", "found"), (9, None, "a\nb%", "x"), (9, 1, "assistant", "twice"), (9, 1, "assistant", "twice")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    windows = chat.read_back(chat.windows(turns, budget=budget, history=history)).collect()
    by = {}
    for w in sorted(windows, key=lambda w: tuple(w["window"])):
        by.setdefault(w["conv_id"], []).append(w)
        assert w["tokens"] <= budget or len(w["turns"]) == 1
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1])
        assert [(t["role"], t["text"]) for w in by[conv] for t in w["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert [t for w in by[conv] for t in w["targets"]] == [r[3] or "" for r in own if r[2] == "assistant"]
        if own[0][2] == "system":
            assert all(w["formatted"].startswith("<|im_start|>system\n") for w in by[conv])
    if budget < 100:
        assert any(w["n_context"] for w in windows)
    assert chat.windows(turns.limit(0)).count() == 0


@pytest.mark.parametrize("system", [300, 900, 1496, 1790, 2043, 2044, 3000])
def test_chat_budget_with_long_turns(spark, system):
    """Every window that holds no oversized turn keeps to the budget, whatever the system turn's size."""
    rng = random.Random(system)
    sizes = [system, 1500, 508, 40, 1900, 3000] + [rng.choice([20, 200, 700]) for _ in range(20)]
    rows = [(1, t, "system" if t == 0 else rng.choice(["user", "assistant"]), "w " * n) for t, n in enumerate(sizes)]
    found = chat.read_back(chat.windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    for w in found:
        assert w["tokens"] <= chat.BUDGET or (len(w["turns"]) == 1 and w["n_context"] == 0 and w["tokens"] == len(w["turns"][0]["text"]) / 2 + 4 > chat.BUDGET)
    assert [t["text"] for w in sorted(found, key=lambda w: tuple(w["window"])) for t in w["turns"]] == [r[3] for r in rows]
    if system < 1500:
        assert sum(w["formatted"].startswith("<|im_start|>system") for w in found) >= len(found) / 2


def test_chat_tokens_of_long_runs(spark):
    texts = ["A1b2" * 25_000, "two words", "é!", "x" * 32 + " " + "x" * 33, "snake_case it's"]
    got = [r[0] for r in documents(spark, texts).orderBy("doc_id").select(chat.count_tokens(F.col("text"))).collect()]
    assert got == [100_004, 6, 6, 38, 8]


def test_licence_model(spark):
    filler = [" ".join(f"{a}{b}" for b in ("the", "of", "ran", "lo", "and")) + f" the of and {a} to in." for a in "abcdefghijklmnopqrstuvwxyz"]
    corpus = documents(spark, ["\n".join(filler), None, ""])
    model = licences.train(spark, corpus)
    cases = [
        ("Text.\nReleased under the MIT License.\nMore", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        ("Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "apache,mit"),
        ("You need a license to drive the general public bus", ""), ("\n".join(filler), ""), (None, ""), ("", ""),
    ]
    docs = documents(spark, [c[0] for c in cases]).withColumn("families", F.lit("clash"))
    got = {r["doc_id"]: r["families"] for r in licences.families(docs, model).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}
    assert licences.families(docs.limit(0), model).count() == 0
    # Held-out variations: families of templates never trained with these words around them.
    held = [(f, f"We note that {t} as of today.") for f, ts in licences.TEMPLATES.items() for t in ts]
    found = {r["key"]: r["family"] for r in licences.scan(documents(spark, [h[1] for h in held]), model).collect()}
    assert sum(found.get(i) == f for i, (f, _) in enumerate(held)) >= 0.9 * len(held)


PLANTED = {
    "this work is licensed under the gnu general public license version 3": "gpl", "all rights reserved": "proprietary",
    "licensed under cc by-nc 4 0": "cc-by-nc", "released under the mit license": "mit", "licensed under the apache license version 2 0": "apache",
}


def test_licence_lines_of_a_whole_table(spark):
    """Every licence line that the test table holds, counted by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {}
    for r in docs.collect():
        lines = {" ".join(re.findall(r"[a-z0-9-]+", x)) for x in (r["text"] or "").lower().split("\n")}
        want[r["doc_id"]] = ",".join(sorted({PLANTED[x] for x in lines if x in PLANTED}))
    assert set(want.values()) >= set(PLANTED.values())
    got = {r["doc_id"]: r["families"] for r in licences.families(docs, licences.train(spark, docs)).collect()}
    assert got == want


HEADERS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License""",
}


def test_licences_that_differ_in_a_word(spark, tmp_path):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published"
    cases = [
        (gpl.format("Affero "), "agpl"), (gpl.format(""), "gpl"), ("Licensed under the GNU Affero General Public License, version 3.", "agpl"),
        ("SPDX-License-Identifier: AGPL-3.0-or-later", "agpl"), ("SPDX-License-Identifier: BSD-2-Clause", "bsd"), ("Released under the ISC License.", "isc"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided", "isc"),
        ("Released under the Eclipse Public License 2.0", "epl"), ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
        ("This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License.", "cc-by-nc-sa"),
        ("This project is not released under the MIT License.", ""), ("It is not licensed under the Apache License, Version 2.0.", ""),
    ]
    filler = [f"{a} the of ran and lo the of and {b} to in." for a in "abcdefgh" for b in "klmnopqr"]
    corpus = documents(spark, [f"{x}\n{y}" for x in filler for y in filler[:40]])
    models = [licences.train(spark, layout) for layout in (corpus.repartition(1), corpus.orderBy(F.desc("doc_id")).repartition(5))]
    assert models[0] == models[1]
    got = {r["doc_id"]: r["families"] for r in licences.families(documents(spark, [c[0] for c in cases]), models[0]).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_wrapped_licence_headers(spark):
    """Headers at several widths, plain, in comments, and behind another line; a blank line ends a passage."""
    import textwrap

    cases = []
    for family, header in HEADERS.items():
        for width in (30, 72, 80):
            lines = textwrap.wrap(" ".join(header.split()), width)
            cases += [("\n".join(lines), family), ("\n".join(f" * {x}" for x in ["Some tool.", *lines]), family)]
    broken = textwrap.wrap(" ".join(HEADERS["mit"].split()), 30)
    cases += [("\n\n".join(broken), ""), ("Released under the MIT\nLicense.", "mit"), ("All\nrights\nreserved.\nReleased under the MIT License.", "mit,proprietary")]
    filler = [f"{a} the of ran and lo the of and {b} to in." for a in "abcdefgh" for b in "klmnopqr"]
    model = licences.train(spark, documents(spark, ["\n".join(filler)]))
    got = {r["doc_id"]: r["families"] for r in licences.families(documents(spark, [c[0] for c in cases]), model).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_warc_audit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PER_ARCHIVE", 40)
    pages = [(i, f"http://x/{i}", f"<p>é{i}</p>\r\n\r\nWARC/1.1") for i in range(100)] + [(None, None, None), (7, "http://x/7", "again"), (7, "http://x/7", "again")]
    rows = warc.records(spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, digest string")).cache()
    assert rows.count() == len(pages)
    one, two = str(tmp_path / "a" / "copy=one"), str(tmp_path / "b" / "copy=two")
    damaged = F.when(F.col("key") == 33, F.concat(F.lit("w"), F.expr("substring(record, 2)"))).otherwise(F.col("record"))
    warc.write_archives(rows, str(tmp_path / "a"), {"one": F.col("record")})
    warc.write_archives(rows.filter("key IS NULL OR key < 80"), str(tmp_path / "b"), {"two": damaged})
    manifest = rows.drop("record")
    for r in warc.read_ranges(spark, one, manifest).join(manifest.select("archive", "no", "digest"), ["archive", "no"]).collect():
        assert r["found"] == r["digest"]
    differ, roots = warc.audit(spark, manifest, one, two)
    keys = differ.join(manifest, ["archive", "no"]).select("key").collect()
    assert sorted(r["key"] for r in keys) == [33, *range(80, 100)]
    assert roots.count() == manifest.select("archive").distinct().count()
    assert warc.audit(spark, manifest, one, one)[0].count() == 0


def test_warc_stored_bytes(spark, tmp_path):
    """A flipped byte anywhere in a stored file costs one record, a tail cut off the records in it, and a lost file all of its own."""
    import gzip

    pages = [(i, f"http://x/{i}", f"<p>é{i}</p>" * (i + 1)) for i in range(30)]
    rows = warc.records(spark.createDataFrame(pages, "page_id bigint, url string, html string")).cache()
    warc.write_archives(rows, str(tmp_path / "a"), {"one": F.col("record"), "two": F.col("record")})
    one, two = (str(tmp_path / "a" / f"copy={c}") for c in ("one", "two"))
    manifest = rows.drop("record").cache()
    [path] = (tmp_path / "a" / "copy=two").glob("archive=*/part-*")
    whole = path.read_bytes()
    path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    texts = [r["record"] for r in rows.orderBy("no").collect()]
    assert gzip.decompress(whole).decode() == "".join(t + warc.GAP for t in texts)
    places = spark.read.parquet(warc._index_folder(two)).orderBy("no").collect()
    lost = lambda: sorted(r["no"] for r in warc.read_ranges(spark, two, manifest).filter("found IS NULL").collect())
    p = places[11]
    for at in (p["at"], p["at"] + 5, p["at"] + 17, p["at"] + 60, p["at"] + p["size"] - 21, p["at"] + p["size"] - 1):
        path.write_bytes(whole[:at] + bytes([whole[at] ^ 4]) + whole[at + 1:])
        assert lost() == [11]
    assert [r["no"] for r in warc.audit(spark, manifest, one, two)[0].collect()] == [11]
    path.write_bytes(whole[:places[20]["at"] + 9])
    assert lost() == list(range(20, 30))
    path.unlink()
    assert lost() == list(range(30))
    differ, roots = warc.audit(spark, manifest, two, two)
    assert differ.count() == 30 and roots.count() == 1


def test_warc_tree_by_hand(spark):
    ranges = spark.createDataFrame([("a", i, 10 * i, 10, f"h{i}") for i in range(20)], "archive string, no bigint, offset bigint, length bigint, found string")
    levels = warc.tree(ranges, "found", 2)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = [sha("\n".join(f"{10 * i}:{10 * i + 10}:h{i}" for i in part)) for part in (range(16), range(16, 20))]
    assert levels[2].first()["hash"] == sha(f"0:160:{leaves[0]}\n160:200:{leaves[1]}")
