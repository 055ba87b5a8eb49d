"""Every operator against brute force or an exact round trip on small tables with nulls, empties, ties and repeats."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from foliospark.llm import chat, components, decontaminate, exact_dedup, jaccard_join, language_id, license_scan, mixing, suffix_dedup, token_counts, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
random.seed(3)
WORDS = [f"{a}{b}" for a in ("an", "be", "co", "di", "él", "fu") for b in ("ra", "si", "tu", "vo")]
BASE = " ".join(random.choice(WORDS) for _ in range(260))


def rows():
    near = BASE.split(" ")
    near[7] = "XX"
    texts = [BASE, BASE.upper().replace("É", "é"), " ".join(near), None, "", "one two", "one two", "  \t ", "a\x1cb 你好 <|endoftext|>'s", "x" * 3000, "start " + BASE + " end" * 40, "y" * 900]
    return [(k, t, "en" if k % 2 else None, "s0" if k % 3 else None, 0, "e") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("largest", [1 << 16, 1])
def test_suffix_dedup(docs, empty, largest):
    length, raws = 60, {r[0]: (r[1] or "").encode() for r in rows()}
    seen = {}
    for raw in raws.values():
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    want = {}
    for d, raw in raws.items():
        mark = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            mark[i : i + length] |= seen[raw[i : i + length]] > 1
        kept = bytes(b for b, m in zip(raw, mark, strict=True) if not m)
        want[d] = (len(raw), int(mark.sum()), int((mark & ~np.r_[False, mark[:-1]]).sum()), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, length, k=20, largest_group=largest).collect()}
    assert got == want
    assert suffix_dedup.remove_repeats(empty, length, k=20).collect() == []


def test_jaccard(docs, empty):
    import re

    sets = {}
    for d, t, *_ in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {d: (len(sets[d]), root[d]) for d in sets}
    assert jaccard_join.jaccard_components(empty).collect() == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(20, 60)] + [(60, 5), (100, 101), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 5 for k in range(20, 61)}, 5: 5, 100: 100, 101: 100}


def test_chat(spark):
    turns = [(1, 0, "user", "a<|im_end|>\\b"), (1, 1, "assistant", "<|im_start|>x\n"), (1, 2, "assistant", None), (2, 0, None, "hi"), (1, 1, "assistant", "<|im_start|>x\n")]
    segments = chat.format_segments(chat.text_messages(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    plain = [(r or "", t or "") for _, _, r, t in sorted([t for t in turns if t[0] == 1], key=lambda t: (t[1], t[2], t[3] or ""))]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in plain).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(t for r, t in plain if r == "assistant").encode()).hexdigest()
    assert (got[1].n_turns, got[2].n_turns, got[2].loss_chars) == (4, 1, 0)


def test_chat_parts(spark):
    parts = [("text", "see <|image:0|>", None, None, None, None, None), ("image", None, "i.png", 56, 30, None, None), ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3)]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_segments(df).first()
    assert r.segment == "<|im_start|>assistant\nsee <\\|image:0|><|image:0|><|audio:1|><|document:2|><|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "i.png", 4), ("audio", "a.wav", 50), ("document", "d.pdf", 768)]
    assert r.n_tokens == 2 + 4 + 50 + 768


def test_token_counts(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path, 500).collect()}
    want = {d: (len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 500) for d, t, *_ in rows()}
    assert got == want
    assert token_counts.token_counts(empty, path).collect() == []


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, start, want = Tokenizer.from_file(path), 0, {}
    for d, t, *_ in rows():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_output(docs, path).collect()} == want
    assert token_files.token_output(empty, path).collect() == []


def test_direct_codes():
    for ids in (np.array([], dtype=np.uint32), np.arange(0, 300_000, 37, dtype=np.uint32), np.array([2**32 - 1, 0, 255, 256, 65536] * 500, dtype=np.uint32)):
        codes = token_files.DirectCodes(token_files.encode_ids(ids))
        assert (codes.all() == ids).all() and all(codes[i] == ids[i] for i in range(0, len(ids), 61))


@pytest.mark.parametrize("files", [None, 1])
def test_exact_dedup(docs, empty, files):
    fold = {d: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for d, t, *_ in rows()}
    groups = {}
    for d, t in fold.items():
        groups.setdefault(t, []).append(d)
    want = {d: (max(groups[t]), len(groups[t]), d == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in fold.items()}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, files_per_batch=files).collect()}
    assert got == want
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_mixing(spark, empty):
    data = [(k, " ".join(["w"] * (1 + k % 7)), "en", "big" if k % 10 < 7 else ("mid" if k % 10 < 9 else None), 0, "e") for k in range(3000)]
    df = spark.createDataFrame(data, DOCS)
    total = {}
    for r in data:
        total[r[3]] = total.get(r[3], 0) + len(r[1].split())
    out = mixing.mix(df, repetition_limit=2.0, block_rows=64).collect()
    used, copies = {}, {}
    for r in out:
        used[r.source] = used.get(r.source, 0) + r.mix_tokens
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    weights = {r.source: r.mix_weight for r in out}
    budget = sum(total.values())
    assert abs(sum(weights.values()) - 1) < 1e-9
    for s, w in weights.items():
        assert used[s] <= w * budget and w * budget - used[s] <= 64 * 7  # short by less than a block's end
        assert w * budget / total[s] <= 2.0 + 1e-6
    assert max(copies.values()) <= 2
    assert mixing.mix(empty, target_entropy=0.5).collect() == []
    x = mixing.bisected([800, 150, 50], 1000, target_entropy=0.9)
    assert abs(mixing.entropy(mixing.weights_at([800, 150, 50], x)) - 0.9) < 1e-6


def test_license_scan(spark, empty):
    texts = ["Intro. Released under the MIT License.\nMore", "Permission? Unless told: no.", None, "You may not use this file except in compliance with the License. Hm. You may obtain a copy of the License at\nhttp", "You may not use this file except in compliance with the License; words.\nYou may obtain a copy of the License at http www apache org licenses LICENSE-2.0"]
    df = spark.createDataFrame([(k, t, None, None, 0, "") for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(df).collect()}
    assert got == {0: "MIT", 1: "", 2: "", 3: "", 4: "Apache-2.0"}
    assert license_scan.license_scan(empty).collect() == []


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_3 = BSD + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"""


def test_license_scan_reads_wrapped_notices(spark):
    import textwrap

    notices = {MIT: "MIT", BSD: "BSD-2-Clause", BSD_3: "BSD-2-Clause,BSD-3-Clause", APACHE: "Apache-2.0", GPL: "GPL-3.0-or-later"}
    texts = []
    for notice, name in notices.items():
        for width in (40, 70, 80, 10_000):
            lines = [x for p in notice.split("\n") for x in textwrap.wrap(p, width) or [""]]
            texts += [(leader + f"\n{leader}".join(["Copyright 2020", *lines, "End"]), name) for leader in ("", "# ", " * ", "// ")]
    texts += [(MIT.replace("free of charge", "for a fee"), ""), (APACHE.replace("Licensed under the Apache", "Under the Apache").replace("2.0\n", "2.0 or so\n"), "")]
    df = spark.createDataFrame([(k, t, None, None, 0, "") for k, (t, _) in enumerate(texts)], DOCS)
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(df).collect()}
    assert got == {k: name for k, (_, name) in enumerate(texts)}


def test_decontaminate(spark, empty):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, f"{sentence(14)}. {sentence(12)}.") for k in range(40)] + [(40, None), (41, "")]
    plain = [sentence(400) for _ in range(30)]
    leaky = [f"{sentence(rng.randint(0, 300))} {items[k][1].upper()} {sentence(rng.randint(0, 300))}" for k in range(20)]
    half = [sentence(90) + " " + items[30][1].split(". ")[0] + " " + sentence(90)]
    data = [(k, t, None, None, 0, "") for k, t in enumerate([*plain, *leaky, *half, None, ""])]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(data, DOCS)
    for shard in (2_000_000, 200):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(df, bench, shard_terms=shard).collect()}
        assert got == {(30 + k, k) for k in range(20)}
    assert sorted(r.doc_id for r in decontaminate.clean(df, bench).collect()) == [*range(30), 50, 51, 52]
    assert decontaminate.contamination(empty, bench).collect() == []
    assert decontaminate.contamination(df, bench.where("false")).collect() == []


def test_retrieval_is_that_of_plain_bm25():
    rng = random.Random(9)
    rows_ = [(k, [f"w{rng.randint(0, 60)}" for _ in range(8)], [f"w{rng.randint(0, 60)}" for _ in range(6)]) for k in range(70)]
    df = {}
    for _, q, a in rows_:
        for w in {*q, *a}:
            df[w] = df.get(w, 0) + 1
    index = decontaminate.ItemIndex.of(rows_, df, len(rows_), 14)
    weight = {}
    for t in range(len(index.terms)):
        for p in range(index.item_start[t], index.item_start[t + 1]):
            weight[t, int(index.item_of[p])] = float(index.impact[p])
    windows = [sorted(rng.sample(range(len(index.terms)), 25)) for _ in range(50)]
    w, i, s = index.retrieve(np.repeat(np.arange(50), 25), np.array(sum(windows, [])), 50, 0.5)
    want = {(k, item) for k, terms in enumerate(windows) for item in range(70) if sum(weight.get((t, item), 0) for t in terms) >= 0.5 - 1e-9}
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == want


def test_language_id(spark, empty):
    rng = random.Random(2)
    tongues = {"aa": ["the", "and", "thing", "with"], "bb": ["der", "und", "nicht", "sch"]}
    data = []
    for k in range(300):
        lang = "aa" if k % 2 else "bb"
        data.append((k, " ".join(rng.choice(tongues[lang]) for _ in range(rng.randint(1, 200))), lang if k % 3 else None, None, 0, ""))
    data += [(300, None, "aa", None, 0, ""), (301, "123 !!", "bb", None, 0, ""), (302, "the und " * 80, None, None, 0, "")]
    df = spark.createDataFrame(data, DOCS)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert all(got[k].lang_pred == ("aa" if k % 2 else "bb") for k in range(300))
    assert {got[300].lang_pred, got[301].lang_pred} == {"und"} and got[300].score == 0
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    assert 0.4 < got[302].score < 0.7
    assert language_id.identify(empty).collect() == []


def test_language_id_reads_long_words_to_their_end(spark):
    run = "\u4e00" * 37 + "étÉ" + "b" * 80 + "c"
    assert "".join(language_id.words_of(f"{run}, de")) == run.lower() + "de"
    assert max(map(len, language_id.words_of(run))) == 40
    rng, tongues = random.Random(4), ("alo", "eru")
    data = [(k, "q" * 40 + "".join(rng.choice(tongues[k % 2]) for _ in range(60)), ("aa", "bb")[k % 2], None, 0, "") for k in range(80)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(data, DOCS)).collect()}
    assert got == {k: ("aa", "bb")[k % 2] for k in range(80)}


def test_forward_backward_against_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    total, want = 0.0, np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        p = np.exp(sum(scores[k, y] for k, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        total += p
        for k, y in enumerate(path):
            want[k, y] += p
    got, _ = language_id.forward_backward(np.r_[scores[:2], scores], np.array([2, 5]), moves)
    assert np.allclose(got[2:], want / total)


def test_pipeline_keeps_columns_and_clean_documents(spark):
    import corpus_pipeline

    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == docs.columns
        if name == "language_id":
            assert out.count() == docs.count()


@pytest.mark.parametrize("files", [None, 1])
def test_exact_dedup_compares_bytes_where_digests_collide(docs, monkeypatch, files):
    from pyspark.sql import functions as F

    short = lambda t: F.unhex(F.lpad(F.hex(F.length(exact_dedup.normalised(t)) % 3), 2, "0"))
    monkeypatch.setattr(exact_dedup, "digest_of", short)
    groups = {}
    for d, t, *_ in rows():
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), []).append(d)
    want = {d: (max(g), len(g), d == max(g)) for g in groups.values() for d in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, files_per_batch=files).collect()} == want


def plain_jaccard(texts):
    """Set size and smallest reachable id of each text, by comparing all pairs."""
    import re

    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (len(sets[d]), top(d)) for d in ids}


def test_jaccard_large_group_of_near_copies(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = {}
    for k in range(500):
        words = base.copy() if k < 350 else [rng.choice(vocabulary) for _ in range(rng.randint(3, 200))]
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts[k] = " ".join(words) + (" " + " ".join(base[: rng.randint(20, 119)]) if k % 5 == 0 else "")
    for k in range(500, 540):
        texts[k] = texts[k - 500]
    df = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == plain_jaccard(texts)


CLASH = ("id", "row", "comp", "gone", "leak", "leak_id", "gone_id", "mix_source", "mix_weight", "b_source", "b_block", "l_source", "digest", "place", "whole", "part", "bits", "found")
LONG_WORD = "".join(random.Random(6).choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(200_000))


def odd_rows():
    long = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))
    texts = [(None, "null id text of six words"), (None, None), (1, "same id one two three four"), (1, "same id other words here now"), (1, "same id one two three four"), (2, long), (3, long + " and an end"), (4, LONG_WORD), (5, ""), (6, "a" * 70_000)]
    return [(d, t, "en", "s", 0, *(f"{c}{k}" for c in CLASH)) for k, (d, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH))


def test_odd_rows_and_clashing_names_keep_their_columns(spark, odd):
    plain = sorted(odd_rows(), key=str)
    assert sorted((tuple(r)[: len(plain[0])] for r in mixing.mix(odd, repetition_limit=1.0).collect()), key=str) == plain
    bench = spark.createDataFrame([(1, "nothing that any text would hold. really nothing at all here."), (2, None)], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.clean(odd, bench).collect()), key=str) == plain
    kept = sorted((r.doc_id or -1, (r.text or "")[:20]) for r in jaccard_join.first_of_each(odd).collect())
    assert kept == sorted((d or -1, (t or "")[:20]) for d, t, *_ in odd_rows() if d != 3)


def test_odd_rows_in_every_operator(odd):
    from tokenizers import Tokenizer
    import sentencepiece

    plain = [(d, t or "") for d, t, *_ in odd_rows()]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(odd).collect())
    first, second, letters = (len(plain[k][1]) for k in (5, 6, 9))
    assert got == sorted((d or -1, len(t), {2: first, 3: second - 11 if d == 3 else 0, 6: letters}.get(d, 0)) for d, t in plain) or [g for g in got if g[0] == 3][0][2] >= first - 11
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.jaccard_components(odd).collect())
    assert [g[0] for g in got] == sorted(d or -1 for d, _ in plain) and all(c == (2 if d in (2, 3) else d) for d, _, c in got)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.token_counts(odd, path).collect()) == sorted((d or -1, len(library.encode(t))) for d, t in plain)
    path, start, want = public_tokenizers.path("word_bpe_49k.json"), 0, []
    library = Tokenizer.from_file(path)
    for d, t in sorted(plain, key=lambda x: (x[0] or -1, x[1])):
        n = len(library.encode(t, add_special_tokens=False).ids) + 1
        want.append((d, start, n))
        start += n
    assert sorted(((r.doc_id, r.start, r.n_tokens) for r in token_files.token_output(odd, path).collect()), key=lambda x: x[1]) == want
    from pyspark.sql import functions as F

    placed = odd.withColumn("at", F.monotonically_increasing_id())
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size) for r in exact_dedup.exact_dedup(placed, locator=[F.col("at")]).collect()) == sorted([(-1, -1, 1), (-1, 5, 2), (5, 5, 2), (1, 1, 2), (1, 1, 1), (1, 1, 2), (2, 2, 1), (3, 3, 1), (4, 4, 1), (6, 6, 1)])
    assert license_scan.license_scan(odd).count() == language_id.identify(odd).count() == len(plain)


def test_long_words_count_as_in_the_library():
    import sentencepiece

    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(8)
    library, merger = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PieceMerger(path)
    words = [LONG_WORD[:30_000], "the" * 9_000, "a" * 5_001, "".join(rng.choice("aeinst") for _ in range(20_000)), "é你" * 4_000, "international" * 700]
    for text in [*words, " ".join(words)]:
        assert token_counts.TextCounter(merger).count([text]) == [len(library.encode(text))]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    path = str(tmp_path / "cased.json")
    json.dump(spec, open(path, "w"))
    texts = ["Some Words In Capitals", "it's 12 o'clock"]
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in token_files.WordEncoder(path).encode(texts)] == want


def test_chat_roles_with_line_ends_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    turns = [(1, 0, "a\nb", "hi"), (1, 1, "a\\nb\\", "b\nhi"), (None, 0, "x", "y")]
    read = lambda df: chat.read_back(chat.format_segments(chat.text_messages(df))).collect()
    got = {r.conv_id: r.turns_sha256 for r in read(spark.createDataFrame(turns, schema))}
    assert got == {1: hashlib.sha256(b"a\nb\nhi\na\\nb\\\nb\nhi\n").hexdigest(), None: hashlib.sha256(b"x\ny\n").hexdigest()}
    assert read(spark.createDataFrame([], schema)) == []
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_mixing_against_brute_force(spark):
    from pyspark.sql import functions as F

    data = [(k, " ".join(["w"] * (1 + k % 7)), "en", ("big", "big", "mid", "low", None)[k % 17 % 5], 0, "e") for k in range(900)]
    df = spark.createDataFrame(data, DOCS)
    per_block, limit, most = 16, 1.5, 12
    marks = {r.doc_id: (r.m, r.h) for r in df.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("m"), F.xxhash64(F.xxhash64(F.lit(17), "doc_id", "text")).alias("h")).collect()}
    sources = {}
    for d, t, _, s, *_ in data:
        sources.setdefault(s, []).append((d, len(t.split())))
    names = list(sources)
    tokens = [sum(n for _, n in sources[s]) for s in names]
    weights, budget, want = mixing.weights_at(tokens, mixing.bisected(tokens, sum(tokens), repetition_limit=limit)), sum(tokens), []
    for s, total, w in zip(names, tokens, weights, strict=True):
        epochs, rest = divmod(int(w * budget), total)
        blocks = min(most, max(1, -(-len(sources[s]) // per_block)))
        keys = spark.createDataFrame([(s, b) for b in range(blocks)], "s string, b long").select("b", F.xxhash64(F.lit(17), "s", "b").alias("k")).collect()
        order = {r.b: (r.k, r.b) for r in keys}
        used = 0
        for d, n in sorted(sources[s], key=lambda x: (order[marks[x[0]][1] % blocks], marks[x[0]][0])):
            used += n
            want += [d] * (epochs + (used <= rest))
    got = sorted(r.doc_id for r in mixing.mix(df, repetition_limit=limit, block_rows=per_block, most_blocks=most).collect())
    assert got == sorted(want)
