"""Licences by names, expressions and notices; lasting state of exact deduplication; the pipeline as a chain."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from foliospark.llm import exact_dedup, license_scan
from tests.llm.test_llm import DOCS, plain_jaccard, rows

GRANT = "This {} is free software; you can redistribute it and/or\nmodify it under the terms of the GNU {} Public\nLicense{}as published by the Free Software Foundation"
WARRANTY = "\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the"
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"
DISCLAIMED = '\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS. IN NO EVENT'
LICENCES = [
    ("This file is licensed under the MIT license.", "MIT"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "GPL-2.0-or-later"),
    ("# SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode", "Apache-2.0,MIT"),
    ("SPDX-License-Identifier:ISC\nSPDX-License-Identifier:", "ISC"),
    ("SPDX-License-Identifier: Foo OR MIT", ""),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not", "MPL-2.0"),
    (GRANT.format("library", "Lesser General", " ") + "; either\nversion 2.1 of the License, or (at your option) any later version." + WARRANTY, "LGPL-2.1-or-later"),
    (GRANT.format("program", "General", " version 2 ") + ".", "GPL-2.0"),
    (ISC + ",\nprovided that the above copyright notice and this permission notice appear in all copies." + DISCLAIMED, "ISC"),
    (ISC + "." + DISCLAIMED, "0BSD"),
    ("Released under the Mozilla Public License 2.0.\nThis work is licensed under CC BY-SA 4.0", "CC-BY-SA-4.0,MPL-2.0"),
    ("Licensed under the GNU General Public License version 2 or later.", "GPL-2.0-or-later"),
    ("We spoke of the MIT license under a tree.", ""),
    ("SPDX-License-Identifier: " + "MIT AND " * 300 + "MIT", "MIT"),
    (None, ""),
    ("", ""),
]


def test_licences_by_names_expressions_and_notices(spark):
    import duckdb
    import pandas as pd

    from foliospark.llm import registry

    data = [(k, t) for k, (t, _) in enumerate(LICENCES)]
    got = license_scan.license_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {k: name for k, (_, name) in enumerate(LICENCES)}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(data, columns=["doc_id", "text"]))
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.op9_sql()).fetchall())


def test_every_known_sentence_is_found_by_its_own_pattern():
    import re

    tree = re.compile(license_scan.prefix_tree(list(license_scan.SENTENCES)))
    assert all(tree.fullmatch(s) and tree.match(s + "\n").group() == s for s in license_scan.SENTENCES)
    assert re.compile(license_scan.prefix_tree(["a", "ab", "abc d", "b"])).match("abc").group() == "ab"


@pytest.mark.parametrize("collide", [False, True])
def test_exact_dedup_goes_on_from_its_state(spark, tmp_path, monkeypatch, collide):
    from pyspark.sql import functions as F

    if collide:
        monkeypatch.setattr(exact_dedup, "digest_of", lambda t: F.unhex(F.lpad(F.hex(F.length(exact_dedup.normalised(t)) % 3), 2, "0")))
    every = rows() + [(d + 100, t, *rest) for d, t, *rest in rows()[:5]]
    state, seen = str(tmp_path / "state"), []
    for new in (every[::2], every[1::2], []):
        df = spark.createDataFrame(new, DOCS)
        got = exact_dedup.exact_dedup(df, state_dir=state, earlier=spark.createDataFrame(seen, DOCS) if seen else None).collect()
        seen += new
        groups = {}
        for d, t, *_ in seen:
            groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), []).append(d)
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == {d: (max(g), len(g), d == max(g)) for g in groups.values() for d in g}
        assert len(got) == len(seen)
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(df, state_dir=state)


def test_pipeline_as_a_chain(spark, tmp_path):
    """Planted rows go at their stages, all others reach the token files, with the ids that the library gives."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plain = [r for r in docs.collect() if r.text]
    long = max(plain, key=lambda r: len(r.text.split()))
    item = max((r for r in items.collect() if r.text), key=lambda r: len(r.text))
    words, top = long.text.split(), max(r.doc_id for r in plain)
    near = " ".join([*words[:-1], "changed"])
    planted = {top + 1: None, top + 2: "12 34 !?", top + 3: near, top + 4: long.text, top + 5: f"{' '.join(words[:40][::-1])} {item.text} {' '.join(words[40:80][::-1])}"}
    added = [tuple(planted[d] if c == "text" else d if c == "doc_id" else long[c] for c in docs.columns) for d in planted]
    docs.unionByName(spark.createDataFrame(added, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()

    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    spoken = {d: t for d, t in texts.items() if t and any(c.isalpha() for c in t)}
    left = {d for d, (n, root) in plain_jaccard(spoken).items() if root == d or not n}
    assert not left & set(planted) - {top + 5}
    ids = {r.doc_id for r in out}
    assert ids <= left - {top + 5}
    library, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r in out:
        want = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert len(ids) >= 0.8 * len(left)  # mixing leaves out what the weights don't hold, and some documents hold benchmark passages
