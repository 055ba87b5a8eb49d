import random
import re
from collections import Counter

import pytest

from foliospark.operators import stats
from foliospark.plans import queries

SCHEMA = "doc_id long, line_no int, title string, authors array<string>, first_author string, doi string"


def dice(a, b):
    a, b = (re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", "", (x or "").lower())).strip() for x in (a, b))
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    return 2.0 * (x & y).total() / (len(a) + len(b) - 2) if min(len(a), len(b)) > 2 else 0.0


def all_pairs(rows):
    """The pairs by comparing all references of a document."""
    docs = {}
    for r in rows:
        docs.setdefault(r[0], []).append(r)
    out = {}
    for doc, refs in docs.items():
        refs = sorted((r for r in refs if r[2] and len(r[2]) >= 25), key=lambda r: r[1])
        out |= {(doc, a[1], b[1]): s for k, a in enumerate(refs) for b in refs[k + 1 :] if (s := dice(a[2], b[2])) >= 0.88 and dice(a[3], b[3]) >= 0.5}
    return out


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng = random.Random(11)
    base = ["Methodology of crops", "On the use of item81 in a new way", "aa aa aa aa aa aa aa aa aa aa aa", "Interest rates and terms of OwnBank savings", "!?" * 15 + "A", "!?" * 15 + "ab", "É" * 30]
    rows = [(2, 1, None, None, "Smith, J.", None), (2, 2, base[1], None, None, "10.1/x"), (2, 3, base[1], None, None, "10.1/x"), (None, 1, base[1], None, "Smith, J.", None)]
    for n in range(160):
        title = list(rng.choice(base) + rng.choice(["", " of fields"]))
        for _ in range(rng.randint(0, 3)):
            title[rng.randrange(len(title))] = rng.choice("abz9 -")
        authors = [rng.choice(["Smith, J.", "Smyth, J.", "Lee, K."]), "Brown, B.", "Wolde-Giorgis, T."][: rng.randint(1, 3)]
        rows.append((n % 2, n, "".join(title), authors, authors[0], rng.choice([None, "10.1/y"])))
    want = all_pairs([(r[0], r[1], r[2], r[4]) for r in rows])
    found = stats.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {(r.doc_id, r.line_no, r.line_b): r.similarity for r in found}
    assert len(found) == len(got) > 100
    assert got == pytest.approx(want)


def test_near_duplicates_query_is_that_of_all_pairs(spark):
    sf_dir = "/root/testdata/sf0.001"
    refs = queries.apa_refs(spark, sf_dir).select("doc_id", "line_no", "title", "first_author").collect()
    found = queries.QUERIES["a2_near_duplicates"](spark, sf_dir).collect()
    assert {(r.doc_id, r.line_no, r.line_b) for r in found} == set(all_pairs(refs))
    assert len(found) > 1000


def test_near_duplicates_of_short_and_long_lists_agree(spark, monkeypatch):
    rows = [(d, k, f"On the use of item{(k * 37 + d) % 113} in a {'new' if k % 3 else 'new new'} way", [None, "", "Smith, A.", "Smyth, A.", "Garcia, B.", "É"][(k + d) % 6]) for d in range(3) for k in range(1, 20)]
    rows += [(7, 1, "%%%%%%%%%%%%%%%%%%%%%%%%%%%%%ab", "Smith"), (7, 2, "%%%%%%%%%%%%%%%%%%%%%%%%%%%%%ab", "Smith"), (8, 1, "A title that stands alone in its list", "Smith"), (8, 2, None, "Smith")]
    r = spark.createDataFrame(rows, "doc_id long, line_no int, title string, first_author string")
    found = lambda: {(x.doc_id, x.line_no, x.line_b): x.similarity for x in stats.near_duplicates(r).collect()}
    short = found()
    monkeypatch.setattr(stats, "IN_PLACE", 1)
    long = found()
    assert len(short) > 30 and {k: v for k, v in short.items() if k[0] != 7} == {k: v for k, v in long.items() if k[0] != 7} and short[7, 1, 2] == 1.0
