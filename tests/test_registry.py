"""Exact similarity with the registry against all pairs, typos included, and the recall of blocking by words."""

import random
import re
from collections import Counter

import pytest

from foliospark.operators import registry

REFS = "doc_id int, line_no int, doi string, title string, first_author string, journal string, issn string, eissn string, year string, volume string, pages string, article_number string"
DOCS = "doi string, title string, first_author string, journal string, issn string, eissn string, year string, volume string, issue string, pages string, article_number string"


def normal(x):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", "", (x or "").lower())).strip()


def dice(a, b):
    a, b = normal(a), normal(b)
    if not a or not b or a != b and min(len(a), len(b)) < 3:
        return 0.0
    if a == b:
        return 1.0
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    return 2.0 * (x & y).total() / (len(a) + len(b) - 2)


def last(x):
    x = (x or "").strip()
    return (x.split(",")[0].strip() if "," in x else re.sub("[.,]", "", x.split()[-1]) if x else "").lower()


def people(a, b):
    x, y = last(a), last(b)
    return 0.0 if not x or not y else 1.0 if x == y else dice(x, y)


def years(a, b):
    x, y = (int(m[1]) if (m := re.match(r"\s*(\d{1,9})", v or "")) and int(m[1]) else None for v in (a, b))
    return 0.0 if x is None or y is None else 1.0 if x == y else 0.5 if abs(x - y) == 1 else 0.0


def places(r, d):
    both = [(a, b) for a, b in ((r["volume"], d["volume"]), (r["pages"] or r["article_number"], d["pages"] or d["article_number"])) if a and b]
    return sum(a == b for a, b in both) / len(both) if both else 0.0


WORDS = "of the big data set in a new era management crops yield deep learning study for soil".split()
rng = random.Random(4)


def typo(t):
    k = rng.randrange(len(t)) if t else 0
    return t[:k] + rng.choice("abex ") + t[k + rng.randint(0, 1) :]


def tables():
    docs, refs = [], []
    for n in range(60):
        title = rng.choice(["", None, "ab", "of"]) if n % 15 == 0 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 9)))
        some = lambda v: rng.choice([v, v, None])
        docs.append((f"10.1/{n:03d}", title, some(rng.choice(["Smith, J.", "Smyth, K.", "Lee", "X"])), some(rng.choice(["Crops", "Soil Sci"])), None, None, some(str(2000 + n % 6)), some(str(n % 4)), None, some(f"{n}-{n + 5}"), None))
    docs.append(("10.1/typo", "Management of the big data set in the new era xx", "Smith, J.", None, None, None, "2001", None, None, None, None))
    for n in range(120):
        d = list(rng.choice(docs))
        title = d[1]
        for _ in range(rng.randint(0, 4)):
            title = typo(title or "")
        some = lambda v: rng.choice([v, v, v, None])
        refs.append((n % 7, n, None if n % 3 else d[0], title, some(d[2]), some(d[3]), None, None, rng.choice([d[6], "2003", "n.d.", None]), some(d[7]), some(d[9]), None))
    refs.append((9, 500, None, "Managament of the big data set in the new era xx", "Smith, J.", None, None, None, "2001", None, None, None))
    refs.append((9, 501, None, None, None, None, None, None, None, None, None, None))
    names = lambda kind, rows: [dict(zip((c.split()[0] for c in kind.split(", ")), r, strict=True)) for r in rows]
    return refs, docs, names(REFS, refs), names(DOCS, docs)


def test_exact_metadata_matches_equal_all_pairs(spark):
    refs, docs, r_rows, d_rows = tables()
    score = lambda r, d: 0.6 * dice(r["title"], d["title"]) + 0.15 * people(r["first_author"], d["first_author"]) + 0.1 * dice(r["journal"], d["journal"]) + 0.1 * years(r["year"], d["year"]) + 0.05 * places(r, d)
    best = {(r["doc_id"], r["line_no"]): max(score(r, d) for d in d_rows) for r in r_rows}
    want = {k: s for k, s in best.items() if s >= 0.8 - 1e-9}
    r, d = spark.createDataFrame(refs, REFS), spark.createDataFrame(docs, DOCS)
    exact = {(x.doc_id, x.line_no): x.confidence for x in registry.exact_metadata_matches(r, d).collect()}
    assert exact == pytest.approx(want) and (9, 500) in exact and len(want) > 15
    by_word = {(x.doc_id, x.line_no) for x in registry.metadata_matches(r, d).where("confidence >= 0.8").collect()}
    assert by_word <= set(exact) and (9, 500) in exact
    low = {(x.doc_id, x.line_no): x.confidence for x in registry.exact_metadata_matches(r, d, 0.55).collect()}
    assert low == pytest.approx({k: s for k, s in best.items() if s >= 0.55 - 1e-9})
    assert registry.exact_metadata_matches(r, d.where("false")).collect() == [] and registry.exact_metadata_matches(r.where("false"), d).collect() == []
    src = spark.createDataFrame([], "issn string, eissn string, title string, coverage string, discontinued boolean")
    status = {(x.doc_id, x.line_no): x.status for x in registry.registry_matches(r, d, src, exact=True).collect()}
    assert status[9, 500] in ("SCOPUS", "PROBABLE_SCOPUS") and len(status) == len(refs)


@pytest.mark.parametrize("spread", [3])
def test_doi_candidates_equal_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(registry, "SPREAD", spread)
    refs, docs, r_rows, d_rows = tables()
    half = lambda a, b, s: 0.5 if a is None or b is None else s(a, b)
    score = lambda r, d: 0.6 * dice(r["title"], d["title"]) + 0.25 * half(r["first_author"], d["first_author"], people) + 0.15 * half(r["year"], d["year"], years)
    want = {}
    for r in r_rows:
        if r["doi"] is None:
            rows = sorted((-round(score(r, d), 9), d["doi"]) for d in d_rows)[:5]
            want |= {(r["doc_id"], r["line_no"], n + 1): (doi, -s) for n, (s, doi) in enumerate(rows)}
    works = spark.createDataFrame([(d["doi"], d["title"], [(d["first_author"], None)] if d["first_author"] else [], int(d["year"]) if d["year"] else None, None, None, None, None) for d in d_rows], "doi string, title string, authors array<struct<family:string,given:string>>, issued int, published int, published_print int, published_online int, created int")
    r = spark.createDataFrame(refs, REFS)
    got = {(x.doc_id, x.line_no, x.rank): (x.doi, x.score) for x in registry.doi_candidates(r, works).collect()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()})
    assert sum(got[k][0] == want[k][0] for k in want) >= 0.99 * len(want)  # ties within rounding may change places
    few = {(x.doc_id, x.line_no, x.rank): x.score for x in registry.doi_candidates(r, works, least=0.6).collect()}
    assert few == pytest.approx({k: v[1] for k, v in want.items() if v[1] >= 0.6})


def test_copies_are_compared_once(spark, monkeypatch):
    seen, plain = [], registry.similar_titles

    def counted(left, right, *more):
        seen.append((left.select("lid").distinct().count(), right.select("rid").distinct().count()))
        return plain(left, right, *more)

    monkeypatch.setattr(registry, "similar_titles", counted)
    refs = spark.range(60).selectExpr("id AS doc_id", "1 AS line_no", "CAST(NULL AS string) AS doi", "concat('green widget of steel', id % 2) AS title", "'Smith, A.' AS first_author", "CAST(NULL AS string) AS journal", "'1999' AS year", "CAST(NULL AS string) AS volume", "CAST(NULL AS string) AS pages", "CAST(NULL AS string) AS article_number")
    docs = refs.selectExpr("concat('10.1/', doc_id + 10) AS doi", "'green widget of steel1' AS title", "first_author", "journal", "year", "volume", "pages", "article_number")
    best = registry.exact_metadata_matches(refs, docs).collect()
    none = "CAST(NULL AS int)"
    works = docs.selectExpr("doi", "title", "array(named_struct('family', 'Smith', 'given', CAST(NULL AS string))) AS authors", "1999 AS issued", f"{none} AS published", f"{none} AS published_print", f"{none} AS published_online", f"{none} AS created")
    few = registry.doi_candidates(refs, works, least=0.7).where("doc_id = 7").orderBy("rank").collect()
    assert len(best) == 60 and [x.doi for x in few] == [f"10.1/{n}" for n in range(10, 15)]
    assert seen and all(a <= 2 and b <= 1 for a, b in seen)
