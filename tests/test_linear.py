"""What works on long arrays of one document: equal to plain loops, and linear enough for very long ones."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.operators import checks, convert, matching, prep, rules


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").select("k", expression.alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.k)]


def test_matches_and_places(spark):
    random.seed(1)
    texts = ["".join(random.choice("ab1 []é") for _ in range(random.randint(0, 60))) for _ in range(300)] + ["", None]
    for pattern in ("\\[[^\\]]*\\]", "a+", "1", "(?<=b)a"):
        got = column(spark, texts, "string", text.find_all("v", pattern))
        assert [[(m.raw, m.position) for m in x] for x in got] == [[(m[0], m.start()) for m in re.finditer(pattern, t or "")] for t in texts]


def test_many_matches_are_linear(spark):
    df = spark.createDataFrame([("a b " * 80_000,)], "v string")
    df.select(F.size(text.find_all("v", "x"))).collect()
    began = time.time()
    last = df.select(F.element_at(text.find_all("v", "b"), -1).alias("x")).first().x
    assert (last.raw, last.position) == ("b", 4 * 80_000 - 2)
    assert time.time() - began < 10  # some 1 s; a fold that copies took over a minute


def test_scan(spark):
    values = [[random.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 3, 17, 64, 100)]
    got = column(spark, values, "array<int>", text.scan(F.col("v"), lambda a, b: a * 2 - b))  # not associative: order of rounds is not defined
    assert [len(x) for x in got] == [len(x) for x in values]
    sums = column(spark, values, "array<int>", text.scan(F.col("v"), lambda a, b: a + b))
    assert sums == [[sum(x[: k + 1]) for k in range(len(x))] for x in values]


LINES = ["", " ", "INTRODUCTION", "RESULTS 2", "123", "456 ", "A sentence ends.", "goes on", "  in the middle ", "with (Smith,", "2020) cited.)", "Really?\"", "ÉCOLE", "X" * 70, "é", "end:"]


def one_line_a_sentence(lines):
    out = []
    for raw in lines:
        heading = lambda t: 0 < len(t) <= 60 and t == t.upper() and re.search("[A-Z]", t)
        last = out[-1].strip(" ") if out else ""
        own = raw.strip(" ")
        if not own or not last or re.search("[.!?:;][\")'\\]]?$", last) or heading(last) or heading(own):
            out.append(raw)
        else:
            out[-1] = out[-1].rstrip(" ") + " " + own
    return "\n".join(out)


def test_unwrapped(spark):
    random.seed(2)
    docs = [[random.choice(LINES) for _ in range(random.randint(0, 12))] for _ in range(400)]
    assert column(spark, ["\n".join(d) for d in docs], "string", prep.unwrapped("v")) == [one_line_a_sentence("\n".join(d).split("\n")) for d in docs]


ENTRIES = ["Smith, J. (2020). A title", "of some length.", "[3] Lee, K., 2019. Another", "continued here", "https://doi.org/10.1000/ab", "", "n.d.", "pp. 3-4.", "Universitas X", "2018.", "1999, in", "Author bio", "10.1234/", "(2001)", "  (2002a)  ", "4. Brown"]


def entries(lines):
    found, held = [], []
    starts = lambda t: re.search(r"^\s*(?:\[\d+\]|\(\d+\)|\d+[.)])\s*[A-Z]", t) or (re.search("^[A-Z]", t) and "," in t[:100] and re.search(r"\(\d{4}[a-z]?\)", t[:220]))

    def complete(t):
        dated = re.search(r"\(\d{4}[a-z]?\)|(?:^|\s)(19|20)\d{2}[a-z]?[.,)]", t) or re.search(r"(?i)\bn\.d\.", t)
        return dated and re.search(r"[.)]$|https?://\S+$|\d{4,9}/\S*$", t)

    for t in (x.strip(" ") for x in lines):
        if held and (not t or starts(t) or complete(" ".join(held))):
            found.append(" ".join(held))
            held = []
        held += [t] if t else []
    found += [" ".join(held)] if held else []
    return [t for t in found if re.search(r"\b(19|20)\d{2}[a-z]?\b|(?i:\bn\.d\.)|\bdoi\.org/|(?:^|\s)10\.\d{4,9}/|https?://", t)]


def test_rejoined_references(spark):
    random.seed(3)
    docs = [[random.choice(ENTRIES) for _ in range(random.randint(0, 14))] for _ in range(500)]
    assert column(spark, ["\n".join(d) for d in docs], "string", prep.rejoined_references("v")) == [entries(d) for d in docs]
    long = "\n".join(random.choice(ENTRIES) for _ in range(20_000))
    assert column(spark, [long], "string", prep.rejoined_references("v")) == [entries(long.split("\n"))]


def test_sentences(spark):
    many = "As Smith et al. found it works. " * 20_000
    got = column(spark, [many, "See fig. 3 now. Dr. No.", "", None], "string", prep.sentence_array("v", 1))
    assert got == [["As Smith et al. found it works."] * 20_000, ["See fig. 3 now.", "Dr. No."], [], []]


def test_compressed_runs(spark):
    random.seed(4)
    values = [[random.randint(1, 12) for _ in range(random.randint(0, 9))] for _ in range(200)] + [[None, 3, 4]]

    def plain(numbers):
        out, rest = [], sorted({n for n in numbers if n is not None})
        while rest:
            k = next((i for i in range(1, len(rest)) if rest[i] != rest[i - 1] + 1), len(rest))
            out += [f"{rest[0]}-{rest[k - 1]}"] if k > 2 else [str(n) for n in rest[:k]]
            rest = rest[k:]
        return ", ".join(out)

    assert column(spark, values[:-1], "array<int>", checks.compressed_runs(F.col("v"))) == [plain(v) for v in values[:-1]]


def greedy(spans):
    out, upto = [], 0
    for s, e, x in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if s >= upto:
            out.append((s, e, x))
            upto = e
    return out


def test_accepted_spans(spark):
    random.seed(6)
    docs = {k: [(s := random.randint(0, 60), s + random.randint(0, 9), n) for n in range(random.randint(1, 40))] for k in range(150)}
    docs[999] = [(s := random.randint(0, 300_000), s + random.randint(1, 9), n) for n in range(100_000)]
    rows = [(k, *s) for k, spans in docs.items() for s in spans]
    df = spark.createDataFrame(rows, "doc_id int, start int, end int, x int")
    got = {}
    for r in matching.accepted_spans(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.x))
    assert {k: sorted(v, key=lambda s: (s[0], -s[1], s[2])) for k, v in got.items()} == {k: greedy(v) for k, v in docs.items()}
    assert matching.accepted_spans(df.where("false")).collect() == []


def test_merged_spans(spark):
    rows = [(1, 0, 5, "suggestion"), (1, 3, 9, "error"), (1, 9, 12, "warning"), (1, 20, 21, "suggestion"), (2, 0, 1, "warning")]
    got = matching.merged_spans(spark.createDataFrame(rows, "doc_id int, start int, end int, severity string")).collect()
    assert sorted((r.doc_id, r.start, r.end, r.severity) for r in got) == [(1, 0, 9, "error"), (1, 9, 12, "warning"), (1, 20, 21, "suggestion"), (2, 0, 1, "warning")]


def test_stitched(spark):
    article = "".join(f"word{k} [{k}] " for k in range(5_000))
    spans = [(1, m.start(), m.end(), f"<{m[0]}>") for m in re.finditer(r"\[\d+\]", article)]
    docs = spark.createDataFrame([(1, article), (2, "as it was"), (3, None)], "doc_id int, article string")
    got = {r.doc_id: r.article for r in convert.stitched(docs, spark.createDataFrame(spans, "doc_id int, start int, end int, replacement string")).collect()}
    assert got == {1: re.sub(r"(\[\d+\])", r"<\1>", article), 2: "as it was", 3: None}


def test_coverage(spark):
    random.seed(8)
    runs, spans, want = [], [], {}
    for p in range(60):
        letters, run_no = [], 0
        for run_no in range(random.randint(0, 6)):
            size, italic = random.randint(0, 7), random.choice([True, False, None])
            runs.append((1, p, run_no, "x" * size, italic))
            letters += [bool(italic)] * size
        for n in range(3):
            start = random.randint(0, 20)
            end = start + random.randint(0, 15)
            spans.append((1, p, f"s{n}", start, end))
            part = letters[start:end]
            want[p, f"s{n}"] = sum(part) / len(part) if part else None
    got = checks.span_coverage(spark.createDataFrame(runs, "doc_id int, para_no int, run_no int, text string, italic boolean"), spark.createDataFrame(spans, "doc_id int, para_no int, span string, start int, end int")).collect()
    found = {(r.para_no, r.span): r.coverage for r in got}
    assert {k: v for k, v in found.items() if v is not None} == {k: v for k, v in want.items() if v is not None}


def test_located_by_whole_text_first(spark):
    same = "Smith, J. (2020). A title that begins as another one does and "
    refs = f"{same}ends here.\n{same}goes on."
    found = spark.createDataFrame([(1, "X", "error", f"{same}goes on.", None), (1, "X", "error", f"{same}is not there.", None), (1, "X", "error", "nowhere", None), (1, "X", "error", "in the text", None)], "doc_id int, issue_code string, severity string, code string, correction string")
    got = checks.located(found, spark.createDataFrame([(1, "First.\nThis is in the text.", refs)], "doc_id int, article string, reference_text string")).collect()
    assert [(r.source, r.line) for r in got] == [("references", 2), ("references", 1), (None, None), ("article", 2)]


def test_rules_on_one_summary(spark):
    refs = spark.createDataFrame([(1, k, str(2010 + k), "book" if k % 2 else "journal-article", "international" if k < 3 else "local") for k in range(10)] + [(1, 10, None, "book", "local"), (2, 1, "2020", "book", "local")], "doc_id int, line_no int, year string, source_type string, origin string")
    sets = spark.createDataFrame([("a", 5, 3, 50.0, "book", 50.0, None, 10.0), ("b", None, 100, 1.0, None, None, 20.0, None)], "rule_set string, min_count int, years int, years_min_pct double, source_type string, type_min_pct double, intl_min_pct double, registry_min_pct double")
    as_of = spark.createDataFrame([(1, 2020), (2, 2020)], "doc_id int, as_of_year int")
    statuses = spark.createDataFrame([(1, 1, "SCOPUS"), (1, 2, "UNKNOWN")], "doc_id int, line_no int, status string")
    got = {(r.doc_id, r.rule_set, r.rule_id): (r.actual, r["pass"]) for r in rules.evaluate_rules(refs, sets, as_of, statuses).collect()}
    assert got == {
        (1, "a", "min_count"): (11.0, True), (1, "a", "year_range"): (30.0, False), (1, "a", "source_type"): (54.5, True), (1, "a", "registry"): (9.1, False), (1, "b", "year_range"): (100.0, True), (1, "b", "origin"): (27.3, True),
        (2, "a", "min_count"): (1.0, False), (2, "a", "year_range"): (100.0, True), (2, "a", "source_type"): (100.0, True), (2, "a", "registry"): (None, False), (2, "b", "year_range"): (100.0, True), (2, "b", "origin"): (0.0, False),
    }


@pytest.mark.parametrize("value", [None, ""])
def test_nothing(spark, value):
    assert column(spark, [value], "string", prep.unwrapped("v")) == [""]
    assert column(spark, [value], "string", prep.rejoined_references("v")) == [[]]
