"""Version diffs against a plain version that compares all paragraphs of a gap."""

import random
import resource

from foliospark.operators import diff

ROWS = "pair_id long, side string, para_no int, text string"


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    return table[0][0]


def test_common_subsequences_are_longest():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in "ab")
        pairs = diff._common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == longest(a, b)


def test_long_lists_need_little_memory():
    a = [f"p{k}" for k in range(20_000)]
    b = [x if k % 50 else f"q{k}" for k, x in enumerate(a)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(diff._common(a, b)) == sum(x == y for x, y in zip(a, b))
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 200


def plain(old, new):
    """Rows by anchors and by greedy choice over all pairs of a gap."""
    rows, i, j = [], 0, 0
    for p, q in [*diff._common(old, new), (len(old), len(new))]:
        scored = sorted((-diff.similarity(old[a], new[b]), a, b) for a in range(i, p) for b in range(j, q))
        pairs = {}
        for s, a, b in scored:
            if -s >= diff.SIMILAR and a not in pairs and b not in pairs.values():
                pairs[a] = b
        back = {b: a for a, b in pairs.items()}
        rows += [("del", a, None) for a in range(i, p) if a not in pairs]
        rows += [("modified", back[b], b) if b in back else ("add", None, b) for b in range(j, q)]
        rows += [("same", p, q)] if p < len(old) else []
        i, j = p + 1, q + 1
    return rows


WORDS = "a of to the and model price market review in it data set yield crops soil river x".split()


def version(rng, paragraphs):
    out = []
    for text in paragraphs:
        words = text.split(" ")
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        if rng.random() < 0.85:
            out.append(" ".join(words))
        if rng.random() < 0.1:
            out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))))
    return out


def table(spark, pairs):
    return spark.createDataFrame([(k, side, n, t) for k, versions in pairs.items() for side, texts in zip(("old", "new"), versions) for n, t in enumerate(texts)], ROWS)


def test_diff_equals_all_comparisons(spark):
    rng = random.Random(3)
    pairs = {k: (old := [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(0, 14))], version(rng, old)) for k in range(40)}
    pairs |= {100: ([], []), 101: (["", "", "a b"], ["", "x", ""]), 102: (["a b c"], []), 103: ([], ["  ", "a"]), 104: (["a a a a", " "], ["a a", "  ", "a a a"])}
    pairs[105] = ([f"the price of item {k} in {k * 7} markets" for k in range(81)], [f"the price of item {k} in {k * 7} shops" for k in range(81)])
    got = {}
    found = diff.diff_paragraphs(table(spark, pairs)).collect()
    for r in sorted(found, key=lambda r: (r.pair_id, r.seq)):
        got.setdefault(r.pair_id, []).append((r.type, r.old_idx, r.new_idx))
    assert got == {k: rows for k, v in pairs.items() if (rows := plain(*v))}
    assert [t for t, _, _ in got[105]] == ["modified"] * 81
    text = {(r.pair_id, r.seq): (r.old_text, r.new_text) for r in found}
    assert all((r.old_idx is None or text[r.pair_id, r.seq][0] == pairs[r.pair_id][0][r.old_idx]) and (r.new_idx is None or text[r.pair_id, r.seq][1] == pairs[r.pair_id][1][r.new_idx]) for r in found)
    scripts = {(r.pair_id, r.seq): r.script for r in diff.word_diff(diff.diff_paragraphs(table(spark, {105: pairs[105]}))).collect()}
    for (k, n), script in scripts.items():
        assert "".join(s["text"] for s in script if s["type"] != "add") == pairs[k][0][n] and "".join(s["text"] for s in script if s["type"] != "del") == pairs[k][1][n]
    assert diff.diff_paragraphs(table(spark, {})).collect() == []


def test_pairs_without_texts_are_those_with_texts(spark):
    rows = [(p, s, k, f"Paragraph {k} of pair {p}" + (" with an end" if s == "new" and k == 2 else "")) for p in range(4) for s in ("old", "new") for k in range(5) if not (s == "new" and k == 3)]
    p = spark.createDataFrame(rows, "pair_id long, side string, para_no int, text string")
    whole = diff.diff_paragraphs(p)
    keys = ["pair_id", "seq", "type", "old_idx", "new_idx"]
    assert sorted(whole.select(*keys).collect(), key=str) == sorted(diff.diff_rows(p).select(*keys).collect(), key=str)
    assert "FlatMapGroups" not in diff.anchors(p)._jdf.queryExecution().toString()
