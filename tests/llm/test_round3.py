"""Spelling variants, cross-tokenizer alignment and the quality classifier against brute force, with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from foliospark.llm import alignment, quality, spelling

DOCS = "doc_id long, text string, word string, n long, quality int"
random.seed(5)
LETTERS = "abcdeéÉñ×ÿ"
LEXICON = ["".join(random.choice(LETTERS) for _ in range(random.randint(5, 11))) for _ in range(30)]
VARIANTS = [w[:k] + random.choice(LETTERS) + w[k + random.randint(0, 1) :] for w in LEXICON for k in (0, 3, len(w))]


def _sentences():
    pick = lambda: random.choice(LEXICON) if random.random() < 0.9 else random.choice(VARIANTS)
    texts = [" ".join(pick() for _ in range(60)) for _ in range(40)]
    long_word = "abc" * 3000
    texts += [None, "", "  ", "1234 !!", "AABBAABB aabbaabb", f"{long_word} {long_word} {long_word[:-1]}x {long_word[:-1]}x", "你好 <|endoftext|>'s ▁ x", "x" * 2500, " \n\t " * 300]
    out = [(k, t, "w", 1, None) for k, t in enumerate(texts)]
    return out + [(None, texts[0], "w", 1, None), (1, texts[1], "w", 1, None), (1, texts[2], "w", 1, None)]


ROWS = _sentences()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def brute_variants(rows):
    import re

    count = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
        return a != b and len(a) - len(b) <= 1 and (a[k + 1 :] == b[k:] or a[k + 1 :] == b[k + 1 :])

    form, close = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        close[w] = len(others)
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], close[w], n[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("part, filter_bytes", [(spelling.PART_BYTES, spelling.FILTER_BYTES), (64, 192)])
def test_spelling(spark, docs, part, filter_bytes):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs, part_bytes=part, filter_bytes=filter_bytes).collect()}
    want = brute_variants(ROWS)
    assert got == want and sum(v[0] is not None for v in want.values()) > 3
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []


def test_forms_are_followed(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(40)]
    forms = spark.createDataFrame(chain, "word string, form string")
    assert {(r.word, r.root) for r in spelling.roots(forms).collect()} == {(a, "w40") for a, _ in chain}


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_library.encode_special_tokens = True
    b_library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_letters()
    made, count = [], Counter()
    for d, t, *_ in rows:
        t = t or ""
        a, b = a_library.encode(" " + t, add_special_tokens=False), b_library.encode(t)
        a_bytes = [bytes(letters[c] for c in x) for x in a.tokens]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_library.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_library.id_to_piece(i)]]
        if not t or b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            made.append((d, [], []))
            continue
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        groups = defaultdict(lambda: ([], []))
        cuts = sorted(set(a_ends) & set(b_ends))
        for side, (ids, stops) in enumerate(((a.ids, a_ends), (b, b_ends))):
            for i, e in zip(ids, stops):
                groups[next(c for c in cuts if c >= e)][side].append(i)
        groups = [groups[c] for c in cuts]
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        count.update(set(links))
        made.append((d, groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for d, groups, links in made:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        sums = (sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links))
        out.append((d, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), *sums, sha))
    return Counter(out)


@pytest.mark.parametrize("head, most, long", [(alignment.HEAD, alignment.PAIRS, 200_000), (20, 300, 40)])
def test_alignment(spark, docs, monkeypatch, head, most, long):
    monkeypatch.setattr(alignment, "LONG", long)
    monkeypatch.setattr(alignment, "CHUNK", long // 2)
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    kept = [r for r in ROWS if len(r[1] or "") < 20_000]
    table = docs.where("text is null or length(text) < 20000")
    got = Counter(tuple(r) for r in alignment.align_documents(table, *paths, head=head, most=most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == brute_alignment(kept)
    assert alignment.align_documents(spark.createDataFrame([], DOCS), *paths).collect() == []


def test_long_texts_are_cut_where_no_token_reaches(monkeypatch):
    side = alignment.ByteSide(public_tokenizers.path("byte_bpe_50k.json"))
    other = alignment.PieceSide(public_tokenizers.path("piece_bpe_32k.model"))
    text = " ".join(random.choice(["It's", "a", "12", "naïve", "word", "\n", "", "x.", "…"]) for _ in range(400))
    whole = side.encode(text), other.encode_all([text])
    assert whole[0] == side.library.encode(" " + text, add_special_tokens=False).ids
    monkeypatch.setattr(alignment, "LONG", 50)
    monkeypatch.setattr(alignment, "CHUNK", 20)
    assert len(alignment.chunks(text)) > 5 and "".join(alignment.chunks(text)) == text
    assert (side.encode(text), other.encode_all([text])) == whole


def test_shared_ends_with_long_cutless_intervals():
    random.seed(9)
    for _ in range(200):
        total, texts = 0, []
        a_ends, b_ends, low, high = [], [], [], []
        for _ in range(3):
            n = random.randint(1, 60)
            a, b = ({*random.sample(range(1, n + 1), random.randint(0, n // 2)), n} for _ in "ab")
            low.append(len(a_ends))
            a_ends += [total + e for e in sorted(a)]
            b_ends += [total + e for e in sorted(b)]
            high.append(len(a_ends))
            total += n
        cut = alignment.shared_ends(np.array(a_ends), np.array(b_ends), np.array(low), np.array(high))
        assert cut.tolist() == [e in set(b_ends) for e in a_ends], texts


def reviews():
    random.seed(7)
    words = "the of and in to market price model result review".split()
    out, labels = [], []
    for k in range(300):
        good = k % 4 != 0
        text = " ".join(random.choice(words) for _ in range(random.randint(5, 40)))
        text = text if good else " ".join(w + "!!" for w in text.upper().split())
        out.append((k, text, "w", 1, None))
        labels.append((k, int(good), 0))
    return out + [(1000, None, "w", 1, None), (1001, "", "w", 1, None), (None, "the", "w", 1, None), (3, "PRICE!! MARKET!!", "w", 1, None)], labels


def test_quality(spark):
    rows, labels = reviews()
    docs = spark.createDataFrame(rows, DOCS)
    odd = [(5, 0, 0), (5, 1, 0), (None, 1, 0), (7, None, 0), (9999, 0, 0), (1, 1, 0)]
    table = spark.createDataFrame(labels + odd, "doc_id long, quality int, text int")
    got = quality.score_documents(docs, table).collect()
    assert len(got) == len(rows)
    truth = dict((d, q) for d, q, _ in labels)
    tested = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert len(tested) > 40 and all(r.predicted == truth[r.doc_id] and 0 <= r.score <= 1 for r in tested)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    empty = [r.score for r in got if r.doc_id in (1000, 1001)]
    assert empty[0] == empty[1]
    # Labels of held-out rows are never learned from: turning them over changes no score.
    turned = spark.createDataFrame([(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels] + odd, "doc_id long, quality int, text int")
    key = lambda r: (r.doc_id is None, r.doc_id, r.score)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, quality.score_documents(docs, turned).collect()), key=str)
    none = quality.score_documents(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_documents(spark.createDataFrame([], DOCS), table).collect() == []


def test_indicators_and_descent():
    text = "The the The cat, cat!! 12 a_b " * 3
    assert set(quality.indicators(text, quality.Lexicon())) >= set(quality.indicators("The the", quality.Lexicon()))
    whole, step = quality.indicators(text * 20, quality.Lexicon()), quality.STEP
    try:
        quality.STEP = 7
        assert (quality.indicators(text * 20, quality.Lexicon()) == whole).all()
    finally:
        quality.STEP = step
    # Brute force: the dual optimum of a small problem by projected gradient steps.
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 30, 8)) for _ in range(40)]
    good = rng.random(40) < 0.6
    ratios = quality.count_ratios(sets, good)
    dense = np.zeros((40, quality.BUCKETS + 1))
    for k, s in enumerate(sets):
        dense[k, s] = quality.unit(ratios[s])
    dense[:, -1] = 1
    dense *= np.where(good, 1.0, -1.0)[:, None]
    gram, dual = dense @ dense.T, np.zeros(40)
    for _ in range(20_000):
        dual = np.clip(dual + 0.02 * (1 - gram @ dual), 0, 1)
    weights, bias = quality.descend(sets, ratios, good, rounds=2000)
    want = dense.T @ dual
    assert np.abs(weights - want[:-1]).max() < 0.02 and abs(bias - want[-1]) < 0.02
