"""Token counts by rank-synchronous array merging.

The vocabulary of a sentencepiece BPE model becomes sorted arrays of mergeable symbol pairs. A batch
of distinct pre-tokens is held as one ragged array of symbols; in every round each pre-token applies
its own best-ranked pair, all pre-tokens at once, until no pair is left. Surviving symbols are the
tokens; a symbol outside the vocabulary counts one token for each UTF-8 byte.

Why splitting into pre-tokens is exact: no piece of such a vocabulary has a word mark after another
character, so no merge crosses the start of a word. This is checked when the model is loaded; where
it fails, a whole text is one pre-token. In the same way words are cut between two characters that no piece has side by side. What
is still longer than ``LONG`` symbols, such as a long run of letters, is merged pair by pair from a heap, in the same order.

Defined results: a null text counts as empty, an empty text has 0 tokens, rows that repeat give
repeated rows, an empty table gives an empty table, other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from foliospark.llm.common import slices

MARK = "▁"  # what sentencepiece writes for a space
NONE = np.iinfo(np.int32).max
#: Distinct words that a worker remembers, and the longest word that it remembers.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 64
#: Symbols of a run above which its merges come from a heap.
LONG = 2_000


class PieceMerger:
    """Counts the pieces of strings as a sentencepiece BPE model with byte fallback does."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        ids.sort(key=lambda i: -model.get_score(i))
        pieces = [model.id_to_piece(i) for i in ids]
        vocabulary = set(pieces)
        chars = sorted({c for p in pieces for c in p})
        # Symbols 0 to 3 stand for characters outside the vocabulary, by their UTF-8 length.
        names = [*chars, *(p for p in pieces if len(p) > 1)]
        symbol = {name: k + 4 for k, name in enumerate(names)}
        self.cost = np.array([1, 2, 3, 4, *(1 if n in vocabulary else len(n.encode()) for n in names)], dtype=np.int64)
        self.of_char = np.empty(0x110000, dtype=np.int32)
        for k, bounds in enumerate(((0, 0x80), (0x80, 0x800), (0x800, 0x10000), (0x10000, 0x110000))):
            self.of_char[bounds[0] : bounds[1]] = k
        for c in chars:
            self.of_char[ord(c)] = symbol[c]
        self.size = len(names) + 4
        keys, ranks = [], []
        rank_of = {p: r for r, p in enumerate(pieces)}
        self.made = np.array([symbol[p] for p in pieces], dtype=np.int32)
        self.safe = np.ones(len(pieces), dtype=bool)
        for rank, piece in enumerate(pieces):
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in symbol and right in symbol:
                    keys.append(symbol[left] * self.size + symbol[right])
                    ranks.append(rank)
                    for part in (left, right):
                        # A part that ranks after what is made of it has to be merged one place at a time.
                        if len(part) > 1 and rank_of[part] > rank:
                            self.safe[rank_of[part]] = False
        order = np.argsort(keys)
        self.keys, self.ranks = np.array(keys, dtype=np.int64)[order], np.array(ranks, dtype=np.int32)[order]
        self.by_word = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.side_by_side = np.unique([symbol[a] * self.size + symbol[b] for p in pieces for a, b in zip(p, p[1:], strict=False)])
        self.rank_of_pair: dict[int, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE).astype(np.int32)

    def _touch(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether some piece has these two characters side by side; between others nothing merges."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.side_by_side, key), len(self.side_by_side) - 1)
        return self.side_by_side[at] == key

    def _count_long(self, symbols: np.ndarray) -> int:
        """The pieces of one long run: the best-ranked pair first, of equal ones the leftmost."""
        if not self.rank_of_pair:
            self.rank_of_pair = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        n, held, rank = len(symbols), symbols.tolist(), self.rank_of_pair.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, held[i], held[i + 1]) for i, r in enumerate(self._rank(symbols[:-1], symbols[1:]).tolist()) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if held[i] != a or j >= n or held[j] != b:
                continue  # one of the two has merged with another
            held[i], held[j] = int(self.made[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(held[i] * self.size + held[k])) is not None:
                    heapq.heappush(heap, (r, i, held[i], held[k]))
            h = before[i]
            if h >= 0 and (r := rank(held[h] * self.size + held[i])) is not None:
                heapq.heappush(heap, (r, h, held[h], held[i]))
        return int(self.cost[[s for s in held if s >= 0]].sum())

    def count(self, strings: list[str]) -> np.ndarray:
        """The number of pieces of each string, which holds marks in place of spaces."""
        totals = np.zeros(len(strings), dtype=np.int64)
        lengths = np.array([len(s) for s in strings], dtype=np.int64)
        if not lengths.sum():
            return totals
        points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = self.of_char[points]
        word = np.repeat(np.arange(len(strings)), lengths)
        opens = np.r_[True, (word[1:] != word[:-1]) | ~self._touch(symbols[:-1], symbols[1:])]
        owner = np.cumsum(opens) - 1
        word = word[opens]
        sizes = np.diff(np.r_[np.flatnonzero(opens), len(symbols)])
        for run in np.flatnonzero(sizes > LONG).tolist():
            totals[word[run]] += self._count_long(symbols[owner == run])
        short = (sizes <= LONG)[owner]
        symbols, owner = symbols[short], owner[short]
        ranks = np.full(len(symbols), NONE, dtype=np.int32)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inside] = self._rank(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            best_here = np.repeat(best, sizes)
            done = best_here == NONE
            if done.any():  # runs without a mergeable pair leave the batch
                np.add.at(totals, word[owner[done]], self.cost[symbols[done]])
                stay = ~done
                symbols, owner, ranks, best_here = symbols[stay], owner[stay], ranks[stay], best_here[stay]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == best_here)
            # Of places side by side, every other one from the left; of an unsafe piece, the leftmost.
            fresh = np.r_[True, np.diff(at) != 1]
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - run_start) % 2 == 0
            first = np.r_[True, owner[at][1:] != owner[at][:-1]]
            take &= first | self.safe[best_here[at]]
            at = at[take]
            symbols[at] = self.made[best_here[at]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[at + 1] = False
            moved = (np.cumsum(stay) - 1)[at]
            symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
            changed = np.unique(np.r_[moved, np.maximum(moved - 1, 0)])
            after = np.minimum(changed + 1, len(symbols) - 1)
            pair = (after > changed) & (owner[changed] == owner[after])
            ranks[changed[~pair]] = NONE
            changed, after = changed[pair], after[pair]
            ranks[changed] = self._rank(symbols[changed], symbols[after])
        return totals


@lru_cache(maxsize=2)
def merger_of(model_path: str) -> PieceMerger:
    """The merger of a model file, loaded once in a worker process."""
    return PieceMerger(model_path)


class TextCounter:
    """Counts whole texts; remembers the counts of frequent words."""

    def __init__(self, merger: PieceMerger):
        self.merger, self.known = merger, {}

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text, each without its first mark."""
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if not self.merger.by_word:
            return [marked]
        if MARK * 2 not in marked and marked[0] != MARK and marked[-1] != MARK:
            return marked.split(MARK)
        return [w[1:] for w in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + marked)]

    def count(self, texts: list[str]) -> list[int]:
        split = [self.words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*split) - self.known.keys()) if split else []
        long: dict[str, int] = {}
        for k in range(0, len(new), 100_000):
            part = new[k : k + 100_000]
            for word, n in zip(part, self.merger.count([MARK + w for w in part]).tolist(), strict=True):
                (self.known if len(word) <= LONGEST_REMEMBERED else long)[word] = n
        get = self.known.__getitem__ if not long else {**self.known, **long}.__getitem__
        return [sum(map(get, words)) for words in split]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of ``docs`` (doc_id, text).

    One pass without a shuffle. A worker holds some hundred texts and a bounded memory of words.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TextCounter(merger_of(model_path))
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"].tolist()]
            tokens: list[int] = []
            for begin, end in slices(texts):
                tokens += counter.count(texts[begin:end])
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
                    "n_tokens": tokens,
                    "over_limit": [n > limit for n in tokens],
                }
            )

    return docs.select("doc_id", "text").mapInPandas(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
