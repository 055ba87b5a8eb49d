"""Language identification with a linear-chain conditional random field over words.

Every word has affix, character n-gram and lexicon features (hashed); the labels are the languages of
the training rows, the transitions between the labels of neighbouring words are learned with the
features by the gradient of the conditional likelihood. Forward-backward gives each word's marginals, so
a text that switches languages gets words of several labels. A document's score for a language is the
mean marginal of its words, its prediction the best one.

Words are runs of letters; runs of over 40 letters are cut into consecutive words of 40 and the rest. Chains are runs of ``CHAIN`` words;
a whole text is cut into chains, none of it is skipped.

Fitting uses a bounded sample of labelled rows: at most ``per_language`` rows of each language, those of
smallest hash, of at most ``longest`` characters; that bound, times the number of languages (``most_languages``
at most, more raise an error), limits what reaches the driver. The prediction reads nothing but the text.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every row where no
row is labelled; equal texts get equal predictions; ties go to the language first in order; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import slices

UND = "und"
CHAIN = 64
BUCKETS = 1 << 16
REMEMBERED = 150_000
#: A run of letters; of a longer run, such as scripts without spaces have, every 40 characters and the rest are words of the chain.
_WORD = re.compile(r"[^\W\d_]{1,40}")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, (bucket, word number): n-grams of 1 to 4 bytes between word marks, the word itself.

    N-grams that hold a mark are the word's prefixes and suffixes; the whole word is the lexicon feature.
    """
    joined = "".join(f"^{w}$" for w in words).encode("utf-8", "surrogatepass")
    data = np.frombuffer(joined, dtype=np.uint8).astype(np.uint64)
    starts = np.flatnonzero(data == ord("^"))
    owner = np.repeat(np.arange(len(words)), np.diff(np.r_[starts, len(data)]))
    mixed, who = [], []
    gram = np.zeros(len(data), dtype=np.uint64)
    for n in range(1, 5):
        gram = gram[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :] + np.uint64(n)
        inside = owner[: len(gram)] == owner[n - 1 :]
        mixed.append(gram[inside])
        who.append(owner[: len(gram)][inside])
    powers = np.arange(len(data)) - starts[owner]
    whole = np.add.reduceat((data + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15) ** (powers.astype(np.uint64) + np.uint64(1)), starts)
    mixed.append(whole)
    who.append(np.arange(len(words)))
    keys = np.concatenate(mixed) * np.uint64(0xD6E8FEB86659FD93)
    keys ^= keys >> np.uint64(32)
    keys *= np.uint64(0xD6E8FEB86659FD93)
    return (keys >> np.uint64(48)).astype(np.int64) % BUCKETS, np.concatenate(who)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word and the summed pair marginals of neighbours.

    scores: [words, labels], chains one after the other with the given lengths (all above 0).
    """
    labels = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    ordered = lengths[order]
    weight = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max())
    active = [int(np.searchsorted(-ordered, -t, side="left")) for t in range(int(ordered[0]))]
    forward = np.empty_like(weight)
    for t, n in enumerate(active):
        at = starts[:n] + t
        now = weight[at] if t == 0 else (forward[at - 1] @ step) * weight[at]
        forward[at] = now / now.sum(axis=1, keepdims=True)
    pairs = np.zeros((labels, labels))
    marginals = forward.copy()
    back = np.ones((len(ordered), labels))
    for t in range(len(active) - 1, 0, -1):
        n = active[t]
        at = starts[:n] + t
        ahead = back[:n] * weight[at]
        before = ahead @ step.T
        both = forward[at - 1] * before
        norm = both.sum(axis=1, keepdims=True)
        pairs += step * ((forward[at - 1] / norm).T @ ahead)
        marginals[at - 1] = both / norm
        back[:n] = before / before.sum(axis=1, keepdims=True)
    return marginals, pairs


def chain_lengths(n_words: int) -> list[int]:
    return [min(CHAIN, n_words - k) for k in range(0, n_words, CHAIN)]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        bucket, who = word_features(words)
        order = np.argsort(who, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(who[order]) > 0])
        return np.add.reduceat(self.weights[bucket[order]], first, axis=0)


def fit(texts: list[str], langs: list[str], rounds: int = 15, rate: float = 0.5, decay: float = 1e-4) -> LanguageModel:
    """Fits the field by AdaGrad over all sampled chains; each word of a row carries the row's language."""
    languages = sorted(set(langs))
    split = [words_of(t) for t in texts]
    number = {w: k for k, w in enumerate(sorted(set().union(*split)))}
    model = LanguageModel(languages, np.zeros((BUCKETS, len(languages)), dtype=np.float32), np.zeros((len(languages), len(languages))))
    if not number:
        return model
    at = np.array([number[w] for words in split for w in words])
    truth = np.repeat([languages.index(x) for x in langs], [len(w) for w in split])
    lengths = np.array([n for words in split for n in chain_lengths(len(words))])
    same = np.ones(len(at), dtype=bool)
    same[np.cumsum(lengths) - lengths] = False
    seen_pairs = np.zeros((len(languages),) * 2)
    np.add.at(seen_pairs, (truth[:-1][same[1:]], truth[1:][same[1:]]), 1)
    vocabulary = list(number)
    bucket, who = word_features(vocabulary)
    square, square_t = np.full(model.weights.shape, 1e-8), np.full(model.transitions.shape, 1e-8)
    for _ in range(rounds):
        scores = model.word_scores(vocabulary)[at].astype(np.float64)
        marginals, pairs = forward_backward(scores, lengths, model.transitions)
        marginals[np.arange(len(at)), truth] -= 1
        for k in range(len(languages)):
            per_word = np.bincount(at, marginals[:, k], minlength=len(vocabulary))
            slope = np.bincount(bucket, per_word[who], minlength=BUCKETS) / len(at) + decay * model.weights[:, k]
            square[:, k] += slope**2
            model.weights[:, k] -= (rate * slope / np.sqrt(square[:, k])).astype(np.float32)
        slope = (pairs - seen_pairs) / len(at) + decay * model.transitions
        square_t += slope**2
        model.transitions -= rate * slope / np.sqrt(square_t)
    return model


def training_sample(docs: DataFrame, trainable: Column, per_language: int = 150, most_languages: int = 64, longest: int = 20_000) -> tuple[list[str], list[str]]:
    """The texts and languages of the bounded sample; ``trainable`` says which labelled rows may be used."""
    labelled = docs.where(trainable & F.col("lang").isNotNull() & (F.length("text") <= longest))
    mark = F.xxhash64(F.lit("fit"), "doc_id", "text")
    ranked = labelled.select("lang", mark.alias("mark")).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("mark")))
    picked = ranked.where(F.col("n") <= per_language).select("lang", "mark").distinct().limit(per_language * most_languages + 1)
    marks = [r["mark"] for r in picked.collect()]
    if len(marks) > per_language * most_languages:
        raise ValueError(f"more than {most_languages} languages")
    rows = labelled.where(mark.isin(marks)).select("lang", "text", mark.alias("mark")).dropDuplicates(["lang", "mark"]).collect() if marks else []
    rows.sort(key=lambda r: (r["lang"], r["mark"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def _label(model: LanguageModel | None):
    """A function of a pandas series of texts: lang_pred, score and n_words of each."""
    languages = [] if model is None else model.languages


    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        table = np.zeros((0, len(languages)), dtype=np.float32)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.tolist()]
            names, scores, counts = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
            for begin, end in slices(texts) if languages else ():
                split = [words_of(t) for t in texts[begin:end]]
                if len(known) > REMEMBERED:
                    known, table = {}, table[:0]
                new = list(set().union(*split) - known.keys())
                if new:
                    known.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                    table = np.concatenate([table, model.word_scores(new)])
                sizes = np.array([len(w) for w in split])
                counts[begin:end] = sizes
                full = np.flatnonzero(sizes)
                if not len(full):
                    continue
                at = np.fromiter((known[w] for words in split for w in words), dtype=np.int64, count=int(sizes.sum()))
                lengths = np.array([n for size in sizes[full].tolist() for n in chain_lengths(size)])
                marginals, _ = forward_backward(table[at].astype(np.float64), lengths, model.transitions)
                ends = np.cumsum(sizes[full])
                means = np.add.reduceat(marginals, ends - sizes[full], axis=0) / sizes[full][:, None]
                best = means.argmax(axis=1)
                for k, b, s in zip(full.tolist(), best.tolist(), means.max(axis=1).tolist(), strict=True):
                    names[begin + k], scores[begin + k] = languages[b], min(1.0, s)
            yield pd.DataFrame({"lang_pred": names, "score": scores, "n_words": counts})

    return F.pandas_udf(label, "lang_pred string, score double, n_words long")


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score and n_words of every row. One pass without a shuffle."""
    found = docs.select("doc_id", _label(model)("text").alias("found"))
    return found.select("doc_id", "found.*")


def keep_known(docs: DataFrame, model: LanguageModel | None, least_score: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with at least that score."""
    found = _label(model)("text")
    return docs.where((found["lang_pred"] != UND) & (found["score"] >= least_score))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame) -> LanguageModel | None:
    texts, langs = training_sample(docs, ~held_out())
    return fit(texts, langs) if texts else None


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, after fitting on rows that aren't held out."""
    found = predict(docs, fit_on(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words")
