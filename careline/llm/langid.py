"""Language of documents by a linear-chain conditional random field over their words.

A word is a run of letters, in lower case. Its features are hashed: all runs of one to four
characters of ``^word$`` (those with ``^`` or ``$`` are affixes, the others n-grams) and the
word itself (lexicon). Scores of languages per word and of transitions between neighbours are
learned together: the gradient of the likelihood comes from forward-backward marginals.
Besides whole documents, training sees passages of different languages put together from the
same documents, so that transitions learn what a switch inside a text costs.

A document is labelled word by word with the forward-backward marginals; its language is the
one with the largest expected share of words, and the score is that share.

Forward-backward runs over a block of documents as one chain, with a fresh start at each
document. The chain is cut into as many pieces as a piece is long: transfer matrices of all pieces are
multiplied side by side, messages pass over the pieces, and the pieces are filled in side by
side. The result is that of one pass along the chain.

Training takes a bounded sample (``PER_LANGUAGE`` rows of each of the ``LANGUAGES`` most frequent languages, of any
length) from rows that are not held out and have a letter, on the driver; the model is bounded, too. Of a text longer than
``ROW_CHARS`` it sees the letters of four spans, one from anywhere in each quarter (words may be cut at
their ends). Prediction reads whole texts, in blocks.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any
labelled row everything is ``und``, and ``with_known_language`` returns all rows as they are; a null language is not learned; repeated rows are
predicted each; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careline.llm.common import appended
from careline.llm.pretokens import LETTER, blocks, classes, distinct, multipliers
from careline.llm.splits import held_out, sampled, spans

#: Rows of each language that are learned from, and the characters of each that are seen.
PER_LANGUAGE, ROW_CHARS = 100, 20_000
#: Languages that are learned, those with the most rows.
LANGUAGES = 64
#: Characters of documents that are labelled as one chain; in a longer text the chain begins anew after them.
LABELLED = 300_000
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
ROUNDS, RATE, DECAY = 20, 0.2, 1e-5
UNKNOWN = "und"


@dataclass
class Words:
    """Distinct words of some texts: their characters with marks, and codes of all words."""

    chars: np.ndarray  # ^word$ of each distinct word, one after another
    length: np.ndarray  # with marks
    codes: np.ndarray
    text_of: np.ndarray


def words_of(parts: list[tuple[int, str]]) -> Words | None:
    """Words of (number of the text, text) parts; None if there are none."""
    lowered = [p.lower() for _, p in parts]
    chars = np.frombuffer("\n".join(lowered).encode("utf-32-le"), np.uint32)
    letter = classes()[chars] == LETTER
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return None
    length = end - start
    codes, rep = distinct(chars, start, length)
    sizes = np.array([len(p) + 1 for p in lowered])
    which = np.searchsorted(np.cumsum(sizes), start, "right")
    n = length[rep]
    marked = n + 2
    first = np.cumsum(marked) - marked
    out = np.full(int(marked.sum()), ord("^"), np.uint32)
    out[first + marked - 1] = ord("$")
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(first + 1, n) + inside] = chars[np.repeat(start[rep], n) + inside]
    return Words(out, marked, codes, np.array([i for i, _ in parts])[which])


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the distinct words: (bucket, word) of each, order by order."""
    chars = words.chars.astype(np.uint64)
    owner = np.repeat(np.arange(len(words.length)), words.length)
    left = np.repeat(np.cumsum(words.length), words.length) - np.arange(len(chars))
    buckets, of = [], []
    hashed = np.zeros(len(chars), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        hashed[:len(chars) - n + 1] = (hashed[:len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15)
                                       + chars[n - 1:] + np.uint64(n))
        if n in ORDERS:
            ok = left >= n
            mixed = hashed[ok] * np.uint64(0xD6E8FEB86659FD93)
            buckets.append((mixed >> np.uint64(64 - 17)).astype(np.int64))
            of.append(owner[ok])
    at = np.arange(len(chars)) - np.repeat(np.cumsum(words.length) - words.length, words.length)
    first = np.cumsum(words.length) - words.length
    whole = np.add.reduceat(chars * multipliers()[at & 8191], first)
    mixed = whole * np.uint64(0xA24BAED4963EE407)
    buckets.append((mixed >> np.uint64(64 - 17)).astype(np.int64))
    of.append(np.arange(len(words.length)))
    return np.concatenate(buckets), np.concatenate(of)


def summed(weights: np.ndarray, buckets: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Scores (n, languages) of the distinct words."""
    return np.stack([np.bincount(of, weights[buckets, k], n) for k in range(weights.shape[1])], 1)


@dataclass
class Chain:
    """Marginals (n, L), and transition counts expected (L, L)."""

    marginals: np.ndarray
    transitions: np.ndarray


def forward_backward(scores: np.ndarray, moves: np.ndarray, start: np.ndarray, fresh: np.ndarray,
                     expected: bool = False) -> Chain:
    """``scores`` (n, L) per word, ``moves`` (L, L) between neighbours, ``start`` (L) for words where
    ``fresh`` holds: there the chain begins anew."""
    n, k = scores.shape
    size = max(1, int(np.ceil(np.sqrt(n))))
    pieces = -(-n // size)
    full = size * pieces
    emit = np.ones((full, k))
    emit[:n] = np.exp(scores - scores.max(1, keepdims=True))
    reset = np.ones(full, bool)
    reset[:n] = fresh
    reset[0] = True
    emit = emit.reshape(pieces, size, k).transpose(1, 0, 2).copy()  # [place in piece, piece, L]
    reset = reset.reshape(pieces, size).T.copy()[:, :, None]
    move, first = np.exp(moves), np.exp(start - start.max())
    first /= first.sum()
    # transfer matrix of each piece
    whole = np.broadcast_to(np.eye(k), (pieces, k, k))
    for c in range(size):
        whole = np.where(reset[c][:, :, None], whole.sum(2, keepdims=True) * first, whole @ move) * emit[c][:, None, :]
        whole = whole / whole.max((1, 2), keepdims=True)
    # messages over the pieces
    enter, leave = np.empty((pieces, k)), np.empty((pieces, k))
    a, b = np.full(k, 1 / k), np.ones(k)
    for s in range(pieces):
        enter[s] = a
        a = a @ whole[s]
        a = a / a.sum()
    for s in range(pieces - 1, -1, -1):
        leave[s] = b
        b = whole[s] @ b
        b = b / b.max()
    # inside the pieces
    alpha, beta = np.empty_like(emit), np.empty_like(emit)
    a = enter
    for c in range(size):
        a = np.where(reset[c], a.sum(1, keepdims=True) * first, a @ move) * emit[c]
        a = a / a.sum(1, keepdims=True)
        alpha[c] = a
    b = leave
    for c in range(size - 1, -1, -1):
        beta[c] = b
        e = emit[c] * b
        b = np.where(reset[c], (e @ first)[:, None], e @ move.T)
        b = b / b.max(1, keepdims=True)
    flat = (lambda x: x.transpose(1, 0, 2).reshape(full, k)[:n])
    alpha, beta, emit = flat(alpha), flat(beta), flat(emit)
    marginals = alpha * beta
    marginals /= marginals.sum(1, keepdims=True)
    counts = np.zeros((k, k))
    if expected and n > 1:
        later = emit[1:] * beta[1:]
        weight = np.einsum("ti,ij,tj->t", alpha[:-1], move, later)
        weight = np.where(fresh[1:], 0, 1 / weight)
        counts = move * (alpha[:-1].T @ (later * weight[:, None]))
    return Chain(marginals, counts)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray


def train(rows: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 5) -> Model:
    """From (text, language) rows."""
    languages = sorted({lang for _, lang in rows})
    k = len(languages)
    model = Model(languages, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k))
    rows = sorted(rows)
    found = words_of([(i, t) for i, (t, _) in enumerate(rows)]) if rows else None
    if found is None or k < 2:
        return model
    gold_of_text = np.array([languages.index(lang) for _, lang in rows])
    codes, texts = found.codes, found.text_of
    # passages of 4 to 24 words, dealt anew, stand behind the documents themselves
    rng = np.random.default_rng(seed)
    cut = np.concatenate(([True], (texts[1:] != texts[:-1]) | (rng.random(len(texts) - 1) < 1 / 12)))
    passage = np.cumsum(cut) - 1
    order = rng.permutation(passage[-1] + 1)
    mixed = np.argsort(order[passage], kind="stable")
    line = np.concatenate((np.arange(len(codes)), mixed))
    codes, gold = codes[line], gold_of_text[texts[line]]
    fresh = np.concatenate((np.concatenate(([True], texts[1:] != texts[:-1])),
                            np.arange(len(mixed)) % 200 == 0))
    buckets, of = features(found)
    n_words = len(found.length)
    wanted = np.zeros((len(codes), k))
    wanted[np.arange(len(codes)), gold] = 1
    pairs = np.zeros((k, k))
    inner = ~fresh[1:]
    np.add.at(pairs, (gold[:-1][inner], gold[1:][inner]), 1)
    parts = [model.weights.astype(np.float64), model.moves, model.start]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for t in range(1, rounds + 1):
        scores = summed(parts[0], buckets, of, n_words)[codes]
        chain = forward_backward(scores, parts[1], parts[2], fresh, expected=True)
        error = chain.marginals - wanted
        by_word = np.stack([np.bincount(codes, error[:, j], n_words) for j in range(k)], 1)
        slopes = [np.stack([np.bincount(buckets, by_word[of, j], BUCKETS) for j in range(k)], 1),
                  chain.transitions - pairs, error[fresh].sum(0)]
        for i, (p, g) in enumerate(zip(parts, slopes)):
            g = g / len(codes) + DECAY * p
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.98 * second[i] + 0.02 * g * g
            p -= RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.98**t)) + 1e-8)
    model.weights, model.moves, model.start = parts[0].astype(np.float32), parts[1], parts[2]
    return model


def label(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    k = len(model.languages)
    shares, n = np.zeros((len(texts), max(k, 1))), np.zeros(len(texts))
    for parts in blocks(texts, LABELLED):
        found = words_of(parts)
        if found is None or not k:
            continue
        scores = summed(model.weights, *features(found), len(found.length))[found.codes]
        fresh = np.concatenate(([True], found.text_of[1:] != found.text_of[:-1]))
        chain = forward_backward(scores, model.moves, model.start, fresh)
        for j in range(k):
            shares[:, j] += np.bincount(found.text_of, chain.marginals[:, j], len(texts))
        n += np.bincount(found.text_of, minlength=len(texts))
    best = shares.argmax(1)
    score = np.where(n > 0, shares[np.arange(len(texts)), best] / np.maximum(n, 1), 0.0)
    return [model.languages[j] if m else UNKNOWN for j, m in zip(best, n)], np.clip(score, 0, 1)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model:
    """A model of the rows that are not held out and have a language."""
    text = F.col(text_col)
    rows = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()
                       & text.rlike(r"\p{L}"))
    some, _ = sampled(rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
                                  text.alias("text")), "id", "lang", per_language, LANGUAGES)
    # what is no letter only separates words, so a span is never without any
    letters = F.when(F.length("text") <= ROW_CHARS, F.col("text")).otherwise(
        F.trim(F.regexp_replace("text", r"[^\p{L}]+", " ")))
    seen = some.select("id", "lang", letters.alias("text")).select(
        "lang", spans(F.col("text"), F.col("id"), ROW_CHARS).alias("text"))
    return train([(r["text"], r["lang"]) for r in seen.collect()])


def with_language(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None,
                  names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (by default all) with the language and its score, named by ``names``; they
    replace columns of those names."""
    return appended(docs, text_col, f"`{names[0]}` string, `{names[1]}` double",
                    lambda texts: label(texts, model), keep)


def with_known_language(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language can be told, that is whose text has a letter, with their columns; a null
    language becomes the one found. All rows as they are, if the model knows no language."""
    if not model.languages:
        return docs
    free = "_"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    found = with_language(docs, model, text_col, names=(f"{free}lang", f"{free}score"))
    told = F.coalesce(F.col(f"`{lang_col}`"), F.col(f"{free}lang")).alias(lang_col)
    return found.filter(F.col(f"{free}lang") != UNKNOWN).select(
        [told if c == lang_col else F.col(f"`{c}`") for c in docs.columns])
