import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from careline.llm import packing, pretokens, tokens
from careline.llm.q_tokens import files

ODD = ["", None, " ", "  a  b\n\nc 's  's it's can't we'll 've  'sup'sup ''s !'s a'S I'm\t 12 34٣ ²x Ⅷ",
       "a<|endoftext|>b <|endoftext|><|endoftext|> c", " x   y　\u0085 z", "é́á 日本語。ですか？ 👍🏽 don’t",
       "x" * 3000, " " * 50 + "q", "ab " * 10, "'", "'s", "'re've'll'", "\r\n\r\n a \r\n", "…'d'm't 1's 's\n's",
       "\x1c\x1d a\x1f b", "﻿hi", "a'", "tail  "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(files()[1])


def fuzz(n):
    rnd = random.Random(3)
    parts = [" ", "  ", "'", "s", "re", "ve", "ll", "d", "\n", "\t", "1", "²", "é", "!", " ", "A", "日", "<|endoftext|>"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(n)]


def count_tokens(texts):
    """Tokens of each text, through the parts of the operator."""
    known, total = {}, [0] * len(texts)
    found = [(i, tokens.packed_counts(codes, n)) for i, codes, n in tokens.document_counts(texts, known)]
    table = pretokens.pieces(*files())
    n_pieces = np.array([table.count(w) for w in known], np.int64)
    for i, packed in found:
        total[i] += tokens.summed(packed, n_pieces) if len(packed) > 2 else 0
    assert {i for i, _ in found} == set(range(len(texts)))
    return total


def test_counts_equal_the_library(library):
    texts = ODD + fuzz(3000)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert count_tokens(texts) == want


@pytest.mark.parametrize("codes, counts", [([], []), ([0], [1]), ([3, 300, 70_000, 20_000_000], [1, 255, 256, 70_000]), ([255, 256, 511], [65_535, 65_536, 1])])
def test_packed_counts(codes, counts):
    n_pieces = np.arange(max(codes, default=0) + 1) % 7
    packed = tokens.packed_counts(np.array(codes, np.int64), np.array(counts, np.int64))
    assert [x.tolist() for x in tokens.unpacked_counts(packed)] == [codes, counts]
    words = ["", "a", "é\0", "日" * 300, " the"] * len(codes)
    assert [w.decode() for w in tokens.unpacked_words(tokens.packed_words(words))] == words
    assert tokens.summed(packed, n_pieces) == sum(n * (c % 7) for c, n in zip(codes, counts))


def test_long_texts_are_cut_where_a_pre_token_starts(library, monkeypatch):
    text = "word, and 'twas  more\n\n of it " * 300 + "x" * 500 + " end"
    monkeypatch.setattr(pretokens.blocks, "__defaults__", (100,))
    assert len(list(pretokens.blocks([text]))) > 50
    assert count_tokens([text, None, text]) == [
        len(library.encode(text, add_special_tokens=False).ids), 0, len(library.encode(text, add_special_tokens=False).ids)]


def test_the_worker_table_starts_anew(library):
    table = pretokens.Pieces(*files(), remembered=2)
    for _ in range(3):
        assert table.ids([" the", "zq", "<|endoftext|>"]) == [[262], library.encode("zq").ids, [50256]]


def test_query_on_odd_and_empty_tables(odd_docs, no_docs, clashing, library):
    found = tokens.token_counts(clashing, *files())
    assert found.columns == [c for c in clashing.columns if c != "n_tokens"] + ["n_tokens"]
    assert sorted(str((r.doc_id, r.n_tokens)) for r in found.collect()) == sorted(
        str((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids))) for r in odd_docs.collect())
    assert tokens.token_counts(no_docs, *files(), keep=["doc_id"]).count() == 0
    small = tokens.token_counts(odd_docs, *files(), keep=["doc_id"], vocabulary=2)  # many segments
    assert sorted(map(str, small.collect())) == sorted(map(str, found.select("doc_id", "n_tokens").collect()))
    assert tokens.token_counts(odd_docs.filter("text IS NULL"), *files(), keep=[]).collect() == [(0,)] * 2


# ---- packing ----------------------------------------------------------------------------

def whole_packing(texts, library):
    full = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    got, used, base = [[] for _ in texts], {}, 0
    for rows, ids in packing.pack(texts, files()):
        rows[4] += base
        base = rows[4].max() + 1
        for (d, s, n, _, q, o), raw in zip(rows.T.tolist(), ids):
            assert len(got[d]) == s and used.get(q, 0) == o
            piece = np.frombuffer(raw, "<u4").tolist()
            got[d] += piece
            assert len(piece) == n
            used[q] = o + n
    assert got == full
    return used, sum(map(len, full))


def test_every_id_is_in_one_piece(library, monkeypatch):
    used, total = whole_packing(["a b. c.", None, "", "x " * 5000, "é. " * 3000, "", "a<|endoftext|>b"], library)
    assert max(used.values()) <= 2048
    monkeypatch.setattr(pretokens.blocks, "__defaults__", (700,))
    whole_packing(["hello there. " * 300, None, "b", "c " * 1500, "", "d"], library)
    whole_packing([None, "", None], library)


def test_little_padding(library):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["some", "words", "here.", "and", "there"]) for _ in range(rnd.randint(1, 900))) + "." for _ in range(300)]
    used, total = whole_packing(texts, library)
    padding = sum(2048 - v for v in used.values() if v & (v - 1))
    assert padding < 0.02 * total


def test_cuts_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        places = np.unique(rng.integers(1, 1400, 60))
        places = np.unique(np.concatenate((places, np.arange(90, 1400, 90), [1400])))
        penalty = rng.integers(0, 30, len(places))
        cuts = packing.best_cuts(places, penalty, 300)
        at, pen = [0, *places.tolist()], [0, *penalty.tolist()]

        def cost(a, b):
            n = b - a
            return (0 if n in packing.POWERS or n == 300 else 300 - n) + packing.SEQUENCE

        best = [0.0]
        for j in range(1, len(at)):
            best.append(min(best[i] + cost(at[i], at[j]) for i in range(j) if at[j] - at[i] <= 300) + pen[j])
        mine = sum(cost(a, b) for a, b in zip([0, *cuts], cuts)) + sum(pen[at.index(c)] for c in cuts)
        assert mine == best[-1]


def test_packed_rows(odd_docs, no_docs, library):
    rows = packing.packed(odd_docs.coalesce(2), files(), with_ids=True).collect()
    assert packing.packed(no_docs, files()).count() == 0
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    lengths = sorted(r.doc_tokens for r in rows if r.start == 0)
    assert lengths == sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd_docs.collect())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048
