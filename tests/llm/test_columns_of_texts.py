"""Whole columns of texts encode as the library encodes each text, and every distinct unit is asked for once."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewake.llm import byte_table, encode
from tidewake.llm.encode import BYTE, Encoder


@pytest.fixture()
def enc():
    import public_tokenizers

    return Encoder(public_tokenizers.path(BYTE), True)


def check(enc, texts, kind=None):
    column = pa.array(texts, kind or pa.string())
    for part in (column, column.slice(1), column.slice(len(texts) // 2, 3)):
        ids, counts = enc.column(part, 7)
        at = 0
        for t, c in zip(part.to_pylist(), counts.tolist()):
            assert ids[at : at + c].tolist() == [*enc.tok.encode(t or "", add_special_tokens=False).ids, 7], repr(t)
            at += c
        assert at == len(ids) and len(counts) == len(part)


ODD = ["a", "Bc", " ", "  ", "\n", "\n\n", "\t", "7", "42", "!", "$$$", "'s", "don't", "_", "é", "ÿß", "×", "÷", "я", "слово", "漢字", "カナ", " ", "　", " ", " ", "\u0085", "\x1c", "\x1f",
       "\x00", "—", "…", "é", "😀", "<|endoftext|>", "supercalifragilisticexpialidocious", "x" * 16, "y" * 17, "﻿", "​", "\r\n", "\x7f"]


def test_odd_texts(enc):
    r = random.Random(4)
    check(enc, [None, "", " ", "\n", None, "a", " a", "a ", "a\x00", "a", "\x00", "", *ODD, None])
    for k in range(6):
        check(enc, ["".join(r.choice(ODD + [" "] * 12 + ["the", "and", "word"]) for _ in range(r.randrange(40))) for _ in range(300)], pa.large_string() if k % 2 else None)
    check(enc, [f"{a} {b}" for a in ODD for b in ODD])


def test_parts_and_full_tables(enc, monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice(ODD + [" "] * 12) for _ in range(200)) for _ in range(60)] + [" ".join(f"w{i % 700} слово{i}" for i in range(3000)), "", "z"]
    for most, bits in ((2_400_000, 22), (300, 9), (10_000, 8)):  # the last one grows
        for name, v in (("PART", 50), ("MOST", most), ("BITS", bits), ("LONG_MOST", 5)):
            monkeypatch.setattr(encode._Units, name, v)
        enc.units = None
        check(enc, texts)


def test_units_of_an_equal_mix_stay_apart(enc, monkeypatch):
    monkeypatch.setattr(byte_table, "mix", lambda low, high: (low & np.uint64(1)) << np.uint64(63))
    check(enc, ["one two three four one two", "five six one", "seven two"])


def test_each_unit_is_asked_for_once(enc, monkeypatch):
    asked, learn = [], encode._Units._learn
    monkeypatch.setattr(encode._Units, "_learn", lambda self, units, whole: (asked.extend(units), learn(self, units, whole))[1])
    for _ in range(3):
        check(enc, ["the cat, the dog and the cat", "the dog saw 42 cats"])
    assert len(asked) == len(set(asked)) == len({b"the", b" cat", b",", b" the", b" dog", b" and", b" saw", b" 42", b" cats"})


def test_re_pair_of_wide_symbols(monkeypatch):
    from tidewake.llm import grammar_store as g

    r = np.random.default_rng(2)
    ids = np.concatenate([r.permutation(50_000), np.tile(np.arange(64), 8)]).astype("<u4")
    for rule in (g.FIRST_RULE, 1 << 29):  # then pairs and positions need more than 64 bits together
        monkeypatch.setattr(g, "FIRST_RULE", rule)
        blob, n = g.pack([1, 2], [ids.tobytes(), ids[::-1].tobytes()])
        s = g.Shard(blob)
        assert n == 2 * len(ids) and s.lengths.max() >= 16
        assert s.document(0).tolist() == ids.tolist() and s.document(1).tolist() == ids[::-1].tolist()


def test_words_of_columns():
    from tidewake.llm.common import Words, words_of

    r, kinds = random.Random(1), ["a", "B", "Z", "[", "@", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x00", "É", "\xa0", "\x1c", "x" * 15, "Ab" * 9, "word"]
    for k in range(200):
        texts = [None if r.random() < 0.1 else "".join(r.choice(kinds) for _ in range(r.randrange(12))) for _ in range(r.randrange(2, 9))]
        for column in (pa.array(texts, pa.large_string() if k % 2 else pa.string()), pa.array(texts, pa.string()).slice(len(texts) // 2)):
            w = Words(column)
            got = [[w.word(i) for i in range(b, b + c)] for b, c in zip(w.begin.tolist(), w.count.tolist())]
            assert got == [[*words_of(t), b"\n"] for t in column.to_pylist()]
            assert w.odd.tolist() == [len(x) > 16 or b"\x00" in x for g in got for x in g]
            assert w.binary(np.arange(len(w.at))).to_pylist() == [x for g in got for x in g]


def test_words_are_counted_and_prepared_by_arrays(spark, monkeypatch):
    """No text or word becomes a Python object but those without keys, and counts are those of a plain loop."""
    import collections

    from tidewake.llm import common, gru_lm

    r = random.Random(3)
    pool = [f"W{i}" for i in range(300)] + ["y" * 17, "a\x00", "a", "é" * 9, "Z", "\x00"]
    rows = [(i, None if i % 17 == 0 else " ".join(r.choice(pool) for _ in range(r.randrange(60)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trained, seen = collections.Counter(), collections.Counter()
    words = {i: [*common.words_of(t), b"\n"] for i, t in rows}
    for i, t in rows:
        seen.update(words[i])
        trained.update(words[i] if zlib.crc32(str(i).encode()) % 5 != 1 else [])
    counts = {bytes(x["word"]): (x["trained"], x["seen"]) for x in gru_lm.word_counts(docs).collect()}
    assert counts == {w: (trained[w], seen[w]) for w in seen}
    known = sorted(trained, key=lambda w: (-trained[w], w))
    for some in (known[:40] + [b"a\x00", b"y" * 17], [w for w in known if w != b"\n"][:3]):
        scorer = gru_lm.Scorer([(w, trained[w]) for w in some], sum(trained.values()), len(trained), words=30)
        for x in gru_lm.prepared(docs, spark.sparkContext.broadcast(scorer)).collect():
            own, rare = words[x["doc_id"]], collections.Counter()
            for w, n in zip(x["rare"], x["times"]):
                rare[bytes(w)] += n
            assert x["n_tokens"] == len(own) and x["n_known"] == sum(w in some for w in own) and rare == collections.Counter(w for w in own if w not in some)
            assert np.frombuffer(x["tokens"], "<u2").tolist() == [scorer.place.get(w, len(scorer.place)) for w in own]
    asked, word = [], common.Words.word
    monkeypatch.setattr(common.Words, "word", lambda self, i: (asked.append(word(self, i)), asked[-1])[1])
    taken = {}
    monkeypatch.setattr(gru_lm, "arrow_map", lambda df, fn, *a, **k: taken.update(fn=fn) or docs.selectExpr("text word", "doc_id trained", "doc_id seen"))
    gru_lm.word_counts(docs)
    list(taken["fn"]([pa.RecordBatch.from_arrays([pa.array([True]), pa.array(["one two two " + "z" * 20])], names=["train", "text"])]))
    assert asked == [b"z" * 20]
