import os
import random

import numpy as np
import pytest

from loomwork.llm import sentencepiece as sp
from loomwork.llm.queries import PIECES

pytestmark = pytest.mark.skipif(not os.path.exists(PIECES), reason="no vocabulary file")


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)


def encode(texts):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    ids, n = sp.Batch(sp.Encoder(sp.load_model(PIECES))).encode(np.frombuffer(b"".join(raw), np.uint8), off)
    cut = np.concatenate([[0], np.cumsum(n)])
    return [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]


def test_equals_the_library(library):
    r = random.Random(7)
    alphabet = "abcdefghijklmnopqrstuvwxyz   éüñ日▁🦄..,\n\x001('\"-_/\\<>"
    texts = ["", " ", "  ", "▁", "<s></s><unk><0x0A>", "日本", " 日", "x" * 3000, " " * 200 + "the" + " " * 99]
    texts += [" " * n + s for n in range(36) for s in ("", "a", "日")]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(800)]
    texts += ["".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(200)]
    assert encode(texts) == library.encode(texts)


def test_pair_decisions_equal_merging():
    m = sp.load_model(PIECES)
    e = sp.Encoder(m)
    names = [b.decode() for b in m.raw]
    order = {n: i for i, n in enumerate(names) if i >= m.chars and n}
    r = random.Random(1)
    pairs = [(a, b) for a, b in ((r.randrange(m.chars, 4000), r.randrange(m.chars, 4000)) for _ in range(300)) if names[a] and names[b] and not names[b].startswith(sp.MARK)]
    got = e.decide(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert got.tolist() == [sp._merge(list(names[a] + names[b]), order)[0] == [names[a], names[b]] for a, b in pairs]


def test_odd_rows_and_decoding(spark, odd, none, library):
    out = sp.encode_pieces(odd.withColumn("ids", odd.lang), PIECES, keep=["doc_id", "lang", "ids", "text"])
    assert out.columns == ["doc_id", "lang", "text", "ids", "n_pieces", "round_trip"]
    rows = out.collect()
    assert len(rows) == 12 and all(r.round_trip and r["ids"] == library.encode(r.text or "") and r.n_pieces == len(r["ids"]) for r in rows)
    back = sp.decode_pieces(out.select("doc_id", "ids"), PIECES).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in rows)
    assert sp.encode_pieces(none, PIECES).count() == 0
    assert sp.decode_pieces(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PIECES).first().text is None


def test_round_trip_of_space_marks(spark):
    texts = ["plain text", "a▁b", "▁", "  two  ", ""]
    rows = sp.encode_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PIECES).collect()
    assert {r.doc_id: r.round_trip for r in rows} == {0: True, 1: False, 2: False, 3: True, 4: True}


def test_words_that_come_again_are_not_matched_again(library, monkeypatch):
    """Matching every batch's words anew was most of the time of stage 5; kept words are bounded and change no result."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdé日") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) + " " * r.randint(0, 2) for _ in range(600)] + ["ab" * 500, "", "  "]
    matched, encode_words = [], sp.Encoder.encode
    monkeypatch.setattr(sp.Encoder, "encode", lambda self, text, first, end: matched.append(len(first)) or encode_words(self, text, first, end))

    def run(kept_words, kept_pieces, step):
        monkeypatch.setattr(sp, "KEPT_WORDS", kept_words)
        monkeypatch.setattr(sp, "KEPT_PIECES", kept_pieces)
        batch = sp._batch(sp.load_model(PIECES))
        for a in range(0, len(texts), step):
            raw = [t.encode() for t in texts[a : a + step]]
            ids, n = batch.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            cut = np.cumsum([0, *n])
            assert [ids[x:y].tolist() for x, y in zip(cut, cut[1:])] == library.encode(texts[a : a + step])
            assert len(batch.words) <= kept_words and len(batch.flat) <= kept_pieces and (batch.words[1:] > batch.words[:-1]).all()

    monkeypatch.setattr(sp, "_BATCH", {})
    run(1 << 20, 5 << 20, 100)
    once = sum(matched)
    assert once == len({w for t in texts for w in t.split(" ") if w})
    run(1 << 20, 5 << 20, 70)  # another task of the process; the word of 1000 letters isn't kept
    assert sum(matched) <= once + 1
    for kept in ((1500, 1 << 20), (400, 1 << 20), (1 << 20, 3000), (0, 0)):
        monkeypatch.setattr(sp, "_BATCH", {})
        run(*kept, 50)
