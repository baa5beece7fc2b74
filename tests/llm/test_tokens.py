"""Token store and piece tokenizer against whole-text encoding, a full lattice and round trips."""

import random
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sigframe.llm import elias_fano, piece_tokenizer, token_store
from sigframe.session import shared_path
from tests.llm.conftest import clashing, pairs

SPEC = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
MODEL = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def plain_store(rows, end=1):
    tok, out, start = Tokenizer.from_str(SPEC), [], 0
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(spark, df, by_word=True):
    path = shared_path(spark, "tokens")
    token_store.write_store(df, path, SPEC, by_word=by_word)
    return path, [tuple(r) for r in token_store.read_store(spark, path).orderBy("start").collect()]


def test_store_of_documents(spark, docs):
    _, got = read(spark, docs)
    assert got == plain_store(sorted(pairs(docs)))


def test_store_of_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT", 500)
    df = clashing(odd, "part", "seq", "ids", "segment")
    for by_word in (True, False):
        _, got = read(spark, df, by_word)
        assert [r[0] for r in got] == sorted([r[0] for r in got], key=lambda d: (d is not None, d or 0))
        key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
        want = plain_store(sorted(pairs(odd), key=lambda r: (r[0] is not None, r[0] or 0)))
        assert sorted([(a, 0, c, d) for a, _, c, d in got], key=key) == sorted([(a, 0, c, d) for a, _, c, d in want], key=key)
        assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
    assert read(spark, none)[1] == []


def test_fetch_by_select(spark, docs):
    path, _ = read(spark, docs)
    wanted = docs.filter("doc_id % 17 = 3").select("doc_id")
    got = {r.doc_id: r.ids for r in token_store.fetch(spark, path, wanted).collect()}
    whole = {r.doc_id: r.ids for r in token_store.read_store(spark, path, with_ids=True).collect()}
    assert got and got == {k: whole[k] for k in got} and len(got) == wanted.count()


def test_damaged_segment_is_noticed():
    raw = bytearray(token_store.pack([b"\x01\0\0\0", b"\x02\0\0\0\x03\0\0\0"], False))
    ids, ends = token_store.unpack(bytes(raw))
    assert ids.tolist() == [1, 2, 3] and ends.values().tolist() == [1, 3]
    raw[20] ^= 1
    with pytest.raises(ValueError):
        token_store.unpack(bytes(raw))


@given(st.lists(st.integers(0, 5000), max_size=700), st.integers(0, 100_000))
@settings(max_examples=60, deadline=None)
def test_elias_fano(steps, beyond):
    values = np.cumsum(np.array(steps, np.int64))
    universe = int(values[-1]) + beyond if len(values) else beyond
    raw = elias_fano.encode(values, universe)
    e = elias_fano.EliasFano(raw)
    assert e.values().tolist() == values.tolist() == [e[i] for i in range(len(values))] and e.size == len(raw)
    if len(values) > 100:
        assert len(raw) <= 36 + len(values) * (3 + max(0, np.log2(universe / len(values)))) / 8 + 4 * (len(values) // 256 + 1) + 16


@pytest.fixture(scope="module")
def codec():
    return piece_tokenizer.Codec(MODEL)


def best_score(v, line):
    """The greatest sum of scores, over the whole lattice."""
    best = [0.0]
    for end in range(1, len(line) + 1):
        options = [best[a] + v.score[line[a:end]] for a in range(max(0, end - v.longest), end) if line[a:end] in v.score]
        best.append(max(options + ([] if line[end - 1] in v.score else [best[end - 1] + v.unknown])))
    return best[-1]


def score_of(v, ids):
    total, k = 0.0, 0
    names = {i: p for p, i in v.ids.items()}
    while k < len(ids):
        if ids[k] in names:
            total, k = total + v.score[names[ids[k]]], k + 1
        else:  # the bytes of one character
            lead = v.raw[ids[k]][0]
            total, k = total + v.unknown, k + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
    return total


@given(st.text(alphabet=st.sampled_from("abcdeht in\n.,!éß日😀"), max_size=400))
@settings(max_examples=80, deadline=None)
def test_streaming_viterbi_is_the_best_path(codec, text):
    ids = codec.encode(text).tolist()
    assert codec.decode(ids) == text
    if text:
        assert score_of(codec.v, ids) == pytest.approx(best_score(codec.v, "▁" + text.replace(" ", "▁")))


def test_window_is_bounded_and_chunks_do_not_matter(codec):
    r = random.Random(1)
    text = "".join(r.choices("etaoinshr", k=5000))
    v, got, widest = piece_tokenizer.StreamingViterbi(codec.v), [], 0
    for k in range(0, len(text), 7):
        got += v.feed(text[k : k + 7])
        widest = max(widest, len(v.text))
    got += v.finish()
    once = piece_tokenizer.StreamingViterbi(codec.v)
    assert got == once.feed(text) + once.finish() and widest < 200


def test_runs_of_one_character_take_linear_time(codec):
    v = codec.v
    signs = sorted({p[0] for p in v.ids if len(p) > 1 and p == p[0] * len(p)})
    assert {"-", "#", "=", "▁"} <= set(signs)
    for sign in signs:
        for n in (997, 5000):
            path = piece_tokenizer.StreamingViterbi(v)
            ids = path.feed(sign * n) + path.finish()
            assert "".join(v.raw[i].decode().replace(" ", "▁") for i in ids) == sign * n
            assert score_of(v, ids) == pytest.approx(best_score(v, sign * n))
    began = time.time()
    ids = codec.encode("-" * 1_000_000)
    assert time.time() - began < 30 and codec.decode(ids.tolist()) == "-" * 1_000_000


def test_ordinary_text_keeps_a_short_window(codec):
    r = random.Random(3)
    text = "".join(r.choices("etaoinshr-=", weights=[9] * 9 + [1, 1], k=60_000))
    path, widest, ids = piece_tokenizer.StreamingViterbi(codec.v), 0, []
    for k in range(0, len(text), 500):
        ids += path.feed(text[k : k + 500])
        widest = max(widest, len(path.back))
    assert widest < 2000 and score_of(codec.v, ids + path.finish()) == pytest.approx(best_score(codec.v, text))


def test_documents_round_trip(spark, docs, odd, none):
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for df in (docs, clashing(odd, "ids", "n_ids", "exact")):
        rows = piece_tokenizer.encode(df, MODEL)
        assert rows.count() == df.count() and rows.filter("not exact or n_ids <> size(ids)").isEmpty()
        assert rows.filter("ids is null").count() == df.filter("text is null").count()
        back = piece_tokenizer.decode(rows, MODEL)
        text = lambda d: sorted((str(r.doc_id), r.text is None, r.text or "") for r in d.select("doc_id", "text").collect())
        assert text(back) == text(df)
    for r in piece_tokenizer.encode(docs, MODEL).join(docs, "doc_id").select("ids", "text").collect():
        assert sp.decode(r.ids) == r.text
    assert piece_tokenizer.encode(none, MODEL).isEmpty()
