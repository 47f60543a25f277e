"""The numpy and plain Python parts, without Spark."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from strandloom.llm import langid, licenses, lm, media, mixing, packing, quality, simhash, warc

TEXT = st.text(st.sampled_from("aB é\n\t\x85 .!#|<1"), max_size=60)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- WARC


@pytest.mark.parametrize("chunk", [1, 13, 1 << 16])
def test_warc_stream(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    r = random.Random(1)
    want = [(i, None if i % 5 == 0 else f"http://x/{i}\r\nX: y", bytes(r.randrange(256) for _ in range(r.choice([0, 1, 99, 700])))) for i in range(30)]
    want.append((30, "u", b"\r\n\r\nWARC/1.1\r\n\r\n"))
    data = b"".join(warc.member(i, u, p, hashlib.sha256(p).hexdigest()) for i, u, p in want)
    got = [(int(x["headers"]["page-id"]), x["payload"], x["payload_bytes"], x["payload_digest"]) for x in warc.read_records(io.BytesIO(data), payload=True)]
    assert got == [(i, p, len(p), hashlib.sha256(p).hexdigest()) for i, _, p in want]


def test_warc_damage_is_found():
    p = b"payload" * 50
    d = hashlib.sha256(p).hexdigest()
    for bad in (warc.member(1, None, p, "0" * 64), warc.member(1, None, p, d)[:-20], zlib.compress(b"x", wbits=31)):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))
    revisit = list(warc.read_records(io.BytesIO(warc.member(2, None, p, d, 1))))[0]
    assert (revisit["payload_bytes"], revisit["payload_digest"], revisit["headers"]["refers-to-page-id"]) == (350, d, "1")


# ---- mixing


@given(st.lists(st.floats(0.01, 100), min_size=1, max_size=8), st.integers(0, 60))
@settings(max_examples=100, deadline=None)
def test_sainte_lague_takes_highest_quotients(weights, seats):
    q = [0] * len(weights)
    for _ in range(seats):
        i = max(range(len(q)), key=lambda k: (weights[k] / (2 * q[k] + 1), -k))
        q[i] += 1
    got = mixing.sainte_lague(np.array(weights), seats)
    assert got.sum() == seats
    assert got.tolist() == q or sorted(np.array(weights) / (2 * got + 1)) == pytest.approx(sorted(np.array(weights) / (2 * np.array(q) + 1)))


def test_targets_reshare_the_excess():
    sizes = np.array([10, 1000, 1000, 0])
    t = mixing.targets(sizes, np.array([5.0, 2, 1, 5]))
    assert t[0] == 30 and t[3] == 0 and t.sum() == pytest.approx(2010) and t[1] == pytest.approx(2 * t[2])
    assert mixing.targets(np.zeros(2, int), np.ones(2)).tolist() == [0, 0]


# ---- quality


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_statistics(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = Counter(zip(words, words[1:], words[2:]))
    cover = {i + j for i, k in enumerate(zip(words, words[1:], words[2:])) if tri[k] > 1 for j in range(3)}
    want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))
    assert quality.statistics(text)[0] == want


def test_trees_learn_and_are_monotone():
    r = np.random.default_rng(0)
    x = r.random((600, len(quality.FEATURES)))
    y = (x[:, 2] + 0.2 * r.random(600) < 0.6).astype(float)
    t = quality.fit(x, y, rounds=30)
    assert ((t.score(x) > 0.5) == (y > 0.5)).mean() > 0.93
    for j, sign in enumerate(quality.MONOTONE):
        if sign:
            a = np.repeat(x[:1], 50, axis=0)
            a[:, j] = np.linspace(0, 1, 50)
            assert (np.diff(t.score(a)) <= 1e-12).all()
    assert quality.fit(x[:0], y[:0]).score(x).min() > 0.99
    assert quality.statistics(None)[0] == (0, 0, 0, 0, 0)


# ---- language identification


def test_gradients():
    r = np.random.default_rng(0)
    net = langid.new_network(["a", "b", "c"], hidden=3)
    for p in net.params():
        p[...] = r.standard_normal(p.shape) * 0.5
    x, y = r.integers(0, 256, (4, 6)), np.array([0, 1, 2, 1])
    _, grads = langid.gradients(net, x, y)
    for p, g in zip(net.params(), grads):
        for i in map(tuple, np.argwhere(np.abs(g) > 1e-3)[:6]):
            old, e = p[i], 1e-2
            p[i] = old + e
            up, _ = langid.gradients(net, x, y)
            p[i] = old - e
            down, _ = langid.gradients(net, x, y)
            p[i] = old
            assert (up - down) / (2 * e) == pytest.approx(g[i], rel=0.05, abs=2e-4)


def test_scorer_counts_every_byte_once():
    net = langid.new_network(["a", "b"])
    s = langid.Scorer(net)
    for n in (1, 63, 64, 65, 200):
        raw = bytes(random.Random(n).randrange(32, 250) for _ in range(n))
        p = s.documents([raw, b"x" * 300])
        assert p.shape == (2, 2) and p.sum(axis=1) == pytest.approx([1, 1], abs=1e-4)
        assert s.documents([raw])[0] == pytest.approx(p[0], abs=1e-5)


# ---- SimHash


@given(TEXT)
@settings(max_examples=100, deadline=None)
def test_fingerprint(text):
    import xxhash

    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


# ---- licences


def test_rules():
    p = re.compile(licenses.pattern(("a", "b"))[0])
    ids = lambda s: "".join(f" {x} " for x in s.split())
    assert p.search(ids("a b")) and p.search(ids("x a y z b")) and not any(map(p.search, map(ids, ("a 1 2 3 b", "b a", "aa b"))))
    assert p.sub(r"\1", ids("x a y z b w")) == ids("x y z w") and licenses.pattern(("a", "b"))[1] == "$1"
    assert licenses.normal("Licensed under CC BY-NC 4.0.") == "licensed under cc by nc 4 0"


# ---- packing


@given(st.lists(st.text(st.sampled_from("ab cé.\n!"), max_size=40), max_size=12), st.sampled_from([8, 16]))
@settings(max_examples=60, deadline=None)
@example(["a       "], 8)
def test_packer_keeps_every_token_once(texts, length):
    p = packing.Packer(_encoder(), length, block=64)
    out = [x for i, t in enumerate(texts) for x in p.add(i, t)] + p.finish()
    seen, spans = {}, {}
    for d, start, n, crc, total, seq, offset in out:
        ids = np.append(_encoder().encode(texts[d]), np.uint32(1)).astype("<u4")
        assert start == seen.get(d, 0) and total == len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes())
        assert offset == spans.get(seq, 0) and n > 0
        seen[d], spans[seq] = start + n, offset + n
        assert spans[seq] <= length
        if seen[d] == total:
            seen[d] = total
    assert sorted(seen) == list(range(len(texts)))
    assert all(seen[i] == len(_encoder().encode(t)) + 1 for i, t in enumerate(texts))


_CACHE = []


def _encoder():
    if not _CACHE:
        _CACHE.append(packing.Encoder())
    return _CACHE[0]


def test_cuts_are_the_cheapest():
    r = random.Random(5)
    for _ in range(30):
        pos = sorted(r.sample(range(1, 60), 25))
        while any(b - a > 16 for a, b in zip([0, *pos], pos)):
            pos = sorted(r.sample(range(1, 60), 25))
        cost = [r.choice([0.0, 1.0, 8.0]) for _ in pos]
        best = {0: 0.0}
        for p, c in zip(pos, cost):
            best[p] = min(best[a] + c + (0 if p - a in (8, 4) else 16 - (p - a)) for a in best if p - a <= 16)
        _, got = packing.plan_cuts(np.array(pos), np.array(cost), 16)
        assert got == pytest.approx([best[p] for p in pos])


@pytest.mark.parametrize("text", ["", "a", "It's 10  times\n\n x ", "<|endoftext|> a <|endoftext|>", "éß 漢字\t!", "x" * 3000])
def test_ids_equal_the_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = t.encode(text, add_special_tokens=False).ids
    assert _encoder().encode(text).tolist() == want
    assert packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(text).tolist() == want


# ---- media


@given(st.binary(max_size=300))
@settings(max_examples=50, deadline=None)
def test_png_round_trip(raw):
    p = media.padded(raw)
    assert len(p) % 64 == 0 and p and p.startswith(raw) and media.decode_png(media.encode_png(p)) == p


def test_png_damage():
    good = media.encode_png(media.padded(b"abc"))
    for bad in (b"x" + good, good[:40] + bytes([good[40] ^ 1]) + good[41:]):
        with pytest.raises(ValueError):
            media.decode_png(bad)


def test_items_stay_in_order():
    items = media.parse('<p>one <b>two</b></p><figure><img src="sha256:d1" alt="A"><figcaption>cap &amp; x</figcaption></figure>three<script>no<img src="z"></script><img src="d2">')
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["alt"], i["caption"]) for i in items] == [(0, "text", "one two", None, None, None), (1, "media", None, "d1", "A", "cap & x"), (2, "text", "three", None, None, None), (3, "media", None, "d2", None, None)]
    assert media.parse(None) == [] and media.parse("") == []


# ---- language model


def test_seating_draws_follow_their_weights():
    s = lm.stirling(0.5, 12)
    d = [[0.0] * 14 for _ in range(14)]
    d[1][1] = 1.0
    for c in range(1, 12):
        for t in range(1, c + 2):
            d[c + 1][t] = d[c][t - 1] + max(0.0, c - 0.5 * t) * d[c][t]
    assert np.exp(s[12, 1:13]) == pytest.approx(d[12][1:13])
    n = 20000
    t = lm.sample_tables(np.full(n, 6), np.full(n, 0.7), np.arange(n) * 7919, 0.5, lm.stirling(0.5), 3)
    w = np.array([d[6][k] * 0.7**k for k in range(1, 7)])
    assert np.bincount(t, minlength=7)[1:7] / n == pytest.approx(w / w.sum(), abs=0.02)
    big = lm.sample_tables(np.array([0, 1, 10**6]), np.full(3, 0.1), np.arange(3), 0.5, lm.stirling(0.5), 1)
    assert big[0] == 0 and big[1] == 1 and 1 <= big[2] <= 10**6


def test_contexts_and_planes():
    assert lm.contexts_of(np.array([-1, 2, -1, -1, 0, -1])).tolist() == [lm.CLASSES, lm.CLASSES, 2, 2, 2, 0]
    k = np.array([0, 5, 70000])
    assert lm.unpack_tokens(lm.pack_tokens(k, np.array([0, 1, 2]))).tolist() == (k * lm.CONTEXTS + [0, 1, 2]).tolist()


def test_parts_have_the_words_of_their_texts(monkeypatch):
    texts = ["", None, "  A b\tÄ c\x0bD ", "\n\n", "x", "A\x1cB \x85 c d   é\x00z", "q  " * 10, None]
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(lm, "PART_BYTES", size)
        got = []
        for words, n in lm.split_words(pa.array(texts)):
            w = iter(words.to_pylist())
            got += [[next(w) for _ in range(k)] for k in n]
            assert next(w, None) is None
        assert got == [lm.tokens(t)[:-1] for t in texts]
    assert list(lm.split_words(pa.array([], pa.string()))) == []


def test_contexts_end_with_their_text():
    c = lm.CLASSES
    assert lm.contexts_of(np.array([-1, 2, -1, 0, -1, -1, -1, 3, 1]), np.array([0, 3, 5])).tolist() == [c, c, 2, c, 0, c, c, c, 3]


def test_numbers_of_pairs_equal_unique():
    a = np.random.default_rng(5).integers(0, 50, 1000).astype(np.uint64) << np.uint64(58)
    for x in (a, a[:1], a[:0]):
        assert all(p.tolist() == q.tolist() for p, q in zip(lm.numbered(x), np.unique(x, return_inverse=True)))
