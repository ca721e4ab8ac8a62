"""Words, tokens, wavelet matrices, packing cuts and page extraction without Spark."""

import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from tilequarry.llm import html, packing, wavelet  # noqa: E402
from tilequarry.llm.tokens import Encoder  # noqa: E402
from tilequarry.llm.words import NOT_ALNUM, SPACE, find_words, sliding_min, windows  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = list("ab.'s1 é\n\t\x0b  \x1c　​\x85\xa0!日") + ["the", " ", "  ", ", ", "<|endoftext|>"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def test_words_are_those_of_bytes_split():
    r = random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(500)] + [None, ""]
    got = [w.data[a:b].tobytes() for w in find_words(pa.array(texts), slice_bytes=200) for a, b in zip(w.starts, w.ends)]
    counts = np.concatenate([w.counts for w in find_words(pa.array(texts), slice_bytes=200)])
    assert got == [x for t in texts for x in (t or "").encode().split()]
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    texts = ["a bb ccc", "ccc a", "x" * 5000 + " bb", "BB"]
    seen = {}
    for w in find_words(pa.array(texts), SPACE, lower=True, slice_bytes=10):
        for a, b, h in zip(w.starts, w.ends, w.hashes()):
            assert seen.setdefault(w.data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingles_and_windows():
    (w,) = find_words(pa.array(["a b c d e f", "a b", "", "b c d e f"]))
    s, first = w.shingles(5)
    assert np.diff(first).tolist() == [2, 1, 0, 1] and s[1] == s[3] and s[0] != s[1]
    h = w.hashes()
    assert windows(h[:6], 5)[1] == windows(h[8:13], 5)[0] and len(windows(h[:3], 5)) == 0
    x = np.random.default_rng(1).integers(0, 99, 50)
    for n in (1, 2, 3, 17):
        assert sliding_min(x, n).tolist() == [x[i : i + n].min() for i in range(51 - n)]


def test_separator_classes():
    (w,) = find_words(pa.array(["MIT-License, ä9\x7fz"]), NOT_ALNUM, lower=True)
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)] == ["mit", "license", "ä9", "z"]


def test_ids_are_those_of_whole_texts(encoder):
    r = random.Random(2)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(3000)] + [None, "", "x" * 300 + " y", "foo, bar. foo"]
    assert encoder.encode_all(texts) == [encoder.whole(t or "") for t in texts]


def test_cache_generations(encoder, monkeypatch):
    from tilequarry.llm import tokens

    monkeypatch.setattr(tokens, "KEEP", 40)
    e, r = Encoder(PATH), random.Random(3)
    for _ in range(30):
        texts = [" ".join(str(r.randint(0, 60)) for _ in range(20))]
        assert e.encode_all(texts) == [encoder.whole(texts[0])]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=300))
def test_wavelet_matrix(values):
    ids = np.array(values, "<u4") * 1000
    shard, doc_ids, nulls, lengths = wavelet.from_file(wavelet.to_file(ids, [5, None], [len(ids), 0]))
    assert shard.ids().tolist() == ids.tolist() and doc_ids.tolist() == [5, 0] and nulls.tolist() == [0, 1] and lengths.tolist() == [len(ids), 0]
    for i in range(0, len(ids), 7):
        assert shard.access(i) == ids[i]
    for v in {*ids.tolist(), 999}:
        places = np.flatnonzero(ids == v).tolist()
        assert shard.count(v) == len(places) and shard.count(v, 3, 50) == (ids[3:50] == v).sum()
        assert [shard.select(v, k) for k in range(len(places))] == places
        with pytest.raises(IndexError):
            shard.select(v, len(places))


def test_wavelet_matrix_over_blocks():
    ids = np.random.default_rng(4).integers(0, 50257, 30_000).astype("<u4")
    shard = wavelet.from_file(wavelet.to_file(ids, [1], [len(ids)]))[0]
    assert (shard.ids() == ids).all() and all(shard.access(i) == ids[i] for i in (0, 4095, 4096, 29_999))
    v = int(ids[20_000])
    assert shard.select(v, shard.count(v, 0, 20_000)) == 20_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0, 3, 7])), min_size=1, max_size=12))
def test_cuts_are_optimal(steps):
    places, penalties = [0], [0]
    for d, p in steps:
        places.append(places[-1] + d)
        penalties.append(p)
    _, cost = packing.best_cuts(places, penalties, 10)
    best = [0.0] + [1e9] * len(steps)
    for j in range(1, len(places)):
        best[j] = min(best[i] + 10 - (places[j] - places[i]) + penalties[j] for i in range(j) if places[j] - places[i] <= 10)
    assert cost == best


def test_stream_of_pieces_covers_every_id_once(encoder):
    r = random.Random(5)
    texts = [". ".join(" ".join(r.choice(["the", "cat", "sat", "over"]) for _ in range(r.randint(1, 40))) for _ in range(r.randint(0, 60))) for _ in range(60)] + ["", "x" * 30_000]
    ids = encoder.encode_all(texts)
    for segment in (3000, 1 << 20):
        s = packing._Stream(2, encoder, 256, 1, segment, 32)
        rows = [p for i, b in enumerate(ids) for p in s.add(i, b)] + list(s.flush(True))
        for i, b in enumerate(ids):
            own = sorted((p for p in rows if p[0] == i), key=lambda p: p[1])
            assert b"".join(p[7] for p in own) == b + b"\1\0\0\0" and all(p[4] == len(b) // 4 + 1 and p[3] == zlib.crc32(p[7]) for p in own)
        by: dict = {}
        for p in rows:
            by.setdefault(p[5], []).append((p[6], p[2]))
        for v in by.values():
            at = 0
            for o, n in sorted(v):
                assert o == at
                at += n
            assert at <= 256
        assert sum(len(b) // 4 + 1 for b in ids) / 256 / len(by) > 0.9 and min(by) == 2 << 36


def test_chain_learns_and_decodes():
    chain = html.trained()
    r = random.Random(1234)
    pages = [html.labelled(r) for _ in range(150)]
    hits = sum(a == b for f, y in pages for a, b in zip(chain.labels(f), y))
    assert hits / sum(len(y) for _, y in pages) > 0.96
    assert chain.labels([]) == []


def test_viterbi_is_the_best_of_all_labellings():
    r = random.Random(7)
    chain = html.Chain({"a": 1.3, "b": -0.7, "c": 0.2}, -0.1, np.array([0.3, -0.2]), np.array([[0.5, -0.9], [-0.4, 0.8]]))
    for _ in range(50):
        page = [frozenset(r.sample("abc", r.randint(0, 3))) for _ in range(r.randint(1, 7))]

        def score(y, page=page):
            e = [chain.bias + sum(chain.weights[x] for x in f) for f in page]
            return chain.start[y[0]] + sum(e[k] * y[k] for k in range(len(y))) + sum(chain.step[a][b] for a, b in zip(y, y[1:]))

        every = [[n >> k & 1 for k in range(len(page))] for n in range(1 << len(page))]
        assert score(chain.labels(page)) == pytest.approx(max(map(score, every)))


def test_pages():
    chain = html.trained()
    page = '<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><!-- ad --><div class="ad">Buy this now, please.</div><article><h1>A  title &amp; more</h1><p><b>First text, with &eacute; and\n a <a href=x>link</a> in it.<br><p>Second text here, as long as others are in it.</p><div class="comments"><p>I do not agree with this at all.</p></div></article><aside>Related</aside><footer>&copy; someone</footer></body></html>'
    assert html.main_text(page, chain) == "A title & more\nFirst text, with é and a link in it.\nSecond text here, as long as others are in it."
    assert [html.main_text(x, chain) for x in (None, "", "<p></p>", "<script>x")] == [""] * 4
    deep = "<div>" * 50_000 + "text" + "</span>" * 1000
    assert [b.text for b in html.blocks(deep)] == ["text"]
    assert [b.text for b in html.blocks('<p title="a>b">x</p>y < 3 &lt; 4<!-- <p> -->z')] == ["x", "y < 3 < 4z"]


# A tag as one expression, which says plainly what is a tag but takes quadratic time where quotes or comments stay open.
TAG = re.compile(r"""<(?:!--(?:.*?-->|[^>]*>?)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)""", re.S)
MARKUP = ["<", ">", '"', "'", "/", " ", "a", "=", "!", "<!--", "-->", "<!", "<?", "<p", "</p>", "<svg x=a/>", '<a href="x">', "\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(MARKUP), max_size=30))
def test_tags_are_those_of_the_plain_expression(pieces):
    page, at = "".join(pieces), 0
    tags = html._Tags(page)
    while True:
        m, got = TAG.search(page, at), tags.first(at)
        assert (m is None) == (got is None)
        if m is None:
            return
        assert got == (m.start(), m.end(), m[1] or m[4] or "", m[2] or m[5] or "", m[3] or m[6] or "")
        at = m.end()


@pytest.mark.parametrize("unit", ["<a \"", "<a '", "<!-- >", "<head>", "<a<a", "</script <script", "<svg ===", "<dd></dd>", "<div \"><b '>", "&#1"])
def test_long_broken_pages_take_time_in_proportion(unit):
    start = time.monotonic()
    html.main_text("<dt><ul>" + "<b>" * 20_000 + unit * 60_000, html.trained())
    assert time.monotonic() - start < 30


def test_references_and_slashes_of_any_length():
    told = lambda page: [b.text for b in html.blocks(page)]
    assert told("<p>a&#" + "0" * 9000 + "65;b&#" + "1" * 9000 + ";c</p>") == ["aAb\ufffdc"]
    assert [html._closes_itself(x) for x in (" /", "/", " a=b /", ' a="b"/', " a=b/", " a= b/", " a=/", " a = /", "", " a=b")] == [True] * 4 + [False, False, True, True, False, False]


def test_features_without_weight_change_no_label():
    chain = html.trained()
    r = random.Random(99)
    for _ in range(60):
        page, _ = html.labelled_page(r)
        full = html.features(html.blocks(page))
        assert chain.labels(full) == chain.labels(html.features(html.blocks(page, chain.known)))
