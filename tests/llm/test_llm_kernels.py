"""Kernels of the corpus operators against brute force, without Spark."""

import base64
import hashlib
import io
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from refrain.llm import byte_bpe, html_extract, lsh_forest, multi_index, quality, toxicity, warc, winnowing

RANKS = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdehinorst é漢\n'", min_size=1, max_size=600))
def test_merges_equal_tiktoken(word):
    assert byte_bpe.merge_word(word.encode(), RANKS) == TIKTOKEN.encode_ordinary(word)


def test_long_words_merge_alike_in_both_ways():
    word = "".join(random.Random(5).choice("theanoi") for _ in range(900)).encode()
    assert byte_bpe._merge_long(word, RANKS) == byte_bpe._merge_short(word, RANKS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5).map(float), max_size=40))
def test_segments_are_the_maximal_ones(scores):
    def brute(lo, hi):  # the definition: best segment (shortest, leftmost), then left and right of it
        best = None
        for i in range(lo, hi):
            for j in range(i, hi):
                s = sum(scores[i : j + 1])
                if s > 0 and (best is None or s > best[2] or s == best[2] and j - i < best[1] - best[0]):
                    best = (i, j, s)
        return [] if best is None else brute(lo, best[0]) + [best] + brute(best[1] + 1, hi)

    found = toxicity.segments(np.array(scores, float))
    assert sum(s for *_, s in found) == sum(s for *_, s in brute(0, len(scores)))
    assert max([s for *_, s in found], default=0) == max([s for *_, s in brute(0, len(scores))], default=0)
    assert all(abs(sum(scores[a : b + 1]) - s) < 1e-9 for a, b, s in found)
    assert all(x[1] < y[0] for x, y in zip(found, found[1:]))


def test_many_falling_candidates_are_scanned_in_linear_time():
    scores = np.tile([1.0, -2.0], 100_000)
    assert len(toxicity.segments(scores)) == 100_000


def brute_winnow(text, k, window):
    points = np.array([ord(c) for c in text], np.uint32)
    hashes = []
    for i in range(len(points) - k + 1):
        h = 0
        for c in points[i : i + k]:
            h = (h * winnowing._BASE + int(c) + 1) % 2**64
        hashes.append(h)
    hashes = (winnowing._mixed(np.array(hashes, np.uint64)) & ~winnowing._LOW).tolist()
    out = []
    for i in range(max(1, len(hashes) - window + 1)):
        some = hashes[i : i + window]
        at = i + max(j for j, h in enumerate(some) if h == min(some))
        if not out or out[-1][1] != at:
            out.append((min(some), at))
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é漢", min_size=1, max_size=260), st.integers(1, 20), st.integers(1, 30))
def test_winnowing_equals_brute_force(text, k, window):
    hashes, places = winnowing.winnow(text, k, window)
    if len(text) >= k:
        assert list(zip(hashes.tolist(), places.tolist())) == brute_winnow(text, k, window)
    else:
        assert len(hashes) == 1


def test_winnowing_slices_do_not_show(monkeypatch):
    text = "".join(random.Random(1).choice("abc ") for _ in range(5000))
    whole = winnowing.winnow(text)
    monkeypatch.setattr(winnowing, "SLICE", 64)
    assert all((a == b).all() for a, b in zip(whole, winnowing.winnow(text)))


def test_shared_passages_share_a_hash():
    draw = random.Random(2)
    noise = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        passage = noise(winnowing.K + winnowing.WINDOW - 1)
        a, b = (winnowing.winnow(noise(300) + passage + noise(200))[0] for _ in range(2))
        assert set(a) & set(b)


def test_short_texts_are_winnowed_like_long_ones():
    draw = random.Random(5)
    for n in (*range(95, 106), 30, 12, 10):
        text = "".join(draw.choice("abcdefgh ") for _ in range(n))
        chosen = winnowing.winnow(text)[0]
        assert len(chosen) <= max(1, (n - winnowing.K + 1) / 2)
        if n > 90:
            assert winnowing.likeness(chosen, winnowing.winnow(text[:-1])[0]) > 0.7


@pytest.mark.parametrize("text, size", [("", 0), (" \t\n", 0), ("a b", 1), ("A b c", 1), ("a b c d", 2), ("a b c a b c", 3)])
def test_shingle_sets(text, size):
    assert len(lsh_forest.shingles(text, 3, lsh_forest.Words())) == size


def test_shingles_lower_ascii_only_and_split_at_ascii_space():
    memo = lsh_forest.Words()
    same = lambda a, b: np.array_equal(lsh_forest.shingles(a, 3, memo), lsh_forest.shingles(b, 3, memo))
    assert same("The Cat\x0bsat", "the cat sat") and not same("É b c", "é b c") and not same("a\xa0b c d", "a b c d")


def test_traversal_visits_cells_in_order_up_to_the_limit():
    draw = np.random.default_rng(3)
    a, b = draw.random(7), draw.random(9)
    cells = multi_index.traverse(a, b, 0.9)
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and len(set(cells)) == len(cells)
    assert len(cells) == (a[:, None] + b[None, :] <= 0.9).sum()


def test_full_recall_radius_loses_no_cell():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    halves = [multi_index.Half(multi_index.kmeans(p, 6, 1)) for p in (x[:, :4], x[:, 4:])]
    (o1, t1), (o2, t2) = halves[0].look(x[:, :4]), halves[1].look(x[:, 4:])
    for i in range(len(x)):
        d2 = ((x - x[i]) ** 2).sum(1)
        assert (t1[i][o1] + t2[i][o2] <= d2 + 1e-9).all()


def test_a_chain_joins_what_the_links_join():
    ids = np.array([9, 4, 7, 1, 3])
    pairs = {tuple(sorted(p)) for p in multi_index._chain(ids, np.array([0, 1]), np.array([2, 2])).tolist()}
    assert pairs == {(4, 7), (7, 9)}


def test_records_can_be_read_back_from_single_frames():
    pages = [(i, f"http://x.example/{i}", (f"<p>page {i} " + "some text " * 50).encode()) for i in range(60)]
    raw = [warc.record(i, u, p, len(p), hashlib.sha1(p).hexdigest()) for i, u, p in pages]
    raw.append(warc.record(None, None, None, 700, hashlib.sha1(b"x").hexdigest(), refers_to=3))
    words = warc.train_dictionary(raw)
    assert words is not None
    frames = b"".join(zstandard.ZstdCompressor(dict_data=words).compress(r) for r in raw)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(frames), read_across_frames=True))
    back = list(warc.records_of(stream))
    assert len(back) == 61 and back[5][1].endswith(pages[5][2])
    fields = back[-1][0]
    assert fields["warc-type"] == "revisit" and warc._row_id(fields["warc-record-id"]) is None and warc._row_id(fields["warc-refers-to"]) == "3"
    assert base64.b32decode(fields["warc-payload-digest"][5:]).hex() == hashlib.sha1(b"x").hexdigest()
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(raw[0][:-9])))
    assert warc.train_dictionary(raw[:2]) is None


LONG = "This paragraph has commas, words, and enough of both, to look like the text of an article on a page."


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<p></p><script>x</script>", ""),
        ("just text", "just text"),
        ("<p>one<p>two", "one\n\ntwo"),
        (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}<br>more\n  text</article><footer>f</footer>", f"T & U\n\n{LONG} more text"),
        (f"<div class='sidebar'><p>{LONG}</p></div><div id=content><p>{LONG}</p></div><div id='comments'><p>{LONG}</p></div>", LONG),
        (f"<main><div class=ad>buy</div><p>{LONG}</p><form><p>{LONG}</p></form><ul><li>a<li>b</ul></main>", f"{LONG}\n\na\n\nb"),
        (f"<article><header><h1>T</h1></header><section><p>{LONG}</section><section><p>{LONG}</section></article>", f"T\n\n{LONG}\n\n{LONG}"),
        (f"<article><p>{LONG}</p><aside><p>{LONG}</p></aside><p style='display: none'>{LONG}</p></article>", LONG),
        (f"<article><p>{LONG}</p><p>a &lt;b&gt; &#233;&nbsp;c</p></article><!-- <p>{LONG}</p> -->", f"{LONG}\n\na <b> é c"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


OTHER = "<div class=menu><p>Not an article, just a menu</p></div>"


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<div class='content has-sidebar'>{OTHER}<p>{LONG}</p><div class=sidebar><p>See also</p></div></div>", LONG),
        (f"<div id=page class=no-sidebar><article><p>{LONG}</p></article><div class=related><article><p>Short, one</p></article></div></div>", LONG),
        (f"<div class=nav-open><div class='overlay-root'><main><h1>T</h1><p>{LONG}</p></main></div></div>", f"T\n\n{LONG}"),
        (f"<article><div class='side-image'><p>{LONG}</p></div></article>", LONG),
        (f"<form action=x><input name=v><div id=page><nav><a href=x>Home</a></nav><p>{LONG}</p><select><option>x</select></div></form>", LONG),
        (f"<article><p>{LONG}</p><h2 id=related-work>Related work</h2><p class=notice-text>{LONG}</p></article>", f"{LONG}\n\nRelated work\n\n{LONG}"),
        (f"<article><header class=entry-header><h1>T</h1></header><p>{LONG}</p></article>", f"T\n\n{LONG}"),
        (f"<article><p>{LONG}</p><p>{LONG}</p><section id=discussion><h2>Discussion</h2><p>{LONG}</p></section></article>", f"{LONG}\n\n{LONG}\n\nDiscussion\n\n{LONG}"),
        (f"<article><p>{LONG}</p><p>{LONG}</p><section id=comments><h2>Comments</h2><p>{LONG}</p></section></article>", f"{LONG}\n\n{LONG}"),
        (f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math></p></article>", f"{LONG} x=1"),
        ("<div class=widget>short</div>", "short"),
        (f"<div class=post><p>{LONG}</p></div><div id=comments><p>{LONG}</p><p>{LONG}</p></div>", LONG),
        (f"<div class=post><p>{LONG}</p></div><div class=related><article><p>Short, one</p></article></div>", LONG),
        (f"<div class=sidebar style='display:none'><p>{LONG}</p></div>", ""),
    ],
)
def test_wrappers_of_articles_are_read(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        (f'<body><p class="x"">{LONG}</p><p>{LONG}</p>', f"{LONG}\n\n{LONG}"),
        (f"<body><p>See <a href=/it's/here>this</a></p><p>{LONG}</p><p>{LONG}</p>", f"See this\n\n{LONG}\n\n{LONG}"),
        (f'<body><p title="5" tall">{LONG}</p><p>{LONG}</p>', f"{LONG}\n\n{LONG}"),
        (f"<body><p class = \"a > b\" id='c > d'>{LONG}</p>", LONG),
        (f"<body><p =x / data-y=\"1\"z='2'>{LONG}</p>", LONG),
        (f"<body><div class=sidebar\"><p>{LONG}</p></div><div class='content'><p>{LONG} {LONG}</p></div>", f"{LONG} {LONG}"),
        ("<p>a</p><p title='never closed>b</p>", "a"),
        ("<body><div>" + f"<div><div><div><p>{LONG}</p></div></div></div>" * 4 + "</div><div class=footer>f</div></body>", "\n\n".join([LONG] * 4)),
        ("<body><div>" + f"<div><h3>H</h3><div><h4>S</h4><div><p>{LONG}</p></div></div></div>" * 4 + "</div></body>", "\n\n".join(["H", "S", LONG] * 4)),
        ("<body><div>" + "<div>" * 50 + f"<p>{LONG}</p>" + "</div>" * 50 + f"<p>{LONG}</p></div></body>", f"{LONG}\n\n{LONG}"),
        (f"<article><div class='post-header'><h1>T</h1></div><p>{LONG}</p></article>", f"T\n\n{LONG}"),
        (f"<article><div class='site-header'><h1>T</h1></div><p>{LONG}</p></article>", LONG),
        (f"<div class='page-header'><p>{LONG}</p></div><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
    ],
)
def test_odd_tags_and_deep_wrappers(html, text):
    assert html_extract.main_text(html) == text


def test_odd_tags_take_linear_time():
    for html in ("<a " + 'x=" ' * 200_000, "<a " + "= / ' " * 100_000, "<p " + "x" * 500_000, "<" * 200_000, "<a b" * 100_000):
        html_extract.main_text(html + f"><p>{LONG}</p>")


def test_broken_and_deep_pages_are_read():
    assert html_extract.main_text("<div>" * 20_000 + "x") == "x"
    assert html_extract.main_text("<p <b></p></div></p>a") in ("", "a")
    assert len(html_extract.main_text("<div><p>some text here, " * 3000)) > 40_000


def test_ftrl_learns_and_an_empty_text_has_the_bias():
    memo = quality.WordForms()
    rows = [(*quality.sparse_row(quality.hashed_ngrams(t.encode(), memo)), y) for t, y in [("good words here", 1), ("BAD!!! words### here", 0)] * 50]
    w = quality.train_ftrl(rows)
    score = lambda t: quality.score_of(quality.hashed_ngrams(t.encode(), memo), w)
    assert score("good words here") > 0.7 > 0.3 > score("BAD!!! words### here")
    assert score("") == pytest.approx(1 / (1 + np.exp(-w[-1])))
