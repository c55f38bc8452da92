"""Cases in which operators once did less than the whole job."""

import json

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from tessera.llm import bpe, html_text as H, licenses, pieces


ODD = ["", None, "  a  b ", "a \n b\t\t c's  'll ", " Bonjour\u00a0: monde", "\ta b  c", " a\u3000b", "a\u00a0b  c", "a\tb\tc   d", "a b\nc", " ", "a  b", "é à ü", "“a” b", "\u2003 x", "日本 語 \u200b x", "नमस्ते दुनिया", "\U0001f600 \U0001f600 b", "\u180e x", "\ufeff x", "x \x85y"]


def test_pieces_are_cut_where_pre_tokens_end():
    import regex

    wide = r"[\s\x1c-\x1f\x85\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2060\u3000\ufeff]"
    for at in range(len(ODD)):  # also of arrays that begin within a larger one
        made, counts = pieces.cut(pa.array(ODD).slice(at))
        made = iter(made.to_pylist())
        for t, n in zip(ODD[at:], counts.tolist(), strict=True):
            own = [next(made) for _ in range(n)]
            assert all(own) and "".join(own) == (t or "")
            assert all(x[0] == " " and not regex.match(wide, x[1]) and not regex.match(wide, y[-1]) for y, x in zip(own, own[1:]))
            for pattern in (P.PATTERN, r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"):
                assert [x for c in own for x in regex.findall(pattern, c)] == regex.findall(pattern, t or "")
    assert pieces.cut(pa.array(["नमस्ते दुनिया"]))[1].tolist() == [2]


def test_packed_numbers_and_strings():
    words = pa.array(["a", "b", "é" * 300, " the", "the "])
    bounds, data = pieces.unpack_pieces(pieces.pack_pieces(words))
    assert [bytes(data[a:b]).decode() for a, b in zip(bounds, bounds[1:])] == words.to_pylist()
    assert len(set(pieces.hashes_of(bounds, data).tolist())) == 5
    numbers = np.array([0, 1, 70_000, 2**32 - 1])
    assert pieces.unpack_ints(pieces.pack_ints(numbers)).tolist() == numbers.tolist() and not len(pieces.unpack_ints(pieces.pack_ints(numbers[:0])))


def test_many_slices_and_buckets(spark, monkeypatch):
    """Pieces of many slices, dealt to many buckets, give every text its own ids again."""
    import tiktoken

    monkeypatch.setattr(pieces, "SLICE_BYTES", 300)
    monkeypatch.setattr(pieces, "BUCKETS", 9)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = [" ".join(f"w{(i * k) % 97}" for k in range(i % 60)) for i in range(200)] + ODD
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for docs in (df, df.unionByName(df), df.repartition(3, "i"), df.orderBy("text").limit(150)):  # equal slices, and rows that come in any order
        rows = bpe.encode(docs, path, P.PATTERN).collect()
        assert len(rows) == docs.count() and all(r["ids"] == library.encode_ordinary(r["text"] or "") for r in rows)
    scan = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id > 3").select("text", "doc_id")
    assert pieces._comes_alike(scan) and pieces._comes_alike(spark.range(9).where("id > 3"))
    assert not any(map(pieces._comes_alike, (scan.repartition(3, "doc_id"), scan.limit(3), scan.distinct(), scan.unionByName(scan), scan.join(scan.select("doc_id"), "doc_id"))))
    assert [r["ids"] for r in bpe.encode(spark.createDataFrame([("a b",)], "text string"), path, P.PATTERN, keep_text=False).collect()] == [library.encode_ordinary("a b")]


def test_every_license_of_a_run():
    s = licenses.Scanner()
    for notice in ("Released under the MIT License.", "Licensed under CC BY 4.0.", licenses.TEMPLATES["Apache-2.0"][0]):
        words = len(licenses._WORD.findall(notice))
        for n in (1, 2, 1000):
            found = s.scan(" ".join([notice] * n))
            assert [m["first_word"] for m in found] == list(range(0, n * words, words)) and {m["coverage"] for m in found} == {1.0}


def test_changed_words_up_to_the_coverage():
    for texts in licenses.TEMPLATES.values():
        for t in texts:
            words = licenses._WORD.findall(t)
            s = licenses.Scanner({"x": [t]})
            n = len(words) - s.needed[0]
            for at in {tuple(k * len(words) // (n + 1) for k in range(1, n + 1)), *((k,) for k in range(len(words)) if n == 1), tuple(range(4, len(words) - 1, 5))[:n]}:
                changed = ["other" if i in at else w for i, w in enumerate(words)]
                assert len(s.scan("before it " + " ".join(changed) + " after it")) == 1, (t, at)


def test_repeats_of_one_page_are_not_fixed():
    pages = ["<ul>" + "<li>Yes</li>" * 8 + "</ul><p>one</p>", "<h2>Two</h2><p>two</p>", "<pre>three</pre>"]
    wrapper = H.loaded(json.dumps(H.infer(pages)))
    assert H.extract(pages[0], wrapper).split("\n\n") == ["Yes"] * 8 + ["one"]
    same = [f"<h2>Site</h2><p>{k}</p>" for k in "abc"]
    assert H.extract(same[1], H.loaded(json.dumps(H.infer(same)))) == "b"


def test_articles_inside_named_containers():
    for label in ("layout has-sidebar", "content-with-nav", "page-with-banner", "sidebar", "widget"):
        for tag in ("article", "main"):
            assert H.extract(f'<div class="{label}"><{tag}><p>Text</p></{tag}><nav>Menu</nav></div>', None) == "Text", (label, tag)
    assert H.extract('<article><p>a</p><section class="related-work"><p>b</p></section><div id="search-results"><p>c</p></div></article>', None) == "a\n\nb\n\nc"
    for label in ("comments", "cookie-notice", "ad_banner", "x related"):
        assert H.extract(f'<article><p>a</p></article><div class="{label}"><p>b</p><article>c</article></div>', None) == "a"
    for label in ("reader-comments", "site-footer", "ad-slot", "user-comment-list", "cookie-bar"):
        assert H.extract(f'<article><p>a</p><section class="{label}"><p>b</p></section></article>', None) == "a", label
    assert H.extract('<article><p class="alert-history">a</p><div class="social-history"><p>b</p></div></article>', None) == "a\n\nb"
    assert H.extract('<article><p>a <span class="advert">x <b>y</b></span> b <em>c</em></p><p>d <i class="ad">e</p><p>f</p></article>', None) == "a b c\n\nd\n\nf"


def whole_alignment(template, words):
    """The most template words in a local alignment of best score, over all cells: matches 2, anything else -1."""
    best, row = (0, 0), [(0, 0)] * (len(words) + 1)
    for w in template:
        new = [(0, 0)]
        for j, x in enumerate(words):
            if w == x:
                cell = (row[j][0] + 2, row[j][1] + 1)
            else:
                cell = max((row[j][0] - 1, row[j][1]), (row[j + 1][0] - 1, row[j + 1][1]), (new[j][0] - 1, new[j][1]))
            new.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, new[-1])
        row = new
    return best[1]


def test_licenses_as_whole_alignment_finds_them():
    import random

    rng, s = random.Random(6), licenses.Scanner()
    for t, (name, words) in enumerate(s.templates):
        for _ in range(2):
            changed = [w if rng.random() > 0.06 else "other" for w in words]
            text = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(30))] + changed + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(30))]
            wanted = {n: max(whole_alignment(x, text) / len(x) for m, x in s.templates if m == n) for n in {n for n, _ in s.templates}}
            found = s.scan(" ".join(text))
            if whole_alignment(words, text) >= s.needed[t]:
                assert [m["license"] for m in found] == [name], (name, text)
            assert all(wanted[m["license"]] >= m["coverage"] - 1e-9 >= licenses.MIN_COVERAGE - 1e-9 for m in found)


def test_bsd_licenses_apart():
    s = licenses.Scanner()
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        for text in licenses.TEMPLATES[name]:
            assert [(m["license"], m["coverage"]) for m in s.scan(f"x {text} y")] == [(name, 1.0)]
