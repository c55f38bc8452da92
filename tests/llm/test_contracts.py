"""Null ids, ties, letters, long items, sides beyond what is broadcast, and scores against plain recomputation."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate as D, html_text as H, language as L, simhash as S, toxicity as T, url_filters as U
from tessera.llm.common import held_out, inline_table


@pytest.mark.parametrize("limit", [500_000, 0])
def test_items_without_id_and_long_items(spark, monkeypatch, limit):
    for name in ("BROADCAST_TERMS", "BROADCAST_CANDIDATES", "BROADCAST_CANDIDATE_WORDS"):
        monkeypatch.setattr(D, name, limit)
    monkeypatch.setattr(D, "SEGMENT", 5)
    rng = random.Random(1)
    long = [f"v{rng.randrange(300)}" for _ in range(200)]
    docs = [" ".join(long[60:100]), "x " + " ".join(long[:13]) + " y " + " ".join(long[-14:]), "no id words here", " ".join(long[5:17])]
    items = [(7, " ".join(long)), (None, "no id words"), (None, "id words here"), (9, "v1")]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    windows = {(i, tuple(w[j : j + min(13, len(w))])) for i, t in items for w in [t.split()] for j in range(len(w) - min(13, len(w)) + 1)}
    want = []
    for t in docs:
        w, hit, ids = t.split(), set(), set()
        for i, win in windows:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    ids |= {str(i)} - {"None"}
        want.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert want[2][1:3] == (4, 0) and want[0][1] == 40
    assert [tuple(r[c] for c in D.OUTPUTS) for r in D.decontaminate(d, b).orderBy("doc_id").collect()] == want
    assert {r["item"] for r in D.proximity_matches(d, b, 0).collect()} >= {7, None}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_rules_of_one_length(spark, monkeypatch, limit):
    monkeypatch.setattr(U, "BROADCAST_RULES", limit)
    rules = inline_table(spark, [("www.a.com", "/", "allow"), ("a.com", "/bcde", "block"), ("a.com", "/bcd", "allow"), ("a.com", "/bcd", "block")], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://www.a.com/bcdef"), (2, "http://x.a.com/bcdef"), (3, "http://a.com/bcd"), (4, None), (5, "none"), (6, "x://a.com/" + "b" * 100_000)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.classify(df, rules).collect()}
    assert got == {1: ("www.a.com/", "allow"), 2: ("a.com/bcde", "block"), 3: ("a.com/bcd", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow")}
    assert U.classify(df.limit(0), rules).collect() == [] and "__salt" not in U.classify(df, rules).columns


def test_letters_and_margins():
    judge = L.Classifier({"en": b"the and of it is that with in the house " * 9, "de": b"der die und das ist mit von in dem haus " * 9}).judge
    for text in ("½ ² Ⅷ ①", "12", "", None, "_", "٣"):
        assert judge(text) == ("und", 0.0, True), text
    assert judge("É")[0] != "und" and judge("日本")[0] != "und"
    assert judge("zz qq")[2] and not judge("the house")[2] and judge("the house")[0] == "en" and judge("das haus")[0] == "de"
    alike = L.Classifier({"a": b"one two three four five " * 9, "b": b"one two three four five " * 9})
    lang, score, rejected = alike.judge("one two three " * 400)
    assert lang == "a" and rejected and score < 1e-9
    long = judge("der die das " * 50_000)
    assert long[0] == "de" and not long[2] and long == judge("der die das " * 50_000)


def test_many_languages(spark, monkeypatch):
    """Every label is learnt, each with a smaller share of the sample."""
    monkeypatch.setattr(L, "ALL_BYTES", 20 * 64_000)
    words = {f"l{k:03d}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i)}x" for i in range(20)] for k in range(60)}
    rows = [(k * 10 + i, " ".join(random.Random(i).choices(w, k=60)), lang) for k, (lang, w) in enumerate(words.items()) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = L.fit(df, F.lit(True))
    assert set(made) == set(words) and max(map(len, made.values())) <= 64_000 // 3 + 1
    assert L.predict(df, made).where("lang = lang_pred").count() > 590


def test_language_against_a_plain_baseline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    judged = L.predict(docs, L.fit(docs, ~out)).where(out & F.col("lang").isNotNull() & (F.length("text") > 0))
    right, kept, n = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg((~F.col("rejected")).cast("int")), F.count(F.lit(1))).first()
    commonest = judged.groupBy("lang").count().agg(F.max("count")).first()[0] / n
    assert right > 0.97 > commonest + 0.2 and kept > 0.97


def plain_score(net, text):
    """The same network, one window, step and character n-gram at a time."""
    sig, p = (lambda x: 1 / (1 + np.exp(-x))), net.p
    words, h = T.words_of(text), T.HIDDEN
    logits = []
    for s in T.windows_of(len(words)):
        xs = []
        for w in words[s : s + T.WINDOW]:
            word, grams, mask = T.features_of([w])
            own = np.array([p["gram"][g] for g, m in zip(grams[0], mask[0]) if m])
            xs.append(np.concatenate([p["word"][word[0]], own.max(0)[: T.PEAKS], own.mean(0)[T.PEAKS :]]))
        states = []
        for way, order in (("f", range(len(xs))), ("b", reversed(range(len(xs))))):
            state, out = np.zeros(h), {}
            for t in order:
                g, hu = xs[t] @ p[f"w{way}"] + p[f"c{way}"], state @ p[f"u{way}"]
                z, r = sig(g[:h] + hu[:h]), sig(g[h : 2 * h] + hu[h : 2 * h])
                n = np.tanh(g[2 * h :] + r * hu[2 * h :])
                state = out[t] = (1 - z) * n + z * state
            states.append([out[t] for t in range(len(xs))])
        both = [np.concatenate(pair) for pair in zip(*states)]
        e = np.array([np.tanh(b @ p["att"] + p["att_b"]) @ p["att_v"] for b in both])
        weight = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        logits.append(sum(a * b for a, b in zip(weight, both)) @ p["out"] + p["out_b"][0])
    return sig(net.scale * (max(logits) if logits else p["out_b"][0]) + net.shift)


def test_toxicity_scores_are_those_of_plain_recomputation():
    rng = random.Random(2)
    net = T.train(["ta re no mi"] * 6 + ["ta grumpf no"] * 6, [0] * 6 + [1] * 6)
    texts = [" ".join(rng.choice(["ta", "grumpf", "é" * 40, "re", "x1"]) for _ in range(n)) for n in (0, 1, 23, 24, 25, 37, 90)] + [None, "?!"]
    assert T.Scorer(net).score(texts) == pytest.approx([plain_score(net, t) for t in texts], abs=1e-4)


def test_toxicity_held_out(spark):
    """On labelled documents that were not learnt from, and beyond guessing the commoner label."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = held_out(F.col("doc_id"), 3, 1)
    net = T.fit(docs, labels, ~out)
    rows = T.predict(docs.join(labels.select("doc_id", "toxic"), "doc_id").where(out), net).select("doc_id", "toxic", "predicted", "score").collect()
    y, p, s = (np.array([r[c] for r in rows]) for c in ("toxic", "predicted", "score"))
    auc = lambda v: np.mean([(a > b) + 0.5 * (a == b) for a in v[y == 1] for b in v[y == 0]])
    assert (y == 1).sum() > 100 and p[y == 1].mean() > 0.6 and p[y == 0].mean() < 0.02
    # the plain baseline: the most telling word by log odds
    texts = dict(docs.join(labels, "doc_id").select("doc_id", "text").where("text is not null").collect())
    learnt = [(set(T.words_of(texts[r["doc_id"]])), r["toxic"]) for r in labels.where(~out).collect() if r["doc_id"] in texts]
    n = [sum(t == k for _, t in learnt) for k in (0, 1)]
    counts = [Counter(w for words, t in learnt if t == k for w in words) for k in (0, 1)]
    odds = lambda w: np.log((counts[1][w] + 0.5) / (n[1] + 1)) - np.log((counts[0][w] + 0.5) / (n[0] + 1)) if counts[1][w] else -9.0
    ids = [r["doc_id"] for r in docs.join(labels, "doc_id").where(out).select("doc_id").collect()]
    plain = dict((i, max(map(odds, T.words_of(texts.get(i))), default=-9.0)) for i in ids)
    assert auc(s) > auc(np.array([plain[r["doc_id"]] for r in rows])) - 0.02 and auc(s) > 0.93


def test_crowded_cells_of_one_bit(spark):
    """A crowded cell and its neighbours: the links are the same however few pairs a cell may hold."""
    rng = random.Random(3)
    base = rng.getrandbits(63)
    v = sorted({base ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 2))) for _ in range(300)})
    df = spark.createDataFrame([(x,) for x in v], "v long")
    from tessera.llm.components import components

    for limit in (256, 3):
        assert components(S.near_pairs(df, limit=limit)).select("root").distinct().count() == 1


def test_components_of_odd_edges(spark):
    from tessera.llm.components import components

    chain = [(i, i + 1, "x") for i in range(100, 140)]
    edges = [(1, 2, "x"), (2, 1, "x"), (1, 2, "y"), (3, 3, "x"), (None, 4, "x"), (5, None, None), *chain, *((50, k, "hub") for k in range(51, 90))]
    df = spark.createDataFrame(edges, "a long, b long, root string")
    groups = {}
    for r in components(df).collect():
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[1, 2], list(range(50, 90)), list(range(100, 141))]
    assert components(df.limit(0)).collect() == []


def test_scratch_tables_go(spark):
    import os

    from tessera.llm import common, near_copies

    paths = []
    real = common.fresh_path
    common.fresh_path = lambda *a: paths.append(real(*a)) or paths[-1]
    try:
        docs = spark.createDataFrame([(i, f"some words of text number {i // 2} here") for i in range(20)], "doc_id long, text string")
        kept = near_copies.one_of_each(docs)
        assert len(paths) > 5 and [os.path.basename(x) for x in paths if os.path.exists(x)] == ["kept"] and kept.count() == 10
        with pytest.raises(ZeroDivisionError), common.scratch(spark):
            common.stored(docs, "inner")
            with common.scratch(spark):
                outer = common.stored(docs, "outer", keep=True)
            assert outer.count() == 20
            raise ZeroDivisionError
        assert [os.path.basename(x) for x in paths if os.path.exists(x)] == ["kept"]
    finally:
        common.fresh_path = real


def test_wrapper_decides_what_is_the_same_on_all_pages():
    import json

    pages = [f"<div>Welcome to our site</div><div><p>Story {k} of the day</p></div><div>All rights reserved</div>" for k in "abcd"]
    wrapper = H.loaded(json.dumps(H.infer(pages)))
    assert H.extract(pages[2], wrapper) == "Story c of the day" != H.extract(pages[2], None)


BROKEN = """<html><body><nav><ul><li><a href="/">Menu %s</a></li><li>More</li></ul></nav><div class="ad">Buy %s</div><article><h1>Head %s</h1><p>One %s<p>Two</p></article><aside><p>Side</p></aside><footer>Foot</footer></body></html>"""


def test_wrapper_mends_pages_without_end_tags():
    """Its own tags put the article inside the menu; the host's wrapper knows better."""
    import json

    wrapper = H.loaded(json.dumps(H.infer([BROKEN % ((k,) * 4) for k in "abc"])))
    whole = BROKEN % (("x",) * 4)
    want = "Head x\n\nOne x\n\nTwo"
    assert H.extract(whole, wrapper) == H.extract(whole, None) == want
    for gone in ("</nav>", "</div>", "</ul></nav>", "</article>", "</nav></div>", "</body></html>", "</aside>"):
        page = whole
        for tag in gone.replace("><", "> <").split():
            page = page.replace(tag, "")
        assert H.extract(page, wrapper) == want, gone
    assert H.extract(whole.replace("</nav>", ""), None) == ""
    # more paragraphs and menu entries than any sampled page has, and a page that the wrapper doesn't know
    longer = whole.replace("</nav>", "").replace("<li>More", "<li>Even<li>More").replace("<p>Two", "<p>Three<p>Four<p>Two")
    assert H.extract(longer, wrapper) == "Head x\n\nOne x\n\nThree\n\nFour\n\nTwo"
    assert H.extract("<main><table><tr><td>Other</td></tr></table></main><nav>m</nav>", wrapper) == "Other"
    assert H.extract("", wrapper) == H.extract("<p", wrapper) == ""
