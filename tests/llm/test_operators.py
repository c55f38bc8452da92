"""Operators against brute force, round trips and held-out accuracy, on small fixtures."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate as D, html_text as H, huffman, language, licenses, media, queries, simhash as S, toxicity as T, url_filters as U
from tessera.llm.common import held_out, inline_table
from tessera.llm.components import components

SF = "/root/testdata/sf0.001"
ODD_TEXTS = ["", None, "  a  b ", "a \n b\t\t c's  'll ", "x" * 3000, "aaaa aaa " * 300, "日本語 テスト  é　 ü", "\u0301 a", "a\x01 b", " lead", "trail ", "<|endoftext|> x", "The quick brown fox. " * 40]


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def find_roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_query(spark, texts):
    import xxhash

    def slow(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
        w = [x.lower() for x in w]
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))

    prints = {i: slow(t) for i, t in texts}
    ids = sorted(prints)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 3]
    roots = find_roots(len(ids), links)
    want = {(i, f"{prints[i]:016x}", ids[r]) for i, r in zip(ids, roots, strict=True)}
    assert {tuple(r) for r in queries.op1_simhash(spark, SF).collect()} == want


@pytest.mark.parametrize(("limit", "bits"), [(256, 3), (2, 3), (256, 1), (256, 2), (1, 2), (256, 4)])
def test_near_pairs_connect_as_brute_force(spark, limit, bits):
    rng = random.Random(5)
    points = set()
    for _ in range(5):
        base = rng.getrandbits(64)
        for _ in range(30):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
    v = np.array(sorted(points), np.uint64).view(np.int64).tolist()
    links = [(a, b) for a in range(len(v)) for b in range(a) if ((v[a] ^ v[b]) & (2**64 - 1)).bit_count() <= bits]
    roots = find_roots(len(v), links)
    df = spark.createDataFrame([(x,) for x in v], "v long")
    got = {r["node"]: r["root"] for r in components(S.near_pairs(df, bits, limit)).collect()}
    groups = lambda of: sorted(map(sorted, collections.defaultdict(list, {k: [x for x, y in of if y == k] for k in {y for _, y in of}}).values()))
    assert groups([(x, got.get(x, x)) for x in v]) == groups([(x, v[r]) for x, r in zip(v, roots, strict=True)])


def test_manhattan_never_exceeds_hamming(spark):
    rng = random.Random(2)
    rows = [(rng.getrandbits(64) - 2**63, rng.getrandbits(64) - 2**63) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long")
    e = F.bit_count(S.embedding(F.col("a")).bitwiseXOR(S.embedding(F.col("b"))))
    for r in df.select("a", "b", e.alias("m")).collect():
        count = lambda x, i: (x >> 2 * i & 3).bit_count()
        assert r["m"] == sum(abs(count(r["a"], i) - count(r["b"], i)) for i in range(32)) <= ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count()


def test_raised_cells_are_the_neighbours(spark):
    rng = random.Random(8)
    v = [rng.getrandbits(64) - 2**63 for _ in range(50)]
    df = spark.createDataFrame([(x,) for x in v], "v long").select("v", S.embedding(F.col("v")).alias("e"))
    count = lambda x, s: (x >> 2 * s & 3).bit_count()
    for r in df.select("v", S._cells(F.col("e"), 3).alias("own"), S._raised(F.col("e"), 3).alias("raised")).collect():
        own = dict(r["own"])
        assert own == {g: sum((0, 1, 3)[count(r["v"], s)] << 2 * s for s in segments) - (1 << 64 if g == 1 and count(r["v"], 31) == 2 else 0) for g, segments in enumerate(S.groups_of(3))}
        want = {(g, s) for g, segments in enumerate(S.groups_of(3)) for s in segments if count(r["v"], s) < 2}
        got = [(g, [s for s in range(32) if count(cell, s) != count(own[g], s)]) for g, cell in r["raised"]]
        assert {(g, s[0]) for g, s in got} == want and len(got) == len(want) and all(len(s) == 1 for _, s in got)


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(3, text), (2, text), (2, text), (5, "other words here"), (5, "other words here"), (None, "alone"), (None, "alone")], "doc_id long, text string")
    assert sorted((str(r[0]), r[1][:5]) for r in S.one_of_each(df).collect()) == [("2", "w0 w1"), ("5", "other"), ("None", "alone")]


def test_bpe_equals_library(spark, texts):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    every = [t for _, t in texts] + ODD_TEXTS
    df = spark.createDataFrame(list(enumerate(every)), "i int, text string")
    rows = bpe.decode(bpe.encode(df, path, P.PATTERN), path).collect()
    for r in rows:
        assert r["ids"] == encoding.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert len(rows) == len(every)


def test_bpe_lower_rank_after_merge():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 258, b"xab": 259, b"aa": 260, b"aaa": 261}
    encoding = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    words = ["abc", "abab", "xabab", "aaaa", "aaaaa", "xabcab", "ababcab", "caab", "aabc"]
    flat, starts, sizes = bpe.MergeReplay(ranks).encode([w.encode() for w in words])
    assert [flat[a : a + n].tolist() for a, n in zip(starts, sizes, strict=True)] == [encoding.encode_ordinary(w) for w in words]


def test_huffman_query(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, start = {}, 0
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r[0]: tuple(r)[1:] for r in queries.op6_huffman_ids(spark, SF).collect()} == want


def test_huffman_ids_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    every = [*ODD_TEXTS, "x <|endoftext|> y", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", "a <|endof text|>", " Bonjour\u00a0: monde", "a b\nc"]
    assert tok.encode(every[-6], add_special_tokens=False).ids == [87, 220, 50256, 331]
    for vocab in (50_257, 1 << 17):
        df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
        rows = huffman.tokenize(df, path, 7, vocab).collect()
        got = {r["doc"]: np.frombuffer(bytes(r["data"]), huffman.id_type(vocab)).tolist() for r in rows}
        assert got == {k: [*tok.encode(t or "", add_special_tokens=False).ids, 7] for k, t in enumerate(every)}
        assert all(r["n"] == len(got[r["doc"]]) for r in rows)


@pytest.mark.parametrize("counts", [[5], [1, 1], [2 ** max(0, i) for i in range(40)], [0, 3, 0, 9, 1], [1] * 300])
def test_huffman_codes(counts):
    counts = np.array(counts, np.int64)
    lengths = huffman.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= huffman.MAX_LENGTH
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    rng = np.random.default_rng(0)
    ids = rng.choice(np.flatnonzero(counts), 5000)
    for n in (0, 1, 255, 256, 257, 5000):
        block = huffman.make_block([None, 4], np.array([n // 2, n - n // 2]), ids[:n], huffman.canonical_codes(lengths), lengths)
        docs, sizes, back = huffman.read_block(block, huffman.decoding_table(lengths))
        assert docs == [None, 4] and sizes.sum() == n and (back == ids[:n]).all()


def test_png(spark):
    for data in (b"", b"a", bytes(range(256)) * 9, "é".encode() * 500):
        p = media.padded(data)
        png = media.to_png(p, idat_bytes=100)
        assert len(p) % 192 == 0 and p and media.from_png(png).tobytes() == p and len(media.cosine_hash(media.from_png(png))) == 16
    for at in (40, len(png) // 2, len(png) - 6):
        with pytest.raises(ValueError):
            media.from_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(ValueError):
        media.from_png(png[:-12])


def test_png_filters():
    rng = np.random.default_rng(1)
    for step in (1, 3):
        image = rng.integers(0, 256, (7, 12), np.uint8)
        rows, kinds = [], np.array([4, 3, 0, 1, 2, 4, 3])
        for i, k in enumerate(kinds):
            above = image[i - 1].astype(int) if i else np.zeros(12, int)
            left = np.concatenate([np.zeros(step, int), image[i, :-step]])
            corner = np.concatenate([np.zeros(step, int), above[:-step]])
            p = left + above - corner
            near = np.select([(abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), abs(p - above) <= abs(p - corner)], [left, above], corner)
            rows.append((image[i].astype(int) - [0, left, above, (left + above) // 2, near][k]) % 256)
        assert (media.unfilter(kinds, np.array(rows, np.uint8), step) == image).all()


def test_media_query(spark, texts):
    got = {r["doc_id"]: r for r in queries.op8_png_media(spark, SF).collect()}
    for i, t in texts:
        payload = media.padded((t or "").encode())
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    judged = language.predict(docs, language.fit(docs, ~out)).where(out & (F.length("text") > 100))
    right, n = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right > 0.97
    judge = language.Classifier({"en": b"the and of it is that with " * 9, "de": b"der die und das ist mit von " * 9}).judge
    assert judge(None)[0] == judge("12 %$")[0] == "und" and judge("the of")[0] == "en"
    assert language.Classifier({}).judge("x") == ("und", 0.0, True)


def test_toxicity_learns():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ta", "re", "no", "mi", "lu"]) for _ in range(rng.randint(1, 3)))
    texts, labels = [], []
    for i in range(300):
        words = [word() for _ in range(rng.randint(5, 120))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = "grumpf" + rng.choice(["a", "ix", "ole"])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    net = T.train(texts[:220], labels[:220])
    score = T.Scorer(net).score(texts[220:])
    y = np.array(labels[220:])
    assert (score[y == 1] >= T.THRESHOLD).mean() > 0.9 and (score[y == 0] >= T.THRESHOLD).mean() < 0.1
    late = T.Scorer(net).score([" ".join(["ta"] * 5000 + ["grumpfix"]), " ".join(["ta"] * 5000), "", None])
    assert late[0] > 0.7 > late[1] and late[2] < 0.7 and late[3] == late[2]
    assert (T.Scorer(T.train(["a"], [0])).score(["a", ""]) <= 0.5).all()


def test_toxicity_gradients():
    net = T.Network(1)
    words = ["alpha", "beta", "gamma", "delta"]
    f = T.features_of(words)
    at, live = np.zeros((2, T.WINDOW), np.int64), np.zeros((2, T.WINDOW), bool)
    at[0, :3], at[1, :2] = [0, 1, 2], [3, 1]
    live[0, :3] = live[1, :2] = True
    at[~live] = 4
    y = np.array([1.0, 0.0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        x = np.vstack([net.p["word"][f[0]], np.zeros((0, T.WIDTH))])
        grams = (net.p["gram"][f[1]] * f[2][..., None]).sum(1) / f[2].sum(1)[:, None]
        peaks = np.where(f[2][..., None], net.p["gram"][f[1]], -9).max(1)
        both = np.concatenate([x, peaks[:, : T.PEAKS], grams[:, T.PEAKS :]], 1)
        gates = net.gates(np.vstack([both, np.zeros((1, 2 * T.WIDTH))]))
        z = net.forward(gates, at, live)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g = net.gradients(*f, at, live, y)
    for name in ("uf", "wb", "att", "out", "cf", "gram", "word"):
        i = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, eps = net.p[name][i], 1e-4
        net.p[name][i] = old + eps
        up = loss()
        net.p[name][i] = old - eps
        down = loss()
        net.p[name][i] = old
        assert g[name][i] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=1e-4), name


def test_windows_cover_every_word():
    for n in (0, 1, 23, 24, 25, 36, 37, 100):
        assert {k for s in T.windows_of(n) for k in range(s, min(s + T.WINDOW, n))} == set(range(n))


def brute_hits(docs, items, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in items:
            v = words(x)
            m = min(n, len(v))
            wanted = {tuple(v[j : j + m]) for j in range(len(v) - m + 1)} if m else set()
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in wanted:
                    hit.update(range(j, j + m))
                    ids.add(str(i))
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(1, " ".join(f"q{i}" for i in range(20))), (2, "The É end"), (10, "the the the the"), (3, None), (4, "..."), (2, "The É end"), (5, " ".join(["a", "b"] * 8))]
    docs = ["x " * 50 + " ".join(f"Q{i}" for i in range(3, 18)) + " y", "the É END", "the é end", "the the the the the", None, "", "a b " * 30, " ".join(rng.choice(["a", "b", "the"]) for _ in range(400)), "q1 q2"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r[c] for c in D.OUTPUTS) for r in D.decontaminate(d, b).orderBy("doc_id").collect()]
    assert got == brute_hits(docs, items)
    assert all(r["n_hit"] == 0 for r in D.decontaminate(d, b.limit(0)).collect())


def test_proximity(spark):
    d = spark.createDataFrame([(1, "one two x three four"), (2, "one two three four"), (3, "one y y y two three four")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    exact, near = D.proximity_matches(d, b, 0), D.proximity_matches(d, b, 1)
    keys = {r[1]: r[0] for r in d.select(F.xxhash64("doc_id", "text"), "doc_id").collect()}
    assert {r["key"] for r in exact.collect()} == {keys[2]} and {r["key"] for r in near.collect()} == {keys[1], keys[2]}


def test_url_filters(spark):
    urls = ["http://www.example.com/en/a?x", "https://EXAMPLE.com/en/", "http://m.example.com/fr/#t", "http://a.net/es/x", "http://a.net", "no url", None, "http://com/", "x://notexample.com/en/", "http://www.example.com/en", "http://example.com?u=/en/", "http://net/fr/a://b/"]
    want = []
    for u in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"))
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    rules = inline_table(spark, queries.RULES, "host string, path string, verdict string")
    assert [tuple(r)[-4:] for r in U.classify(df, rules).orderBy("page_id").collect()] == want
    assert {r["verdict"] for r in U.classify(df, rules.limit(0)).collect()} == {"allow"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav>
<div class="cookie-notice">Accept</div><aside>Side</aside><article><header><h1>Head&amp;line</h1></header><p>One <b>bold</b>
 text.<br>More<p>Two &eacute;<div class="ad">Buy</div><p>%s</p><form><p>Mail</p></form></article><section class="comments"><p>Nice!</p></section><footer>F</footer>"""


def test_html():
    pages = [PAGE % ("x" * k + "</p><p>" * (k % 3) + "end") for k in range(6)]
    import json

    wrapper = H.loaded(json.dumps(H.infer(pages)))
    for k, page in enumerate(pages):
        want = ["Head&line", "One bold text. More", "Two é", *[x for x in ("x" * k + "</p><p>" * (k % 3) + "end").split("</p><p>") if x]]
        assert H.extract(page, wrapper).split("\n\n") == H.extract(page, None).split("\n\n") == want
    assert H.extract(None, wrapper) == H.extract("", wrapper) == H.extract("<p", wrapper) == ""
    assert H.extract("<p>a</p><nav>b</nav><p>c &am", None) == "a\n\nc &am"
    wrapper = H.loaded(json.dumps(H.infer([PAGE % "a", PAGE % "b"])))
    tokens = H.tokens_of(PAGE % "c")
    stream = "".join(wrapper[0].get("T\t" + r if k == "T" else f"{k}\t{v}\t{r}", "\0") for k, v, r in tokens)
    assert wrapper[1].fullmatch(stream)


def test_html_repeats():
    nodes = [["tok", k, "", "plain", "", 1] for k in ("ul", "li", "li", "li", "/ul")]
    assert [n[0] for n in H.collapse(nodes)] == ["tok", "rep", "tok"]


def test_licenses():
    s = licenses.Scanner()
    text = "intro Permission is hereby granted " + licenses.TEMPLATES["MIT"][2][len("Permission is hereby granted,") :].replace("without restriction", "with no real restriction") + " tail. Licensed under CC BY-NC 4.0. end"
    found = s.scan(text)
    assert [m["license"] for m in found] == ["MIT", "CC-BY-NC-4.0"] and 0.9 < found[0]["coverage"] < 1 and found[1]["coverage"] == 1
    assert text[found[1]["start"] : found[1]["end"]] == "Licensed under CC BY-NC 4.0"
    assert s.scan(None) == s.scan("") == s.scan("licensed under nothing") == []
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert name in {m["license"] for m in s.scan("a b c " + t + " d e f")}
