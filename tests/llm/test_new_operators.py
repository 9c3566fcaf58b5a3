"""Audits, fill-in-middle samples and page texts against plain versions, and on odd rows."""

import hashlib
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import audit, extraction, infill
from logloom.llm.blocks import Paths, leaf_blocks
from logloom.llm.layouts import sample_page

WORDS = " ".join(f"w{i}" for i in range(300))
TEXTS = [
    None, "", " ", "  a  b ", "same text here", "same text here", "x\ny\tz\r\n\n", "日本語 ΣΑΣ İx", "A B C", "a\x0bb\x1cc\x85d\xa0e　f",
    "word " * 6000, "q" * 30000, "has a <P> mark", "<S", "a\x00b", WORDS, WORDS, WORDS + " #", "🙂 🙂\x0c", "eight888" * 3, "seven77 ", "\x08\x0e ab\x7f",
]


@pytest.fixture(scope="module")
def odd(spark):
    clash = {"part": "x", "fails": 3, "key": "k", "first": 1, "n": 2, "form": "f", "step": 1, "good": 5, "first_id": 9, "prefix": "p", "repeated": True}
    data = [(k, t, (None, "en", "de")[k % 3], *clash.values()) for k, t in enumerate(TEXTS)]
    data += [(4, TEXTS[4], "en", *clash.values()), (None, "no id", None, *clash.values()), (None, WORDS, None, *clash.values())]
    kinds = {str: "string", int: "int", bool: "boolean"}
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` {kinds[type(v)]}" for c, v in clash.items())
    return spark.createDataFrame(data, schema).repartition(3)


def plain_audit(docs, labels):
    """All orders, document by document."""
    failing = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs),
        }
        mine = [l for l in labels if l[0] == doc_id and doc_id is not None]
        failing.append((lang or "", {f for f, v in fails.items() if v}, any(q == 1 for _, q, _ in mine), any(t == 1 for _, _, t in mine)))
    rows, removed = {}, {}
    for part in {p for p, *_ in failing}:
        mine = [f for f in failing if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, own in enumerate(order, 1):
                gone = [f for f in left if own in f[1]]
                left = [f for f in left if own not in f[1]]
                failed = sum(own in f[1] for f in mine)
                removed[part, own] = removed.get((part, own), 0) + len(gone)
                rows[part, order, step] = (
                    own, len(left), len(gone), failed - len(gone), sum(f[1] == {own} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone),
                )
    return sorted((*k, *v[1:], removed[k[0], v[0]]) for k, v in rows.items())


def test_audit_like_all_orders(spark, odd):
    labels = [(0, 1, 0), (1, 0, 1), (4, 1, 1), (4, 0, 0), (5, None, None), (15, 1, None), (16, 1, 1), (None, 1, 1), (99, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()], labels)
    got = audit.audit_filters(odd, told)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 3 * 600
    assert audit.audit_filters(odd.limit(0), told).count() == 0
    assert audit.audit_filters(odd, told.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_with_other_filters(spark):
    fails = spark.createDataFrame([("p", s, s + 1, 0, 0) for s in range(8)], "part string, fails int, documents long, good long, toxic long")
    rows = audit.audit_orders(fails, "XYZ").collect()
    assert len(rows) == 18 and all(r["kept"] == 1 for r in rows if r["step"] == 3)
    for f in range(3):
        own = [r for r in rows if r["filter_order"][r["step"] - 1] == "XYZ"[f]]
        assert {r["shapley"] for r in own} == {sum(r["removed"] for r in own)}
        assert {r["unique_fails"] for r in own} == {(1 << f) + 1}


def plain_sample(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(p) for p in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h[3] % 100 < 80 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), "spm" if h[3] % 100 < 80 else "psm", len(prefix), len(middle), out


def test_samples_like_a_plain_version(spark, odd, small):
    many = spark.createDataFrame([(1000 + k, t) for k in range(40) for t in TEXTS], "doc_id long, text string")
    for docs in (odd, many, spark.read.parquet(f"{small}/documents.parquet")):
        got = infill.fill_in_middle(docs).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
        assert all(r["back"] == r["text"] for r in got)
        want = sorted((plain_sample(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
        assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in got), key=repr) == want
    assert infill.fill_in_middle(odd.limit(0)).count() == 0


def test_words_of_bytes():
    rng = np.random.default_rng(3)
    for size in (0, 1, 7, 8, 9, 1000):
        data = rng.integers(0, 256, size, np.uint8)
        blank = (data == 0x20) | ((data >= 9) & (data <= 13))
        words = infill.as_words(data)
        flag = lambda flags: (flags.view(np.uint8) >> 7)[:size].astype(bool)
        assert (flag(infill.blank_bytes(words)) == blank).all()
        assert (flag(infill.token_ends(words)) == (~blank & np.append(blank[1:], True)[:size])).all()
        assert (flag(infill.first_bytes(words)) == ((data & 0xC0) != 0x80)).all()
        flags = infill.token_ends(words)
        marks, places = infill.Marks(flags), np.flatnonzero(flag(flags))
        assert (marks.select(np.arange(1, len(places) + 1)) == places).all()
        assert (marks.rank(np.arange(size)) == [np.sum(places < k) for k in range(size)]).all()


def test_blocks_of_broken_markup():
    paths = Paths()
    html = (
        '<title>T &amp; x</title><script>var t="</p>";</script><nav><ul><li><a href="/a>b">A<li><a>B</a></ul></nav><!-- <p>no -->'
        '<div class="ad side-bar">buy</div><h1>Head</h1><p><b>first<br><p>2nd 1 < 2 &nbsp;x</p>tail <i>it</i>alic<style>p{}</style><td>z'
    )
    found = leaf_blocks(html, paths)
    assert [t for t, _, _ in found] == ["T & x", "A", "B", "buy", "Head", "first", "2nd 1 < 2 x", "tail italic", "z"]
    assert {"<div", "ad", "side", "bar"} == paths.sets[found[3][1]] and [l for _, _, l in found][1:3] == [1, 1]
    for odd in (None, "", "  \n", "<!-- open <p>x", "<script>x", "<", "<p", "</p>"):
        assert leaf_blocks(odd, paths) in ([], [("<", 0, 0)], [("<p", 0, 0)])
    deep = leaf_blocks("<div>" * 20000 + "x" + "<p>y" * 20000, paths)
    assert len(deep) == 20001 and len(paths.sets) < 40


def test_slopes_of_the_network():
    rng = np.random.default_rng(1)
    weights = {k: v.astype(np.float64) for k, v in extraction.first_weights(rng).items()}
    paths, drawn = Paths(), [sample_page(rng) for _ in range(3)]
    blocks = extraction.page_blocks([leaf_blocks(h, paths) for h, _ in drawn], paths)
    wanted = np.concatenate([l for _, l in drawn]).astype(np.float32)
    _, slopes = extraction.gradients(weights, blocks, wanted)
    for name in weights:
        at = np.unravel_index(np.argmax(np.abs(slopes[name])), slopes[name].shape)
        sides = []
        for shift in (-0.01, 0.01):
            moved = {**weights, name: weights[name].copy()}
            moved[name][at] += shift
            sides.append(extraction.gradients(moved, blocks, wanted)[0])
        assert (sides[1] - sides[0]) / 0.02 == pytest.approx(slopes[name][at], rel=0.03), name


def test_scores_do_not_depend_on_company():
    rng = np.random.default_rng(2)
    weights, paths = extraction.trained(60, 1), Paths()
    pages = [leaf_blocks(sample_page(rng)[0], paths) for _ in range(20)]
    alone = [extraction.page_blocks([p], paths) for p in pages]
    together = extraction.page_blocks(pages, paths)
    each = np.concatenate([extraction.scores(weights, extraction.read(weights, b), b.lengths) for b in alone])
    assert np.allclose(each, extraction.scores(weights, extraction.read(weights, together), together.lengths), atol=1e-4)


def test_blocks_of_unseen_pages():
    rng, weights = np.random.default_rng(77), extraction.trained()
    right = total = 0
    for _ in range(200):
        html, labels = sample_page(rng)
        texts = [t for t, _, _ in leaf_blocks(html, Paths())]
        got, count = extraction.main_blocks(weights, [html])[0]
        assert count == len(labels)
        want = [t for t, l in zip(texts, labels) if l]
        right += len(set(got) & set(want))
        total += len(set(got) | set(want))
    assert right / total > 0.98


def test_main_text_of_the_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extraction.extract_text(pages).collect()}
    for row in pages.collect():
        html = row["html"]
        article = html[html.index("<article>") : html.index("</article>")]
        assert got[row["page_id"]] == "\n".join(t for t, _, _ in leaf_blocks(article, Paths()))


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, n_blocks int, keep int"
    rows = [(1, None, None, "t", 0, 0), (None, "u", "", "t", 0, 0), (2, "u", "<p>" + "word " * 50000 + ".</p>", "t", 0, 0), (2, "u", " \n", "t", 0, 0)]
    got = extraction.extract_text(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_blocks", "n_kept"]
    assert sorted((r["n_blocks"], len(r["text"])) for r in got.collect())[:3] == [(0, 0)] * 3 and got.count() == 4
    assert extraction.extract_text(spark.createDataFrame([], schema)).count() == 0


def resembling(spark, data):
    from logloom.llm import resemblance

    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").select(F.struct("doc_id", "text").alias("row"))
    hashed = docs.mapInArrow(resemblance.print_batches(5), "row struct<doc_id: long, text: string>, print long, buckets array<long>")
    sets = hashed.select("print", "row.text").distinct().mapInArrow(resemblance.set_batches(5), "print long, set array<long>")
    rooted = hashed.select(F.explode("buckets").alias("bucket"), "print", F.col("print").alias("root")).distinct()
    return resemblance, rooted, sets


def test_a_shared_passage_makes_few_pairs(spark):
    """Texts that share a passage of three quarters, but are not near copies, meet in proportion to their number."""
    counts = []
    for n in (100, 200, 400):
        rng = np.random.default_rng(n)
        passage = " ".join(f"p{i}" for i in range(240))
        texts = [passage + " " + " ".join(f"w{rng.integers(10**7)}" for _ in range(80)) for _ in range(n)]
        resemblance, rooted, sets = resembling(spark, texts)
        assert rooted.groupBy("bucket").count().agg(F.max("count")).first()[0] > n // 20
        counts.append(resemblance.rest_pairs(rooted, sets, 0.8).count())
    assert counts[2] <= 4 * counts[0] + 400


def test_rest_pairs_lose_none(spark):
    """Every pair of a large bucket that is alike is among the pairs, however the texts are made."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 5), replace=False):
            words[at] = f"x{rng.integers(9)}"
        texts.append(" ".join(words[: 60 - rng.integers(0, 8)]))
    resemblance, rooted, sets = resembling(spark, texts)
    found = {(r["a"], r["b"]) for r in resemblance.rest_pairs(rooted.withColumn("bucket", F.lit(1)).distinct(), sets, 0.8).collect()}
    held = {r["print"]: set(r["set"]) for r in sets.collect()}
    want = {(a, b) for a in held for b in held if a < b and 5 * len(held[a] & held[b]) >= 4 * len(held[a] | held[b])}
    assert len(want) > 30 and want <= found


def alike_texts():
    """Texts of ten families with words changed, added or moved, exact copies, and texts of one run."""
    rng = np.random.default_rng(11)
    out = ["", " \n ", "one run", "ONE  run", "another run", "a b " * 40, "a b " * 50]
    for f in range(10):
        base = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(80, 200)))]
        for k in range(8):
            words = list(base)
            for at in rng.choice(len(words), k // 2, replace=False):
                words[at] = f"x{rng.integers(9)}"
            out.append(" ".join(words[: len(words) - int(rng.integers(0, 6))]))
        out.append(out[-1])
    return out


def test_near_fingerprints_link_first(spark, monkeypatch):
    """Pairs within three bits come from the fingerprints' own probes, and no pair of 0.8 stays apart."""
    from logloom.llm import resemblance, simhash

    data, calls = alike_texts(), []
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    sets = [set(resemblance.shingles(simhash.digests(t, 5)).tolist()) for t in data]
    bits = [simhash.fingerprint(t, 5) for t in data]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    rows = docs.select(F.struct("doc_id", "text").alias("row"))
    schema = "row struct<doc_id: long, text: string>, print long, buckets array<long>, fingerprint long"
    hashed = rows.mapInArrow(resemblance.print_batches(5, fingerprinted=True), schema).cache()
    held = {r["doc_id"]: (r["print"], r["fingerprint"] % 2**64) for r in hashed.select("row.doc_id", "print", "fingerprint").collect()}
    assert [held[d][1] for d in range(len(data))] == bits
    met = {(r["a"], r["b"]) for r in resemblance.fingerprint_pairs(hashed.filter(F.size("buckets") > 0), 3).collect()}
    firsts = {}
    for d in range(len(data)):
        if sets[d]:
            firsts.setdefault(bits[d], set()).add(held[d][0])
    want = {tuple(sorted((p, min(f)))) for f in firsts.values() for p in f if p != min(f)}
    want |= {tuple(sorted((min(firsts[x]), min(firsts[y])))) for x in firsts for y in firsts if 0 < (x ^ y).bit_count() <= 3}
    assert met == want and len(want) > 10

    real = resemblance.near_links
    monkeypatch.setattr(resemblance, "near_links", lambda prints, most: (calls.append(most), real(prints, most))[1])
    top = list(range(len(data)))
    for a in range(len(data)):
        for b in range(a):
            if alike(a, b) or not (sets[a] or sets[b]):
                low, high = sorted((top[a], top[b]))
                top = [low if t == high else t for t in top]
    kept = sorted(r["doc_id"] for r in corpus_pipeline.keep_one_copy(spark, docs, "").collect())
    assert kept == sorted(set(top)) and calls == [3]
