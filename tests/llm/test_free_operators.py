"""Near-duplicates, suffixes, archives, pages and toxicity on small tables."""

import hashlib
import random
import struct
import time
import tracemalloc
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from pages_by_hand import PAGES

from floorlake.llm import components, deepshallow, html_blocks, html_labeller, html_pages, minhash, shingles, suffix, toxicity, warc

DOCS = "doc_id long, text string, node string, kept string"
ODD = [None, "", " \n\t", "word", "two words", "Two WORDS", "Same text here now.", "Same text here now.", "long " * 20_000, "é ß 漢字 " * 60]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)


def sentence(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


def edited(r, text, share):
    return " ".join(x if r.random() > share else sentence(r, 1) for x in text.split())


# shingles and near-duplicates


def grams(text, n):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(texts, n, percent=80):
    sets = [grams(t, n) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [len(s) for s in sets], [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("n", [1, 4, 5])
def test_shingle_sets(n):
    r = random.Random(n)
    texts = [*ODD, *[" ".join(r.choices(["a", "b", "Cc", "d e"], k=r.randint(0, 9))) for _ in range(60)]]
    h, ends = shingles.shingle_sets([(t or "").encode() for t in texts], n)
    got = np.split(h, ends[:-1])
    want = [grams(t, n) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_long_texts_in_pieces(monkeypatch):
    r = random.Random(2)
    texts = [(t or "").encode() for t in ODD] + [b"x" * 50, *[(" " * r.randint(0, 3)).join("".join(r.choices("abCd \n", k=r.randint(0, 9))) for _ in range(r.randint(0, 40))).encode() for _ in range(80)]]
    whole = [shingles.shingle_sets([t], 4)[0] for t in texts]
    monkeypatch.setattr(shingles, "FOLD", 5)
    for size in (1, 3, 7, 16):
        monkeypatch.setattr(shingles, "CHUNK_BYTES", size)
        assert all(np.array_equal(a, shingles.long_set(t, 4)) for a, t in zip(whole, texts, strict=True) if len(t) < 1000)


def test_a_long_set_takes_a_few_times_its_text():
    text = " ".join(map(str, range(1_500_000))).encode()
    tracemalloc.start()
    assert len(shingles.long_set(text, 4)) == 1_500_000 - 3
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * len(text) + (64 << 20)


def test_near_duplicates_of_long_texts(spark):
    """Texts of 50 MB: one and its near copy, and a short one."""
    numbers = "array_join(transform(sequence(1, {0}), x -> string(x)), ' ')"
    d = spark.sql(f"SELECT 1L AS doc_id, {numbers.format(6_400_000)} AS text UNION ALL SELECT 2L, {numbers.format(6_300_000)} UNION ALL SELECT 3L, {numbers.format(60)}")
    d.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/long")
    got = minhash.near_duplicates(spark.read.parquet(path), 4).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == [(1, 6_399_997, 1, True), (2, 6_299_997, 1, False), (3, 57, 3, True)]


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 6)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 900)
    r = random.Random(7)
    texts = list(ODD)
    for _ in range(4):
        base = sentence(r, r.randint(30, 120))
        texts += [edited(r, base, r.choice([0, 0.01, 0.03, 0.06])) for _ in range(30)]
    texts += [sentence(r, 60) for _ in range(20)]
    sizes, want = brute_components(texts, 4)
    got = {x["doc_id"]: x for x in minhash.near_duplicates(docs_of(spark, texts), 4).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))
    kept = {x["doc_id"] for x in minhash.drop_near_duplicates(docs_of(spark, texts), 4).collect()}
    assert kept == {i for i in range(len(texts)) if want[i] == i}


def test_many_near_copies_of_one_text(spark):
    r = random.Random(8)
    words = sentence(r, 60).split()
    texts = [" ".join(words)] + [" ".join([*words[:k], f"new{i}", *words[k + 1 :]]) for i, k in enumerate(r.choices(range(1, 4), k=10_000))]
    texts += [" ".join([*words, f"more{i}"]) for i in range(10_000)]
    got = minhash.near_duplicates(docs_of(spark, [*texts, sentence(r, 60)])).orderBy("doc_id").collect()
    assert {x["component_id"] for x in got[:-1]} == {0} and [x["doc_id"] for x in got if x["kept"]] == [0, len(texts)]


@pytest.mark.parametrize("block", [60, 1 << 18])
def test_exact_links_in_parts(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    r = random.Random(9)
    words = sentence(r, 30).split()
    texts = [" ".join(words)] + [" ".join([*words[: 30 - k], *sentence(r, k).split()]) for k in range(12) for _ in range(4)]
    signs = minhash.signed(docs_of(spark, texts), 5)
    rows = {x["doc_id"]: x for x in signs.collect()}
    known = spark.createDataFrame([(x["node"], i, x["n_shingles"], x["signature"]) for i, x in rows.items()], "node long, rep long, n long, signature binary").dropDuplicates(["node"])
    size = lambda i: rows[i]["n_shingles"]
    named = [(u, v) for u in (0, 5) for v in range(len(texts)) if texts[u] != texts[v]]
    pairs = spark.createDataFrame([(rows[u]["node"], rows[v]["node"], size(u), size(v)) for u, v in named], "u long, v long, nu long, nv long")
    cut = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = {tuple(sorted((rows[u]["node"], rows[v]["node"]))) for u, v in named if near(cut(texts[u]), cut(texts[v]))}
    got = minhash.exact_links(pairs, known, docs_of(spark, texts), 5).collect()
    assert len(got) == len(want) > 3 and {tuple(x) for x in got} == want


def test_near_duplicates_of_odd_rows(spark):
    text = "one two three four five six seven"
    d = docs_of(spark, ["other words entirely here, not those", text]).union(spark.createDataFrame([(None, text, "x", "y"), (None, "alone with no id at all", "x", "y"), (1, text, "x", "y")], DOCS))
    out = minhash.drop_near_duplicates(d)
    assert out.columns == d.columns
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["text"]) for x in out.collect()) == [(False, 0, "other words entirely here, not those"), (False, 1, text), (False, 1, text), (True, 0, "alone with no id at all")]
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_posterior_bounds():
    least = minhash.least_matches(128)
    assert all(0 < least[n] < n for n in least) and list(least) == list(range(16, 129, 16))
    r = np.random.default_rng(1)
    same = r.random((4000, 128)) < 0.8
    a = np.zeros((4000, 128), np.uint8)
    assert minhash.plausible(a, np.where(same, 0, 1).astype(np.uint8)).mean() > 0.999
    far = r.random((4000, 128)) < 0.4
    assert minhash.plausible(a, np.where(far, 0, 1).astype(np.uint8)).mean() < 0.01


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, 300)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    seen = {}
    for s in sorted(near):
        todo = [s] if s not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = s
                todo += near[x]
    assert got == seen
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# suffixes


def brute_repeats(texts, n):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for i in range(len(b) - n + 1):
            count[b[i : i + n]] = count.get(b[i : i + n], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("contexts", [2000, 7, 1])
def test_repeats_against_brute_force(spark, monkeypatch, contexts):
    monkeypatch.setattr(suffix, "RUN_CONTEXTS", contexts)
    monkeypatch.setattr(suffix, "SLAB_BYTES", 4000)
    r = random.Random(11)
    passage = sentence(r, 80)
    texts = [None, "", "short", "ab" * 200, "Of " * 300, passage, passage, "é漢" * 150]
    for _ in range(40):
        at, n = r.randint(0, 200), r.randint(150, 300)
        texts.append(sentence(r, r.randint(0, 30)) + passage[at : at + n] + sentence(r, r.randint(0, 30)))
    rows = {x["doc_id"]: x for x in suffix.remove_repeats(docs_of(spark, texts)).collect()}
    assert [(rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"], rows[i]["kept_sha256"]) for i in range(len(texts))] == brute_repeats(texts, 200)


def test_repeats_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 64)
    text = sentence(random.Random(1), 100)
    d = spark.createDataFrame([(None, text, "a", "b"), (None, text, "a", "b"), (1, text[50:] + "x", "a", "b")], DOCS)
    rows = suffix.remove_repeats(d, with_text=True).collect()
    want = brute_repeats([text, text, text[50:] + "x"], 200)
    assert sorted((x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in rows) == sorted(want)
    assert all(hashlib.sha256(x["kept"]).hexdigest() == x["kept_sha256"] for x in rows)
    assert suffix.remove_repeats(d.limit(0)).count() == 0


def test_deep_shallow_sort():
    r = random.Random(1)
    for _ in range(60):
        base = bytes(r.choices(b"ab", k=r.randint(200, 500)))
        text = base + bytes(r.choices(b"abc", k=50)) + base[r.randint(0, 50) :] + base[: r.randint(0, 200)]
        n = r.choice([40, 80, 200])
        starts = np.array(r.sample(range(len(text) - n + 1), r.randint(1, len(text) - n + 1)))
        order, group = deepshallow.sort_substrings(text, starts, n)
        found = [text[i : i + n] for i in starts[order]]
        assert found == sorted(found)
        assert all((found[i] == found[i - 1]) == (group[i] == group[i - 1]) for i in range(1, len(found)))


# archives


def test_archives_round_trip(spark):
    r = random.Random(4)
    page = lambda: f"<html><p>{sentence(r, 60)}</p></html>"
    shared = page()
    rows = [(i, f"http://x/{i}", page()) for i in range(30)] + [(40, "u", shared), (35, "line\nbreak", shared), (36, None, shared), (50, "e", ""), (51, "n", None), (52, "s", "tiny"), (53, "s", "tiny"), (None, "q", shared), (60, "é", "漢" * 50)]
    rows += [(35, "line\nbreak", shared)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit(1)).repartition(3)
    got = warc.archived(d).collect()
    assert len(got) == len(rows)
    want = {i: h for i, _, h in rows}
    for x in got:
        raw = (want[x["page_id"]] or "").encode()
        assert x["payload_bytes"] == len(raw) and x["payload_digest"] == hashlib.sha256(raw).hexdigest()
        again = want[x["page_id"]] == shared and x["page_id"] != 35
        assert (x["record_type"], x["refers_to"]) == (("revisit", 35) if again else ("response", None))
        assert x["html"] == (None if again else want[x["page_id"]] or "")
    assert warc.archived(d.limit(0)).count() == 0


def test_archive_is_plain_zstandard():
    records = [warc.record(i, "http://x/", f"<p>page {i} {'text ' * 40}</p>".encode(), "d" * 64, 10, None) for i in range(200)]
    frames = list(warc.archive(iter(records)))
    assert int.from_bytes(frames[0][:4], "little") == warc.DICTIONARY_MAGIC
    content = warc.EMPTY_FRAME.encode().join(frames) + warc.EMPTY_FRAME.encode()
    assert [int(h["Page-ID"]) for h, _ in warc.read_records(content)] == list(range(200))
    size = int.from_bytes(frames[0][4:8], "little")
    assert len(frames[0]) == size + 8
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(frames[0][8:]))
    assert [unpack.decompress(f) for f in frames[1:]] == records


@pytest.mark.parametrize("records", [[b"one record"], [b"x" * 3_000_000], [b"same"] * 20, [b"short", b"y" * 2_000_000, *[f"record {i} text".encode() for i in range(300)]]])
def test_every_archive_has_its_dictionary(records):
    frames = list(warc.archive(iter(records)))
    magic, size = struct.unpack_from("<II", frames[0])
    assert magic == warc.DICTIONARY_MAGIC and size > 0 and len(frames) == len(records) + 1
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(frames[0][8:]))
    assert [unpack.decompress(f) for f in frames[1:]] == records
    assert list(warc.archive(iter([]))) == []


# pages


def test_blocks():
    page = "<p>a &amp; b<br>c</p><!-- x --><script>if (a<b) {}</script><div class='Big box'>one <b>two</b>\n three<ul><li>x<li>y &lt;</ul></div><p>open<p>next <a href='>'>link</a> &nbsp; end<"
    assert [x.text for x in html_blocks.leaves(page)] == ["a & b c", "one two three", "x", "y <", "open", "next link end<"]
    names = ("div", ".big", ".box", "in:div", "in:.big", "in:.box")
    assert html_blocks.leaves(page)[1].ids == tuple(sorted({zlib.crc32(x.encode()) % html_blocks.PATH_DIM for x in names}))
    assert [x.text for x in html_blocks.leaves("<p>a<!-- open <p>b")] == ["a"]
    assert html_blocks.leaves("") == [] == html_blocks.leaves("<style>p{}") == html_blocks.leaves("&nbsp; <p> </p>")
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert [x.text for x in html_blocks.leaves(deep)] == ["x"]


def test_blocks_inside_blocks():
    texts = lambda page: [x.text for x in html_blocks.leaves(page)]
    assert texts("<p>Let <math><mi>x</mi></math> be <b>one</b>.</p>") == ["Let x be one."]
    assert texts("<p>One <noscript>no script</noscript>two.</p><p>three") == ["no script", "One two.", "three"]
    assert texts("<div>a<video>none<p>b</div>c<svg><text>d<p>e") == ["none", "b", "a", "d", "c", "e"]
    assert texts("<select><option>x<option>y") == ["xy"]


def test_deep_pages_in_linear_time():
    began = time.process_time()
    assert len(html_blocks.leaves("<div class='a b'>t" * 16_000)) == 16_000
    assert len(html_blocks.leaves("<b>" * 20_000 + "<p>x</i>" * 20_000)) == 20_000
    assert len({id(x.ids) for x in html_blocks.leaves("<div class='a b'>t" * 1000)}) < 10
    assert time.process_time() - began < 10


@pytest.mark.parametrize("name", PAGES)
def test_pages_by_hand(name):
    page, article = PAGES[name]
    assert html_labeller.main_texts(html_labeller.default_weights(), [page]) == [article]


def test_labeller_on_held_out_pages():
    w = html_labeller.default_weights()
    made = [html_pages.labelled_page(i) for i in range(50_000, 50_150)]
    chances = html_labeller.probabilities(w, [html_blocks.leaves(h) for h, _ in made])
    right = np.concatenate([(c >= 0.5) == np.array(y) for c, (_, y) in zip(chances, made, strict=True)])
    assert right.mean() > 0.99


def test_extract_pages(spark):
    body = "<nav><ul><li><a href='/'>home</a></li></ul></nav><div class='ad'>buy it now</div><article><h1>Title here</h1><p>First &amp; one.</p><p><b>Second\n one.<br><p>Third one.</p></article><footer>&copy; x</footer>"
    rows = [(1, "u", f"<html><body>{body}</body></html>"), (2, None, None), (3, "v", ""), (None, "w", "<p> </p>"), (1, "u", f"<html><body>{body}</body></html>")]
    got = html_labeller.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect()
    assert len(got) == 5 and all(len(x["text"]) == x["n_chars"] for x in got)
    assert {x["text"] for x in got if x["page_id"] == 1} == {"Title here\nFirst & one.\nSecond one.\nThird one."}
    assert all(x["text"] == "" for x in got if x["page_id"] != 1)
    assert html_labeller.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    h = html_labeller.HIDDEN
    w = html_labeller.Weights(rng.normal(0, 0.3, (2, html_labeller.INPUT, 4 * h)), rng.normal(0, 0.3, (2, h, 4 * h)), np.zeros((2, 4 * h)), rng.normal(0, 1, 2 * h), np.zeros(1))
    lengths = [3, 1, 5]
    gates = rng.normal(0, 1, (2, 9, 4 * h))
    weight = rng.normal(0, 1, (9, 2 * h))
    loss = lambda g: float((html_labeller.forward(w, g, lengths) * weight).sum())
    _, tape, place, here = html_labeller.forward(w, gates, lengths, keep=True)
    found, _ = html_labeller._gradients(w, tape, place, here, weight, 9)
    for d, b, k in [(0, 0, 0), (1, 2, 5), (0, 8, 3 * h), (1, 3, 2 * h + 1), (0, 5, h + 2)]:
        up, down = gates.copy(), gates.copy()
        up[d, b, k] += 1e-5
        down[d, b, k] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - found[d, b, k]) < 1e-6


# toxicity


def plain_bag(text):
    """Buckets of the n-grams of a text, one by one."""
    raw = bytes(32 if c in b"\t\n\v\f\r" else c for c in b" " + text.lower() + b" ")
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(raw) - n + 1):
            gram = raw[i : i + n]
            if 32 in gram[1:-1]:
                continue
            h = 0
            for c in gram:
                h = (h * 0x100000001B3 + c + 1) % 2**64
            h = (h + (n << 56)) % 2**64
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> shift)) * factor % 2**64
            out.add((h ^ (h >> 31)) % toxicity.BUCKETS)
    return sorted(out)


def test_scores_are_those_of_the_softmax_model():
    r = random.Random(6)
    texts = [sentence(r, r.randint(1, 30)) + (" nasty nasty word" if i % 3 == 0 else "") for i in range(90)]
    bags = [toxicity.bag(t.encode()) for t in texts]
    assert [b.tolist() for b in bags[:8]] == [plain_bag(t.encode()) for t in texts[:8]]
    assert toxicity.bag("Ünder\tA b\n".encode()).tolist() == plain_bag("Ünder\tA b\n".encode())
    labels = np.array([int(i % 3 == 0) for i in range(90)])
    table, weights, bias = toxicity.train(bags, labels, epochs=3)
    other = [*texts, "", "zzz qqq", "nasty " * 5]
    want = []
    for t in other:
        mean = np.zeros(toxicity.DIM)
        for k in (ids := plain_bag(t.encode())):
            mean += table[k] / len(ids)
        logits = [sum(mean[d] * weights[d, c] for d in range(toxicity.DIM)) + bias[c] for c in (0, 1)]
        want.append(np.exp(logits[1]) / (np.exp(logits[0]) + np.exp(logits[1])))
    assert np.allclose(toxicity.score([t.encode() for t in other], *toxicity.fit(bags, labels, epochs=3)), want)


def test_fitting_rows_are_bounded_by_bytes(spark, monkeypatch):
    d = docs_of(spark, [sentence(random.Random(i), 50) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda bags, labels: seen.append(sum(x.nbytes for x in bags)) or (np.zeros(toxicity.BUCKETS), 0.0))
    toxicity.fit_toxicity(d, labels)
    toxicity.fit_toxicity(d, labels, fit_bytes=seen[0] // 3)
    assert seen[0] // 6 < seen[1] <= seen[0] // 3


def test_toxicity_held_out(spark):
    r = random.Random(9)
    bad = ["idiot", "moron", "worthless"]
    texts, labels = [], []
    for i in range(700):
        words = sentence(r, r.randint(20, 60)).split()
        toxic = i % 4 == 0
        for _ in range(5 if toxic else 0):
            w = r.choice(bad)
            k = r.randrange(len(w))
            words.insert(r.randrange(len(words)), w if r.random() < 0.6 else w[:k] + "x" + w[k + 1 :])
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    d = docs_of(spark, texts).union(spark.createDataFrame([(None, None, "x", "y"), (900, "", "x", "y"), (0, texts[0], "x", "y")], DOCS))
    table = spark.createDataFrame([*labels, (None, 1), (901, None)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(d, toxicity.fit_toxicity(d, table)).collect()
    assert len(rows) == 703 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in rows)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in rows if x["doc_id"] is not None)
    test = [x for x in rows if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 700]
    assert sum(x["predicted"] == (x["doc_id"] % 4 == 0) for x in test) > 0.95 * len(test)
    assert toxicity.score_toxicity(d.limit(0), (np.zeros(toxicity.BUCKETS), 0.0)).count() == 0
    assert toxicity.fit_toxicity(d, table.limit(0))[1] == 0.0
