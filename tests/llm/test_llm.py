import base64
import bz2
import gzip
import itertools
import lzma
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quarry.llm import chat_format, components, decontaminate, html_extract, jaccard_join, license_scan, line_rules, packing, quality_model, secret_scan, warc_bundles

CLASH = {"n": 1, "sid": 2, "head": "x", "cell": 3, "host": "y", "k1": 4, "d": 5, "b": "z", "row_key": 6, "key": 7, "h": 8, "bits": 9}


def documents(spark, rows, clash=True):
    """rows: (doc_id, text, source)."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}) if clash else df


def words(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


EDGE = [(1, None, None), (2, "", "a"), (3, "one", "a"), (3, "one", "a"), (None, "two words", "a"), (5, "x" * 50_000 + " " + "long words " * 3000, "a"), (6, " \t\r\n", None)]


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = jaccard_join.words_of(t)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}, [len(s) for s in sets]


def test_jaccard_against_brute_force(spark):
    r, rows = random.Random(1), []
    for g in range(12):
        base = words(g, r.choice([3, 8, 40, 120])).split()
        for _ in range(r.choice([1, 2, 9])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                own[r.randrange(len(own))] = f"e{r.randrange(99)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), None), (len(rows) + 1, "")]
    want, sizes = brute_components(rows, 4, 85)
    got = jaccard_join.jaccard_components(documents(spark, [(d, t, "s") for d, t in rows]), 4, 85).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want
    assert [x["n_shingles"] for x in sorted(got, key=lambda x: x["doc_id"])] == sizes
    kept = jaccard_join.representatives(documents(spark, [(d, t, "s") for d, t in rows]), 4, 85)
    assert {x["doc_id"] for x in kept.collect()} == {d for d, c in want.items() if d == c} and "row_key" in kept.columns


@pytest.mark.parametrize("percent", [80, 85])
def test_jaccard_splits_regions(spark, monkeypatch, percent):
    """Regions of a few classes are split by document pivots; chains of copies of copies cross the bounds of Voronoi regions."""
    monkeypatch.setattr(jaccard_join, "LEAF", 3)
    monkeypatch.setattr(jaccard_join, "MORE", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    r, rows = random.Random(percent), []
    for g in range(3):
        base = words(50 + g, 90).split()
        chain = [list(base)]
        for _ in range(40):
            own = list(r.choice(chain))
            for _ in range(r.choice([1, 2, 3])):
                own[r.randrange(len(own))] = f"e{r.randrange(999)}"
            chain.append(own)
        rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate(chain)]
    r.shuffle(rows)
    want, _ = brute_components(rows, 4, percent)
    assert len(set(want.values())) > 5
    got = jaccard_join.jaccard_components(documents(spark, [(d, t, "s") for d, t in rows]), 4, percent, count_links=False).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    r, rows = random.Random(2), []
    for g, copies in enumerate((1, 2, 3, 30, 9)):
        base = words(g, 60).split()
        for _ in range(copies):
            own = list(base)
            for _ in range(r.choice([0, 1, 2])):
                own[r.randrange(len(own))] = f"e{r.randrange(99)}"
            rows.append((len(rows), " ".join(own), "s"))
    rows += [(len(rows), None, "s"), (len(rows) + 1, "two words", "s")]
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if (w := jaccard_join.words_of(t)) else set() for _, t, _ in rows]
    links = {d: sum(d != e and bool(a) and 100 * len(a & b) >= 85 * len(a | b) for e, b in enumerate(sets)) for d, a in enumerate(sets)}
    got = [jaccard_join.jaccard_components(documents(spark, rows).repartition(k), 4, 85).collect() for k in (1, 5)]
    for found in got:
        assert {x["doc_id"]: x["n_links"] for x in found} == links and max(links.values()) > 8
        assert all((x["class_id"] == y["class_id"]) == (sets[x["doc_id"]] == sets[y["doc_id"]]) for x in found for y in found)
    assert len({frozenset((x["doc_id"], x["class_id"]) for x in found) for found in got}) == 1


def test_jaccard_edges(spark):
    got = jaccard_join.jaccard_components(documents(spark, EDGE)).collect()
    assert len(got) == len(EDGE) and sum(x["n_shingles"] == 0 for x in got) == 3
    assert jaccard_join.jaccard_components(documents(spark, EDGE).where("false")).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components.connected(e).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_line_rules(spark):
    common = "this line stands on every page of the host"
    rows = [(k, f"{words(k, 30)}\n{common}", "h") for k in range(40)] + [(100, f"{common}\n{common.upper()}", "h"), (101, words(7, 30), "g")] + [(200 + k, words(77, 30), "h") for k in range(30)] + EDGE
    out = {r["doc_id"]: r for r in line_rules.line_rules(documents(spark, rows)).collect()}
    assert out[0]["n_removed_words"] == 9 and out[0]["kept"] and out[101]["kept"]
    assert out[100]["depleted"] and not out[100]["kept"] and out[200]["kept"]
    assert out[1]["base_failed"] and out[1]["n_words"] == 0 and out[5]["n_repeat_words"] > 5000
    clean = {r["doc_id"]: r for r in line_rules.cleaned(documents(spark, rows)).collect()}
    assert common not in clean[0]["text"] and clean[0]["n_chars"] == len(clean[0]["text"]) and 100 not in clean
    assert line_rules.line_rules(documents(spark, rows).where("false")).count() == 0


def test_near_copies_do_not_deplete_each_other(spark):
    common, page = "this line stands on every page of the host", [words(k, 12) for k in range(8)]
    near = [(500 + k, "\n".join([*page[: k % 8], f"own{k} {page[k % 8]}", *page[k % 8 + 1 :], common]), "h") for k in range(300)]
    rows = [(k, f"{words(1000 + k, 30)}\n{common}", "h") for k in range(40)] + [(100, common * 2 + f"\n{common}\n{common}", "h")] + near
    clean = {r["doc_id"]: r["text"] for r in line_rules.cleaned(documents(spark, rows)).collect()}
    assert all(clean[d] == t.removesuffix("\n" + common) for d, t, _ in near)
    assert all(common not in clean[k] for k in range(40)) and len(clean[0].split()) == 30


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    items = [(k, words(1000 + k, r.choice([3, 14, 40]))) for k in range(12)] + [(50, None), (51, "")]
    rows = []
    for k in range(30):
        own = words(k, 60).split()
        if k % 2:
            item = items[k % 12][1].split()
            for _ in range(r.choice([0, 0, 1, 3])):
                item[r.randrange(len(item))] = "edit"
            own[20:20] = item
        rows.append((k, " ".join(own).title(), "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    edge = [(d and d + 1000, t, s) for d, t, s in EDGE]
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.leaks(documents(spark, rows + edge), bench, block_items=5).collect()}
    index, want, all_ = decontaminate.Items(*zip(*items, strict=True), 5, 15), {}, set()
    cache = decontaminate.WordHashes()
    for d, t, _ in rows:
        w = decontaminate.words_of(t)
        h, n = decontaminate.word_array(w, cache), np.array([len(x) for x in w])
        for i, size in enumerate(index.words):
            own = min(size, len(w))
            for s in range(len(w) - own + 1):
                sh, first = np.unique(decontaminate.ngram_hashes(h[s : s + own], 5), return_index=True)
                g = decontaminate.shingle_weights(n[s : s + own], 5)[first]
                like = int(g[np.isin(sh, index.sets[i])].sum()) / max(int(g.sum()), index.weight[i])
                far = int(np.bitwise_count(decontaminate.fingerprints(h[s : s + own], n[s : s + own], own)[0] ^ index.index.prints[i]))
                if like >= 0.8:
                    all_.add((d, index.ids[i]))
                    if far <= 15:
                        key = (d, index.ids[i])
                        want[key] = max(want.get(key, 0), like)
    short = {i for i, t in items if t and len(t.split()) < 5}
    assert got == want and len(want) >= 8 and any(i in short for _, i in got)
    assert len(got) >= 0.95 * len(all_)  # the fingerprints lose next to nothing
    left = decontaminate.without_leaks(documents(spark, rows + edge), bench)
    assert {x["doc_id"] for x in left.collect()} == {d for d, *_ in rows + edge} - {d for d, _ in got}
    none = bench.where("false")
    assert decontaminate.leaks(documents(spark, rows), none).count() == 0 and decontaminate.without_leaks(documents(spark, rows), none).count() == len(rows)


def test_ids_of_any_size(spark):
    """2^60 + 1 next to null stays what it is."""
    big, text = 2**60 + 1, license_scan.TEMPLATES["isc"] + " password=hunter2222"
    docs = documents(spark, [(big, text, "s"), (None, text, "s"), (big + 1, text.upper(), "s"), (5, "other words", "s")])
    bench = spark.createDataFrame([(big, license_scan.TEMPLATES["isc"]), (None, license_scan.TEMPLATES["isc"])], "item_id long, text string")
    ids = {big, None, big + 1}
    assert {r["doc_id"] for r in license_scan.licenses(docs).collect()} == ids
    leaks = decontaminate.leaks(docs, bench).collect()
    assert {r["doc_id"] for r in leaks} == ids and {r["item_id"] for r in leaks} == {big, None}
    assert {r["doc_id"] for r in packing.packed(docs).collect()} == ids | {5}
    assert {r["doc_id"] for r in secret_scan.secrets(docs).collect()} == ids | {5}
    assert {r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()} == {big, 5}
    chats = spark.createDataFrame([(c, t, "user", f"t{t}") for c in (None, -1, big, big + 1) for t in (None, big, big + 1)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(chats).where("action != 'insert'").collect()
    assert {(r["conv_id"], r["turn"]) for r in out} == {(c, t) for c in (None, -1, big, big + 1) for t in (None, big, big + 1)} and len(out) == 12
    first = [r for r in out if r["turn"] is None]
    assert len(first) == 4 and all(r["action"] == "keep" for r in first)


def test_hamming_index():
    r = np.random.default_rng(1)
    prints = r.integers(0, 2**63, 500, dtype=np.uint64)
    index = decontaminate.HammingIndex(prints, 15)
    q = prints[7] ^ np.uint64(0b1011 << 20)
    at, far = index.near(q)
    assert set(at.tolist()) == {k for k in range(500) if int(np.bitwise_count(prints[k] ^ q)) <= 15} and 3 in far


def test_quality_model(spark):
    rows = [(k, words(k, 40) if k % 2 else " ".join(f"{w}###" for w in words(k, 40).split()), "s") for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(1, None)], "doc_id long, quality int")
    docs = documents(spark, rows)
    out = quality_model.scored(docs, quality_model.train(docs, labels)).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 50 and sum(r["predicted"] == r["doc_id"] % 2 for r in held) > 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    none = quality_model.scored(documents(spark, EDGE), quality_model.train(documents(spark, EDGE), labels.where("false"))).collect()
    assert {r["score"] for r in none} == {0.5}


def test_ftrl_against_plain_updates(spark):
    """The sparse learner against dense FTRL-proximal written out for one coordinate at a time."""
    model, r, d = quality_model.Ftrl(), random.Random(4), {}
    for _ in range(200):
        at = np.array(sorted(r.sample(range(30), 6)))
        value, label = np.array([r.random() for _ in at]), r.randrange(2)
        model.update(at, value, label)
        x = [*zip(at.tolist(), value.tolist(), strict=True), (2**quality_model.BITS, 1.0)]
        w = {}
        for i, _ in x:
            z, n = d.get(i, (0.0, 0.0))
            w[i] = 0.0 if abs(z) <= 0.02 else -(z - (0.02 if z > 0 else -0.02)) / ((1 + n**0.5) / 1.0 + 0.5)
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x)))
        for i, v in x:
            z, n = d.get(i, (0.0, 0.0))
            g = (p - label) * v
            d[i] = z + g - ((n + g * g) ** 0.5 - n**0.5) * w[i], n + g * g
    assert all(abs(model.z[i] - z) < 1e-9 and abs(model.n[i] - n) < 1e-9 for i, (z, n) in d.items())


def test_html_extract(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>"
        "<article><h1>Title &amp; more</h1><p>First <b>bold</b>\n text.<p>Second&nbsp;part, with several words in it.<script>x('<p>')</script></p></article>"
        "<section class='comments'><p>A comment by a reader.</p></section><footer>&copy; 2020</footer></body></html>"
    )
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p"), (4, "u", "<p")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_extract.extract(rows).collect()
    assert out[0]["text"] == "Title & more\nFirst bold text.\nSecond part, with several words in it."
    assert [r["n_chars"] for r in out[1:3]] == [0, 0] and len(out) == 5
    assert html_extract.extract(rows.where("false")).count() == 0
    inside = "<p>First <script>x('<p>')</script>and <svg><text>no</text></svg>second <math><mi>x</mi><mo>=</mo><mn>2</mn></math><object>fallback</object></p><p>Next"
    assert [b.text for b in html_extract.blocks(inside)] == ["First and second x=2fallback", "Next"]
    field = html_extract.trained()
    from quarry.llm.labelled_pages import _Maker

    right = total = 0
    for seed in range(5000, 5040):
        own = html_extract.blocks(_Maker(seed).page())
        labels = field.decode(html_extract.features(own))
        right += sum((b.label == "main") == bool(y) for b, y in zip(own, labels, strict=True))
        total += len(own)
    assert right > 0.97 * total


def test_viterbi_against_all_labellings():
    r = random.Random(6)
    for _ in range(40):
        names = [[f"f{r.randrange(8)}" for _ in range(3)] for _ in range(r.randrange(1, 9))]
        field = html_extract.Field({f"f{k}": k for k in range(7)}, np.array([[r.gauss(0, 1), r.gauss(0, 1)] for _ in range(7)]), np.array([[r.gauss(0, 1), r.gauss(0, 1)] for _ in range(2)]))

        def score(labels, names=names, field=field):
            own = sum(field.w[field.names[f]][y] for x, y in zip(names, labels, strict=True) for f in x if f in field.names)
            return own + sum(field.t[a][b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(itertools.product((0, 1), repeat=len(names)), key=score)
        assert abs(score(field.decode(names)) - score(best)) < 1e-9


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 400
    pages = [(1, "http://a/\n%", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", "x" * 600_000), (2**60 + 1, "u", "long id")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("n", F.lit(1))
    path = f"file://{tmp_path}/w"
    warc_bundles.write_bundles(df, path)
    out = {r["page_id"]: r for r in warc_bundles.read_bundles(spark, path).collect()}
    assert len(out) == len(pages) and out[2**60 + 1]["page_id"] == 2**60 + 1 and out[1]["record_type"] == "revisit" and out[1]["refers_to"] == 2 and out[2]["refers_to"] is None and out[None]["refers_to"] == 2
    assert out[1]["url"] == "http://a/\n%" and out[1]["payload_bytes"] == len(big.encode()) and out[3]["record_type"] == out[4]["record_type"] == "response"
    got = warc_bundles.lookup(spark, path, warc_bundles.index_bundles(spark, path), spark.createDataFrame([(2,), (6,), (5,)], "page_id long")).collect()
    assert {r["page_id"]: r["html"] for r in got} == {2: big, 6: "x" * 600_000, 5: ""}
    warc_bundles.write_bundles(df.where("false"), path + "0")
    warc_bundles.write_bundles(df, path + "1", bundle_bytes=300)
    assert warc_bundles.read_bundles(spark, path + "1").count() == len(pages)


def test_packing(spark):
    r = random.Random(5)
    rows = [(k, words(k, r.choice([0, 3, 50, 900])), "s") for k in range(120)] + EDGE
    out = packing.packed(documents(spark, rows), capacity=256).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted(zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes()) for ids in ([*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x, _ in rows) for s in range(0, len(ids), 256))
    assert sorted(x["ids_crc32"] for x in out) == want
    by = {}
    for x in out:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.packed(documents(spark, rows).where("false")).count() == 0


def test_secrets(spark):
    plain = "password=hunter2222"
    twice = base64.b64encode(base64.b64encode(gzip.compress(plain.encode() * 2))).decode()
    for text in (f"a {base64.b64encode(plain.encode()).decode()} b", f"a {twice} b", "a password%3Dhunter2222 b", "a password\\u003dhunter2222 b", "a password\\u{3d}hunter2222 b", "a \\U00000070assword=hunter2222 b", "a pass%u0077ord=hunter2222 b"):
        base, found = secret_scan.spans(text)
        assert any(k == 0 and (s, e) == (2, len(text) - 2) for s, k, e in found) and "hunter" not in secret_scan.redacted(text)
    text = 'é Token : "abcdef" AKIA' + "Q" * 16 + " " + "0f" * 12 + " secret=abc"
    assert secret_scan.joined(secret_scan.spans(text)[0]) == "assign:2:17,access:19:39,hex:40:64"
    out = secret_scan.secrets(documents(spark, EDGE)).collect()
    assert len(out) == len(EDGE) and all(r["spans"] == "" for r in out)
    assert secret_scan.without_secrets(documents(spark, [(1, text, "s")])).first()["text"].startswith("é [assign]")


def test_secrets_in_every_copy():
    plain = "password=hunter2222"
    run = base64.b64encode(base64.b64encode(plain.encode())).decode()
    deep = base64.b64encode(f"{run} and {run}".encode()).decode()
    packed = base64.b64encode(gzip.compress(run.encode(), mtime=0)).decode()
    for x in (run, deep, packed):
        text = f"é {x} then {x}\n%C3%A9 {x}"
        at = [k for k in range(len(text)) if text.startswith(x, k)]
        assert len(at) == 3 and {(k, 0, k + len(x)) for k in at} <= set(secret_scan.spans(text)[1])
        assert secret_scan.redacted(text) == "é [assign] then [assign]\n%C3%A9 [assign]"


def wrapped(data, width=60):
    run = base64.b64encode(data).decode()
    return "\n".join(run[k : k + width] for k in range(0, len(run), width))


ENCODERS = {
    "base64": lambda t: base64.b64encode(t.encode()).decode(), "urlsafe": lambda t: base64.urlsafe_b64encode(t.encode()).decode(),
    "gzip": lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode(), "zlib": lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
    "bz2": lambda t: base64.b64encode(bz2.compress(t.encode())).decode(), "xz": lambda t: base64.b64encode(lzma.compress(t.encode())).decode(),
    "zstd": lambda t: base64.b64encode(zstandard.compress(t.encode())).decode(), "deep": lambda t: base64.b64encode(zlib.compress(bz2.compress(gzip.compress(t.encode())))).decode(),
    "percent": lambda t: "".join(f"%{b:02X}" for b in t.encode()), "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t), "wrapped": lambda t: wrapped(t.encode()),
    "members": lambda t: base64.b64encode(gzip.compress(b"first member") + gzip.compress(t.encode())).decode(), "frames": lambda t: base64.b64encode(zstandard.compress(b"one frame") + zstandard.compress(t.encode())).decode(),
    "binary": lambda t: base64.b64encode(bytes(range(128, 140)) + t.encode()).decode(), "control": lambda t: base64.b64encode(bytes(12) + t.encode()).decode(), "glued": lambda t: f"url/x/{base64.b64encode(t.encode()).decode()}",
    "glued zip": lambda t: f"path/{base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode()}",
}


@pytest.mark.parametrize("first", ENCODERS)
def test_secrets_through_every_pair_of_layers(first):
    for second in ENCODERS:
        text = f"é start {ENCODERS[second](ENCODERS[first]('password=hunter2222'))} end"
        found = secret_scan.spans(text)[1]
        assert any(k == 0 and 7 <= s < e <= len(text) - 3 for s, k, e in found), (first, second)
    assert secret_scan.spans(f"clean {ENCODERS[first]('nothing to see in this text')} end")[1] == []


def test_large_layers():
    for filler in (secret_scan.WINDOW, 2 * secret_scan.WINDOW + 77):
        run = base64.b64encode(zlib.compress(b"password=hunter2222 " + b"x y " * (filler // 4) + b" AKIA" + b"Q" * 16)).decode()
        assert secret_scan.joined(secret_scan.spans(f"a {run}")[1]) == f"assign:2:{len(run) + 2},access:2:{len(run) + 2}"


def test_base_spans_against_brute_force():
    """Each start of each kind is tried, leftmost first; then the next after its end."""
    r, alphabet = random.Random(11), ["password", "Token", "api_key", "=", ":", " ", '"', "a", "f0", "AKIA", "Q", "9", "_", "é", "\n", "0123456789abcdef01234567"]
    for _ in range(300):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
        want = []
        for kind, (name, least) in enumerate((("assign", 6), ("access", 20), ("hex", 24))):
            pattern, at = {"assign": secret_scan.ASSIGN, "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}[name], 0
            while at < len(text):
                m = pattern.match(text, at)
                if m and len(m[1] if kind == 0 else m[0]) >= least:
                    want.append((m.start(), kind, m.end()))
                at = m.end() if m else at + 1
        assert sorted(want) == secret_scan.spans(text)[0]


def test_licenses(spark):
    text = "é before. " + license_scan.TEMPLATES["mit"].upper() + " After."
    edited = license_scan.TEMPLATES["isc"].replace("purpose", "good purpose").replace("fee", "charge")
    out = license_scan.licenses(documents(spark, [(1, text, "s"), (2, edited, "s"), (3, "Licensed under CC BY-NC 4.0.", "s"), (4, words(1, 99), "s"), *EDGE])).collect()
    got = {(r["doc_id"], r["license"]): r for r in out}
    assert got[(1, "mit")]["coverage"] == 1.0 and text[got[(1, "mit")]["start"] : got[(1, "mit")]["end"]].endswith("SOFTWARE")
    assert 0.9 < got[(2, "isc")]["coverage"] < 1 and (3, "cc-by-nc-4.0-notice") in got and not any(d == 4 for d, _ in got)


def test_whole_licenses():
    own = license_scan.Templates(license_scan.TEMPLATES)
    bsd3 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + license_scan.BSD_DISCLAIMER
    mit = license_scan.TEMPLATES["mit"]
    terms = mit[: mit.index(" THE SOFTWARE IS PROVIDED")]
    cc = [license_scan.TEMPLATES[x] for x in ("cc-by-4.0-notice", "cc-by-sa-4.0-notice")]
    for text, want in ((mit, "mit"), (terms, "mit-terms"), (bsd3, "bsd-3-clause"), (license_scan.BSD + license_scan.BSD_DISCLAIMER, "bsd-2-clause"), (cc[0], "cc-by-4.0-notice"), (cc[1], "cc-by-sa-4.0-notice")):
        found = own.found(f"Before. {text} After.", 0.8, license_scan.WordHashes())
        assert [x[0] for x in found] == [want] and found[0][4] >= len("Before. ") + len(text.rstrip(".")) - 1


def test_gnu_notices():
    own = license_scan.Templates(license_scan.TEMPLATES)
    for name in ("gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0"):
        assert [(x[0], x[2]) for x in own.found(f"Before. {license_scan.TEMPLATES[name]} After.", 0.8, license_scan.WordHashes())] == [(name, 1.0)]


def test_license_files():
    """Whole texts of longer licenses, with words replaced, added and left out; a half of one is not reported."""
    texts = license_scan.whole_texts()
    own, r = license_scan.Templates(license_scan.TEMPLATES | texts), random.Random(3)
    for name in ("apache-2.0-text", "gpl-2.0-text", "cc0-1.0-text", "lgpl-3.0-text"):
        w = texts[name].split()
        edited = [x for k, x in enumerate(w) if k % 90 != 7]
        for k in range(5, len(edited), 40):
            edited[k] = r.choice(["other", f"{edited[k]} more"])
        for text, least in ((w, 1.0), (edited, 0.9)):
            found = [x for x in own.found(f"{words(4, 50)} {' '.join(text)} {words(5, 50)}", 0.8, license_scan.WordHashes()) if x[0].endswith("-text")]
            assert [x[0] for x in found] == [name] and found[0][2] >= least
        assert not any(x[0] == name for x in own.found(" ".join(w[: len(w) // 2]), 0.8, license_scan.WordHashes()))


def test_winnowing_takes_the_last_least_hash_of_every_window():
    r = np.random.default_rng(6)
    for n in range(12):
        grams = r.integers(0, 5, n).astype(np.uint64)
        wide = min(3, n)
        want = {max(j for j in range(i, i + wide) if grams[j] == min(grams[i : i + wide])) for i in range(n - wide + 1)} if n else set()
        assert license_scan.winnowed(grams, 3) == want


def plain_lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            best[j + 1], before = max(best[j + 1], best[j], before + 1 if x == y else 0), best[j + 1]
    return best[-1]


def test_alignment_against_plain_subsequence():
    r = random.Random(8)
    for _ in range(60):
        a = [r.choice("abcdefgh") for _ in range(30)]
        b = [x for x in a if r.random() > 0.1]
        for _ in range(3):
            b.insert(r.randrange(len(b)), r.choice("abcdefgh"))
        pairs = license_scan.aligned(a, b, 0, band=40)
        assert len(pairs) == plain_lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def brute_cost(roles):
    """Least cost by exhaustive search over states."""
    best = {chat_format.NONE: 0.0}
    for r in roles:
        new = {}
        for s, t, c, _, _ in chat_format.steps(r):
            if s in best:
                new[t] = min(new.get(t, 1e9), best[s] + c)
        best = new
    return min(c + chat_format.INSERT * len(chat_format.END[s]) for s, c in best.items())


@pytest.mark.parametrize("chunk", [3, 20_000])
def test_chat_format(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat_format, "CHUNK", chunk)
    r, rows = random.Random(2), []
    for conv in range(6):
        rows += [(conv, k, r.choice(["user", "assistant", "system", "human", None, "tool"]), f"t{k}") for k in range(r.choice([1, 4, 25]))]
    rows += [(None, 0, "user", "null id"), (9, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("clash"))
    out = chat_format.format_chats(df).collect()
    assert sum(x["action"] != "insert" for x in out) == len(rows)
    cost = {"keep": 0, "insert": chat_format.INSERT}
    for conv in {x[0] for x in rows}:
        own = sorted((x for x in out if x["conv_id"] == conv), key=lambda x: (x["turn"] is None and x["action"] == "insert" and conv != 9, -1 if x["turn"] is None else x["turn"], x["part"]))
        given = [x[2] for x in sorted((x for x in rows if x[0] == conv), key=lambda x: -1 if x[1] is None else x[1])]
        total, k = 0, 0
        for x in own:
            if x["action"] == "insert":
                total += cost["insert"]
                continue
            known = chat_format.ALIASES.get(given[k] or "")
            total += (chat_format.MERGE if x["action"] == "merge" else 0) + (0 if known and chat_format.ROLES[known] == x["role"] else chat_format.RELABEL if known else chat_format.RELABEL_UNKNOWN)
            k += 1
        assert total == brute_cost(given)
        text = "".join(x["rendered"] for x in own) if conv != 9 else ""
        roles = [p.split("|>")[0] for p in text.split("<|") if not p.startswith("end") and p]
        assert all(a != b for a, b in zip(roles, roles[1:], strict=False)) and (not roles or roles[-1] == "assistant" and text.endswith("<|end|>\n"))
    assert chat_format.format_chats(df.where("false")).count() == 0


def test_encoder_matches_the_tokenizer(monkeypatch):
    """Random strings of Latin-1, other scripts, composed letters, contractions and special tokens, with a cache that overflows."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 200)
    encoder, r = packing.Encoder(packing.tokenizer_path()), random.Random(7)
    latin = [chr(c) for c in range(256)]
    mixed = latin + [*"’“—İΣσςſKé́ñ中文😀"] + ["<|endoftext|>", "<|startoftext|>", "'s", "'RE", " ", " "]
    texts = ["", None, " \n"] + ["".join(r.choice(a) for _ in range(r.randrange(60))) for a in (latin, mixed) for _ in range(1500)]
    right = encoder.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert list(encoder.encode(texts)) == [np.array(e.ids, "<u4").tobytes() for e in right]
