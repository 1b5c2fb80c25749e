"""Joins, near duplicates, line and substring dedup, the quality classifier and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from concordat.llm import bpe, chunks, decontaminate, embeddings, jaccard, lines, quality, queries
from concordat.llm.common import components

WORD1 = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def regular(n):
    """Two words of n letters that a polynomial hash modulo 2^64 can't tell apart from n = 1024 on."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ac"[b] for b in bits), "".join("ca"[b] for b in bits)


def brute_components(vertices, linked):
    parent = {v: v for v in vertices}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {v: root(v) for v in vertices}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, 500 + k) for k in range(1, 80)] + [(None, 3), (7, 7)]
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = brute_components({v for e in real for v in e}, real)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- n-gram Jaccard join ---------------------------------------------------------------------


def shingles(text, size=5):
    w = WORD1.findall((text or "").translate(UPPER))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute_jaccard(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, brute_components(ids, linked)


def test_cells_lose_no_pair():
    """Every pair within the similarity shares a key, also at the very bound and for small sets."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 63, 64, 65, 128, 129, 500, 1500] * 6:
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        gone = int(rng.integers(0, n // 9 + 2))
        new = int(rng.integers(0, n // 9 + 2))
        b = np.concatenate([a[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both) and both < len(a) + len(b) - both:
            assert np.intersect1d(jaccard.cell_keys(a), jaccard.cell_keys(b)).size
            w = min(len(jaccard.bit_sketch(a)), len(jaccard.bit_sketch(b)))
            apart = np.bitwise_count((jaccard.fold(jaccard.bit_sketch(a), w) ^ jaccard.fold(jaccard.bit_sketch(b), w)).view(np.uint64)).sum()
            assert apart <= len(a) + len(b) - 2 * both <= jaccard.most_apart(len(a), len(b))


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 60))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice((3, 5, 8, 9, 20, 60, 150)))]
        for _ in range(rng.randint(1, 6)):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(x) // 30))):
                k = rng.randrange(len(x))
                rng.choice((lambda: x.insert(k, word()), lambda: x.__setitem__(k, word())))()
            texts.append(" ".join(x))
    texts += [" ".join(passage + [word() for _ in range(15)]) for _ in range(12)]
    chain = [word() for _ in range(80)]
    for _ in range(8):
        chain = chain[3:] + [word() for _ in range(3)]
        texts.append(" ".join(chain))
    texts += [texts[0], texts[0].upper(), None, "", "  "]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    sets, want = brute_jaccard(rows)
    got = jaccard.similar_components(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in want}
    assert len(set(want.values())) < len(want) - 10


def test_jaccard_odd_rows(odd_docs, no_docs):
    got = jaccard.similar_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == by[2] == by[0] == 0 and by[10] == 9 and by[7] == 7 and by[None] is None and by[3] == 3
    assert jaccard.similar_components(no_docs).count() == 0


# --- embeddings ------------------------------------------------------------------------------


def brute_vectors(rows, least=0.98):
    ok = {}
    for i, x, label in rows:
        if i is not None and label is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x):
            ok[i] = (np.array(x, np.float32).astype(np.float64), label)
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] / np.linalg.norm(ok[a][0]) / np.linalg.norm(ok[b][0]) >= least]
    comp = brute_components([i for i, _, _ in rows], links)
    return {i: (sum(i in e for e in links), comp[i]) for i in comp}


@pytest.mark.parametrize("block", [1024, 4])
def test_embeddings_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((len(rows), (base + rng.normal(size=16) * 0.12 * np.linalg.norm(base) / 4).tolist(), int(k % 3)))
    rows += [(len(rows) + j, rows[0][1], rows[0][2]) for j in range(10)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, rows[0][1], None), (n + 4, [None] * 16, 0), (n + 5, [], 0), (n + 6, rows[0][1][:8], rows[0][2]), (n + 7, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, n int, key string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute_vectors(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    again = spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [1.0, 0.01], 1), (5, [0.0, 1.0], 1), (6, [0.0, 1.0], 1), (5, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in embeddings.near_duplicates(again).collect()) == [(5, 1, 5, True), (5, 2, 5, True), (5, 2, 5, True), (5, 2, 5, True), (6, 1, 5, False)]


@pytest.mark.parametrize("pivots,dim,centres", [(256, 64, 0), (1024, 64, 0), (2048, 64, 0), (4096, 64, 0), (256, 384, 0), (256, 768, 0), (1024, 384, 50)])
def test_pivot_recall_at_the_threshold(pivots, dim, centres):
    """On random and on clustered vectors."""
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(centres, dim)) if centres else None
    draw = lambda n: rng.normal(size=(n, dim)) if middle is None else middle[rng.integers(0, centres, n)] + 0.5 * rng.normal(size=(n, dim))
    a = draw(1000)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    p = embeddings.spread(draw(2 * pivots), pivots)
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    listed = lambda x: embeddings.codes(np.argsort(-(x @ p.T), axis=1)[:, : embeddings.TOP]).tolist()
    assert np.mean([not set(x).isdisjoint(y) for x, y in zip(listed(a), listed(b))]) >= 0.99


def test_embeddings_of_any_size_of_number(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [2.0, 1.0]), (3, [1e200, 2e200]), (4, [1.01e200, 2e200]), (5, [5e-324, 1e-323]), (6, [1e308, -1e308])]
    got = {r["vec_id"]: r["component_id"] for r in embeddings.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 6}
    for kind in ("decimal(20,10)", "double", "int"):
        df = spark.createDataFrame([(1, [1, 2]), (2, [2, 4]), (3, [2, -1])], "vec_id long, embedding array<int>").selectExpr("vec_id", f"cast(embedding as array<{kind}>) embedding", "0 label")
        assert [r["component_id"] for r in embeddings.near_duplicates(df).orderBy("vec_id").collect()] == [1, 1, 3]
    near = [(1, [1.0, 100.0]), (2, [1.0, 100.0 + 1e-9]), (3, [16777217.0, 1.0]), (4, [16777216.0, 1.0])]
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, 0) for r in near], "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()
    assert [r["component_id"] for r in got] == [1, 1, 3, 3]


# --- line dedup ------------------------------------------------------------------------------


def brute_lines(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        ls = [] if t is None else t.split("\n")
        gone = set()
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if not "".join(w).strip():
                continue
            if seen.setdefault(w, (i, k)) != (i, k):
                gone.update((k, k + 1, k + 2))
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(ls) if k not in gone)
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "d e", " "]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, rows[5][1]), (104, "p\nq\nr\np\nq\nr")]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "doc_id long, text string, n_lines string, h int, __doc int, first int").repartition(4)
    got = lines.dedup_lines(df).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "h", "__doc", "first", "n_lines", "n_removed"}
    assert {r["doc_id"]: r["text"] for r in got} == brute_lines(rows)
    assert {r["doc_id"]: r for r in got}[104]["n_removed"] == 3 and {r["doc_id"]: r for r in got}[100]["n_lines"] is None


def test_lines_odd_rows(odd_docs, no_docs):
    got = lines.dedup_lines(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r["text"] for r in got if r["doc_id"] == 13} == {"x\ny"} and {r["text"] for r in got if r["doc_id"] == 12} == {"l1\nl2\nl3\nl4"}
    assert lines.dedup_lines(no_docs).count() == 0


# --- substring dedup -------------------------------------------------------------------------


def slow_edges(data):
    mask = (1 << 32) - 1
    h = []
    for i in range(len(data)):
        x = 0
        for b in data[max(0, i - chunks.HISTORY + 1) : i + 1]:
            x = ((x << 1) + int(chunks._GEAR[b])) & mask
        h.append(x)
    cut = [i + 1 for i in range(len(data) - 1) if all(h[i] < x for x in h[max(0, i - chunks.REACH) : i]) and all(h[i] <= x for x in h[i + 1 : i + 1 + chunks.REACH]) and h[i] < mask]
    out, at = [], 0
    for c in [*cut, len(data)]:
        while c - at > chunks.MOST + chunks.REACH or (c - at > chunks.MOST and at + chunks.MOST < c - chunks.REACH):
            at += chunks.MOST
            out.append(at)
        out.append(c)
        at = c
    start = lambda j: next((k for k in range(j, len(data)) if data[k] & 0xC0 != 0x80), len(data))
    return sorted({start(j) for j in out})


def test_gear_edges():
    rng = random.Random(1)
    for text in ("", "a", "ab" * 40, " " * 1000, "abcdefghij" * 150, "é" * 400, "".join(rng.choice("abcé漢 ") for _ in range(1500))):
        data = np.frombuffer(text.encode(), np.uint8)
        got = chunks.edges(data).tolist()
        assert got == (slow_edges(text.encode()) if text else [])
        assert all(b - a <= chunks.MOST + chunks.REACH + 4 for a, b in zip([0, *got], got))


def brute_substrings(rows, least=chunks.LEAST):
    """The whole result told again: runs from each chunk on, compared as text."""
    runs = {}
    for i, t in rows:
        raw = (t or "").encode()
        end = slow_edges(raw) if raw else []
        start = [0, *end[:-1]] if end else []
        runs[i] = [(a, next(e for e in end if e >= a + least)) for a in start if end[-1] >= a + least]
        runs[i] += [(runs[i][-1][0], end[-1])] if runs[i] and runs[i][-1][1] < end[-1] else []
    content = {i: [(t or "").encode()[a:b] for a, b in runs[i]] for i, t in rows}
    first, held = {}, {}
    for i in sorted(content):
        for k, c in enumerate(content[i]):
            first.setdefault(c, (i, k))
            held[c] = held.get(c, 0) + 1
    out = {}
    for i, t in rows:
        if t is None:
            out[i] = (None, None, None, None)
            continue
        earlier = [first[c] != (i, k) for k, c in enumerate(content[i])]
        raw, gone, rep = t.encode(), set(), set()
        for (a, b), e, c in zip(runs[i], earlier, content[i]):
            gone |= set(range(a, b)) if e else set()
            rep |= set(range(a, b)) if held[c] > 1 else set()
        out[i] = (bytes(raw[k] for k in range(len(raw)) if k not in gone).decode(), len(rep), len(gone), sorted({first[c][0] for e, c in zip(earlier, content[i]) if e}))
    return out


def test_substrings_against_brute_force(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqé", k=rng.randint(3, 9))) for _ in range(n))
    passages = [prose(60) for _ in range(12)]
    rows = [(i, " ".join(x for k in range(12) if rng.random() < 0.1 for x in (prose(20), passages[k])) + " " + prose(25)) for i in range(40)]
    rows += [(200, rows[3][1]), (201, None), (202, ""), (203, passages[0] * 3), (204, " " * 3000), (205, " " * 2000 + "x" + " " * 900), (206, "short")]
    one, two = regular(1 << 10)
    rows += [(300, f"{one} {prose(5)}"), (301, f"{two} {prose(5)}")]
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], "doc_id long, text string, removed string, __doc string, h1 int, id int").repartition(5)
    total = lambda spans: None if spans is None else sum(s["end"] - s["start"] for s in spans)
    out = chunks.dedup_substrings(df)
    assert out.columns == ["doc_id", "text", "__doc", "h1", "id", "n_chunks", "repeated", "removed", "sources"]
    got = {r["doc_id"]: (r["text"], total(r["repeated"]), total(r["removed"]), r["sources"]) for r in out.collect()}
    assert got == brute_substrings(rows)
    assert got[200][0] == "" and got[204][1] > 2500


def test_chance_chunks_make_no_run(spark):
    """Chunks from as many documents, none of which has two in a row."""
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefghijklmnopq", k=rng.randint(3, 9))) for _ in range(90))
    raw = text.encode()
    end = chunks.edges(np.frombuffer(raw, np.uint8)).tolist()
    bits = [raw[a:b].decode() for a, b in zip([0, *end], end)]
    filler = lambda: "".join(rng.choices("rstuvwxyz ", k=70))
    rows = [(i, filler() + b + filler()) for i, b in enumerate(bits)] + [(1000, text)]
    got = {r["doc_id"]: r for r in chunks.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000]["text"] == text and got[1000]["repeated"] == []


def test_passages_of_fifty_words_are_caught():
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopq", k=rng.randint(3, 9))) for _ in range(n))
    for _ in range(300):
        p = prose(51)
        one, two = (f"{prose(rng.randint(10, 40))} {p} {prose(20)}".encode() for _ in range(2))
        held = [set(zip(*(h.tolist() for h in chunks.digests(x, *chunks.runs(x, chunks.LEAST)[1:])))) for x in (one, two)]
        assert held[0] & held[1]


def test_substrings_odd_rows(odd_docs, no_docs):
    got = chunks.dedup_substrings(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r["text"] for r in got if r["doc_id"] == 2} == {""}
    assert chunks.dedup_substrings(no_docs).count() == 0


# --- quality ---------------------------------------------------------------------------------


def test_site_posteriors_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), rng.random() ** (1 + k % 3)) for k in range(400)] + [("rare", "x", 0.01)]
    sites, share = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p_doc double"))
    mean = lambda x: sum(x) / len(x)
    g = mean([p for *_, p in rows])
    hosts = {h: [p for a, _, p in rows if a == h] for h in {r[0] for r in rows}}
    k = quality.strength(g, mean([(mean(x) - g) ** 2 for x in hosts.values()]), mean([g * (1 - g) / len(x) for x in hosts.values()]))
    up = {h: (sum(x) + k * g) / (len(x) + k) for h, x in hosts.items()}
    paths = {(h, q): [p for a, b, p in rows if (a, b) == (h, q)] for h, q in {r[:2] for r in rows}}
    kp = quality.strength(g, mean([(mean(x) - mean(hosts[s[0]])) ** 2 for s, x in paths.items()]), mean([up[s[0]] * (1 - up[s[0]]) * (1 / len(x) - 1 / len(hosts[s[0]])) for s, x in paths.items()]))
    want = {s: (sum(x) + kp * up[s[0]]) / (len(x) + kp) for s, x in paths.items()}
    got = {(r["host"], r["path"]): (r["p_host"], r["p_path"]) for r in sites.collect()}
    assert abs(share - g) < 1e-12 and set(got) == set(want)
    assert all(abs(got[s][0] - up[s[0]]) < 1e-9 and abs(got[s][1] - want[s]) < 1e-9 for s in want)
    assert abs(got[("rare", "x")][1] - g) < abs(0.01 - g)


def test_quality_on_labels(spark, sf):
    sf = "/root/testdata/sf0.1"  # enough labels to hold some out
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    got = quality.classify(docs, quality.learn(docs, train), docs["source"], docs["lang"]).join(test, "doc_id").collect()
    bad = [r for r in got if r["toxic"] or not r["quality"]]
    good = [r for r in got if not r["toxic"] and r["quality"]]
    assert sum(r["keep"] for r in good) / len(good) >= 0.95
    assert sum(not r["keep"] for r in bad) / len(bad) >= 0.95


def test_classify_against_brute_force(spark, sf):
    """Chances, sites and decisions of all documents told again from the fitted weights."""
    import math

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    e = quality.learn(docs, labels)
    named = docs.withColumnsRenamed({"lang": "__h", "source": "__host"}).withColumn("h", docs["doc_id"])
    got = {r["doc_id"]: r for r in quality.classify(named, e, named["__host"], named["__h"]).collect()}
    rows = docs.collect()
    weight = dict(zip(e.words.tolist(), e.word_weight.tolist()))
    chance = {}
    for r in rows:
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        figures, words, _ = quality.describe(raw, np.array([0, len(raw)]))
        score = e.bias + sum(e.bin_weight[k, int((e.cuts[k] <= figures[0, k]).sum())] for k in range(quality.FIGURES))
        for w in set(words.tolist()) & weight.keys():
            score = score + np.array(weight[w])
        low, toxic = (1 / (1 + math.exp(-max(-40, min(40, x)))) for x in score)
        chance[r["doc_id"]] = (1 - low) * (1 - toxic)
    site = {r["doc_id"]: (r["source"], r["lang"]) for r in rows}
    mean = lambda x: sum(x) / len(x)
    g = mean(list(chance.values()))
    hosts, paths = {}, {}
    for i, s in site.items():
        hosts.setdefault(s[0], []).append(chance[i])
        paths.setdefault(s, []).append(chance[i])
    k = quality.strength(g, mean([(mean(x) - g) ** 2 for x in hosts.values()]), mean([g * (1 - g) / len(x) for x in hosts.values()]))
    up = {h: (sum(x) + k * g) / (len(x) + k) for h, x in hosts.items()}
    kp = quality.strength(g, mean([(mean(x) - mean(hosts[s[0]])) ** 2 for s, x in paths.items()]), mean([up[s[0]] * (1 - up[s[0]]) * (1 / len(x) - 1 / len(hosts[s[0]])) for s, x in paths.items()]))
    odds = lambda p: math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    for i, s in site.items():
        post = (sum(paths[s]) + kp * up[s[0]]) / (len(paths[s]) + kp)
        good = 1 / (1 + math.exp(-(odds(chance[i]) + odds(post) - math.log(g / (1 - g)))))
        assert abs(got[i]["p_doc"] - chance[i]) < 1e-9 and abs(got[i]["p_path"] - post) < 1e-7 and abs(got[i]["p_good"] - good) < 1e-6
        assert got[i]["keep"] == (good >= 0.5) or abs(good - 0.5) < 1e-6
    assert {"__h", "__host", "h", "text"} <= got[0].asDict().keys()


def test_labels_of_repeated_documents_count_once(spark):
    docs = spark.createDataFrame([(k, "good words here and there " * 3 if k % 2 else "bad junk words @@ ## " * 4) for k in range(60)] + [(0, "another text")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    e = quality.learn(docs, labels)
    got = {r["doc_id"]: r["p_low"] for r in quality.with_evidence(docs.where("doc_id > 0"), e, drop=True).collect()}
    assert all((p > 0.5) == (k % 2 == 0) for k, p in got.items())


def test_quality_odd_rows(odd_docs, no_docs, spark):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    for few in (labels, labels.limit(0)):
        evidence = quality.learn(odd_docs, few)
        got = quality.classify(odd_docs, evidence, F.col("source"), F.col("lang")).collect()
        assert len(got) == odd_docs.count() and all(0 <= r["p_good"] <= 1 for r in got)
        assert quality.classify(no_docs, evidence, F.col("source"), F.col("lang")).count() == 0


# --- pipeline --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd_folder(odd_docs, spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    odd_docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_keep_columns_and_odd_rows(spark, odd_folder, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, odd_folder)
        if name != "encode":
            assert out.columns == odd_docs.columns and dict(out.dtypes) == dict(odd_docs.dtypes)
        assert stage(spark, no_docs, odd_folder).count() == 0
        rows = out.collect()
        if name == "quality":
            assert len(rows) == odd_docs.count()
        if name == "near_duplicates":
            assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [0, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15] and sum(r["doc_id"] is None for r in rows) == 2
        if name == "decontaminate":
            assert {9, 10}.isdisjoint({r["doc_id"] for r in rows}) and len(rows) == odd_docs.count() - 3
    assert corpus_pipeline.run(spark, odd_folder).count() == 13


def test_pipeline_against_brute_force(spark, sf):
    """All stages after the classifier, whose decisions are taken as given, told again in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.keep_good(spark, docs, sf)
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 0 < len(rows) < docs.count()
    after = brute_lines(list(rows.items()))
    left = {i: t for i, t in after.items() if t == rows[i] or (t or "").strip()}
    _, comp = brute_jaccard(list(left.items()))
    left = {i: t for i, t in left.items() if comp[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    word = decontaminate.WINDOW
    w2 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = {}
    for i, t in items:
        w = w2.findall((t or "").translate(UPPER))
        for k in range(max(1, len(w) - word + 1) if w else 0):
            grams.setdefault(len(w[k : k + word]), set()).add(tuple(w[k : k + word]))
    clean = {}
    for i, t in left.items():
        w = w2.findall((t or "").translate(UPPER))
        hit = {p for n, g in grams.items() for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in g for p in range(k, k + n)}
        if not hit or 20 * len(hit) < len(w):
            clean[i] = t
    c = bpe.Coder(bpe.default_path())
    want = {}
    for i, t in clean.items():
        raw = (t or "").encode()
        ids, _, _ = c.encode_group(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest(), hashlib.sha256(raw).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_registry():
    assert {re.match(r"op\d+", n)[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.ORACLES) <= set(queries.QUERIES)
