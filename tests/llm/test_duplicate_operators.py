"""Near-duplicates, repeated strings, embeddings, decontamination and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dwellmatch.llm import common, embedding_descent, latent_decontam, minhash_forest, suffix_dedup
from dwellmatch.llm.suffix_groups import suffix_array
from tests.llm.util import ODD, docs, prose


def reachable(ids, links):
    """Smallest id reachable from each."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("edges_per_task", [10, 500_000])
def test_components(spark, monkeypatch, edges_per_task):
    monkeypatch.setattr(common, "EDGES", edges_per_task)
    rnd = random.Random(6)
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(200, k) for k in range(201, 240)]
    pairs = [p for p in [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + chain + star + chain if p[0] != p[1]]
    shelf = common.Shelf(spark, "test")
    edges = spark.createDataFrame(pairs + [(None, 1), (1, None), (7, 7)], "a long, b long").repartition(8)
    got = {r.id: r.component for r in common.components(shelf, edges).collect()}
    want = reachable({x for p in pairs for x in p}, pairs)
    assert got == want
    more = spark.createDataFrame([(139, 201), (500, 501)], "a long, b long")
    first = common.merged(shelf, None, edges, "m0")
    got = {r.id: r.component for r in common.merged(shelf, first, more, "m1").collect()}
    assert got == reachable(set(want) | {500, 501}, [*pairs, (139, 201), (500, 501)])
    assert common.components(shelf, edges.where("false")).count() == 0


def _shingles(text, words):
    parts = (text or "").encode().lower().split()
    if not parts:
        return frozenset()
    return frozenset(tuple(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1)))


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    rnd = random.Random(7)
    base = [prose(rnd, 60).split() for _ in range(6)]
    rows = []
    for k in range(140):
        text = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
            text[rnd.randrange(len(text))] = prose(rnd, 1)
        rows.append((1000 + k, " ".join(text).upper() if k % 7 == 0 else " \n".join(text)))
    rows = [(i, t.replace("SÉ", "Sé")) for i, t in rows] + [(2000, "a b"), (2001, "A  b"), (2002, "b a"), (2003, prose(rnd, 3000))] + ODD
    got = minhash_forest.near_duplicates(docs(spark, rows), words=words).collect()
    assert len(got) == len(rows)
    sets = {i: _shingles(t, words) for i, t in rows}
    ids = sorted(i for i in sets if i is not None)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = reachable(ids, links)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert (r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))
    assert minhash_forest.near_duplicates(docs(spark, [])).count() == 0


def test_neighbours_come_with_their_groups(spark):
    """No join has to look the groups of both ends up for each pair that is found."""
    rows = [(0, b"\0" * 28 + bytes([0, 0, 0, k]), bytes(8), k, k // 3) for k in range(12)]
    table = spark.createDataFrame(rows, "tree int, key binary, tie binary, id long, group long").repartition(5)
    got = minhash_forest.sorted_neighbours(table, common.Shelf(spark, "test"), "order", 2).collect()
    # Of a run of one group only the ends are looked at.
    ends = [k for k in range(12) if k % 3 != 1]
    assert {(r.a, r.b) for r in got} == {(a, b) for i, a in enumerate(ends) for b in ends[i + 1 : i + 3] if a // 3 != b // 3}
    assert all((r.group_a, r.group_b) == (r.a // 3, r.b // 3) for r in got)


def test_copies_that_resemble_only_their_original(spark):
    """A star: each copy is linked with the original, and no copy with another."""
    rnd = random.Random(17)
    original = prose(rnd, 250).split()
    rows = [(5000, " ".join(original))]
    for k in range(1200):
        text = list(original)
        for part in range(5):
            text[50 * part + rnd.randrange(5, 45)] = f"w{k}x{part}"
        rows.append((1000 + k, " ".join(text)))
    sets = {i: _shingles(t, 5) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(alike(5000, i) >= 0.8 for i in sets) and not any(alike(1000, i) >= 0.8 for i in sets if i not in (1000, 5000))
    got = minhash_forest.near_duplicates(docs(spark, rows)).collect()
    assert {r.component_id for r in got} == {1000} and [r.doc_id for r in got if r.kept] == [1000]


def test_suffix_arrays():
    rng = np.random.default_rng(8)
    for _ in range(1500):
        text = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40))
        whole = text.tolist()
        assert suffix_array(text).tolist() == sorted(range(len(whole)), key=lambda k: whole[k:])


def _repeats(texts, length):
    starts = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            starts.setdefault(t[p : p + length], []).append((k, p))
    hit = [np.zeros(len(t), bool) for t in texts]
    for places in starts.values():
        if len(places) > 1:
            for k, p in places:
                hit[k][p : p + length] = True
    return hit


@pytest.mark.parametrize("crowd,piece", [(4096, 1 << 20), (1, 500)])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd, piece):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rnd = random.Random(9)
    length = 80
    pool = [prose(rnd, 60) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [prose(rnd, rnd.randrange(12))]
        for _ in range(rnd.randrange(4)):
            s = rnd.choice(pool)
            a = rnd.randrange(len(s))
            parts += [s[a : a + rnd.randrange(60, 200)], prose(rnd, rnd.randrange(6))]
        rows.append((100 + k, "é".join(parts)))
    rows += [(k, "-" * n) for k, n in ((300, 79), (301, 81), (302, 200))] + [(303, "ab" * 100), (304, rows[0][1] + "!"), (305, rows[0][1][1:])]
    rows += [r for r in ODD if r[0] != 6] + [(6, prose(rnd, 900))]
    got = suffix_dedup.remove_repeats(docs(spark, rows), length=length, with_text=True, carry=["source"]).collect()
    texts = [(t or "").encode() for _, t in rows]
    want = sorted(
        (str(i), len(t), int(h.sum()), int((np.diff(h.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~h])).hexdigest())
        for (i, _), t, h in zip(rows, texts, _repeats(texts, length))
    )
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(w[2] for w in want) > 3000 and all(r.carried.source == "s" for r in got)
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs(spark, []), length=20)


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((12, 16))
    rows = []
    for k in range(400):
        v = centres[rng.integers(12)] + rng.standard_normal(16) * rng.choice([0.02, 0.15, 0.3, 2.0])
        rows.append((k, [float(x) for x in v], int(rng.integers(3))))
    big = [float(x) for x in centres[0]]
    rows += [(400 + k, big, 7) for k in range(30)] + [(430, [x * 1e200 for x in big], 7), (431, [-x for x in big], 7)]
    odd = [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [float("nan")] + big[1:], 7), (504, [None] + big[1:], 7), (505, big, None), (506, [float("inf")] + big[1:], 7), (507, big[:5], 7), (None, big, 7), (508, big, 8), (508, big, 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit(1), "part": F.lit(2), "unit": F.lit(3), "a": F.lit(4)})
    got = embedding_descent.near_duplicates(df).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r.vec_id: r for r in got}
    x = np.array([np.array(r[1]) / np.linalg.norm(np.array(r[1]) / np.abs(r[1]).max()) / np.abs(r[1]).max() for r in rows])
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    want = reachable(range(len(rows)), list(zip(*np.nonzero(linked))))
    wrong = [k for k in range(len(rows)) if (found[k].n_links, found[k].component_id, found[k].kept) != (linked[k].sum(), want[k], want[k] == k)]
    assert not wrong and linked.sum() > 1000
    for i in (500, 501, 502, 503, 504, 505, 506, 507):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert (found[None].n_links, found[None].component_id, found[None].kept) == (0, None, True)
    assert all(r.n_links == 1 and r.kept for r in got if r.vec_id == 508)
    assert embedding_descent.near_duplicates(df.where("false")).count() == 0


def test_repeated_passages_of_short_words(spark):
    rnd = random.Random(21)
    short = lambda n: " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n))
    passage, few, long = short(51), short(50), " ".join("".join(rnd.choice("abcdefgh") for _ in range(12)) for _ in range(50))
    rows = [(k, f"{prose(rnd, 40)} <{k}> {part} <{k}> {prose(rnd, 40)}") for k, part in enumerate([passage, passage, few, few, long, long, short(51)])]
    df = spark.createDataFrame([(i, t, "en", "s", t and len(t)) for i, t in [*rows, (None, None)]], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.without_repeats(spark, df, "").collect()}
    assert {i: r.text for i, r in got.items() if i is not None} == {i: t.replace(passage, "") for i, t in rows}
    assert all(r.n_chars == len(r.text) for i, r in got.items() if i is not None)


@pytest.mark.parametrize("piece, words", [(1 << 19, 1 << 16), (300, 128)])
def test_passages_equal_brute_force(spark, monkeypatch, piece, words):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "WORDS", words)
    rnd = random.Random(12)
    parts = [prose(rnd, n) for n in (51, 50, 52, 70, 130, 60, 200)]
    blank = lambda: rnd.choice([" ", " ", "\n", "  ", "\t\r\n", "\x1c"])
    rows = []
    for k in range(60):
        text = prose(rnd, rnd.randrange(1, 80))
        for _ in range(rnd.randrange(4)):
            part = rnd.choice(parts)
            text += blank() + (part if rnd.random() < 0.6 else part.replace(" ", "  ", 1) if rnd.random() < 0.5 else part[rnd.randrange(40) :]) + blank() + prose(rnd, rnd.randrange(30))
        rows.append((k, text))
    rows += [(0, rows[0][1]), (1, rows[2][1] + " x"), (100, "de " * 300), (101, "de " * 51), (102, "de\n" * 60), (None, parts[4]), (None, prose(rnd, 90)), *ODD]
    found: dict[bytes, list] = {}
    for r, (_, text) in enumerate(rows):
        data = (text or "").encode()
        at = [m.span() for m in re.finditer(rb"\S+", data)]
        for w in range(len(at) - 50):
            found.setdefault(data[at[w][0] : at[w + 50][1]], []).append((r, at[w][0], at[w + 50][1]))
    gone = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    for places in found.values():
        for r, a, b in places if len(places) > 1 else ():
            gone[r][a:b] = True
    want = sorted((str(i), t and bytes(np.frombuffer(t.encode(), np.uint8)[~g]).decode(), int(g.sum())) for (i, t), g in zip(rows, gone) if t is not None)
    got = suffix_dedup.remove_passages(docs(spark, rows)).collect()
    assert sorted((str(r.carried.doc_id), r.kept_text, r.n_removed) for r in got if r.carried.text is not None) == want
    assert len(got) == len(rows) and all(r.kept_text is None and r.n_removed == 0 for r in got if r.carried.text is None)


def test_passages_have_few_anchors():
    """What is counted and shuffled grows with anchors: one in about 16 words, each passage within one of them."""
    data = prose(random.Random(4), 5000).encode()
    got = suffix_dedup.word_anchors(data, np.array([0]), 51, suffix_dedup.RollingHash(1), suffix_dedup.RollingHash(2))
    counts = [len(data[a:b].split()) - 50 for a, b in zip(got["start"], got["stop"])]
    assert sum(counts) == 5000 - 50 and min(counts) > 0 and len(counts) < 5000 / 12


def test_links_between_groups_larger_than_their_lists(spark, monkeypatch):
    rng = np.random.default_rng(20)
    x = np.zeros((300, 16))
    x[:240, :2] = np.repeat([[1, 0], [0.94, np.sqrt(1 - 0.94**2)]], [120, 120], axis=0)
    x[240:] = rng.standard_normal((60, 16))
    x[:240] += 0.002 * rng.standard_normal((240, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.93
    np.fill_diagonal(linked, False)
    want = reachable(range(300), list(zip(*np.nonzero(linked))))
    assert want[200] == 0 and linked[:120, 120:240].any() and (x @ x.T)[:120, 120:240].max() < (x @ x.T)[:120, :120].min()
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    for wide in (2048, 50):
        monkeypatch.setattr(embedding_descent, "WIDE", wide)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_descent.near_duplicates(df).collect()}
        assert got == {k: (linked[k].sum(), want[k]) for k in range(300)}


def test_benchmark_items_are_found(spark, monkeypatch):
    rnd = random.Random(11)
    items = [(k, f"{prose(rnd, rnd.randrange(12, 40))}. {prose(rnd, 8)}.") for k in range(25)] + [(90, None), (91, ""), (92, prose(rnd, 150))]
    rows, want = list(ODD), set()
    for k in range(120):
        text = prose(rnd, rnd.randrange(20, 200)).split()
        if k % 4 == 0:
            item, body = rnd.choice([i for i in items if i[1]])
            words = body.split()
            if k % 8 == 0:  # a paraphrase: one word in eight is another one, some are left out
                words = [prose(rnd, 1) if rnd.random() < 0.12 else w for w in words if rnd.random() < 0.95]
            at = rnd.randrange(len(text))
            text[at:at] = words
            want.add((1000 + k, item))
        rows.append((1000 + k, " ".join(text)))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for block in (512, 10):
        monkeypatch.setattr(latent_decontam, "ITEMS", block)
        got = latent_decontam.contaminated(docs(spark, rows), bench).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert latent_decontam.contaminated(docs(spark, []), bench).count() == 0
    assert latent_decontam.contaminated(docs(spark, rows), bench.where("false")).count() == 0


def test_items_that_many_documents_hold(spark):
    rnd = random.Random(18)
    hot, rare = f"{prose(rnd, 30)}. {prose(rnd, 8)}.", f"{prose(rnd, 30)}. {prose(rnd, 8)}."
    bench = spark.createDataFrame([(1, hot), (2, rare)], "item_id long, text string")
    for n, every in ((150, 3), (5, 2)):
        rows = [(k, " ".join([prose(rnd, 60), *[hot] * (k % every == 0), *[rare] * (k == 1), prose(rnd, 60)])) for k in range(n)]
        got = latent_decontam.contaminated(docs(spark, rows), bench).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == sorted([(k, 1) for k in range(0, n, every)] + [(1, 2)])


def test_short_items_of_a_long_benchmark(spark):
    rnd = random.Random(19)
    items = [(k, prose(rnd, rnd.randrange(15, 61))) for k in range(600)]
    spelt = lambda n: " ".join(rnd.choice(items)[1].split()[0] for _ in range(n))
    rows = [(k, f"{spelt(70)} {text} {spelt(70)}") for k, text in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = latent_decontam.contaminated(docs(spark, rows), bench).collect()
    assert {(k, k) for k, _ in items} <= {(r.doc_id, r.item_id) for r in got}
    assert all(len(b.queries) <= 100 or len(b.items) == 1 for b in latent_decontam.blocks_of([*items, (900, prose(rnd, 9000))], 100))


def test_alignment_weighs_words():
    weights = np.array([1.0, 2.0, 5.0])
    item = np.array([0, 1, 2, 1])
    assert latent_decontam.aligned(item, np.array([2, 0, 1, 1]), weights) == pytest.approx(max(7, 5) / 10)
    assert latent_decontam.aligned(item, item, weights) == 1
    assert latent_decontam.aligned(item, np.zeros(0, int), weights) == 0


def test_latent_candidates_reach_brute_force(spark):
    """Recall of the cosine search: pairs above the threshold by exact cosine are found in the latent space."""
    rnd = random.Random(12)
    block = latent_decontam.build_block([(k, prose(rnd, 40)) for k in range(40)])
    weights = np.ones(len(block.terms))
    table = spark.createDataFrame([(k, t.tolist()) for k, (_, t) in enumerate(block.queries)], "number int, terms array<long>")
    space = latent_decontam.latent_space(table, len(block.terms), weights, 40)
    exact = np.zeros((len(block.queries), len(block.terms)))
    for k, (_, terms) in enumerate(block.queries):
        np.add.at(exact[k], terms, 1)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    near = (exact @ space) @ (exact @ space).T
    assert np.abs(near - exact @ exact.T).max() < 1e-3


def _heaviest(item, region, weights):
    """Common subsequence by the plain table, for comparison."""
    table = [[0.0] * (len(region) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item):
        for j, y in enumerate(region):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (weights[x] if x == y else 0))
    return table[-1][-1] / sum(weights[x] for x in item)


def test_alignment_within_spans_equals_brute_force():
    rng = np.random.default_rng(3)
    for k in range(60):
        weights = rng.random(9) + 0.1
        item, region = rng.integers(0, 9, rng.integers(1, 12)), rng.integers(-1, 9, rng.integers(0, 60))
        starts, windows = latent_decontam.windows_of(region, 2 * len(item), max(1, len(item) // 2))
        got = latent_decontam.alignments(item, windows, weights)
        assert windows.shape == (len(starts), 2 * len(item))
        for at, share in zip(starts, got):
            assert share == pytest.approx(_heaviest(item, [t for t in region[at : at + 2 * len(item)]], weights))
        span = len(item) + len(item) // 2
        least = max((_heaviest(item, region[at : at + span], weights) for at in range(max(1, len(region) - span + 1))), default=0)
        assert least - 1e-9 <= got.max() <= _heaviest(item, region, weights) + 1e-9
        found = list(latent_decontam.copies(item, item[-1:], region, weights))
        assert all(0 <= share <= got.max() + 1e-9 or share <= 1 for share, _, _ in found)
        twice = np.concatenate([item, item, item])
        assert max(share for share, rest, _ in latent_decontam.copies(item, item[-1:], twice, weights) if rest == 1) >= 0.5


def test_strewn_words_of_an_item_are_no_copy(spark):
    rnd = random.Random(21)
    items = [(k, prose(rnd, 40)) for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for k, text in items:
        for n, times in enumerate((10, 20, 40, 80)):
            words = [w for _ in range(times) for w in rnd.sample(text.split(), 40)]
            rows.append((1000 + 10 * k + n, " ".join(words)))
        rows.append((2000 + k, prose(rnd, 200) + " " + text + " " + prose(rnd, 200)))
        rows.append((3000 + k, " ".join(w + " of the" * 2 if j % 10 == 0 else w for j, w in enumerate(text.split()))))
    rows += [(5000 + k, prose(rnd, 60)) for k in range(200)]
    got = latent_decontam.contaminated(docs(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted([(2000 + k, k) for k in range(20)] + [(3000 + k, k) for k in range(20)])
    assert all(0.35 <= r.cosine <= 1 for r in got)


def test_cosine_of_repeated_words_is_exact(spark):
    text = "alpha beta beta beta gamma gamma delta epsilon"
    bench = spark.createDataFrame([(1, text), (2, "zeta eta theta iota kappa")], "item_id long, text string")
    rows = [(1, text), (2, "beta " * 40 + text), (3, "lorem ipsum")]
    weights = {w: np.log((2 + 3) / (1 + n)) for w, n in {"alpha": 2, "beta": 2, "gamma": 2, "delta": 2, "epsilon": 2}.items()}

    def vector(words):
        return np.array([words.count(w) * weights[w] for w in weights])

    got = {r.doc_id: r.cosine for r in latent_decontam.contaminated(docs(spark, rows), bench).collect()}
    item = vector(text.split())
    for k, words in ((1, text.split()), (2, rows[1][1].split())):
        want = max(vector(words[a : a + 64]) @ item / np.linalg.norm(vector(words[a : a + 64])) / np.linalg.norm(item) for a in range(0, len(words), 32))
        assert got[k] == pytest.approx(want, abs=1e-3) if want >= 0.35 else k not in got


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(13)
    letters = {"aa": "abcdeé", "bb": "mnopqö"}
    word = lambda lang: "".join(rnd.choice(letters[lang]) for _ in range(rnd.randrange(3, 9)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows = [(k, text("aa" if k % 2 else "bb", 80), "aa" if k % 2 else "bb") for k in range(120)]
    passage, item = text("aa", 60), text("bb", 30)
    rows += [(200, rows[3][1], "aa"), (201, rows[3][1] + " x", "aa"), (202, None, "aa"), (203, "12 34", None), (204, text("aa", 30) + " " + passage, "aa"), (205, passage + " " + text("aa", 50), "aa"), (206, text("bb", 40) + " " + item, "bb"), (5, rows[5][1], "aa"), (None, text("aa", 40), "aa")]
    df = spark.createDataFrame([(i, t, lang, "s", t and len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "tokens":
            assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/out-{name}.parquet")
        now = spark.read.parquet(f"{tmp_path}/out-{name}.parquet")
        kept[name] = now.collect()
    ids = {name: sorted((r.doc_id for r in found), key=str) for name, found in kept.items()}
    start = sorted((r[0] for r in rows), key=str)
    assert ids["language"] == [i for i in start if i not in (202, 203)]
    assert ids["minhash"] == sorted(set(i for i in start if i not in (200, 201, 202, 203)), key=str)
    assert ids["repeats"] == ids["minhash"]
    cut = {r.doc_id: r for r in kept["repeats"]}
    whole = {r[0]: r[1] for r in rows}
    assert all(passage not in cut[i].text and len(cut[i].text) == cut[i].n_chars < len(whole[i]) for i in (204, 205))
    assert all(cut[i].text == whole[i] for i in ids["minhash"] if i not in (204, 205))
    assert ids["benchmark"] == [i for i in ids["repeats"] if i != 206]
    assert ids["tokens"] == ids["benchmark"] and all(r.decoded_sha256 == hashlib.sha256(cut[r.doc_id].text.encode()).hexdigest() for r in kept["tokens"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["tokens"])


def test_stage_keeps_texts_of_one_id_and_columns_of_any_name(spark):
    rnd = random.Random(14)
    texts = [prose(rnd, 60) for _ in range(6)]
    rows = [(3, texts[0]), (3, texts[1]), (4, texts[2]), (4, texts[2]), (5, texts[3]), (6, texts[3]), (7, texts[4]), (None, texts[5]), (8, None), (8, "")]
    df = docs(spark, rows)
    for name in ("block", "w0", "w7", "possible", "_key", "_row", "_possible"):
        df = df.withColumn(name, F.lit(777777))
    got = corpus_pipeline.one_of_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    found = got.collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(set(rows) - {(6, texts[3])}, key=str)
    assert {r[n] for r in found for n in ("block", "w0", "w7", "possible", "_key", "_row", "_possible")} == {777777}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_short_items_among_weightier_words_are_found(spark):
    """Their passages are dissimilar to them as a whole, so the cosine alone doesn't tell."""
    rnd = random.Random(23)
    items = [(k, prose(rnd, n)) for k, n in enumerate([1, 2, 4, 5, 6, 8, 10, 15] + [40] * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    heavy = [w for k, t in items if k >= 8 for w in t.split()]
    rows = [(k, " ".join([*rnd.sample(heavy, n), text, *rnd.sample(heavy, 200)])) for n in (0, 90) for k, text in items[:8]]
    rows = [(100 * n + k, text) for n, (k, text) in enumerate(rows)] + [(5000 + k, text.split()[0]) for k, text in items[8:]] + ODD
    got = latent_decontam.contaminated(docs(spark, rows), bench).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    assert len(found) == len(got)
    for n, (k, _) in enumerate([*items[:8], *items[:8]]):
        assert (100 * n + k, k) in found
    assert all(0 < r.cosine <= 1 and r.aligned >= 0.6 for r in got)
    assert min(r.cosine for r in got) < 0.35


def test_stretches_hold_what_an_alignment_may_weigh():
    rng = np.random.default_rng(5)
    for n in (1, 3, 20, 50):
        weights = rng.random(60) + 0.1
        item = rng.integers(0, 60, n)
        shares = np.zeros((60, 1), np.float32)
        np.add.at(shares[:, 0], item, weights[item] / weights[item].sum())
        words = rng.integers(0, 60, 3000)
        at = int(rng.integers(0, 3000 - 2 * n))
        words[at : at + 2 * n : 2] = item
        strip = np.arange(3000) // latent_decontam.STRIP
        wide = np.array([latent_decontam.strips_of(2 * n)])
        first = {int(s) for found, _ in latent_decontam.stretches(words, strip, shares, wide, 0.999) for s in found}
        assert at // latent_decontam.STRIP in first
    assert [latent_decontam.strips_of(n) for n in (1, 2, 33, 34, 65, 66)] == [1, 2, 2, 3, 3, 4]
