"""Language-model scores, conversation repair and ranked search against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellmatch.llm import backoff_lm, treap_search, turn_repair, word_hash
from tests.llm.util import ODD, docs, prose

# ---- words


def test_word_hashes_follow_the_words(monkeypatch):
    monkeypatch.setattr(word_hash, "CHUNK", 64)
    rnd = random.Random(1)
    hashes = word_hash.WordHashes(word_hash.BLANKS)
    texts = ["".join(rnd.choice("aAbB \n\té") for _ in range(rnd.choice([0, 5, 30, 63, 64, 65, 300]))).encode() for _ in range(400)]
    texts += [None, b"", b"x" * 63, b"x" * 64, b"x" * 65, b" " + b"x" * 129 + b" y", b"x" * 64 + b" " * 200 + b"x"]
    found, counts = hashes.of(texts)
    words = [t.lower().split() if t else [] for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    seen = {}
    for word, h in zip(itertools.chain(*words), found.tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    for x in (found, found[:0], np.sort(found)):
        assert (word_hash.unpack(word_hash.pack(x)) == x).all()
    assert (word_hash.unpack(word_hash.pack(np.sort(found), True), True) == np.sort(found)).all()


# ---- language model


def _model(rows, learn, order):
    texts = [["<s>", *(t or "").encode().lower().split(), "</s>"] for _, t in rows]
    counts = Counter()
    for (i, _), w in zip(rows, texts):
        if learn(i):
            counts["<s>",] += 1
            for k in range(1, len(w)):
                counts.update(tuple(w[k - n + 1 : k + 1]) for n in range(1, order + 1) if k - n + 1 >= 0)
    singles = {g: n for g, n in counts.items() if len(g) == 1 and g != ("<s>",)}
    total = sum(singles.values())

    def p(context, word):
        if not context:
            return (singles.get((word,), 0) + 0.1) / (total + 0.1 * (len(singles) + 1))
        return (counts[(*context, word)] + backoff_lm.BACKOFF * p(context[1:], word)) / (counts[context] + backoff_lm.BACKOFF)

    out = []
    for w in texts:
        logs = lambda n: sum(math.log10(p(tuple(w[max(0, k - n + 1) : k]), w[k])) for k in range(1, len(w)))  # noqa: B023, E731
        out.append((len(w) - 1, sum((x,) in singles for x in w[1:]), total, logs(1), logs(order)))
    return out


@pytest.mark.parametrize("order,slab", [(1, 1 << 20), (2, 40), (3, 1 << 20), (3, 40), (4, 17)])
def test_scores_equal_brute_force(spark, monkeypatch, order, slab):
    monkeypatch.setattr(backoff_lm, "SLAB", slab)
    monkeypatch.setattr(backoff_lm, "STEPS", 7)
    monkeypatch.setattr(backoff_lm, "RANGE_KEYS", 500)
    rnd = random.Random(order)
    rows = ODD + [(100 + k, " ".join(rnd.choice(["a", "B", "b", "<s>", "é", "dd", "1"]) for _ in range(rnd.randrange(30)))) for k in range(60)]
    rows += [(200, prose(rnd, 130)), (201, rows[-1][1])]
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    found = backoff_lm.score_texts(docs(spark, rows), ~backoff_lm.held_out(F.col("doc_id")), order=order).collect()
    key = lambda r: (str(r[0]), r[1], r[2], round(r[4], 6), round(r[5], 6))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.learned) for r in found), key=key)
    want = sorted(((i, *w, learn(i)) for (i, _), w in zip(rows, _model(rows, learn, order))), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[6] == w[6]
        assert g[4] == pytest.approx(w[4], rel=1e-9, abs=1e-12) and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-12)


def test_probabilities_of_a_context_add_up():
    """All words and the unknown one, after each context of a small corpus."""
    words = np.sort(np.array([1, 2, 50, 60, 70], np.uint64))
    stream = np.array([1, 50, 60, 2, 1, 50, 50, 2, 1, 70, 2], np.uint64)
    doc = {"lead": np.ones(3, np.int64), "tokens": np.array([3, 3, 2]), "learn": np.array([True, True, False]), "row": np.arange(3)}
    slab = backoff_lm._Slab(doc, word_hash.pack(words), word_hash.pack(np.searchsorted(words, stream)), 3)
    learn = doc["learn"][slab.piece]
    totals = []
    for n in range(3):
        use = learn & (slab.gram[n] >= 0) & (slab.counted | (n == 0) & slab.opening)
        totals.append(np.bincount(slab.gram[n][use], minlength=len(slab.keys[n])))
    automaton = backoff_lm.Automaton(slab, totals, 6, 3)
    seen = [k for k in range(len(words)) if words[k] != 1]
    reached = {0, *automaton.first.tolist(), *automaton.targets.tolist()}
    assert len(reached) == 7
    for state in reached:
        logs = automaton.step(np.full(len(seen), state), np.array(seen))[1]
        # 70 is unknown and carries the probability of all unknown words.
        assert (10**logs).sum() == pytest.approx(1)


def test_scores_of_nothing(spark):
    assert backoff_lm.score_texts(docs(spark, []), F.lit(True)).count() == 0
    got = backoff_lm.score_texts(docs(spark, [(1, "a b"), (2, None)]), F.lit(None).cast("boolean")).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.learned) for r in got} == {(1, 3, 0, 0, 0.0, 0.0, False), (2, 1, 0, 0, 0.0, 0.0, False)}


# ---- conversations


def _best(rows):
    """Least (cost, edits) by going through the rows with the last role as state; rows: (initial, must go, cut)."""
    step = {(None, "s"): "s", (None, "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserts(state):
        while True:
            more = dict(state)
            for last, (cost, audit) in state.items():
                for r in "ua":
                    if (last, r) in step:
                        to = step[last, r]
                        more[to] = min(more.get(to, (10**9, "")), (cost + 3, audit + "I"))
            if more == state:
                return state
            state = more

    state = inserts({None: (0, "")})
    for initial, must_go, cut in rows:
        after = {}
        for last, (cost, audit) in state.items():
            ways = [(last, 4, "D")]
            if not must_go:
                ways += [(step[last, r], c + 3 * cut, e) for r, c, e in [(initial, 0, "K"), ("u", 3, "R"), ("a", 3, "R")] if (last, r) in step]
            for to, c, e in ways:
                after[to] = min(after.get(to, (10**9, "")), (cost + c, audit + e))
        state = inserts(after)
    return min(state[k] for k in (None, "a") if k in state)


def test_parser_equals_brute_force():
    kinds = [("u", 0, 0), ("a", 0, 0), ("s", 0, 0), ("x", 0, 0), ("u", 1, 0), ("u", 0, 1), ("a", 0, 1), ("s", 0, 1)]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            letters = "".join(turn_repair.letter_of(*r) for r in rows)
            assert turn_repair.cheapest(turn_repair.parse(letters)) == _best(rows), rows
    rnd = random.Random(3)
    for _ in range(300):
        rows = [rnd.choice(kinds) for _ in range(rnd.randrange(5, 60))]
        assert turn_repair.cheapest(turn_repair.parse("".join(turn_repair.letter_of(*r) for r in rows))) == _best(rows)


def test_any_split_gives_the_same_cell():
    """The full chart over all spans and all splits, next to one split a span."""
    rnd = random.Random(4)
    for _ in range(40):
        letters = "".join(rnd.choice("uaso-UAS") for _ in range(rnd.randrange(1, 9)))
        chart = {(k, k + 1): turn_repair._leaf(c) for k, c in enumerate(letters)}
        for length in range(2, len(letters) + 1):
            for k in range(len(letters) - length + 1):
                cells = {turn_repair._join(chart[k, m], chart[m, k + length]) for m in range(k + 1, k + length)}
                assert len(cells) == 1
                chart[k, k + length] = cells.pop()
        assert turn_repair.parse(letters) == chart[0, len(letters)]


SPACES = " \t\n\x0b\x0c\r"


def _repaired(rows):
    """Brute force of one conversation's damaged rows (turn, role, text), in order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        kind = "blank" if not text.strip(SPACES) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACES)[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(kind)
    cost, audit = _best([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults)])
    lines, k, last = [], 0, None
    for edit in audit:
        turned = {"u": "a"}.get(last, "u")
        if edit == "I":
            lines.append(turn_repair.ROLES[turned] + ":")
            last = turned
            continue
        _, role, text = rows[k]
        k += 1
        if edit == "K":
            lines.append(f"{role}:{text}")
            last = role[0]
        elif edit == "R":
            lines.append(f"{turn_repair.ROLES[turned]}:{text}")
            last = turned
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = Counter(faults)
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        told = ":".join(" " if x is None else str(x) for x in (conv, turn))
        h = zlib.crc32(told.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        now = out.setdefault(conv, [])
        if h:
            row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            now += [row] * (2 if h == 3 else 1)
    return out


def test_repairs_equal_brute_force(spark):
    rnd = random.Random(5)
    words = ["Yes.", "No!", "What?", "so \n", "Well. \t", "", " ", "é", None, "a.\n.", "x" * 20_000]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rnd.choice([1, 2, 3, 8, 20])):
            rows.append((conv, rnd.choice([turn, turn, turn, None, 3]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rnd.choice(words)))
    rows += rows[:30] + [(500, k, ["user", "assistant"][k % 2], f"line {k % 400}.") for k in range(3000)]
    schema = "conv_id long, turn long, role string, text string"
    # Further columns with names that are used inside.
    frame = spark.createDataFrame(rows, schema)
    for name in ("n", "kind", "digest", "_h", "part", "seq", "blank"):
        frame = frame.withColumn(name, F.lit("x"))
    want = {conv: _repaired(r) for conv, r in _damaged(rows).items()}
    damaged = turn_repair.damage(frame.repartition(8))
    got = turn_repair.repair_report(frame, damaged).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id]
    turns = turn_repair.Repair(damaged).turns().collect()
    for conv in (3, 500, None):
        lines = [f"{t.role}:{t.text}" for t in sorted((t for t in turns if t.conv_id == conv), key=lambda t: t.place)]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[conv][-1]
    nothing = turn_repair.repair_report(frame, damaged.where("false")).first()
    assert (nothing.audit, nothing.cost, nothing.repaired_sha256) == ("", 0, hashlib.sha256().hexdigest())
    assert turn_repair.repair_report(frame.where("false"), damaged.where("false")).count() == 0


# ---- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _ranked(rows, items, k):
    texts = [(i, Counter(t)) for i, t in ((i, _terms(t)) for i, t in rows) if t]
    total, df = sum(sum(c.values()) for _, c in texts), Counter(w for _, c in texts for w in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(_terms(text))
    out = set()
    for item, terms in wanted.items():
        scored = []
        for i, c in texts:
            m = 100 - 90 + 90 * sum(c.values()) * len(texts) // total
            score = sum(math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out |= {(item, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("block_docs,pass_terms", [(16384, 1 << 20), (7, 12)])
def test_search_equals_brute_force(spark, monkeypatch, block_docs, pass_terms):
    monkeypatch.setattr(treap_search, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(treap_search, "PASS_TERMS", pass_terms)
    monkeypatch.setattr(treap_search, "RANGES", 3)
    rnd = random.Random(6)
    pool = ["the", "The", "a", "x9", "É", "é-b", "rare%d", "w%d", "漢字"]
    text = lambda n: " ".join(p % rnd.randrange(40) if "%" in p else p for p in (rnd.choice(pool) for _ in range(n)))
    rows = ODD + [(100 + k, text(rnd.randrange(1, 60))) for k in range(150)] + [(400 + k, "the a the a") for k in range(30)]
    items = [(k, text(rnd.randrange(1, 12))) for k in range(12)] + [(20, None), (21, "!?"), (22, "unheard"), (23, "the"), (24, rows[20][1]), (24, "x9"), (None, "É b")]
    frame = spark.createDataFrame([(i, t, "x", "x") for i, t in items], "item_id long, text string, score string, term string")
    for k in (10, 3):
        got = treap_search.ranked_search(docs(spark, rows).repartition(3), frame, k).collect()
        assert {tuple(r) for r in got} == _ranked(rows, items, k) and len(got) == len(_ranked(rows, items, k))


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert treap_search.ranked_search(docs(spark, []), items).count() == 0
    assert treap_search.ranked_search(docs(spark, [(1, "a"), (2, "b")]), items.where("false")).count() == 0
    # A term in all documents has the weight 0 or more; one of two has some.
    assert [r.doc_id for r in treap_search.ranked_search(docs(spark, [(1, "a"), (2, "b"), (3, "b")]), items).collect()] == [1]


def test_treap_finds_each_cell():
    rnd = np.random.default_rng(7)
    points = np.unique(rnd.integers(0, 200, (500, 2)), axis=0)
    values = rnd.integers(1, 1000, len(points))
    treap = treap_search.Treap(*treap_search.Treap.build(points[:, 0], points[:, 1], values))
    for row in range(200):
        found = {}
        treap.best_columns(np.array([row]), np.array([3]), lambda: 1, lambda cols, sums: found.update(zip(cols.tolist(), sums.tolist())))
        assert found == {int(c): int(v) * 3 for (r, c), v in zip(points, values) if r == row}
