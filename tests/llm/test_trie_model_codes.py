"""The prefix trie, the language model and vector codes against brute force."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlens.llm import hmm, prefix_trie, vector_codes


# --- Prefix trie ------------------------------------------------------------------

def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(v[2], v[4]) for v in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members, below = defaultdict(set), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[b] for b in below[p]) or 1
        saved[p] = sum(saved[b] for b in below[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(rebuilt[c]) == len(p))))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below[p]), leaves[p], saved[p],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [20, prefix_trie.BLOCK_ARCS])
def test_prefix_trie(spark, block):
    rnd = random.Random(1)
    rows = [(c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bb", None, "👍c"]))
            for c in range(-150, 400, 3) for t in range(rnd.choice([0, 1, 2, 3, 8]))]
    rows += [(700, t, "u", f"x{t % 7}") for t in range(200)]  # one conversation with a large part of the turns
    rows += [(701, 1, "u", "same")] * 60 + [(c, 0, "u", "hello" * 3000) for c in range(900, 990)] + [(None, 1, "u", "z")]
    rows += [(c, t, "u", "q") for c in (1001, 1002) for t in range(zlib.crc32(str(c).encode()) % 6)]  # nothing is left of these
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {"id": F.lit(1), "key": F.lit("k"), "depth": F.lit("d")})
    assert {tuple(r) for r in prefix_trie.prefix_trie(df, block=block).collect()} == plain_trie(rows)


def test_prefix_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(empty).count() == 0


def test_list_rank_of_a_shuffled_list(spark):
    """Numbers say nothing about the order here, so random mates have to join the runs."""
    order = random.Random(5).sample(range(0, 4000, 2), 600)
    df = spark.createDataFrame([(a, b) for a, b in zip(order, [*order[1:], -1])], "arc long, next long")
    got = {r.arc: r.position for r in prefix_trie.list_rank(df, block=40).collect()}
    assert got == {a: i for i, a in enumerate(order)}


# --- Language model ----------------------------------------------------------------

def small_model(states=3, symbols=5, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Model(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, symbols))))


def path_probabilities(model, doc):
    """Every path of states with its probability together with the symbols."""
    for path in itertools.product(range(len(model.start)), repeat=len(doc)):
        p = model.start[path[0]] * model.emit[path[0], doc[0]]
        for a, b, s in zip(path, path[1:], doc[1:]):
            p *= model.step[a, b] * model.emit[b, s]
        yield path, p


@pytest.mark.parametrize("chunk", [2, 3, 100])
def test_likelihood_and_expected_counts(monkeypatch, chunk):
    monkeypatch.setattr(hmm, "CHUNK", chunk)
    monkeypatch.setattr(hmm, "UNIT_TOKENS", 7)
    rng, model = np.random.default_rng(1), small_model()
    docs = [rng.integers(0, 5, n) for n in (1, 4, 7, 2, 3, 8, 5, 1)]
    want = hmm.Model(np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)))
    logs = []
    for doc in docs:
        paths = list(path_probabilities(model, doc))
        total = sum(p for _, p in paths)
        logs.append(math.log(total))
        for path, p in paths:
            want.start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                want.step[a, b] += p / total
            for s, o in zip(path, doc):
                want.emit[s, o] += p / total
    assert np.allclose(hmm.log_likelihoods(model, docs), logs)
    found = hmm.Expected(model)
    found.add(docs)
    assert np.allclose(found.start, want.start) and np.allclose(found.step, want.step) and np.allclose(found.emit, want.emit)
    assert math.isclose(found.log, sum(logs))


TEXTS = ["The cat  sat\ton the mat", "", None, "Ärger mit der Katze\x0b und dem Ärger", "the the the THE", "x" * 500 + " the", "a b c d e f g",
         "unseen-a unseen-b the cat", "  ", "cat mat sat " * 400]


def test_scores_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BATCH_DOCS", 7)
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(None, "the null id"), (3, TEXTS[3]), (3, TEXTS[4])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, batch int").repartition(3)
    found = hmm.corpus(df)
    model, totals, logs = hmm.train(found, iterations=3)
    assert logs == sorted(logs)  # no iteration makes the training texts less likely
    assert np.allclose(model.emit.sum(1), 1) and np.allclose(model.step.sum(1), 1) and math.isclose(model.start.sum(), 1)
    split = lambda t: hmm.words(t or "") + [hmm.END]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    key = lambda w: w if len(w) <= hmm.LONG_WORD else b" " + hashlib.sha256(w).digest()
    per_symbol = defaultdict(list)
    for w, c in counts.items():
        per_symbol[hmm.symbol(key(w))].append(c)
    for s, c in per_symbol.items():  # what a symbol gives its words and one unseen one adds up to all
        assert totals[s] == sum(c) + 0.5 * len(c) + (0.5 if s != hmm.SYMBOLS else 0)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.held_out, r.n_known, r.train_tokens, round(r.base_score, 6),
                   round(r.score, 6)) for r in hmm.score(df).collect()))
    model, totals, _ = hmm.train(found)
    want = []
    for i, t in rows:
        w = split(t)
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        state, log = None, 0.0
        for x in w:
            s = hmm.symbol(key(x))
            state = (model.start if state is None else state @ model.step) * model.emit[:, s]
            log += math.log10(state.sum()) + math.log10((counts[x] + 0.5) / totals[s])
            state = state / state.sum()
        want.append((i is not None, i or 0, len(w), held(i), sum(counts[x] > 0 for x in w), n, round(base, 6), round(log, 6)))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want)):
        assert a[:6] == b[:6] and abs(a[6] - b[6]) < 1e-4 and abs(a[7] - b[7]) < 1e-4


def test_scores_of_nothing_and_without_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.score(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = hmm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert row.held_out and row.n_tokens == 3 and row.n_known == 0 and row.train_tokens == 0 and math.isfinite(row.score)


# --- Vector codes ----------------------------------------------------------------------

def plain_codes(vectors, parts=8, entries=16, rounds=6):
    """(order key, ints) rows to codes, errors and codebooks in Python integers."""
    rows = sorted(vectors)
    w = len(rows[0][1]) // parts
    split = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v in rows]
    books = [[list(s[p]) for s in split[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for s in split:
                groups[nearest(p, s[p])[1]].append(s[p])
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    final = [[nearest(p, s[p]) for p in range(parts)] for s in split]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for r, f in zip(rows, final)], digest


def test_vector_codes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(i % 5, 0.3, 16)], i % 3 if i % 7 else None) for i in range(300)]
    rows += [(400 + i, rows[5][1], 9) for i in range(120)]  # a very common vector
    rows += [(600 + i, [float(x) for x in rng.integers(-2, 3, 16)], 1) for i in range(80)]  # distances that tie
    rows += [(700, [1000.0] * 16, 2), (5, rows[6][1], 0), (None, rows[7][1], None)]
    odd = [(701, None, 1), (702, [], 1), (703, [0.1] * 15 + [math.nan], 1), (704, [math.inf] * 16, 1), (705, [None] * 16, 1),
           (706, [1.0] * 8, 1), (707, [1.0] * 17, 1), (708, [1e30] * 16, 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows + odd],
                               "vec_id long, embedding array<float>, label int, code string, part int").repartition(5)
    ints = [((i is None, i or 0), [math.floor(4096 * x) for x in v]) for i, v, _ in rows]
    want, digest = plain_codes(ints)
    got = vector_codes.compress(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error) for r in got) == sorted((*k, c, e) for k, c, e in want)
    assert {r.codebooks_sha256 for r in got} == {digest}
    labels = defaultdict(list)
    for i, _, label in rows:
        labels[(i is None, i or 0)].append(label)
    by_label = defaultdict(int)
    unique = {k: v[0] for k, v in labels.items() if len(v) == 1}
    for r in got:
        if (key := (r.vec_id is None, r.vec_id or 0)) in unique:
            by_label[unique[key]] += r.error
    for r in got:
        if (key := (r.vec_id is None, r.vec_id or 0)) in unique and unique[key] == 9:
            assert r.label_error == by_label[9]


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(i, [i / 8.0] * 8, None) for i in range(3)], "vec_id long, embedding array<double>, label string")
    want, digest = plain_codes([(i, [i * 512] * 8) for i in range(3)])
    got = vector_codes.compress(few).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == want and {r.codebooks_sha256 for r in got} == {digest}
    assert {r.label_error for r in got} == {0}
    assert vector_codes.compress(few.limit(0)).count() == 0


def test_bounds_settle_what_full_comparison_gives():
    rng = np.random.default_rng(9)
    v, book = rng.integers(-50, 50, (400, 4)), rng.integers(-50, 50, (16, 4))
    sizes = [4, 2, 5, 8, 3, 2]
    state, _ = vector_codes.compare_all(v, book, sizes[0])
    settled = 0
    for b in sizes[1:]:
        after = book + rng.integers(-4, 5, book.shape)
        moved = np.sqrt(((after - book) ** 2.0).sum(1)) * (1 + 1e-12)
        book = after
        raw = state.written()
        state = vector_codes.PartState.read(raw, state.near.shape[1])
        state, best, counts = vector_codes.move(v, book, moved, state, b)
        settled += int(counts[0])
        d2 = vector_codes.squared(v, book)
        assert (state.entry == d2.argmin(1)).all() and (best == d2.min(1)).all()
        for i in range(len(v)):  # the stored bounds hold for every other entry
            near = dict(zip(state.near[i], state.bound[i]))
            assert all(math.sqrt(d2[i, e]) >= near.get(e, state.outer[i]) for e in range(16) if e != state.entry[i])
    assert settled > 0
