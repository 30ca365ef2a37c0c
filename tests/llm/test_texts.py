"""The document operators against brute force, on texts with every odd case."""

import collections
import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from bidlens.llm import bpe, exact_dedup, near_dedup, packing, pii, quality, sharding  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, row string, doc string, `a.b` int"


def table(spark, texts, ids=None):
    """Documents with extra columns that clash with names used inside operators."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "r", "d", 7) for i, t in zip(ids, texts)], SCHEMA)


def odd_texts():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    base = " ".join(rng.choice(words) for _ in range(300))
    long = " ".join(rng.choice(words) for _ in range(30_000))
    edited = base.split()
    edited[150] = "changed"
    far = base.split()
    far[::20] = ["other"] * len(far[::20])
    odd = ["Hello wörld's it's 12 İ <|startoftext|> x ﬁ", "ΟΔΥΣΣΕΥΣ\x1cx\x85y", "é 漢字 👍🏽", "a" * 3000, "\t\n ", "x"]
    return [base, base.replace(" ", "\n\t"), base.upper(), " ".join(edited), " ".join(far), long, long, None, "", *odd]


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# --- Sharding ----------------------------------------------------------------

def test_table_is_what_taking_turns_gives_and_is_even():
    names = [f"s{i}" for i in range(7)]
    table_ = sharding.fill_table(names, 101)
    want, orders = {}, {}
    for n in names:
        offset, skip = sharding.preference(n, 101)
        orders[n] = iter([(offset + j * skip) % 101 for j in range(101)])
    while len(want) < 101:
        for k, n in enumerate(names):
            if len(want) < 101:
                want[next(s for s in orders[n] if s not in want)] = k
    assert [want[s] for s in range(101)] == table_
    assert max(Counter(table_).values()) - min(Counter(table_).values()) <= 1
    fewer = sharding.fill_table(names[:-1], 101)
    assert sum(a != b for a, b in zip(table_, fewer)) < 101 / 2


def test_shards_of_rows(spark, tmp_path):
    docs = table(spark, ["a", None, "c", "c"], [1, None, 3, 3])
    names = ["x", "y", "z"]
    rows = sharding.assign(docs, ["doc_id"], names, slots=101).collect()
    filled = sharding.fill_table(names, 101)
    for r in rows:
        key = "-" if r.doc_id is None else f"={r.doc_id}"
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101 and r.shard == filled[r.slot]
    assert len(rows) == 4 and sharding.assign(docs.limit(0), ["doc_id"], names).count() == 0
    sharding.write_shards(docs.drop("a.b"), str(tmp_path / "s"), ["doc_id"], names)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4
    with pytest.raises(ValueError):
        sharding.fill_table(names, 100)


def test_shards_hold_whole_rows_of_any_columns(spark, tmp_path):
    long_key = "k" * 500_000
    docs = spark.createDataFrame(
        [(long_key, "a", 1, "x" * 300_000), (long_key, "b", 2, ""), (None, None, None, None), ("c", "c", 3, "t"), ("c", "c", 3, "t")],
        "`key.1` string, Slot string, shard int, text string")
    names = [f"s{i}" for i in range(8)]
    stored = sharding.write_shards(docs, str(tmp_path / "s"), ["key.1"], names)
    assert stored.columns == ["key.1", "_Slot", "_shard", "text", "slot", "shard"]
    assert Counter(map(tuple, stored.select("`key.1`", "_Slot", "_shard", "text").collect())) == Counter(map(tuple, docs.collect()))
    assert len({(r.slot, r.shard) for r in stored.where("`key.1` like 'k%'").collect()}) == 1
    spread = sharding.assign(docs, ["key.1"], names, spread=["shard"])
    assert len({r.slot for r in spread.where("`key.1` like 'k%'").collect()}) == 2
    assert sharding.write_shards(docs.limit(0), str(tmp_path / "e"), ["key.1"], names).count() == 0


# --- Encoding and packing ------------------------------------------------------

def test_round_trip_is_the_librarys(spark, texts):
    tool = Tokenizer.from_file(PATH)
    rows = {r.doc_id: r for r in bpe.round_trip_digests(table(spark, texts), PATH).collect()}
    for i, text in enumerate(texts):
        ids = tool.encode(text or "", add_special_tokens=False).ids
        decoded = tool.decode(ids, skip_special_tokens=False)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_encode_and_decode_keep_columns(spark, texts):
    tool = Tokenizer.from_file(PATH)
    found = bpe.decode(bpe.encode(table(spark, texts), PATH), PATH).collect()
    for r in found:
        ids = tool.encode(r.doc.text or "", add_special_tokens=False).ids
        assert array("I", bytes(r.ids)).tolist() == ids and r.decoded == tool.decode(ids, skip_special_tokens=False)
        assert r.doc["a.b"] == 7
    assert bpe.encode(table(spark, []), PATH).count() == 0


def test_trie_on_random_words():
    tool, trie, words = Tokenizer.from_file(PATH), bpe.TrieEncoder(PATH), packing.WordwiseEncoder(PATH)
    assert all(trie.is_sound(i) for i in trie.ids.values())
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeéÀİΣß 12'.,<|>\n\t\x1f́漢👍stlmdvre") for _ in range(60)) for _ in range(400)]
    for text, ours, others in zip(texts, trie.encode_batch(texts), words.encode_batch(texts)):
        want = tool.encode(text, add_special_tokens=False).ids
        assert bpe.from_little_endian(ours).tolist() == want and ours == others


def test_packing(spark, texts):
    tool = Tokenizer.from_file(PATH)
    rows = packing.pack(table(spark, texts), PATH).collect()
    ids = [np.array([*tool.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    sequences = defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and r.start == 4096 * r.piece and zlib.crc32(part.tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack(table(spark, []), PATH).count() == 0


def test_plan_is_best_fit_document_by_document():
    rng = random.Random(9)
    for _ in range(30):
        lengths = [rng.choice([1, 2, 3, 5, 9, 10, 17, 20, 33, 50, 64, 100]) for _ in range(rng.randrange(1, 200))]
        plan = packing.plan_best_fit(Counter(lengths), 100)
        rooms = []
        for length in sorted(lengths, reverse=True):  # best fit, one piece after the other
            fitting = [i for i, room in enumerate(rooms) if room >= length]
            if fitting:
                rooms[min(fitting, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(100 - length)
        used = {first + (k // each) for _, _, n, first, each, _ in plan for k in range(n)}
        assert len(used) == len(rooms) and sum(p[2] for p in plan) == len(lengths)
        filled = Counter()
        for length, _, n, first, each, _ in plan:
            for k in range(n):
                filled[first + k // each] += length
        assert sorted(100 - v for v in filled.values()) == sorted(rooms)


# --- Exact copies ---------------------------------------------------------------

def exact_expected(texts, ids):
    groups = defaultdict(list)
    for i, t in zip(ids, texts):
        groups[normal(t)].append(i)
    return groups


@pytest.mark.parametrize("digest", ["sha256", "first letter"])
def test_exact_groups(spark, texts, digest):
    texts, ids = [*texts, "x", "same", "same"], [*range(len(texts)), 900, None, 901]
    weak = {} if digest == "sha256" else {"digest": lambda c: c.substr(1, 1).cast("binary")}
    rows = exact_dedup.exact_groups(table(spark, texts, ids), **weak).collect()
    groups = exact_expected(texts, ids)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): members for t, members in groups.items()}
    assert len(rows) == len(texts)
    for r in rows:
        members = by_sha[r.text_sha256]
        assert r.group_size == len(members) and r.keep_id == min(m for m in members if m is not None)
        assert r.kept == (r.doc_id == r.keep_id)


def test_exact_copies_go_and_columns_stay(spark, texts):
    docs = table(spark, [*texts, "rep", "rep"], [*range(len(texts)), 500, 500])
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert Counter(normal(r.text) for r in left.collect()) == Counter(exact_expected([*texts, "rep"], range(99)).keys())
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0


# --- Near copies ------------------------------------------------------------------

def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def near_expected(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_texts(texts):
    """Also a base with many edited copies, some of which only the base links to the rest."""
    rng = random.Random(8)
    base = [f"b{rng.randrange(500)}" for _ in range(200)]
    copies = []
    for k in range(60):
        words = list(base)
        for _ in range(k % 7):
            words[rng.randrange(200)] = f"e{k}"
        copies.append(" ".join(words))
    return [*texts, " ".join(base), *copies, "a b c", "A b  c", "one two three four five six"]


def test_near_groups(spark, texts):
    texts = near_texts(texts)
    roots, sizes = near_expected(texts)
    rows = {r.doc_id: r for r in near_dedup.near_groups(table(spark, texts)).collect()}
    assert [rows[i].component_id for i in range(len(texts))] == roots
    assert [rows[i].n_shingles for i in range(len(texts))] == sizes
    assert all(rows[i].kept == (roots[i] == i) for i in range(len(texts)))


def test_near_groups_of_repeated_and_null_ids(spark):
    same = " ".join(f"word{i}" for i in range(60))
    rows = near_dedup.near_groups(table(spark, [same, same, same + " more", "x", "", None], [4, 4, 9, None, 5, 5])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [
        (-1, -1, True), (4, 4, True), (4, 4, True), (5, 5, True), (5, 5, True), (9, 4, False)]


def test_near_copies_go(spark, texts):
    texts = near_texts(texts)
    docs = table(spark, [*texts, "a b c", None], [*range(len(texts)), None, 5000])
    left = near_dedup.drop_near_copies(docs)
    roots, _ = near_expected(texts)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted([*set(roots), 5000])
    assert near_dedup.drop_near_copies(docs.limit(0)).count() == 0


def edited(words, places, mark, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), places):
        words[at] = f"{mark}x{at}"
    return words


def links_by_brute_force(texts):
    """All linked pairs, from counts of the shingles that two or more texts share."""
    sets = [shingles(t) for t in texts]
    sizes, holders = np.array([len(s) for s in sets]), defaultdict(list)
    for i, s in enumerate(sets):
        for shingle in s:
            holders[shingle].append(i)
    wide = [h for h in holders.values() if len(h) > 2]
    has = np.zeros((len(texts), len(wide)), np.float32)
    for k, h in enumerate(wide):
        has[h, k] = 1
    common = has @ has.T
    for h in holders.values():
        if len(h) == 2:
            common[h[0], h[1]] += 1
            common[h[1], h[0]] += 1
    linked = 100 * common >= 75 * (sizes[:, None] + sizes - common)
    return [(i, j) for i, j in np.argwhere(np.triu(linked, 1)).tolist()]


def smallest_linked(n, links):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


def test_versions_of_a_long_text_meet(spark):
    """Each version is linked to the original alone, and each later version to its own version alone."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(20_000)}" for _ in range(3000)]
    versions = [edited(base, 74, f"v{k}", rng) for k in range(500)]
    later = [edited(v, 74, f"l{k}", rng) for k, v in enumerate(versions[:499])]
    texts = [" ".join(t) for t in [base, *versions, *later]]
    links = links_by_brute_force(texts)
    want = smallest_linked(len(texts), links)
    assert len(links) < 1100 and set(want) == {0}
    found = {r.doc_id: r.component_id for r in near_dedup.near_groups(table(spark, texts)).collect()}
    assert sum(found[i] != w for i, w in enumerate(want)) == 0


def test_pairs_among_pages_of_one_template(spark):
    """Pages of a template that are not linked, and pairs of them that are, in regions of hundreds of classes."""
    rng = random.Random(21)
    base = [f"t{k}" for k in range(400)]
    pages = [edited(base, 15, f"p{k}", rng) for k in range(1500)]
    texts = [" ".join(t) for t in [*pages, *[edited(p, 11, f"q{k}", rng) for k, p in enumerate(pages[:200])]]]
    links = links_by_brute_force(texts)
    want = smallest_linked(len(texts), links)
    assert 100 < len(links) < 400
    found = {r.doc_id: r.component_id for r in near_dedup.near_groups(table(spark, texts)).collect()}
    assert sum(found[i] != w for i, w in enumerate(want)) == 0


def test_every_pair_of_a_large_region_meets(spark):
    """2,000 classes in one region; the two that could be linked lie at its ends, in different runs."""
    rng = np.random.default_rng(3)
    minima = rng.integers(0, 1 << 32, (2000, near_dedup.HASHES), dtype=np.uint64).astype("<u4")
    minima[:, :4] = minima[0, :4]
    minima[-1, 16:] = minima[0, 16:]
    minima[0, 4], minima[-1, 4] = 0, 0xFFFFFFFF
    digests = [i.to_bytes(16, "big") for i in range(2000)]
    rows = [(d, 100, m.tobytes(), (m & 0xFF).astype(np.uint8).tobytes()) for d, m in zip(digests, minima)]
    classes = spark.createDataFrame(rows, "digest binary, n long, minima binary, sketch binary")
    # Only the order of the common minima: the pair shares others, which are regions of two.
    members = near_dedup.region_members(classes).where("size > 2")
    assert members.count() == 2000
    pair = (digests[0], digests[-1])
    assert pair not in {(bytes(r.a), bytes(r.b)) for r in near_dedup.candidate_pairs(members).collect()}
    blocks = near_dedup.block_members(members, classes, spark.createDataFrame([], "node binary, root binary"))
    key = ["region", "low", "high"]
    found = blocks.repartition(*key).sortWithinPartitions(*key).mapInArrow(near_dedup._meet, blocks.schema)
    assert tuple(sorted({bytes(r.digest) for r in found.collect()})) == pair


def test_star_contraction(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    links = spark.createDataFrame([(a, b) for a, b in pairs if a != b], "a long, b long")
    root = {}
    for a, b in pairs:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    found = {r.node: r.root for r in near_dedup.components(links).collect()}
    assert found == {n: r for n, r in root.items() if n != r}


# --- Personal data -------------------------------------------------------------------

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_expected(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            bad = (kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 8 <= len(number) <= 15
                   or kind == "card" and not (16 <= len(number) <= 19 and luhn(number)))
            if not bad:
                out.append((kind, m.start(), m.end()))
    return out


def personal_texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("ab1.25@+-() _%👍4\n") for _ in range(80)) for _ in range(150)]
    return [None, "", *made, "a@b.c_d@e.f.g a.b@c..d x@y @z.w", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3",
            "4539 1488 0343 6467 4539148803436467 1" + "2" * 30_000, "a" * 50_000 + "@b.c", "1" * 50_000, "+1" + " " * 20_000,
            "+1 (743) 555-3824 👍 +12 3", ".b" * 20_000 + "@x" + ".y" * 20_000]


def test_base_spans(spark):
    texts = personal_texts()
    rows = {r.doc_id: r for r in pii.report(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = base_expected(text)
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert rows[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), text
        assert [rows[i][f"n_{k}"] for k in FORMS] == [sum(k == w[0] for w in want) for k in FORMS]
        assert set(filter(None, line.split(","))) <= set(rows[i].spans.split(","))


def test_contexts_discover_unseen_identifiers(spark):
    texts = [f"please write to user{i}@mail.example.org today" for i in range(12)]
    texts += ["please write to admin@localhost today", "they saw admin@localhost again", "room 12 b today",
              "please write to nobody today"]
    rows = {r.doc_id: r.spans for r in pii.report(table(spark, texts)).collect()}
    assert rows[12] == "email:16:31" and rows[13] == "email:9:24" and rows[14] == "" and rows[15] == ""


def test_mask(spark):
    texts = [None, "", "clean text", "👍 mail a.b@c.org, ip 10.0.0.1.", "+1 (743) 555-3824 x"]
    docs = table(spark, texts).withColumn("n_chars", F.lit(3).cast("long"))
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    found = {r.doc_id: r for r in masked.collect()}
    assert [found[i].text for i in range(5)] == [None, "", "clean text", "👍 mail <EMAIL>, ip <IP>.", "<PHONE> x"]
    assert [found[i].n_chars for i in range(5)] == [3, 3, 3, len("👍 mail <EMAIL>, ip <IP>."), len("<PHONE> x")]
    assert pii.mask(docs.limit(0)).count() == 0


def test_phones_and_cards_are_discovered_by_whole_spans(spark):
    texts = [f"ring us at +1 (743) 555-38{i:02d} soon" for i in range(12)]
    texts += [f"paid with card 4539 1488 0343 64{n:02d} yesterday" for n in range(100) if luhn(f"45391488034364{n:02d}")]
    texts += [f"seen from host 10.0.0.{i} again" for i in range(12)]
    unseen = ["ring us at 743-555-3899 soon", "paid with card 4539148803436468 yesterday", "seen from host fe80:0:0:1:9:8 again",
              "seat 743-555-38 soon"]
    many = "".join(f"paid with card {10**15 + i} yesterday\n" for i in range(5))
    rows = {r.doc_id: r.spans for r in pii.report(table(spark, texts + unseen)).collect()}
    n = len(texts)
    assert rows[n] == "phone:11:23"
    assert rows[n + 1] == "card:15:31"
    assert rows[n + 2] == "ip:15:29" and rows[n + 3] == ""
    # Values that are no cards make the context doubtful; repeated rows and NULL ids get the same spans.
    found = pii.report(table(spark, [*texts, many, unseen[0], unseen[0]], [*range(n + 1), None, None])).collect()
    assert [r.spans for r in found if r.doc_id is None] == ["phone:11:23"] * 2 and len(found) == n + 3
    assert pii.report(table(spark, texts).limit(0)).count() == 0


def bootstrap_expected(edges, rounds, least_values):
    seeds = {(v, s) for _, v, s in edges if s is not None}
    seed_values, believed, found = {v for v, _ in seeds}, set(seeds), set()
    sizes = collections.Counter(p for p, _, _ in edges)
    for _ in range(rounds):
        hits = collections.Counter((p, k) for p, v, _ in edges for w, k in believed if w == v)
        accepted = {key: n / sizes[key[0]] for key, n in hits.items()
                    if n >= least_values and n / sizes[key[0]] >= pii.LEAST_SHARE}
        doubt = collections.defaultdict(lambda: 1.0)
        for p, v, s in edges:
            for (q, k), share in accepted.items():
                if q == p and s is None and v not in seed_values:
                    doubt[v, k] *= max(1 - share, 1e-3)
        found = {(v, k) for (v, k), d in doubt.items() if 1 - d >= pii.LEAST_SCORE and (k == 0) == ("@" in v)}
        believed = seeds | found
    return {v: min(k for w, k in found if w == v) for v, _ in found}


def test_scores_of_the_graph(spark):
    rng = random.Random(9)
    edges = {}
    for p in range(30):
        share = rng.choice([0.0, 0.95, 1.0, 1.0])
        for _ in range(rng.randrange(3, 40)):
            v = rng.randrange(60) if rng.random() < share else rng.randrange(60, 90)
            edges[f"p{p}", f"v{v}@x" if v < 80 else f"2025550{v:03d}"] = 0 if v < 45 else None
    # A chain: values that only patterns of the round before give.
    edges.update({("c1", f"v{i}@x"): 0 for i in range(40)} | {("c1", f"w{i}@x"): None for i in range(4)})
    edges.update({("c2", f"w{i}@x"): None for i in range(4)} | {("c2", "v1@x"): 0, ("c2", "z@x"): None})
    rows = [(p, v, s) for (p, v), s in edges.items()]
    df = spark.createDataFrame(rows, "pattern string, value string, seed int")
    for rounds in (1, 3):
        want = bootstrap_expected(rows, rounds, 5)
        assert {r.value: r.kind for r in pii.bootstrap(df, rounds, 5).collect()} == want and want


def test_a_text_with_very_many_matches(spark):
    text = "".join(f"user{i}@mail.org wrote\n" for i in range(200_000))
    row = pii.report(table(spark, [text])).first()
    assert row.n_email == 200_000
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base_expected(text)).encode()).hexdigest()
    assert pii.mask(table(spark, [text])).first().text == "<EMAIL> wrote\n" * 200_000


def test_masked_ranges_of_long_and_odd_texts(spark):
    texts = personal_texts() + ["👍" * 2_500 + " a.b@c.org " + "é" * 1_990 + " 10.0.0.1", "+4539148803436467 12", "x" * 1_000]
    found = {r.doc_id: r.text for r in pii.mask(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        out, at = "", 0
        for start, end, kind in sorted((s, e, list(FORMS).index(k)) for k, s, e in base_expected(text)):
            if start >= at:
                out += text[at:start] + f"<{list(FORMS)[kind].upper()}>"
            at = max(at, end)
        assert found[i] == (None if text is None else out + text[at:])


# --- Quality ---------------------------------------------------------------------------

def test_quality(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["the", "and", "river", "stone", "walks", "evening"]) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(rng.choice(["$$$", "###", "CLICK!!", "win|", "free|"]) for _ in range(40)) for _ in range(150)]
    texts = [t for pair in zip(good, bad) for t in pair] + [None, "", "river " * 20_000]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300)] + [(None, 1), (7, None), (99_999, 0)],
                                   "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(rows) == len(texts)
    for i in range(300):
        held = zlib.crc32(str(i).encode()) % 3 == 1
        assert rows[i].held_out == held and rows[i].predicted == int(rows[i].score >= 0.5)
        if held:
            assert rows[i].predicted == 1 - i % 2
    assert rows[300].score == rows[301].score and rows[302].predicted == 1
    # Repeated label rows count once, whatever their number; repeated documents are one.
    assert quality.training_sample(docs.union(docs), labels.union(labels), 1_000).count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(300))
    many = labels.union(spark.createDataFrame([(0, 1)] * 500, "doc_id long, quality int"))
    assert quality.training_sample(docs, many, 20).count() == 40
    # Labels of held-out rows play no part.
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality")
    assert {r.doc_id: r.score for r in quality.score(docs, turned).collect()} == {i: r.score for i, r in rows.items()}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in quality.score(docs, labels.where("quality = 1")).collect()} == {1}
