"""Vectors, conversations, pages, the pipeline and the registered queries."""

import base64
import hashlib
import importlib.util
import json
import math
import os
import random
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from bidlens.llm import chat, sharding, topk, warc
from bidlens.llm.oracles import ORACLES
from bidlens.llm.queries import QUERIES
from oracle_compare import TESTDATA, connect, difference

FOLDER = f"{TESTDATA}/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# --- Exact top-k ---------------------------------------------------------------

def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, 0.2, 12)]) for i in range(260)]
    rows += [(300 + i, rows[20][1]) for i in range(90)]  # a very common vector: scores tie
    rows += [(500, None), (501, []), (502, [0.1] * 11 + [math.nan]), (503, [math.inf] * 12), (504, [None] * 12),
             (None, [0.5] * 12), (40, rows[7][1]), (520, [0.3, -0.2]), (540, [0.1, 0.7])]
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 60)
    monkeypatch.setattr(topk, "STEP", 25)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, dim int, v string")
    got = defaultdict(list)
    for r in topk.top_k(df, topk.F.col("id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries = {i: v for i, v in reversed(good) if i % 20 == 0}
    assert set(got) == set(queries)
    for i in set(queries) - {40}:
        scored = sorted((-sum(a * b for a, b in zip(queries[i], v)), j) for j, v in good
                        if j != i and len(v) == len(queries[i]))[:20]
        assert got[i] == [(n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    assert topk.top_k(df.limit(0), topk.F.col("id") % 20 == 0).count() == 0


def test_top_k_with_pivots_far_out(spark, monkeypatch):
    """A few extreme vectors become pivots; clustered ones must still be told apart."""
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 0.5, (12, 16))
    rows = [(i, [float(np.float32(v)) for v in centres[i % 12] + rng.normal(0, 0.05, 16)]) for i in range(1500)]
    rows += [(2001 + i, [float(np.float32(v)) for v in rng.normal(0, 10.0**e, 16)]) for i, e in enumerate((5, 6, 6, 7))]
    for name, size in (("QUERY_BLOCK", 40), ("VECTOR_BLOCK", 200), ("STEP", 25)):
        monkeypatch.setattr(topk, name, size)
    far_out = np.array([[math.floor(64 * x) for x in v] for _, v in rows[-4:]], np.float64)
    monkeypatch.setattr(topk, "pivot_vectors", lambda vectors: {16: far_out})
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in topk.top_k(df, topk.F.col("id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    assert len(got) == 75
    for q, found in got.items():
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:20]
        assert found == [(i, -s) for s, i in scored]


# --- Chat ------------------------------------------------------------------------

HARD = [r"\### Assistant: </turn> ok", "####", "\\", "\\\\###</turn>", "< /turn></turn></turn>", "", "a\n### user: b </turn>\n",
        "👍 漢字", "\\</turn>\\", "###" * 500]


def test_rendering_is_reversible():
    for role in ["user", "assistant", "", "a:b", "\\###: ", "x </turn>"]:
        for text in HARD:
            shown, start, end = chat.render(role, text)
            assert chat.parse(shown) == (role, text)
            assert chat.unescape(shown[start:end]) == (text if role == "assistant" else "")
    with pytest.raises(ValueError):
        chat.parse("### user: a </turn> b </turn>\n")


def test_log_is_folded_and_read_back(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(HARD)) for c in (1, 2, None) for t in range(9)]
    rows += [(3, None, "assistant", None), (3, 0, None, "x"), (5, 1, "user", "long " * 50_000)]
    rows += [(9, t, "assistant", f"turn {t}") for t in range(3000)]  # one conversation holds most rows
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, message string")
    found = {r.conv_id: r for r in chat.format_and_read_back(chat.events_of_rows(df)).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert set(found) == set(groups)
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        got = found[conv]
        assert got.n_turns == len(turns) and got.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got.loss_chars == len(loss) and got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got.formatted_chars == sum(len(chat.render(r[2] or "", r[3] or "")[0]) for r in turns)
    log = chat.streamed_events(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"append", "regenerate", "edit"}
    assert {r.conv_id: r for r in chat.format_and_read_back(log).collect()} == found
    # Equal turns and repeated rows are messages of their own.
    twice = chat.format_and_read_back(chat.streamed_events(df.union(df))).collect()
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in twice} == {c: (2 * r.n_turns, 2 * r.loss_chars) for c, r in found.items()}
    assert chat.format_and_read_back(chat.events_of_rows(df.limit(0))).count() == 0


def test_events(spark):
    log = [(1, 0, "user", 1, 0, "append", "Hel"), (1, 0, "user", 1, 1, "append", "lo"), (1, 1, "assistant", 2, 0, "append", "first"),
           (1, 1, "assistant", 2, 2, "append", "sec"), (1, 1, "assistant", 2, 1, "regenerate", None), (1, 1, "assistant", 2, 3, "append", "ond"),
           (1, 0, "user", 1, 5, "edit", "Bye"), (1, 0, "user", 1, 6, "append", None), (1, 2, "assistant", 3, 0, "regenerate", None)]
    random.Random(0).shuffle(log)
    events = spark.createDataFrame(log, "conv_id long, turn long, role string, message long, seq long, kind string, text string")
    shown = [chat.parse(r.formatted) for r in chat.format_log(events).orderBy("turn").collect()]
    assert shown == [("user", "Bye"), ("assistant", "second"), ("assistant", "")]


# --- Web archive -------------------------------------------------------------------

@pytest.mark.parametrize("smallest", [0, 3])
def test_archive(spark, smallest):
    pages = [(1, "u", "same"), (2, "u\r\nX: y", "same"), (7, "u", "same"), (3, None, None), (4, "u", ""), (5, "u", "ab"), (6, "u", "ab"),
             (8, "u", "WARC/1.1\r\n\r\nX-Page: 9\r\n\r\n é👍"), (9, "u", "z" * 200_000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    rows = warc.archive_pages(df, smallest).collect()
    winner = {}
    for i, _, html in pages:
        winner[html or ""] = max(i, winner.get(html or "", i))
    assert len(rows) == len(pages)
    for r in rows:
        html = next(h or "" for i, _, h in pages if i == r.page_id)
        body, first = html.encode(), winner[html]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        revisit = len(body) >= smallest and r.page_id != first
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_repeated_pages_have_one_response(spark):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a")], "page_id long, url string, html string")
    assert sorted((r.record_type, r.refers_to) for r in warc.archive_pages(df).collect()) == [
        ("response", None), ("revisit", 1), ("revisit", 1)]


# --- Queries and pipeline -----------------------------------------------------------

def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(got, connect(FOLDER).execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", ["op1_sharding", "op8_pii"])
def test_query_covers_the_table(spark, name):
    ids = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    rows = QUERIES[name](spark, FOLDER).collect()
    assert len(rows) == len(ids) and {r.doc_id for r in rows} == ids


def test_sharding_query_against_plain_look_ups(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    filled = sharding.fill_table([f"shard-{i:03d}" for i in range(64)])
    slots = {d.doc_id: int(hashlib.md5(f"={d.doc_id}".encode()).hexdigest()[:15], 16) % 65537 for d in docs}
    assert sorted(map(tuple, QUERIES["op1_sharding"](spark, FOLDER).collect())) == sorted(
        (d.doc_id, len(d.text.encode()), slots[d.doc_id], filled[slots[d.doc_id]]) for d in docs)


def test_pipeline(spark):
    """Each stage's decisions against plain rules, on the small documents."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    at = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in at.collect()} if "text" in at.columns else {}
        at = corpus_pipeline.materialize(stage(spark, at, FOLDER), "stage")
        if name != "packing":
            assert at.columns == docs.columns
        seen.append((name, before, at))
    quality, exact, near, personal, packed = seen
    kept = {r.doc_id for r in quality[2].collect()}
    right = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.95
    texts = [" ".join(t.split()) for t in (r.text for r in exact[2].collect())]
    assert len(texts) == len(set(texts)) == len({" ".join(t.split()) for t in exact[1].values()})
    assert 0 < near[2].count() <= len(near[1])
    assert not personal[2].where("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.][a-z]' or n_chars <> length(text)").count()
    assert {r.doc_id for r in packed[2].collect()} == {r.doc_id for r in personal[2].collect()}


def test_entry_works_without_the_subpackage(tmp_path):
    """With both left out, the other queries are still there."""
    for name in ("bidlens", "tests", "__spark_entry__.py"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name != "bidlens" else (tmp_path / name).mkdir()
    for name in os.listdir(f"{ROOT}/bidlens"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/bidlens/{name}", tmp_path / "bidlens" / name)
    os.remove(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(f"{ROOT}/__spark_entry__.py").read())
    code = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                          env={**os.environ, "PYTHONPATH": str(tmp_path)})
    names, sql = json.loads(done.stdout.strip().splitlines()[-1])
    assert "pipeline" not in names and not set(QUERIES) & set(names)
    assert set(names) == set(entry.queries()) - set(QUERIES) - {"pipeline"} and set(sql) <= set(names)
    assert importlib.util.find_spec("bidlens.llm") is not None
