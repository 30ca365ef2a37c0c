"""Near-duplicate detection by an LSH forest over MinHash signatures.

A document's set is its distinct five-word shingles.  Documents with equal sets
are one class and only its representative goes on, so copies never meet in pairs.
A class has a signature of ``HASHES`` minima.  Each of ``TREES`` sorted orders
starts at another place of the signature; classes that share the first ``DEPTH``
minima of an order are a region of it.  A region of few classes is compared as a
whole.  A larger one is first sorted by the further minima and cut into runs of a
bounded length; in a run a class meets the neighbours with the longest common
prefix, the closest by sketch (the low byte of each minimum), and the run's hubs,
the classes closest to what most of it agrees on.  These pairs only find early
which classes of a large region belong together: orders are range-partitioned, so a
very large region lies in many tasks, and candidates per class are a fixed number.

Candidates must agree in their sketches in a number of places that a link misses
with a probability below 1e-7, and are then confirmed on the full sets, which are
built again for the documents concerned only.  Links make components by
alternating star contraction, one stored table per step.  Then every pair of a
large region whose classes are still in two components is compared by sketch and,
where that makes a link possible, by its full sets: classes are dealt into blocks
of bounded size, and each pair of blocks is one group of a task.  A pair is left
out only if its classes are in one component already, so what is found does not
depend on the first candidates.  The work of a region grows with the pairs of its
classes that are in different components.

A pair at the threshold shares no region in any order with probability
(1 - 0.75**DEPTH) ** TREES = 5e-6; pairs above it, and components with more than
one path, are safer.

Defined results: words are separated by blanks and ASCII white space only, and A-Z
count as a-z; fewer than five words are one shingle; texts without words, empty
or NULL, have no shingles and are linked with nothing; of a component the row
with the smallest id stays (NULL ids last, then row order), so of repeated rows
one; whole texts are read, however long; empty tables give no rows;
``drop_near_copies`` carries all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.llm.tables import null_last, unpacked, whole_row
from bidlens.session import materialize

WORDS = 5
THRESHOLD = 75  # per cent
TREES, DEPTH = 32, 4
HASHES = TREES * DEPTH
WHOLE_REGION, LONGEST_RUN = 8, 1024
NEIGHBOURS, CLOSEST, HUBS = 1, 2, 2
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 1 << 20
LEAST_AGREEING = 68  # of HASHES: 5.7 standard deviations below the mean at the threshold
BITMAP_BITS = 24
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RANDOM = np.random.default_rng(20240101)
FACTORS = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
WORD_FACTORS = _RANDOM.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    size = len(words) - WORDS + 1
    mixed = np.zeros(size, np.uint64)
    for i in range(WORDS):
        mixed = (mixed ^ (hashes[i:i + size] >> np.uint64(29))) * WORD_FACTORS[i] + hashes[i:i + size]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed * WORD_FACTORS[0])


def signature(shingles: np.ndarray, rows: int = 512) -> np.ndarray:
    """The minima of ``HASHES`` mixed copies of the set, in slices of a bounded size."""
    lowest = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(31)).astype(np.uint32)
    for start in range(0, len(short), rows):
        mixed = short[start:start + rows, None] * FACTORS
        mixed ^= mixed >> np.uint32(16)
        mixed *= np.uint32(0x45D9F3B)
        np.minimum(lowest, mixed.min(0), out=lowest)
    return lowest


def sketch(minima: np.ndarray) -> np.ndarray:
    """The low byte of each minimum: the high ones of a large set's minima are all zero."""
    return (minima & np.uint32(0xFF)).astype(np.uint8)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from bidlens.llm.bpe import slices

    for batch in batches:
        for start, texts in slices(batch.column(3)):
            n, digests, minima, sketches = [], [], [], []
            for text in texts:
                s = shingle_set(text)
                n.append(len(s))
                if len(s):
                    m = signature(s)
                    digests.append(hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest())
                    minima.append(m.astype("<u4").tobytes())
                    sketches.append(sketch(m).tobytes())
                else:
                    for column in (digests, minima, sketches):
                        column.append(None)
            kept = [batch.column(i).slice(start, len(texts)) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n, pa.int64()), *[pa.array(c, pa.binary()) for c in (digests, minima, sketches)]],
                names=["doc", "row", "text_hash", "n", "digest", "minima", "sketch"])


def with_signatures(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """doc (the columns of ``keep``), row, text_hash, n, digest, minima, sketch."""
    doc_type = docs.select(whole_row(keep).alias("doc")).schema["doc"].dataType
    source = docs.select(
        whole_row(keep).alias("doc"),
        F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("doc", doc_type), T.StructField("row", T.LongType()), T.StructField("text_hash", T.LongType()),
        T.StructField("n", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("digest", "minima", "sketch")]])
    return materialize(source.mapInArrow(_sketched, schema), "signatures")


def set_classes(signed: DataFrame, doc_id: str) -> DataFrame:
    """One row per different set: digest, first (missing, value, tie0 = row), n, minima, sketch, text_hash."""
    return materialize(signed.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min(null_last(F.col(f"doc.{doc_id}"), F.col("row"))).alias("first"), F.first("n").alias("n"),
        F.first("minima").alias("minima"), F.first("sketch").alias("sketch"), F.min("text_hash").alias("text_hash")),
        "set-classes")


def region_members(classes: DataFrame) -> DataFrame:
    """region, tree, size, label, digest, n, sketch of every class in a region of two or more; ``label`` orders a region."""
    width = 4 * DEPTH
    twice = F.concat("minima", "minima")
    places = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(
        t.alias("tree"), F.xxhash64(t, F.substring(twice, t * width + 1, F.lit(width))).alias("region"),
        F.substring(twice, (t + 1) * width + 1, F.lit(width)).alias("label")))
    placed = classes.select("digest", F.explode(places).alias("p")).select("p.region", "p.tree", "p.label", "digest")
    shared = materialize(placed.groupBy("region").agg(F.count("*").alias("size")).where("size > 1"), "regions")
    return materialize(placed.join(shared, "region").join(classes.select("digest", "n", "sketch"), "digest")
                       .select("region", "tree", "size", "label", "digest", "n", "sketch"), "members")


def chunk_pairs(sketches: np.ndarray) -> np.ndarray:
    """Index pairs worth comparing in a run of one region, in the order's sequence; shape (pairs, 2).

    Few classes: all pairs.  More: neighbours with the longest common prefix, the
    closest by sketch, and the two classes closest to what most of the run agrees
    on, which is where the original of a large group of copies shows.
    """
    m = len(sketches)
    if m <= WHOLE_REGION:
        return np.argwhere(np.triu(np.ones((m, m), bool), 1))
    places = np.arange(m)
    common = np.bincount((sketches + np.arange(HASHES, dtype=np.int64) * 256).ravel(), minlength=HASHES * 256)
    hubs = np.argsort(-(sketches == common.reshape(HASHES, 256).argmax(1)).sum(1), kind="stable")[:HUBS]
    found = [np.column_stack([places[:-k], places[k:]]) for k in range(1, NEIGHBOURS + 1)]
    found += [np.column_stack([places, np.full(m, hub)]) for hub in hubs]
    for start in range(0, m, 64):
        agreeing = (sketches[start:start + 64, None, :] == sketches[None, :, :]).sum(2)
        rows = places[start:start + 64]
        agreeing[np.arange(len(rows)), rows] = -1
        close = np.argpartition(-agreeing, CLOSEST - 1, axis=1)[:, :CLOSEST]
        found.append(np.column_stack([np.repeat(rows, CLOSEST), close.ravel()]))
    return np.concatenate(found)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted members to likely pairs (a, b); holds one run of a region at a time."""
    def pairs(run: list[tuple]) -> pa.RecordBatch | None:
        if len(run) < 2:
            return None
        sketches = np.frombuffer(b"".join(r[2] for r in run), np.uint8).reshape(-1, HASHES)
        n = np.array([r[1] for r in run], np.int64)
        left, right = chunk_pairs(sketches).T
        small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
        good = (left != right) & (100 * small >= THRESHOLD * large)
        good[good] = (sketches[left[good]] == sketches[right[good]]).sum(1) >= LEAST_AGREEING
        if not good.any():
            return None
        made = {(min(run[i][0], run[j][0]), max(run[i][0], run[j][0])) for i, j in zip(left[good], right[good])}
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*made)], names=["a", "b"])

    region, run = None, []
    for batch in batches:
        for now, *member in zip(*[column.to_pylist() for column in batch.columns]):
            if now != region or len(run) >= LONGEST_RUN:
                if (out := pairs(run)) is not None:
                    yield out
                region, run = now, []
            run.append(member)
    if (out := pairs(run)) is not None:
        yield out


def candidate_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) whose sketches make a link possible."""
    # Only a large region may lie in more than one task.
    large = F.col("size") > WHOLE_REGION
    dealt = members.repartitionByRange("region", F.when(large, F.col("label")), F.when(large, F.col("digest")))
    return (dealt.sortWithinPartitions("region", "label", "digest").select("region", "digest", "n", "sketch")
            .mapInArrow(_candidates, "a binary, b binary").distinct())


def block_members(members: DataFrame, classes: DataFrame, stars: DataFrame) -> DataFrame:
    """Classes of the large regions that hold several components, once for each pair of blocks they are in.

    region, low, high (the blocks), second (whether the class is of block ``high``, not ``low``), tree, digest, n,
    minima, root.
    """
    nodes = stars.select(F.col("node").alias("digest"), "root")
    placed = (members.where(F.col("size") > WHOLE_REGION).select("region", "tree", "digest", "n")
              .join(nodes, "digest", "left").withColumn("root", F.coalesce("root", "digest")))
    regions = materialize(
        placed.groupBy("region").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"),
                                     F.min("root").alias("least"), F.max("root").alias("most"))
        .where("least <> most").select("region", F.greatest(
            F.ceil(F.col("size") / BLOCK_CLASSES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("blocks")), "split-regions")
    own = placed.join(regions, "region").withColumn("own", F.pmod(F.xxhash64("digest"), "blocks"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return each.join(classes.select("digest", "minima"), "digest").select(
        "region", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).alias("second"), "tree", "digest", "n", "minima", "root")


def linked_with(i: int, others: np.ndarray, codes: list[np.ndarray], mark: np.ndarray) -> np.ndarray:
    """Those of ``others`` whose sets are linked with set ``i``; ``mark`` is all false before and after."""
    sizes = np.array([len(codes[j]) for j in others])
    mark[codes[i]] = True
    common = np.add.reduceat(mark[np.concatenate([codes[j] for j in others])], np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
    mark[codes[i]] = False
    return others[100 * common >= THRESHOLD * (len(codes[i]) + sizes - common)]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks, sorted, to what may be linked across components in them; holds one pair of blocks at a time.

    Without full sets, the rows that have a possible partner; with them, links
    (a, b): of each two components that are linked here, at least a path.  A pair
    that shares more regions is looked at in the first of them only.
    """
    def pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        block = pa.Table.from_batches(rows).combine_chunks()
        roots = np.unique(np.array(block["root"].to_pylist(), object), return_inverse=True)[1]
        if not roots.any():
            return None
        m, n, second = len(roots), block["n"].to_numpy(), block["second"].to_numpy()
        minima = np.frombuffer(b"".join(block["minima"].to_pylist()), "<u4").reshape(m, HASHES)
        sketches, regions, tree = sketch(minima), minima.reshape(m, TREES, DEPTH), block["tree"][0].as_py()
        across = block["low"][0].as_py() != block["high"][0].as_py()
        tested, useful, links = "shingles" in block.column_names, np.zeros(m, bool), []
        if tested:
            sets = [np.frombuffer(s, "<u8") for s in block["shingles"].to_pylist()]
            whole = np.unique(np.concatenate(sets), return_inverse=True)[1]
            codes, mark = np.split(whole, np.cumsum(n)[:-1]), np.zeros(int(whole.max()) + 1, bool)
        for i in np.flatnonzero(~second) if across else range(m):
            apart = (roots != roots[i]) & (100 * np.minimum(n, n[i]) >= THRESHOLD * np.maximum(n, n[i]))
            others = np.flatnonzero(apart & second) if across else i + 1 + np.flatnonzero(apart[i + 1:])
            others = others[(sketches[others] == sketches[i]).sum(1) >= LEAST_AGREEING]
            others = others[(regions[others] == regions[i]).all(2).argmax(1) == tree]
            if len(others) and tested:
                for j in linked_with(i, others, codes, mark):
                    if roots[j] != roots[i]:
                        links.append((i, j))
                        roots[roots == roots[j]] = roots[i]
            elif len(others):
                useful[i] = useful[others] = True
        if tested:
            digests = block["digest"]
            return pa.RecordBatch.from_arrays([digests.take(pa.array([x[k] for x in links], pa.int64())).combine_chunks()
                                               for k in (0, 1)], names=["a", "b"]) if links else None
        return block.filter(pa.array(useful)).combine_chunks().to_batches()[0] if useful.any() else None

    key, rows = None, []
    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in ("region", "low", "high")]))
        cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
        for start, end in zip(cuts, cuts[1:]):
            if start < end and keys[start] != key:
                if rows and (out := pairs(rows)) is not None:
                    yield out
                key, rows = keys[start], []
            if start < end:
                rows.append(batch.slice(start, end - start))
    if rows and (out := pairs(rows)) is not None:
        yield out


def links_across(docs: DataFrame, text: str, classes: DataFrame, members: DataFrame, stars: DataFrame) -> DataFrame:
    """a, b: links that join all components that any pair of a large region links."""
    key = ["region", "low", "high"]
    blocks = block_members(members, classes, stars)
    possible = materialize(blocks.repartition(*key).sortWithinPartitions(*key).mapInArrow(_meet, blocks.schema), "possible")
    sets = full_sets(docs, text, classes, possible.select("digest").distinct())
    return materialize(possible.join(sets, "digest").repartition(*key).sortWithinPartitions(*key)
                       .mapInArrow(_meet, "a binary, b binary"), "links-across")


def full_sets(docs: DataFrame, text: str, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest, shingles of the classes in ``wanted``, built again from their texts.

    Texts are let through by a bitmap of text hashes: a table of at most
    2 ** (BITMAP_BITS - 6) rows, so it is broadcast.  What passes by chance is
    dropped when the sets meet ``wanted``.
    """
    bit = F.pmod(F.col("text_hash"), F.lit(1 << BITMAP_BITS))
    word, mask = (bit / 64).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(text_hash, {1 << BITMAP_BITS}) % 64 as int))")
    bitmap = materialize(classes.select("digest", "text_hash").join(wanted, "digest").select(word.alias("word"), mask.alias("bit"))
                         .groupBy("word").agg(F.bit_or("bit").alias("bits")), "text-bitmap")
    source = docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).withColumns(
        {"word": word, "bit": mask})
    passing = source.join(F.broadcast(bitmap), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bidlens.llm.bpe import slices

        for batch in batches:
            for _, texts in slices(batch.column(0)):
                sets = [s.astype("<u8").tobytes() for s in map(shingle_set, texts)]
                digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())],
                                                 names=["digest", "shingles"])

    built = passing.mapInArrow(build, "digest binary, shingles binary")
    # Copies of a text meet in one row per task before anything is shuffled.
    one_each = built.groupBy("digest").agg(F.first("shingles").alias("shingles"))
    return materialize(one_each.join(materialize(wanted, "wanted"), "digest", "left_semi"), "full-sets")


def tested_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the pairs whose full sets are linked."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), "<u8") for c in (2, 3))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= THRESHOLD * (len(x) + len(y) - common):
                    linked.append(i)
            at = pa.array(linked, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    both = (pairs.select("a", "b").join(sets.withColumnsRenamed({"digest": "a", "shingles": "left_set"}), "a")
            .join(sets.withColumnsRenamed({"digest": "b", "shingles": "right_set"}), "b"))
    return both.select("a", "b", "left_set", "right_set").mapInArrow(confirm, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of a link, by alternating star contraction.

    A large star hands a node's larger neighbours to its smallest one, a small
    star the smaller ones; both shorten paths, and nothing changes once every
    node hangs at its component's smallest node.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        lowest = materialize(both.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("low")), "large-star")
        large = materialize(both.where("root > node").join(lowest, "node").select(
            F.col("root").alias("node"), F.col("low").alias("root")).where("node <> root").distinct(), "edges")
        lowest = materialize(large.groupBy("node").agg(F.min("root").alias("low")), "small-star")
        met = large.join(lowest, "node")
        small = met.where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        edges = materialize(small.unionByName(lowest.withColumnRenamed("low", "root")).distinct(), "edges")
        now = _mark(edges)
        if now == mark:
            return edges
        mark = now


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a checksum of them."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root")), F.sum(F.xxhash64("root", "node") % 1000003)).first())


def _with_components(docs: DataFrame, keep: list[str], text: str, doc_id: str) -> DataFrame:
    """doc, row, n, first: the first row of each document's component (NULL without shingles)."""
    signed = with_signatures(docs, keep, text)
    classes = set_classes(signed, doc_id)
    members = region_members(classes)
    pairs = materialize(candidate_pairs(members), "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    links = materialize(tested_pairs(pairs, full_sets(docs, text, classes, wanted)), "links")
    stars = components(links)
    more = links_across(docs, text, classes, members, stars)
    # Stars and the new links together have the components of all links.
    stars = components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    linked = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    names = classes.select("digest", "first").join(linked.withColumnRenamed("node", "digest"), "digest", "left")
    firsts = materialize(names.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("smallest")), "firsts")
    named = materialize(names.join(firsts, "root", "left").select(
        "digest", F.coalesce("smallest", "first").alias("first")), "class-names")
    return signed.select("doc", "row", "n", "digest").join(named, "digest", "left")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    found = _with_components(docs, [doc_id], text, doc_id)
    alone = F.col("digest").isNull()
    own = F.col(f"doc.{doc_id}")
    component = F.when(alone, own).otherwise(F.col("first.value"))
    return found.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                        own.eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and those without words."""
    found = _with_components(docs, docs.columns, text, doc_id)
    return unpacked(found.where(F.col("digest").isNull() | (F.col("first.tie0") == F.col("row"))))
