"""The prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns.  Its key is a running sum of hashed
(position, role, text) words, so prefixes of any length get keys by distributed
running totals and no conversation is walked in one task; every node is then
verified to have one parent and one last turn, so keys that agree by chance stop
the job.  Every node has an enter and an exit arc.  An arc's successor is found
by joins: the first child, the next sibling or the parent's exit.  The tour is
list-ranked in rounds: arcs are dealt into blocks of bounded size, each block
joins the runs it holds, and what is left is dealt again, by number first, by
random mates where that does not help, until one block holds it.  Going back
through the rounds gives every arc its position.  Leaves and savings of a subtree
are differences of prefix sums between a node's two positions.

A node's number follows (smallest member, depth) and siblings stand in that
order, so the tour mostly runs through neighbouring numbers; this decides how many
rounds there are, never the result.

Defined results: rows with a NULL conv_id belong to no conversation; NULL roles
and texts count as empty; turns that tie are ordered by role and text's digest;
repeated rows are turns of their own; a conversation of any length is spread over
tasks; an empty table has no nodes; other columns are ignored.  The digest of the
conversations that end in a node is one hash over their ids in order, so it is
streamed through one task per node, ids already joined into stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.operators.prefix import BLOCK, place_in_blocks, running_totals
from bidlens.session import materialize

GROUP, LONGEST_HEAD = 100, 5  # fixed values of the rebuilding rule
SUMS = [f"s{i}" for i in range(6)]
ROOT = "root"
BLOCK_ARCS = 1 << 16


def numbered_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest of role and text, chars of the text; one row per turn."""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = df.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"),
        F.sha2(what, 256).alias("text"), F.length(what).cast("long").alias("chars"), F.lit(1).cast("long").alias("one"),
        F.monotonically_increasing_id().alias("row")).where("conv_id IS NOT NULL")
    rows = running_totals(rows, ["turn", "role", "text", "row"], {"pos": "one"}, ["conv_id"], "turns")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return materialize(rows.select("conv_id", "pos", digest.alias("digest"), "chars"), "numbered-turns")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns after rebuilding (conv_id, depth, digest, chars, length) and conversations (conv_id, length).

    A conversation takes the first turns of its group's first one, at most five,
    in place of as many of its own.
    """
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LONGEST_HEAD + 1)
    convs = own.select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = materialize(convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", taken.alias("taken"),
        (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    first = turns.where(F.col("pos") <= LONGEST_HEAD).withColumnRenamed("conv_id", "base")
    heads = convs.join(first, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "chars", "length")
    tails = turns.join(convs, "conv_id").where("pos > h").select(
        "conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "chars", "length")
    return heads.unionByName(tails), convs.select("conv_id", "length")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.when(depth == 0, F.lit(ROOT)).otherwise(
        F.sha2(F.concat_ws(".", depth.cast("string"), *[s.cast("string") for s in sums]), 256))


def prefix_keys(turns: DataFrame) -> DataFrame:
    """Adds ``key`` and ``parent``: keys of the prefix up to a turn, and of the one before."""
    word = F.sha2(F.concat_ws(".", F.col("depth").cast("string"), "digest"), 256)
    words = turns.withColumn("word", word).select("*", *[
        F.conv(F.substring("word", 8 * i + 1, 8), 16, 10).cast("long").alias(f"w{i}") for i in range(len(SUMS))]).drop("word")
    summed = running_totals(words, ["depth"], {s: f"w{i}" for i, s in enumerate(SUMS)}, ["conv_id"], "prefixes")
    before = [F.col(s) - F.col(f"w{i}") for i, s in enumerate(SUMS)]
    return summed.select("conv_id", "depth", "digest", "chars", "length", _key(F.col("depth"), [F.col(s) for s in SUMS]).alias("key"),
                         _key(F.col("depth") - 1, before).alias("parent"))


def trie_nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """Numbered nodes: id, key, parent, conv_id (smallest member), depth, n_convs, chars."""
    same = lambda c: (F.min(c) == F.max(c))
    nodes = materialize(prefixes.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"),
        F.min("parent").alias("parent"), F.min("chars").alias("chars"),
        (same("parent") & same("digest") & same("depth")).alias("whole")), "prefix-nodes")
    if not nodes.where(~F.col("whole")).isEmpty():
        raise ValueError("one key stands for two prefixes")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(ROOT).alias("key"), "conv_id", "n_convs", F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("chars"))
    every = nodes.drop("whole").unionByName(root)
    blocks = max(1, -(-2 * nodes.count() // BLOCK_ARCS))
    placed = every.repartitionByRange(blocks, "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    return materialize(placed.withColumn("id", F.monotonically_increasing_id()), "trie-nodes")


def with_parents(nodes: DataFrame) -> DataFrame:
    above = nodes.select(F.col("key").alias("parent"), F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    return materialize(nodes.join(above, "parent", "left").select(
        "id", "key", "conv_id", "depth", "n_convs", "chars", "parent_id", "parent_conv_id"), "trie")


def next_siblings(trie: DataFrame) -> DataFrame:
    """id, sibling: the next child of the same parent, looked up across blocks, so a wide node is no task of its own."""
    placed = place_in_blocks(trie.where("parent_id IS NOT NULL").select("parent_id", "id"), ["parent_id", "id"], "siblings")
    here = F.struct("parent_id", "id")
    # One row per block: what the next block begins with.
    begins = placed.groupBy(BLOCK).agg(F.min(here).alias("first"))
    after = materialize(begins.select(BLOCK, F.lead("first").over(Window.orderBy(BLOCK)).alias("after")), "block-begins")
    inside = Window.partitionBy(BLOCK).orderBy("parent_id", "id")
    following = F.coalesce(F.lead(here).over(inside), F.col("after"))
    return placed.join(after, BLOCK).select("parent_id", "id", following.alias("f")).where(
        "f.parent_id = parent_id").select("id", F.col("f.id").alias("sibling"))


def tour_arcs(trie: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs (arc, next; -1 ends) and nodes with n_children; arc 2 id enters a node, 2 id + 1 leaves it."""
    below = trie.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(
        F.min("id").alias("child"), F.count("*").alias("n_children"))
    nodes = materialize(
        trie.join(below, "id", "left").join(next_siblings(trie), "id", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "tour-nodes")
    enter = F.struct((2 * F.col("id")).alias("arc"), F.coalesce(2 * F.col("child"), 2 * F.col("id") + 1).alias("next"))
    leave = F.struct((2 * F.col("id") + 1).alias("arc"), F.coalesce(
        2 * F.col("sibling"), 2 * F.col("parent_id") + 1, F.lit(-1).cast("long")).alias("next"))
    return nodes.select(F.explode(F.array(enter, leave)).alias("a")).select("a.*"), nodes


def joined_runs(arc: np.ndarray, nxt: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs among the given pieces of a list: (arc, into, offset, next, length).

    ``into`` is the first piece of the run, ``offset`` the distance from its start;
    the first piece has the whole run's length and successor.
    """
    order = np.argsort(arc)
    arc, nxt, length = arc[order], nxt[order], length[order]
    at = np.minimum(np.searchsorted(arc, nxt), len(arc) - 1)
    inside = arc[at] == nxt
    before, offset = np.arange(len(arc)), np.zeros(len(arc), np.int64)
    before[at[inside]] = np.flatnonzero(inside)
    offset[at[inside]] = length[inside]
    while not np.array_equal(further := before[before], before):
        offset += offset[before]
        before = further
    ends = np.flatnonzero(~inside)
    whole_next, whole_length = np.full(len(arc), -1, np.int64), np.zeros(len(arc), np.int64)
    whole_next[before[ends]] = nxt[ends]
    whole_length[before[ends]] = offset[ends] + length[ends]
    return arc, arc[before], offset, whole_next, whole_length


RUN_SCHEMA = "arc long, into long, offset long, next long, length long"


def _join_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's pieces, a bounded number by the way they are dealt."""
    parts = [[batch.column(i).to_numpy() for i in range(3)] for batch in batches if batch.num_rows]
    if parts:
        columns = joined_runs(*(np.concatenate(c) for c in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["arc", "into", "offset", "next", "length"])


def list_rank(arcs: DataFrame, block: int = BLOCK_ARCS) -> DataFrame:
    """arc, position (from 0) along the list that the successors make."""
    pieces = arcs.select("arc", "next", F.lit(1).cast("long").alias("length"))
    count, rounds, by_number = arcs.count(), [], True
    while True:
        last = count <= block
        blocks = -(-count // block)
        if last:
            dealt = pieces.coalesce(1)  # at most ``block`` pieces
        elif by_number:
            dealt = pieces.repartitionByRange(blocks, "arc")
        else:  # heads meet the tail they point to: a quarter of the pieces is joined, whatever their numbers
            coin = F.pmod(F.xxhash64("arc", F.lit(len(rounds))), F.lit(2)) == 1
            dealt = pieces.repartition(blocks, F.when(coin, F.col("next")).otherwise(F.col("arc")))
        rounds.append(materialize(dealt.mapInArrow(_join_block, RUN_SCHEMA), "tour-runs"))
        pieces = rounds[-1].where("into = arc").select("arc", "next", "length")
        if last:
            break
        left = pieces.count()
        by_number = left < 0.7 * count if by_number else not by_number
        count = left
    # The last round has one run, so an offset in it is a position.
    positions = rounds[-1].select("arc", F.col("offset").alias("position"))
    for runs in reversed(rounds[:-1]):
        starts = positions.select(F.col("arc").alias("into"), F.col("position").alias("start"))
        positions = materialize(runs.join(starts, "into").select("arc", (F.col("start") + F.col("offset")).alias("position")),
                                "tour-positions")
    return positions


def subtree_sums(nodes: DataFrame, positions: DataFrame) -> DataFrame:
    """id, n_leaves, saved_tokens of every subtree, from prefix sums at its two positions."""
    leaf = (F.col("n_children") == 0).cast("long")
    weights = nodes.select("id", leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    entered = F.col("arc") % 2 == 0
    placed = positions.withColumn("id", F.shiftright("arc", 1)).join(weights, "id").select(
        "id", "position", entered.alias("entered"), F.when(entered, F.col("leaf")).otherwise(0).alias("leaf"),
        F.when(entered, F.col("saved")).otherwise(0).alias("saved"))
    upto = running_totals(placed, ["position"], {"leaves_upto": "leaf", "saved_upto": "saved"}, label="tour-sums")
    out = [(F.max(F.when(~F.col("entered"), F.col(f"{total}_upto")))
            - F.max(F.when(F.col("entered"), F.col(f"{total}_upto") - F.col(own)))).alias(name)
           for total, own, name in (("leaves", "leaf", "n_leaves"), ("saved", "saved", "saved_tokens"))]
    return upto.groupBy("id").agg(*out)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) as one row per key and batch: key, first id, ids joined by commas."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        starts = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
        pairs = list(zip(starts[:-1], starts[1:]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[a] for a, _ in pairs]), pa.array([ids[a] for a, _ in pairs], pa.int64()),
             pa.array([",".join(map(str, ids[a:b])) for a, b in pairs])], names=["key", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per key over its stretches in order; a key may go on in the next batch."""
    def out(done: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())],
                                          names=["key", "ends_sha256"])

    now, state = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield out(done)
    if now is not None:
        yield out([(now, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 from (key, conv_id)."""
    ordered = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    stretches = ordered.select("key", "conv_id").mapInArrow(_stretches, "key string, first long, ids string")
    return stretches.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key string, ends_sha256 string")


def prefix_trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                block: int = BLOCK_ARCS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt_turns(numbered_turns(df, conv_id, turn, role, text))
    prefixes = materialize(prefix_keys(turns), "prefix-keys")
    trie = with_parents(trie_nodes(prefixes, convs))
    arcs, nodes = tour_arcs(trie)
    sums = subtree_sums(nodes, list_rank(arcs, block))
    ends = prefixes.where("depth = length").select("key", "conv_id").unionByName(
        convs.where("length = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    return nodes.join(sums, "id").join(end_digests(ends), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
