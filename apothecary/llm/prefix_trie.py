"""A prefix trie of conversations from vertical bitmaps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apothecary.llm.common import chosen, stored

_BLOCK = 2048  # conversations of a bitset
_TURNS = 1 << 17  # turns of a block, where conversations are long
_HOT = 1000  # nodes with this share of all nodes as children are fewer than it
ROOT = b""


def turn_lists(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: conv_id and ``turns``, an array of ``turn`` (SHA-256 of role and text) and ``chars`` (code points of the text).

    Turns come by number, null first, then role and text. Null roles and texts
    count as empty; rows without a conversation are left out, other columns too.
    Texts are sorted, never gathered: an array holds some 50 bytes a turn.
    """
    rows = chosen(conversations, conv_id=id_col, at=turn_col, role=role_col, text=text_col).where(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "at", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "role", "text"))
    name = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.select("conv_id", place.alias("place"), name.alias("turn"), F.length("text").cast("long").alias("chars"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "chars"))).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["chars"].alias("chars"))).alias("turns"))


def _chains(lists: DataFrame) -> DataFrame:
    """conv_id, ``keys`` and ``chars``: of each prefix but the root a key of 128 bits and its last turn's code points."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column("turns").to_pylist()
            keys = [list(accumulate((t["turn"] for t in of), lambda key, turn: hashlib.blake2b(key + turn, digest_size=16).digest(), initial=ROOT))[1:] for of in turns]
            chars = [[t["chars"] for t in of] for of in turns]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(keys, pa.list_(pa.binary())), pa.array(chars, pa.list_(pa.int64()))], ["conv_id", "keys", "chars"])

    return lists.select("conv_id", F.coalesce("turns", F.array()).cast("array<struct<turn binary, chars long>>").alias("turns")).mapInArrow(chain, "conv_id long, keys array<binary>, chars array<long>")


def block_nodes(rows: list[tuple[int, list[bytes], list[int]]]) -> Iterator[tuple[bytes, bytes | None, int, int, int, int, list[int]]]:
    """The trie of a block of (conv_id, keys, chars): (key, parent's key, depth, smallest member, members, chars, ids that end there) a node.

    Postings map (position, turn) to the bitset of the conversations that have
    it; a node's bitset meets those of the next position. The lowest bit left
    names the posting to meet next, so each meeting gives a child.
    """
    rows = sorted(rows, key=lambda r: r[0])
    postings: list[dict[bytes, int]] = []
    ends: dict[int, int] = {}
    for bit, (_, keys, _) in enumerate(rows):
        ends[len(keys)] = ends.get(len(keys), 0) | 1 << bit
        for at, key in enumerate(keys):
            if at == len(postings):
                postings.append({})
            postings[at][key] = postings[at].get(key, 0) | 1 << bit
    open_ = [(ROOT, None, 0, (1 << len(rows)) - 1)] if rows else []
    while open_:
        key, parent, depth, members = open_.pop()
        low = (members & -members).bit_length() - 1
        ending = members & ends.get(depth, 0)
        yield key, parent, depth, rows[low][0], members.bit_count(), rows[low][2][depth - 1] if depth else 0, [rows[b][0] for b in _places(ending)]
        rest = members ^ ending
        while rest:
            child = rows[(rest & -rest).bit_length() - 1][1][depth]
            among = rest & postings[depth][child]
            open_.append((child, key, depth + 1, among))
            rest ^= among


def _places(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _shards(chains: DataFrame) -> DataFrame:
    """Partial nodes of blocks of conversations, dealt by ranges of their first prefixes and ids, so a prefix that many share is split."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "parent_key", "depth", "conv_id", "n_convs", "chars", "ends"]
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

        def made(block: list) -> pa.RecordBatch:
            columns = zip(*block_nodes(block), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        block, turns = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "keys", "chars")), strict=True):
                if block and (len(block) == _BLOCK or turns + len(row[1]) > _TURNS):
                    yield made(block)
                    block, turns = [], 0
                block.append(row)
                turns += len(row[1])
        if block:
            yield made(block)

    order = [F.slice("keys", 1, 4), F.col("conv_id")]
    dealt = chains.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(build, "key binary, parent_key binary, depth long, conv_id long, n_convs long, chars long, ends array<long>")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Adds ``parent_conv_id``: parents with very many children, at most ``_HOT``, are broadcast, the others joined by key."""
    total = nodes.count()
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") * _HOT >= total).alias("hot"))
    hot, others = F.broadcast(parents.where("hot").drop("hot")), parents.where("not hot").drop("hot")
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    below = nodes.where("depth > 0")
    return root.unionByName(below.join(hot, "parent_key")).unionByName(below.join(hot, "parent_key", "left_anti").join(others, "parent_key"))


def _subtree_sums(chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, ``n_leaves`` and ``saved_tokens``, each summed over the subtree.

    A node belongs to its smallest member, whose nodes are the tail of its own
    path. So each conversation adds up its tail and hands the sums to all
    prefixes on its path, where they are summed again: as many rows as turns.
    """
    own = F.struct("depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    tails = nodes.groupBy("conv_id").agg(F.collect_list(own).alias("own"))

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys_out, leaves_out, saved_out = [], [], []
            for keys, own in zip(batch.column("keys").to_pylist(), batch.column("own").to_pylist(), strict=True):
                path = [ROOT, *keys]
                saved, leaves = [0] * len(path), [0] * len(path)
                for node in own:
                    saved[node["depth"]], leaves[node["depth"]] = node["saved"], node["leaves"]
                keys_out += reversed(path)
                saved_out += accumulate(reversed(saved))
                leaves_out += accumulate(reversed(leaves))
            yield pa.RecordBatch.from_arrays([pa.array(keys_out, pa.binary()), pa.array(leaves_out, pa.int64()), pa.array(saved_out, pa.int64())], ["key", "n_leaves", "saved_tokens"])

    parts = chains.join(tails, "conv_id").select("keys", "own").mapInArrow(handed, "key binary, n_leaves long, saved_tokens long")
    return parts.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def prefix_trie(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of all conversations in ``turn_lists`` form: its nodes, and (key, conv_id) of each conversation at the node where it ends.

    A node is a distinct sequence of first turns; the root, of depth 0, is the
    empty one. Nodes have key, parent_key (root: null), depth, conv_id (the
    smallest member), parent_conv_id (root: null), n_convs, n_children, chars
    (code points of its last text), n_leaves (childless nodes of its subtree)
    and saved_tokens (each node's (n_convs - 1) * chars summed over it).

    An empty table gives no nodes; a conversation of null or no turns ends at
    the root. Each id comes once in ``lists``. Blocks of conversations are
    indexed apart and their nodes summed by key, so no prefix gathers in one
    task, however many share it.
    """
    chains = stored(_chains(lists))
    partial = stored(_shards(chains))
    merged = partial.groupBy("key").agg(F.min("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("chars").alias("chars"))
    merged = stored(merged)
    children = merged.where("depth > 0").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = stored(merged.join(children, "key", "left").fillna(0, ["n_children"]))
    return _with_parents(nodes).join(_subtree_sums(chains, nodes), "key"), partial.select("key", F.explode("ends").alias("conv_id"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """key and ``ends_sha256`` of the decimal ids that end there, ascending and comma-joined.

    The ids of a node pass one task in order, as a digest needs them, but as a
    sorted stream that is never held.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            keys, out = [], []
            for key, conv_id in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if state is not None and key == last:
                    state.update(b",%d" % conv_id)
                    continue
                if state is not None:
                    keys.append(last)
                    out.append(state.hexdigest())
                last, state = key, hashlib.sha256(b"%d" % conv_id)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])

    return ends.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(digest, "key binary, ends_sha256 string")
