"""The trie of conversation prefixes, from range minima over sorted common-prefix lengths.

A node is a distinct sequence of the first d turns. Conversations are sorted by
the 128-bit names of their turns and dealt to ranges (blocks) of that order; a
large group of copies is cut by ``conv_id``. In a block, LCP[i] is the number of
turns that rows i - 1 and i share. A sparse table answers range minima of LCP, so
each candidate prefix (row, depth) binary-searches the left and the right end of
its members on its own, all candidates at once. Sums over subtrees are
differences of prefix sums, because a subtree is a range of the candidates.

Blocks know the last row before and the first row after them, so every node is
counted once although its members may lie in many blocks: its parent and its size
are counted where its first member is, whether it is a leaf where its last one
is. Nodes that reach over a border (the shared prefixes of neighbouring rows)
give one partial row a block, which are added up by name; all others are final.

Rows: turns are ordered by turn number (null first), equal numbers by role and
name of the turn; a null role or text counts as empty; rows with a null
``conv_id`` belong to no conversation and are left out. A conversation is one
record of 20 bytes a turn. Extra columns are ignored. An empty table has no node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_table, map_groups, ship, shuffle_parts

NAME = 16
#: Turns of a block on average, ids of one piece of a member list.
BLOCK_TURNS = 200_000
PIECE_IDS = 500
#: Border nodes (about 100 bytes each) up to which their table is broadcast.
BORDER_BROADCAST = 50_000

NODE = ("conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string, name binary, parent_name binary, parent_conv_id long, block int, piece int, ends string")


def sequences(rows: DataFrame) -> DataFrame:
    """``conv_id, turns`` of ``rows(conv_id, turn, role, text)``: names and UTF-8 lengths of the turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = rows.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn").cast("long").alias("turn"), role.alias("role"),
            F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("name"),
            F.octet_length(text).alias("size")).alias("t"))
    return named.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(
        t["name"].alias("name"), t["size"].alias("size"))).alias("turns"))


def flat(sequenced: DataFrame) -> DataFrame:
    """``conv_id, seq`` (the names one after another) ``, sizes`` of ``conv_id, turns``."""
    joined = F.array_join(F.transform("turns", lambda t: F.hex(t["name"])), "")
    return sequenced.select("conv_id", F.unhex(joined).alias("seq"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def _common(a: np.ndarray, a_off: np.ndarray, b_off: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Number of leading equal names of pairs of sequences in the name array ``a``."""
    n = np.minimum(a_len, b_len)
    start = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(start[-1]) - np.repeat(start[:-1], n)
    same = (a[np.repeat(a_off, n) + at] == a[np.repeat(b_off, n) + at]).all(axis=1)
    differ = np.append(np.flatnonzero(~same), start[-1])
    return np.minimum(differ[np.searchsorted(differ, start[:-1])] - start[:-1], n)


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """``table[k][i]``: least of ``values[i:i + 2**k]``."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def least(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Range minima over the closed ranges ``left..right``."""
    k = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    out = np.empty(len(left), dtype=table[0].dtype)
    for level in range(len(table)):
        at = np.flatnonzero(k == level)
        out[at] = np.minimum(table[level][left[at]], table[level][right[at] - (1 << level) + 1])
    return out


def extents(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share ``depth`` leading turns with row ``at``; LCP[i] joins rows i - 1 and i."""
    last = len(table[0]) - 1
    left, right = at.copy(), at.copy()
    for level in range(len(table) - 1, -1, -1):
        step = 1 << level
        i = np.flatnonzero(left - step >= 0)
        i = i[table[level][left[i] - step + 1] >= depth[i]]
        left[i] -= step
        i = np.flatnonzero(right + step <= last)
        i = i[table[level][right[i] + 1] >= depth[i]]
        right[i] += step
    return left, right


def _prefix_names(seq: bytes, most: int) -> list[bytes]:
    """Names of the prefixes of up to ``most`` turns."""
    h = hashlib.md5()
    out = [h.digest()]
    for d in range(most):
        h.update(seq[NAME * d:NAME * (d + 1)])
        out.append(h.digest())
    return out


def _block_nodes(t: pa.Table):
    """The nodes of one block: final ones, and partial ones of the prefixes that reach over its borders."""
    ghost = t.column("ghost").to_numpy()
    seqs = t.column("seq").combine_chunks().cast(pa.large_binary())
    off = np.frombuffer(seqs.buffers()[1], dtype=np.int64)[seqs.offset:seqs.offset + len(seqs) + 1] // NAME
    data = seqs.buffers()[2]
    names = np.frombuffer(data, dtype="<u8")[:2 * off[-1]].reshape(-1, 2) if data is not None and data.size else \
        np.zeros((0, 2), dtype="<u8")
    length = np.diff(off)
    shared = _common(names, off[:-2], off[1:-1], length[:-1], length[1:])
    own = np.flatnonzero(ghost == 0)
    before, after = int(own[0]), int(own[-1])
    lcp = np.empty(len(own) + 1, dtype=np.int64)
    lcp[0] = shared[before - 1] if before else -1
    lcp[-1] = shared[after] if after < len(ghost) - 1 else -1
    lcp[1:-1] = shared[before:after]
    reach_left, reach_right = int(lcp[0]), int(lcp[-1])
    base, length = off[own], length[own]
    ids = t.column("conv_id").to_numpy()[own]
    block = t.column("block")[0].as_py()

    # candidates: each row's prefixes that the row before it does not have, and all those of the first row
    first = lcp[:-1] + 1
    first[0] = 0
    n = length - first + 1
    start = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(own)), n)
    depth = np.arange(start[-1]) - np.repeat(start[:-1], n) + np.repeat(first, n)
    inner = lcp[:-1].copy()
    inner[0] = -1                                            # the search stays in the block
    table = sparse_table(inner)
    left, right = extents(table, row, depth)
    open_left = (left == 0) & (depth <= reach_left)
    open_right = (right == len(own) - 1) & (depth <= reach_right)

    def node_of(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Number of the candidate that stands for row i's prefix of d turns."""
        l, _ = extents(table, i, d)
        return start[l] + d - first[l]

    members = right - left + 1
    small = least(sparse_table(ids), left, right)
    counted = ~open_left                                      # where the first member is
    sizes = t.column("sizes").combine_chunks().filter(pa.array(ghost == 0)).flatten().to_numpy()
    at = np.concatenate([[0], np.cumsum(length)])
    weight = np.where(depth > 0, np.append(sizes, 0)[np.where(depth > 0, at[row] + depth - 1, 0)], 0).astype(np.int64)
    leaf = ~open_right & (length[right] == depth)
    until = start[right + 1]                                  # a subtree is a range of candidates
    begin = np.arange(len(row))

    def below(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[until] - total[begin]

    saved = below((members - counted) * weight)
    leaves = below(leaf.astype(np.int64))
    parent = begin - 1
    opens = np.flatnonzero((depth == np.repeat(first, n)) & (row > 0))
    parent[opens] = node_of(row[opens], depth[opens] - 1)
    children = np.bincount(parent[1:], weights=counted[1:], minlength=len(row)).astype(np.int64)
    ends = node_of(np.arange(len(own)), length)               # ascending with the rows of one node
    ending = np.bincount(ends, minlength=len(row))
    ends_at = np.concatenate([[0], np.cumsum(ending)])
    ended = ids[np.argsort(ends, kind="stable")]

    is_open = open_left | open_right
    prefix = {}
    for i, reach in ((0, reach_left), (len(own) - 1, reach_right)):
        if reach >= 0:
            own_seq = names[base[i]:base[i] + reach].tobytes()
            path = np.arange(reach + 1)
            for node, name in zip(node_of(np.full(reach + 1, i), path).tolist(), _prefix_names(own_seq, reach)):
                prefix[node] = name
    sha, name, parent_name, parent_conv = [], [], [], []
    empty = hashlib.sha256().hexdigest()
    for i, (shut, e, p) in enumerate(zip((~is_open).tolist(), ending.tolist(), parent.tolist())):
        sha.append((hashlib.sha256(",".join(map(str, ended[ends_at[i]:ends_at[i + 1]].tolist())).encode()).hexdigest()
                    if e else empty) if shut else None)
        name.append(prefix.get(i))
        parent_name.append(prefix.get(p))
        parent_conv.append(int(small[p]) if p >= 0 and p not in prefix else None)
    null = pa.nulls(len(row))
    fields = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()),
                        ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                        ("ends_sha256", pa.string()), ("name", pa.binary()), ("parent_name", pa.binary()),
                        ("parent_conv_id", pa.int64()), ("block", pa.int32()), ("piece", pa.int32()),
                        ("ends", pa.string())])
    out = pa.Table.from_arrays(
        [pa.array(small), pa.array(depth), pa.array(members), pa.array(children), pa.array(leaves), pa.array(saved),
         pa.array(sha, type=pa.string()), pa.array(name, type=pa.binary()), pa.array(parent_name, type=pa.binary()),
         pa.array(parent_conv, type=pa.int64()), null.cast(pa.int32()), null.cast(pa.int32()), null.cast(pa.string())],
        schema=fields)
    yield from out.to_batches(max_chunksize=10_000)
    pieces = []
    for i in np.flatnonzero(is_open & (ending > 0)).tolist():
        mine = ended[ends_at[i]:ends_at[i + 1]].tolist()
        for k in range(0, len(mine), PIECE_IDS):
            pieces.append({"name": prefix[i], "block": block, "piece": k // PIECE_IDS,
                           "ends": ",".join(map(str, mine[k:k + PIECE_IDS]))})
    if pieces:
        yield from pa.Table.from_pylist(pieces, schema=fields).to_batches(max_chunksize=1000)


def _member_digests(pieces: DataFrame) -> DataFrame:
    """``name, ends_sha256`` of the comma-joined pieces of each member list, read as a stream."""
    def run(batches):
        last, h = None, None
        for b in batches:
            names, out = [], []
            for name, text in zip(b.column("name").to_pylist(), b.column("ends").to_pylist()):
                if name != last:
                    if last is not None:
                        names.append(last)
                        out.append(h.hexdigest())
                    last, h = name, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(text.encode())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.binary()), pa.array(out)],
                                                 names=["name", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], type=pa.binary()), pa.array([h.hexdigest()])],
                                             names=["name", "ends_sha256"])

    dealt = pieces.select("name", "block", "piece", "ends").repartition("name").sortWithinPartitions(
        "name", "block", "piece")
    return dealt.mapInArrow(run, "name binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per node of the trie over ``convs(conv_id, seq, sizes)`` (see ``flat``).

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs`` (members), ``n_children``,
    ``n_leaves`` (childless nodes of the subtree), ``saved_tokens`` (over the subtree, each node's
    members but one times the UTF-8 bytes of its last text) and ``ends_sha256`` (of the ids that end here).
    """
    spark = convs.sparkSession
    ship(spark)
    old: list[str] = []
    convs = cut(convs, "sequences", old)
    size = convs.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = parts or max(shuffle_parts(spark), -(-size // BLOCK_TURNS))
    ranged = cut(convs.repartitionByRange(parts, "seq", "conv_id").withColumn("block", F.spark_partition_id()),
                 "ranges", old)
    edge = ranged.select("block", F.struct("seq", "conv_id").alias("e")).groupBy("block").agg(
        F.min("e").alias("lo"), F.max("e").alias("hi"))
    order = Window.orderBy("block")                           # one row per block
    edge = edge.select("block", F.lag("hi").over(order).alias("before"), F.lead("lo").over(order).alias("after"))
    columns = ["block", "ghost", "seq", "conv_id", "sizes"]
    ghosts = edge.select("block", F.explode(F.array(
        F.struct(F.lit(-1).alias("ghost"), F.col("before").alias("e")),
        F.struct(F.lit(1).alias("ghost"), F.col("after").alias("e")))).alias("g")).filter("g.e is not null").select(
        "block", "g.ghost", "g.e.seq", "g.e.conv_id", F.array().cast("array<int>").alias("sizes"))
    rows = ranged.withColumn("ghost", F.lit(0)).select(*columns).unionAll(ghosts)
    found = cut(map_groups(rows, ["block"], _block_nodes, NODE, order=["ghost", "seq", "conv_id"], parts=parts),
                "prefixes")
    nodes = found.filter("ends is null")
    border = nodes.filter("name is not null").groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.max("parent_name").alias("parent_name"))
    border = cut(border.join(_member_digests(found.filter("ends is not null")), "name", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "border")
    above = border.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("_above"))
    if border.count() <= BORDER_BROADCAST:
        above = F.broadcast(above)
    for path in old:
        drop_table(spark, path)
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = nodes.filter("name is null").select(*result, "parent_name").unionByName(
        border.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*result, "parent_name"))
    return every.join(above, "parent_name", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "_above")).select(*result)
