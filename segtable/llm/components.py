"""Connected components of a graph that is spread over blocks, in supersteps.

Every block holds edges between nodes and owns the nodes that hash to it.  In a superstep a
block joins its edges by union-find under the labels that it knows, tells the owners of nodes
whose label fell (and the owner of the label that was replaced, which is pointer jumping), and
owners tell the blocks that asked about a node.  A block sends one message per distinct node,
however many edges meet in it, so a node with a third of all edges costs one message per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import PACKED, Net, block_of, deal, few, mail, pack, release, unpack, written

STATE = -1  # in column src: the row is a block's state, else a message from that block
_Z = np.zeros(0, np.int64)


def state_row(me: int, a: np.ndarray, b: np.ndarray) -> tuple[int, bytes]:
    """The first state of a block, for ``Net.post``: edges (a[i], b[i])."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    index = index.astype(np.int64)
    return STATE, pack(np.int64([me, 0]), nodes, nodes, index[: len(a)], index[len(a) :], _Z, _Z, _Z, _Z)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least label that each node reaches by the edges."""
    label = label.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
    return label


def _step(table: pa.Table, net: Net) -> pa.Table:
    """One superstep of one block: its state and the messages to it."""
    n = net.n
    state, told, asked = None, [], []
    for src, raw in mail(table):
        got = unpack(raw)
        if src == STATE:
            state = got
        else:
            (asked if got[0][0] == 0 else told).append((src, got[1], got[2]))
    if state is None:  # messages go to blocks that have documents only
        return net.post(0, [])
    head, nodes, label, a, b, own, own_label, sub_node, sub_block = state
    me, turn = int(head[0]), int(head[1])
    out: list[tuple[int, bytes]] = []
    # As owner: take the lowest label proposed; the blocks that ask about a node hear of it from then on.
    if asked:
        node, low = (np.concatenate([x[k] for x in asked]) for k in (1, 2))
        src = np.concatenate([np.full(len(x[1]), x[0]) for x in asked])
        known = np.union1d(own, node)
        before = known.copy()  # a node's first label is itself
        before[np.searchsorted(known, own)] = own_label
        own, own_label = known, before.copy()
        at = np.searchsorted(own, node)
        np.minimum.at(own_label, at, low)
        both = np.unique(np.stack([np.concatenate([sub_node, node]), np.concatenate([sub_block, src])], 1), axis=0)
        sub_node, sub_block = both[:, 0].copy(), both[:, 1].copy()
        changed = own_label < before
        changed[at[low > own_label[at]]] = True
        x = np.searchsorted(own, sub_node)
        x, blocks = x[changed[x]], sub_block[changed[x]]
        out += [(to, pack(np.int8([1]), own[x[i]], own_label[x[i]])) for to, i in deal(blocks, n)]
    # As holder of edges.
    old = label
    if told:
        node, low = (np.concatenate([x[k] for x in told]) for k in (1, 2))
        at = np.searchsorted(nodes, node)
        at_ok = np.minimum(at, max(len(nodes) - 1, 0))
        ok = nodes[at_ok] == node if len(nodes) else np.zeros(len(node), bool)
        label = label.copy()
        np.minimum.at(label, at_ok[ok], low[ok])
    heard = label
    if turn == 0 or told:
        label = joined(label, a, b)
        fell = np.flatnonzero((label < heard) | (turn == 0))
        pairs = np.concatenate([np.stack([nodes[fell], label[fell]], 1), np.stack([old[fell], label[fell]], 1)])
        pairs = np.unique(pairs[(pairs[:, 0] != pairs[:, 1]) | (turn == 0)], axis=0)
        if len(pairs):
            first = np.r_[True, pairs[1:, 0] != pairs[:-1, 0]]
            pairs = pairs[first]  # the lowest label of each node
            for to, i in deal(block_of(pairs[:, 0].copy(), n), n):
                out.append((to, pack(np.int8([0]), pairs[i, 0].copy(), pairs[i, 1].copy())))
    return net.post(me, out, [(STATE, pack(np.int64([me, turn + 1]), nodes, label, a, b, own, own_label, sub_node, sub_block))])


def components(state: DataFrame, net: Net, docs: DataFrame) -> DataFrame:
    """Supersteps until no message is left; the states then hold each owned node's final label.

    ``state``: a ``state_row`` for each block of ``docs``.  Each superstep is written to the shared
    folder, and the one before it deleted.
    """
    last = None
    while True:
        state = written(few(net.exchange(state).groupBy("key").applyInArrow(lambda t: _step(t, net), PACKED), docs))
        if last is not None:
            release(last)
        last = state
        if state.where(F.col("src") != STATE).isEmpty():
            return state


def label_of(ids: np.ndarray, row: bytes | None) -> np.ndarray:
    """The final labels of a block's own nodes, from its state; a node without edges is its own label."""
    out = ids.copy()
    if row is not None:
        own, own_label = unpack(row)[5:7]
        at = np.minimum(np.searchsorted(own, ids), max(len(own) - 1, 0))
        hit = own[at] == ids if len(own) else np.zeros(len(ids), bool)
        out[hit] = own_label[at[hit]]
    return out
