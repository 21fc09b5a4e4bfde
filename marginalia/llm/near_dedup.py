"""Near-duplicate documents by a chosen-path similarity join over minwise tokens.

Every document is reduced to minwise tokens (the minimum of its shingles under many hash functions). A tree splits
documents by branches: at each node two token places are chosen by the node's name, and a document goes to the child
of its token at each place. Documents alike with similarity s meet again in a child with probability s per place, so
alike documents stay together and others part. All documents start at the nodes of depth three, which each works out
by itself; a node with one document ends there. In a node, documents are compared with its first document, then with
the first document of the component found, and, if some stay apart, nodes of up to `SMALL` documents are compared exhaustively and larger ones branch on. Independent trees
repeat this: a pair at exactly 0.75 is missed by one tree with probability 0.1, and by all of the default six with 1e-6.
An exhaustive comparison leaves out only pairs that cannot be alike: each set has one bit per bucket of shingles, telling
whether an odd number of them fell there, and sets differ in at least as many shingles as in bits.

Links decide components only, so documents already joined are not compared again, and groups of near copies of any
size cost one comparison per document rather than all pairs. Every link is confirmed on the full shingle sets.
Equal sets are one class with one representative before any tree is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import slices, schema_of, stored, utf8
from marginalia.llm.shingles import mix, shingle_sets
from marginalia.session import broadcast_if_small

PLACES = 20  # tokens per tree
START_DEPTH = 3
SMALL = 4_000  # a node of so many documents is compared exhaustively
TINY = 8  # ... and of so many without a look at the parities
PARITY = 1 << 12  # buckets of the parities
_BLOCK = 1 << 14


def minwise(sets: list[np.ndarray], n: int) -> np.ndarray:
    """`n` minwise tokens (uint32) of each non-empty set."""
    seeds = mix(np.arange(1, n + 1, dtype=np.uint64))
    factor, shift = (seeds | np.uint64(1)).astype(np.uint32)[:, None], (seeds >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full((len(sets), n), 0xFFFFFFFF, np.uint32)
    for i, s in enumerate(sets):
        short = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), _BLOCK):
            values = short[None, at : at + _BLOCK] * factor + shift
            values ^= values >> np.uint32(15)
            out[i] = np.minimum(out[i], values.min(axis=1))
    return out


def parities(sets: list[np.ndarray]) -> list[bytes]:
    """For each set the bits of the buckets that hold an odd number of it. Bits of two sets differ only where an odd number
    of shingles is in one set alone, so there are at most as many differing bits as differing shingles."""
    return [np.packbits(np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).tobytes() for s in sets]


def signatures(docs: DataFrame, words: int, tokens: int) -> DataFrame:
    """(id, n_shingles, class, tokens, parity): set size, 128-bit hash of the set, minwise tokens (null for an empty set),
    parities of its buckets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body"):
                sets = shingle_sets(batch.column("body").to_pylist(), words)
                small = minwise(sets, tokens)
                with np.errstate(over="ignore"):
                    names = [int(x.sum()).to_bytes(8, "big") + int(mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum()).to_bytes(8, "big") for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(names, pa.binary()),
                     pa.array([t.tobytes() if len(x) else None for x, t in zip(sets, small, strict=True)], pa.binary()),
                     pa.array(parities(sets), pa.binary())],
                    names=["id", "n_shingles", "class", "tokens", "parity"])

    return docs.mapInArrow(sign, schema_of(docs.select("id"), n_shingles="long", **{"class": "binary"}, tokens="binary", parity="binary"))


def _children(node: np.ndarray, used: np.ndarray, tokens: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two children of each (node, tokens of the tree): node name and bit set of the places used on the path."""
    out = []
    rows = np.arange(len(node))
    for turn in range(2):
        place = (mix(node + np.uint64(turn)) % np.uint64(PLACES)).astype(np.int64)
        taken = used if turn == 0 else used | out[0][1]
        for _ in range(PLACES):
            clash = (taken >> place) & 1 == 1
            if not clash.any():
                break
            place = np.where(clash, (place + 1) % PLACES, place)
        child = mix(node ^ mix((place.astype(np.uint64) << np.uint64(32)) | tokens[rows, place].astype(np.uint64)))
        out.append((child, used | (1 << place)))
    return out


def _leaves(tokens: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(tree, node, used) of every starting node of the documents with `tokens` (document, tree, place)."""
    for tree in range(tokens.shape[1]):
        level = [(np.full(len(tokens), mix(np.array([tree + 1], np.uint64))[0]), np.zeros(len(tokens), np.int64))]
        for _ in range(START_DEPTH):
            level = [child for node, used in level for child in _children(node, used, tokens[:, tree])]
        for node, used in level:
            yield tree, node, used


def _plant(reps: DataFrame, trees: int) -> DataFrame:
    """(node, tree, used, rep, n) of the starting depth."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(batch.num_rows, trees, PLACES)
                for tree, node, used in _leaves(tokens):
                    yield _members(batch, node, used, tree)

    return reps.mapInArrow(plant, schema_of(reps.select("rep", "n"), node="long", used="long", tree="int"))


def _grow(members: DataFrame, trees: int) -> DataFrame:
    """Children of `members` (node, tree, used, rep, n, tokens)."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(batch.num_rows, trees, PLACES)
            tree = batch.column("tree").to_numpy()
            node, used = batch.column("node").to_numpy().view(np.uint64), batch.column("used").to_numpy()
            for child, path in _children(node, used, tokens[np.arange(batch.num_rows), tree]):
                yield _members(batch, child, path, tree)

    return members.mapInArrow(grow, schema_of(members.select("rep", "n"), node="long", used="long", tree="int"))


def _members(batch: pa.RecordBatch, node: np.ndarray, used: np.ndarray, tree) -> pa.RecordBatch:
    tree = np.broadcast_to(np.asarray(tree, np.int32), (batch.num_rows,))
    return pa.RecordBatch.from_arrays(
        [batch.column("rep"), batch.column("n"), pa.array(node.view(np.int64)), pa.array(used), pa.array(np.ascontiguousarray(tree))],
        names=["rep", "n", "node", "used", "tree"])


def _shared(members: DataFrame) -> DataFrame:
    """Members of nodes that hold at least two documents, with the node's first document and size."""
    nodes = members.groupBy("node").agg(F.min(F.struct("rep", "n")).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return members.join(nodes, "node")


def _pairs(n_a: str, n_b: str, percent: int):
    """Could the two set sizes give the similarity?"""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def components(links: DataFrame) -> DataFrame:
    """(v, root) for each end of `links` (a, b): the smallest id it is connected with.

    Each round points every vertex to its smallest neighbour, follows the pointers to their ends, and keeps the links
    between different ends. Rounds are logarithmic in the component's length; state is written between rounds.
    """
    roots: DataFrame | None = None
    edges = stored(links.select("a", "b").distinct(), "links")
    while not edges.isEmpty():  # joins on pointers are broadcast while those are few
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        point = stored(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("root")), "pointers")
        while True:
            step = broadcast_if_small(point.select(F.col("v").alias("root"), F.col("root").alias("next")))
            moved = stored(point.join(step, "root", "left").select("v", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")), "pointers")
            point = moved.select("v", "root")
            if moved.filter("moved").isEmpty():
                break
        ends = broadcast_if_small(point.select(F.col("v").alias("at"), F.col("root").alias("end")))
        if roots is None:
            roots = point
        else:
            roots = roots.withColumnRenamed("root", "at").join(ends, "at", "left").select("v", F.coalesce("end", "at").alias("root"))
        left = edges.join(ends.withColumnsRenamed({"at": "a", "end": "ra"}), "a").join(ends.withColumnsRenamed({"at": "b", "end": "rb"}), "b")
        edges = stored(left.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    return roots if roots is not None else links.select(F.col("a").alias("v"), F.col("a").alias("root"))


class _Join:
    """The state of one run: classes, pairs compared so far and the components that their links make."""

    def __init__(self, docs: DataFrame, reps: DataFrame, words: int, percent: int, trees: int):
        self.docs, self.reps, self.words, self.percent, self.trees = docs, reps, words, percent, trees
        self.tried: list[DataFrame] = []
        self.roots: DataFrame | None = None

    def rooted(self, members: DataFrame) -> DataFrame:
        """`members` with the component of each document."""
        if self.roots is None:
            return members.withColumn("root", F.col("rep"))
        return members.join(self.roots.withColumnRenamed("v", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))

    def confirm(self, pairs: DataFrame) -> None:
        """Compare pairs (a, b) on their full sets; links among them extend the components."""
        pairs = pairs.select("a", "b").distinct()
        for old in self.tried:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            return
        self.tried.append(pairs)
        ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "paired")
        words = self.words

        def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "body"):
                    sets = shingle_sets(batch.column("body").to_pylist(), words)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["id", "set"])

        texts = self.docs.join(broadcast_if_small(ids), "id", "left_semi")
        sets = stored(texts.mapInArrow(full, schema_of(texts.select("id"), set="array<bigint>")), "sets")
        held = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        held = held.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        both = F.size(F.array_intersect("set_a", "set_b"))
        held = held.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
        found = held.filter(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * self.percent).select("a", "b")
        if self.roots is None:
            self.roots = stored(components(found), "roots")
            return
        # later links join components: only their roots are connected anew
        for side in ("a", "b"):
            at = self.roots.select(F.col("v").alias(side), F.col("root").alias("_root"))
            found = found.join(at, side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
        joined = stored(components(found.filter("a <> b")), "roots")
        ends = joined.select(F.col("v").alias("root"), F.col("root").alias("_end"))
        old = self.roots.join(ends, "root", "left").select("v", F.coalesce("_end", "root").alias("root"))
        self.roots = stored(old.unionByName(joined.join(self.roots.select("v"), "v", "left_anti")), "roots")

    def open_nodes(self, members: DataFrame) -> DataFrame:
        """Members of nodes whose documents are not all in one component yet."""
        rooted = self.rooted(members)
        nodes = rooted.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("node", "low")
        return stored(rooted.join(nodes, "node"), "open-members")

    def to_roots(self, members: DataFrame) -> None:
        """Compare the members of open nodes with the smallest root among their node's components: copies of one text that
        are not alike enough among themselves are alike to the text they come from. One pair per member."""
        apart = members.filter(F.col("root") != F.col("low"))
        sizes = self.reps.select(F.col("rep").alias("low"), F.col("n").alias("n_low"))
        pairs = apart.select("low", "rep", "n").distinct().join(sizes, "low").filter(_pairs("n", "n_low", self.percent))
        self.confirm(pairs.select(F.least("low", "rep").alias("a"), F.greatest("low", "rep").alias("b")))


def classes(docs: DataFrame, words: int = 5, percent: int = 75, trees: int = 6) -> DataFrame:
    """(id, n_shingles, component) of `docs` (id, body)."""
    light = stored(signatures(docs, words, trees * PLACES), "signatures")
    reps = stored(light.filter("n_shingles > 0").groupBy("n_shingles", "class").agg(
        F.min("id").alias("rep"), F.min_by("tokens", "id").alias("tokens"), F.min_by("parity", "id").alias("parity")).withColumnRenamed("n_shingles", "n"), "representatives")
    state = _Join(docs, reps, words, percent, trees)
    members = _plant(reps, trees)
    for depth in range(START_DEPTH, PLACES // 2):
        members = stored(_shared(members), "members")
        star = members.filter("rep <> first.rep").select(F.col("first.rep").alias("a"), F.col("rep").alias("b"), F.col("first.n").alias("n_a"), F.col("n").alias("n_b"))
        state.confirm(star.filter(_pairs("n_a", "n_b", percent)))
        left = state.open_nodes(members.filter("size > 2"))  # of two documents the only pair is done
        if left.isEmpty():
            break
        state.to_roots(left)
        left = state.open_nodes(members.filter("size > 2"))
        if left.isEmpty():
            break
        large = left.filter(F.col("size") > SMALL)
        last = large.isEmpty()
        _exhaust(state, left.filter(F.col("size") <= SMALL), once=last and depth == START_DEPTH)
        if last:
            break
        members = _grow(large.select("rep", "n", "node", "used", "tree").join(reps.select("rep", "tokens"), "rep"), trees)
    else:
        _exhaust(state, large, tiny=None)  # ten tokens agree and yet several components: nothing is left but to compare
    of_class = reps.select(F.col("n").alias("n_shingles"), "class", "rep")
    rooted = state.rooted(of_class)
    return light.join(rooted, ["n_shingles", "class"], "left").select("id", "n_shingles", F.coalesce("root", "id").alias("component"))


def _exhaust(state: _Join, members: DataFrame, tiny: int | None = TINY, once: bool = False) -> None:
    """Compare all documents of a node that are in different components: by a join in nodes of up to `tiny` documents (all
    with None; the join is split where a node is large), by their parities first in the others. No link is lost by that:
    sets with d shingles in one of them alone are linked when d * (100 + percent) <= (n_a + n_b) * (100 - percent), and d
    is at least the number of differing bits.

    With `once` all open starting nodes are compared here, so a pair is named by the first node that it shares.
    """
    joined = members.filter(F.col("size") <= tiny) if tiny else members
    one, two = joined.select("node", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("ra")), joined.select(
        "node", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("rb"))
    pairs = one.join(two, "node").filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")))
    pairs = pairs.filter(_pairs("n_a", "n_b", state.percent)).select("a", "b")
    if tiny is None:
        return state.confirm(pairs)
    more = members.filter(F.col("size") > tiny).select("node", "rep", "n", "root").join(state.reps.select("rep", "parity", *["tokens"] * once), "rep")
    percent = state.percent

    def compare(node: pa.Table) -> pa.Table:
        parity = np.frombuffer(b"".join(node.column("parity").to_pylist()), np.uint64).reshape(node.num_rows, -1)
        n, root, rep = node.column("n").to_numpy(), node.column("root").to_numpy(), node.column("rep").to_numpy()
        here = np.uint64(node.column("node")[0].as_py() & 0xFFFFFFFFFFFFFFFF)
        if once:
            tokens = np.frombuffer(b"".join(node.column("tokens").to_pylist()), np.uint32).reshape(node.num_rows, -1, PLACES)
            starts = np.stack([x for _, x, _ in _leaves(tokens)], axis=1)
        found_a, found_b = [], []
        for i in range(node.num_rows - 1):
            apart = (root[i + 1 :] != root[i]) & (np.minimum(n[i + 1 :], n[i]) * 100 >= np.maximum(n[i + 1 :], n[i]) * percent)
            other = np.flatnonzero(apart) + i + 1
            if len(other):
                differ = np.bitwise_count(parity[other] ^ parity[i]).sum(axis=1, dtype=np.int64)
                other = other[differ * (100 + percent) <= (n[other] + n[i]) * (100 - percent)]
            if once and len(other):
                first = (starts[other] == starts[i]).argmax(axis=1)
                other = other[starts[i][first] == here]
            if len(other):
                found_a.append(np.minimum(rep[i], rep[other]))
                found_b.append(np.maximum(rep[i], rep[other]))
        none = np.zeros(0, rep.dtype)
        return pa.table({"a": np.concatenate([none, *found_a]), "b": np.concatenate([none, *found_b])})

    kind = state.reps.schema["rep"].dataType
    likely = more.groupBy("node").applyInArrow(compare, schema_of(None, a=kind, b=kind))  # at most SMALL rows a node
    return state.confirm(pairs.unionByName(likely))


def near_copies(docs: DataFrame, words: int = 5, percent: int = 75, trees: int = 6, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles (long), component_id (smallest id reachable by links), kept.

    Documents are linked when 100 * |intersection| >= `percent` * |union| of their shingle sets. Fewer than `words` words
    make one shingle; null, empty and blank texts have none and stand alone, as do rows with a null id. Rows that
    repeat an id and its text share one decision. Texts of any length are read whole. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("body"))
    named = classes(rows.filter(F.col("id").isNotNull()), words, percent, trees)
    nameless = signatures(rows.filter(F.col("id").isNull()), words, 1).select("id", "n_shingles", F.col("id").alias("component"))
    return named.unionByName(nameless).select(
        F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 75, trees: int = 6, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each group of near copies: the smallest id, in a tie of ids the smaller hash of the text.

    The ids that go are joined, texts stay where they lie when those are few. Where ids repeat or are null, each pair of id
    and text is a document of its own (rows that repeat both share one decision, null ids come first), and no other
    row goes with it. Documents without words stay.
    """
    key, columns = "_near_row", docs.columns
    if not docs.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty():
        docs = _numbered(docs, id_col, text_col, key)
        id_col = key
    gone = stored(near_copies(docs, words, percent, trees, id_col=id_col, text_col=text_col).filter("not kept").select(id_col).distinct(), "near-copies")
    return docs.join(broadcast_if_small(gone, 1_000_000), id_col, "left_anti").select(*columns)


def _numbered(docs: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """`docs` plus a number for each pair of id and text, in the order of ids."""
    hashes = [F.xxhash64(F.col(text_col)).alias("_h1"), F.xxhash64(F.col(text_col), F.lit(1)).alias("_h2")]
    pairs = docs.select(F.col(id_col).alias("_id"), *hashes).distinct().repartitionByRange("_id", "_h1", "_h2").sortWithinPartitions("_id", "_h1", "_h2")
    numbers = stored(pairs.withColumn(key, F.monotonically_increasing_id()), "near-numbers")
    rows, at = docs.select("*", *hashes).alias("d"), numbers.alias("n")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("n._id")) & (F.col("d._h1") == F.col("n._h1")) & (F.col("d._h2") == F.col("n._h2"))
    return stored(rows.join(at, same).select("d.*", f"n.{key}").drop("_h1", "_h2"), "near-rows")
