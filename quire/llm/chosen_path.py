"""N-gram Jaccard join by chosen paths.

Every distinct shingle set is a node. A run follows a path of shared tokens: the tokens are the minima of
random orders of the shingles (sampled from the set in a way that similar sets sample the same), the first
one deals all nodes into buckets, and only buckets over `bucket` nodes are split by the next token, until
they are small or the path has `depth` tokens. All pairs of a bucket are compared on sketches; a bucket that
is still over the bound at full depth is compared as pairs of blocks of half the bound. No path is longer
than `depth`, and `runs` are as many as miss a pair at the least similarity with probability 1 - recall at
most where all its buckets have full depth (see `_runs`); pairs in shorter paths are missed less often.

What the buckets give are candidates, joined to components. Sketches of `size` minima let pairs well below the
least similarity pass, which could join many texts of one template; so the nodes of a component over `block`
nodes are compared once more, on sketches of `fine` minima, and joined anew. Each node's shingles are sent to
its component once, and every pair of a component is checked exactly there; components over `block` nodes or
`bytes` bytes are checked as pairs of blocks, so no task holds more than two blocks. Links are counted, not
emitted.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import slices, text_bytes
from ._order import row_key
from ._storage import looked_up, small, staged
from ._tokens import GOLDEN, constants, grams, group_starts, mix, word_hashes
from .components import connected

_U = np.uint64
#: What rows that are compared with each other have in common.
GROUP = ("key", "run", "p", "q")


def _shingles(h: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of all distinct shingles, sorted; a text of fewer than k words has one."""
    doc = np.repeat(np.arange(len(words)), words)
    g = grams(h, k)
    n = len(g)
    inside = doc[:n] == doc[k - 1 : k - 1 + n] if n else np.empty(0, bool)
    at, value = doc[:n][inside], g[inside]
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(words)])[:-1]
        extra = []
        for d in short:
            own = h[first[d] : first[d] + words[d]]
            extra.append(grams(own, int(words[d]), 7)[0])
        at, value = np.concatenate([at, short]), np.concatenate([value, np.array(extra, _U)])
    order = np.lexsort((value, at))
    at, value = at[order], value[order]
    keep = group_starts(at, value)
    return at[keep], value[keep]


def _fingerprints(at: np.ndarray, value: np.ndarray, n: int) -> list[bytes]:
    """A 16-byte fingerprint of each shingle set; the same for the empty sets."""
    count = np.bincount(at, minlength=n)
    both = np.zeros((n, 2), _U)
    if len(at):
        first = group_starts(at)
        both[at[first], 0] = np.add.reduceat(mix(value ^ _U(0x5851F42D4C957F2D)), first)
        both[at[first], 1] = np.add.reduceat(mix(value ^ _U(0x14057B7EF767814F)), first)
    both += count.astype(_U)[:, None]
    raw = mix(both.reshape(-1)).reshape(n, 2)
    return [raw[i].tobytes() for i in range(n)]


def _minima(at: np.ndarray, value: np.ndarray, n: int, size: int) -> np.ndarray:
    """n x size 32-bit minima of the sets under random orders."""
    out = np.zeros((n, size), np.uint32)
    if len(at):
        first = group_starts(at)
        rows = at[first]
        by, plus = constants(size, 21), constants(size, 22)
        for i in range(size):
            out[rows, i] = np.minimum.reduceat((value * by[i] + plus[i]) >> _U(32), first).astype(np.uint32)
    return out


def _sketches(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = text_bytes(batch.column("_text"))
        nodes, counts, sketches = [], [], []
        for i, j in slices(off):
            h, words = word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            at, value = _shingles(h, words, k)
            nodes += _fingerprints(at, value, j - i)
            counts.append(np.bincount(at, minlength=j - i))
            low = _minima(at, value, j - i, size)
            sketches += [low[x].tobytes() for x in range(j - i)]
        n = np.concatenate(counts) if counts else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_row"), pa.array(nodes, pa.binary()), pa.array(n, pa.int32()), pa.array(sketches, pa.binary())],
            ["id", "row", "node", "n", "sketch"],
        )


def _runs(s: float, depth: int, size: int, recall: float) -> int:
    """The least number of runs that miss a pair of similarity s with probability 1 - recall at most.

    All runs draw their tokens from the same `size` minima, a binomial number of which two sets share, so
    the chance of a miss is the mean of (1 - (shared / size)^depth)^runs over it.
    """
    shared = np.arange(size + 1)
    weight = np.array([math.comb(size, x) * s**x * (1 - s) ** (size - x) for x in shared.tolist()])
    path = (shared / size) ** depth
    return next(r for r in itertools.count(8) if (weight * (1 - path) ** r).sum() <= 1 - recall or r >= 1024)


def _orders(runs: int, depth: int, size: int) -> np.ndarray:
    """The tokens that each run follows: distinct first ones, then a shuffle of the others."""
    out = np.empty((runs, depth), np.int64)
    for r in range(runs):
        rest = np.argsort(mix(np.arange(size, dtype=_U) * _U(GOLDEN) + _U(r + 1)))
        rest = rest[rest != r % size]
        out[r] = np.concatenate([[r % size], rest])[:depth]
    return out


def _paths(nodes: DataFrame, runs: int, depth: int, size: int, bucket: int) -> DataFrame:
    """(run, key, p, q, node, sketch): the bucket of each node in each run, and the pair of blocks in it.

    Keys are extended by one token as long as buckets over the bound remain. A bucket that is over it at full
    depth is dealt into blocks, and its nodes go to each pair (p, q) that their block is in; else both are 0.
    """
    order = _orders(runs, depth, size)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(n, size)
            low = pa.array([x.tobytes() for x in (sketch & 0xFF).astype(np.uint8)], pa.binary())
            take = pa.array(np.tile(np.arange(n), runs))
            keys = [mix(sketch[:, order[r, 0]].astype(_U) + _U(((r + 1) * GOLDEN) & (2**64 - 1))) for r in range(runs)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(runs), n), pa.int32()),
                    pa.array(np.concatenate(keys).view(np.int64), pa.int64()),
                    batch.column("node").take(take),
                    low.take(take),
                ],
                ["run", "key", "node", "sketch"],
            )

    rows = nodes.where("n > 0").select("node", "sketch").mapInArrow(first, "run int, key bigint, node binary, sketch binary")
    rows = rows.withColumn("open", F.lit(True))
    tokens = F.array(*[F.array(*[F.lit(int(x) + 1) for x in o]) for o in order])
    for d in range(1, depth + 1):
        over = staged(rows.where("open").groupBy("key").count().where(F.col("count") > bucket).select("key", F.col("count").alias("over")), "over")
        if not over.limit(1).count():
            return rows.select("run", "key", F.lit(0).alias("p"), F.lit(0).alias("q"), "node", "sketch")
        rows = rows.join(small(over), "key", "left").withColumn("open", F.col("open") & F.col("over").isNotNull())
        if d < depth:
            rows = rows.drop("over")
            token = F.substring("sketch", tokens[F.col("run")][d], 1)
            rows = rows.withColumn("key", F.when(F.col("open"), F.xxhash64("key", token)).otherwise(F.col("key")))
    of = F.when(F.col("open"), F.ceil(2 * F.col("over") / bucket)).otherwise(1).cast("int")
    return _block_pairs(rows.withColumn("of", of)).select("run", "key", "p", "q", "node", "sketch")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """rows dealt into `of` blocks, and to each pair (p, q) of different ones that their block is in."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("of")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("of") - 1), lambda x: (x != F.col("own")) | (F.col("of") == 1))
    rows = rows.withColumn("other", F.explode(others))
    return rows.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))


def _brute(sketch: np.ndarray, group: np.ndarray, agree: int, reach: int) -> np.ndarray:
    """Labels 0..n-1 of rows joined within groups (sorted) where sketches agree; groups of up to reach rows."""
    n = len(group)
    label = np.arange(n)
    links = []
    for d in range(1, min(reach, n)):
        left = np.flatnonzero(group[:-d] == group[d:])
        if not len(left):
            break
        for s in range(0, len(left), 1 << 16):
            part = left[s : s + (1 << 16)]
            same = (sketch[part] == sketch[part + d]).sum(1) >= agree
            links.append(np.stack([part[same], part[same] + d], 1))
    links = np.concatenate(links) if links else np.empty((0, 2), np.int64)
    while len(links):
        before = label.copy()
        least = np.minimum(label[links[:, 0]], label[links[:, 1]])
        np.minimum.at(label, links[:, 0], least)
        np.minimum.at(label, links[:, 1], least)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _spread(sketch: np.ndarray, agree: int) -> np.ndarray:
    """Labels 0..n-1 of the rows of one group, joined where sketches agree: each row is compared with all that
    no row has reached yet, the reached ones first."""
    n = len(sketch)
    label = np.arange(n)
    left, rest = np.arange(n), np.ascontiguousarray(sketch.T)
    queue: list[int] = []
    while len(left):
        if queue:
            own = queue.pop()
        else:
            own, left, rest = int(left[0]), left[1:], rest[:, 1:]
        near = (rest == sketch[own][:, None]).sum(0, dtype=np.uint16) >= agree
        if near.any():
            label[left[near]] = label[own]
            queue += left[near].tolist()
            left, rest = left[~near], np.ascontiguousarray(rest[:, ~near])
    return label


def _candidates(batches: Iterator[pa.RecordBatch], agree: int, reach: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Links that join the nodes of each bucket whose sketches agree, of rows sorted by key, run and blocks.

    Buckets of up to `reach` nodes are compared many at a time.
    """

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        n = table.num_rows
        node = table["node"].combine_chunks()
        raw = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8)
        sketch = raw.reshape(n, -1)
        heads = group_starts(*(table[c].to_numpy() for c in GROUP))
        sizes = np.diff(np.append(heads, n))
        a, b = [], []
        mid = heads[(sizes > 1) & (sizes <= reach)]
        if len(mid):
            length = sizes[(sizes > 1) & (sizes <= reach)]
            rows = np.repeat(mid - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            label = _brute(sketch[rows], np.repeat(np.arange(len(mid)), length), agree, reach)
            own = np.flatnonzero(label != np.arange(len(label)))
            a.append(rows[own])
            b.append(rows[label[own]])
        for head, length in zip(heads[sizes > reach], sizes[sizes > reach], strict=True):
            label = _spread(sketch[head : head + length], agree)
            own = np.flatnonzero(label != np.arange(length))
            a.append(head + own)
            b.append(head + label[own])
        if not a or not sum(map(len, a)):
            return None
        return pa.RecordBatch.from_arrays([node.take(pa.array(np.concatenate(a))), node.take(pa.array(np.concatenate(b)))], ["a", "b"])

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < 4 * bucket:
            continue
        whole = pa.concat_tables(held).combine_chunks()
        last = group_starts(*(whole[c].to_numpy() for c in GROUP))[-1]  # may go on in the next batch
        if last and (out := solve(whole.slice(0, last))):
            yield out
        held = [whole.slice(last)]
        size = held[0].num_rows
    if held and (out := solve(pa.concat_tables(held).combine_chunks())):
        yield out


def _check(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Exact links within each (component, row block, column block), of rows sorted by these.

    Gives for each node its number of links there and the least node it is connected to there.
    """

    def solve(rows: list[tuple[bytes, int, bytes]]) -> tuple[list[bytes], list[int], list[bytes]]:
        seen: dict[bytes, tuple[bytes, int, bytes]] = {x[0]: x for x in rows}
        rows = sorted(seen.values())
        if len(rows) < 2:
            return [], [], []
        sets = [np.frombuffer(x[2], _U) for x in rows]
        sizes, side = np.array([len(x) for x in sets]), np.array([x[1] for x in rows])
        inter = _overlaps(sets)
        union = sizes[:, None] + sizes[None, :] - inter
        near = den * inter >= num * union
        np.fill_diagonal(near, False)
        if side[0]:  # two blocks: pairs within a block are counted elsewhere
            near &= side[:, None] != side[None, :]
        links = near.sum(1)
        label = np.arange(len(rows))
        while True:
            least = np.minimum(label, np.where(near, label[None, :], len(rows)).min(1))
            least = least[least]
            if np.array_equal(least, label):
                break
            label = least
        own = np.flatnonzero(links)
        return [rows[i][0] for i in own], [int(links[i]) for i in own], [rows[label[i]][0] for i in own]

    held: list[tuple[bytes, int, bytes]] = []
    at = None
    out: tuple[list, list, list] = ([], [], [])
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("root", "p", "q", "node", "side", "grams")]
        for root, p, q, node, side, raw in zip(*cols, strict=True):
            if (root, p, q) != at:
                for x, y in zip(out, solve(held), strict=True):
                    x.extend(y)
                held, at = [], (root, p, q)
            held.append((node, side, raw))
        if len(out[0]) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["node", "links", "least"])
            out = ([], [], [])
    for x, y in zip(out, solve(held), strict=True):
        x.extend(y)
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["node", "links", "least"])


def _overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices of at most width shingles at a time."""
    n = len(sets)
    if n == 2:
        x = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), x], [x, len(sets[1])]])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    heads = group_starts(flat)
    sizes = np.diff(np.append(heads, len(flat)))
    column = np.repeat(np.arange(len(heads)), sizes)
    shared = np.repeat(sizes > 1, sizes)
    inter = np.diag([float(len(x)) for x in sets])
    lone = np.bincount(owner[shared], minlength=n)
    np.fill_diagonal(inter, np.diag(inter) - lone)
    owner, column = owner[shared], column[shared]
    if len(column):
        column = np.cumsum(np.concatenate([[0], (np.diff(column) > 0).astype(np.int64)]))
        for start in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [start, start + width])
            matrix = np.zeros((n, min(width, int(column[-1]) + 1 - start)), np.float32)
            matrix[owner[a:b], column[a:b] - start] = 1
            inter += matrix @ matrix.T
    return np.rint(inter).astype(np.int64)


def _agree(s: float, size: int, sigmas: float = 4.0) -> int:
    """Of `size` minima, how many agree at least for sets of similarity s, but for chance deviations."""
    return math.floor(size * (s - sigmas * math.sqrt(s * (1 - s) / size)))


def _refined(members: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, fine: int, s: float, reach: int, bucket: int, block: int) -> DataFrame:
    """members (node, root) with the components of over `block` nodes joined anew, on sketches of `fine` minima."""
    spark = members.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = staged(members.groupBy("root").count().where(F.col("count") > block), "large")
    if not sizes.limit(1).count():
        return members
    large = members.join(small(sizes), "root").join(nodes.select("node", "row"), "node")
    large = staged(large.select("row", F.xxhash64("root").alias("key"), F.ceil(2 * F.col("count") / bucket).cast("int").alias("of")), "large")
    found = docs.join(small(large), docs["_row"] == large["row"]).select("_id", "_row", "_text", "key", "of")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in _sketches(iter([batch]), k, fine):
                low = [np.frombuffer(x, np.uint32).astype(np.uint8).tobytes() for x in out.column("sketch").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("of"), out.column("node"), pa.array(low, pa.binary())], ["key", "of", "node", "sketch"])

    rows = found.mapInArrow(sketches, "key bigint, of int, node binary, sketch binary")
    rows = _block_pairs(rows).select(F.lit(0).alias("run"), "key", "p", "q", "node", "sketch")
    dealt = rows.repartition(width, "key", "p", "q").sortWithinPartitions(*GROUP, "node")
    again = connected(dealt.mapInArrow(lambda x: _candidates(x, _agree(s, fine), reach, bucket), "a binary, b binary"))
    kept = members.join(small(sizes.select("root")), "root", "left_anti")
    return staged(kept.select("node", "root").unionByName(again.select("node", "root")), "members")


def near_classes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    similarity: tuple[int, int] = (4, 5),
    recall: float = 0.999,
    size: int = 64,
    bucket: int = 4096,
    depth: int = 3,
    reach: int = 48,
    block: int = 1024,
    fine: int = 512,
    bytes: int = 16 << 20,
) -> DataFrame:
    """One row for each row of df: `id`, `class_id`, `n_links`, `row`, `class_row`.

    Texts are compared by their sets of k consecutive words (white-space separated, as they are; a text of
    fewer words has one shingle, all of it). Two distinct sets are linked if their Jaccard similarity is at
    least `similarity`, a fraction compared exactly. `n_links` is the number of other distinct sets that a
    text's set is linked to; equal sets are one node. `class_id` is the least id of the rows whose sets are
    connected by links. `row` is row_key of the id and the text, and `class_row` that of the first row of
    the class, by id (null last) and key: the row to keep where one of each class is to stay.

    Defined cases: null and empty texts have the empty set, which is equal to itself and linked to nothing;
    rows with equal ids are separate rows, classed by their texts; a null id is never a class id unless all
    ids of the class are null; an empty table gives an empty table; other columns are not looked at.
    """
    spark = df.sparkSession
    num, den = similarity
    s = num / den
    runs = _runs(s, depth, size, recall)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    docs = docs.select("_id", row_key("_id", "_text").alias("_row"), F.coalesce("_text", F.lit("")).alias("_text"))

    rows = staged(docs.mapInArrow(lambda x: _sketches(x, k, size), "id bigint, row bigint, node binary, n int, sketch binary"), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row")).alias("rep")
    nodes = rows.groupBy("node").agg(first, F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    nodes = staged(nodes.withColumn("row", F.col("rep.row")), "nodes")
    paths = _paths(nodes, runs, depth, size, bucket)
    dealt = paths.repartition(width, "key", "p", "q").sortWithinPartitions(*GROUP, "node")
    pairs = dealt.mapInArrow(lambda x: _candidates(x, _agree(s, size), reach, bucket), "a binary, b binary")
    members = _refined(staged(connected(pairs), "members"), nodes, docs, k, fine, s, reach, bucket, block)
    wanted = members.join(nodes.select("node", "row", "n"), "node")
    parts = wanted.groupBy("root").agg(F.count("*").alias("of"), F.sum("n").alias("shingles")).where("of > 1")
    parts = parts.select("root", F.greatest(F.ceil(F.col("of") / block), F.ceil(8 * F.col("shingles") / bytes)).cast("int").alias("of"))
    wanted = staged(wanted.join(small(parts), "root").select("root", "of", "node", "row"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_bytes(batch.column("_text"))
            expected = batch.column("node").to_pylist()
            keep, raw = [], []
            for i, j in slices(off):
                h, words = word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                at, value = _shingles(h, words, k)
                ends = np.searchsorted(at, np.arange(j - i + 1))
                for x, node in enumerate(_fingerprints(at, value, j - i)):
                    if node == expected[i + x]:
                        keep.append(i + x)
                        raw.append(value[ends[x] : ends[x + 1]].tobytes())
            out = pa.Table.from_batches([batch]).select(["root", "of", "node"]).take(pa.array(keep, pa.int64()))
            yield from out.append_column("grams", pa.array(raw, pa.binary())).combine_chunks().to_batches()

    found = docs.join(small(wanted), docs["_row"] == wanted["row"]).select("_text", "root", "of", "node")
    grams_of = found.mapInArrow(sets, "root binary, of int, node binary, grams binary")
    own = F.pmod(F.xxhash64("node"), F.col("of")).cast("int")
    grams_of = grams_of.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    grams_of = grams_of.select(
        "root",
        F.least("own", "other").alias("p"),
        F.greatest("own", "other").alias("q"),
        "node",
        F.when(F.col("own") == F.col("other"), 0).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(2)).alias("side"),
        "grams",
    )
    tasks = grams_of.repartition(width, "root", "p", "q").sortWithinPartitions("root", "p", "q")
    checked = staged(tasks.mapInArrow(lambda x: _check(x, num, den), "node binary, links bigint, least binary"), "links")
    linked = checked.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = connected(checked, "node", "least")
    named = roots.join(nodes.select("node", "rep"), "node").join(linked, "node")
    least = named.groupBy("root").agg(F.min("rep").alias("best"), F.count("*").alias("weight"))
    classes = looked_up(named, staged(least, "classes"), "root", "weight", members.count()).select("node", "best", "n_links")
    full = nodes.select("node", "rep", "copies").join(classes, "node", "left").withColumn("best", F.coalesce("best", "rep"))
    full = full.select("node", F.col("best.id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.col("best.row").alias("class_row"), "copies")
    return looked_up(rows.select("id", "row", "node"), staged(full, "classes"), "node", "copies", rows.count()).select("id", "class_id", "n_links", "row", "class_row")
