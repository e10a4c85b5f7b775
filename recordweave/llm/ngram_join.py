"""Self-join of documents by the Jaccard similarity of their word shingles, as components.

A document is its set of 64-bit shingle hashes; equal sets, known by a 128-bit digest,
are one node. All tokens have one order: by how many chunks of the corpus hold them
(counted exactly over all documents, on a grid of eighths of a power of two), then by
value. A pair that links shares a token among the first n/5 + 1 of both sets, and a
token that only one document holds cannot be it, so most documents are done after the
count and only the rest is searched.

Counting is two packed shuffles: chunks of documents send their distinct tokens in
sorted runs of gaps of four bytes, and get back those that occur elsewhere. A token's traffic
grows with the chunks, not with the documents that hold it.

The search is the T-occurrence problem. Candidates are grouped by centre, in groups of
bounded size; over their sets inverted lists are built, DivideSkip sets the longest
aside, merges the short ones with a heap, and probes survivors in the long ones by
binary search. It runs in two passes:

* Lists of at most SMALL members meet in full. Longer ones meet in one centre, the same
  node in most lists of a group of copies. As Jaccard distance is a metric, a centre
  settles the members it links unless a member of another component is near enough.
* What is not settled is counted anew, over these nodes alone: tokens within one
  component no longer matter. The nodes that still share a token form clusters, and in
  each cluster every node is searched against the inverted lists of all others, in
  blocks of bounded size. This pass leaves nothing open.

Null and empty texts have no shingles and link with nothing; equal rows and rows
that share an id are one node each text; null ids take part and never name a
component; ties in the order of tokens fall to their values; very long texts are one
set like any other; an empty table gives no rows; only doc_id and text are read, so
other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, blocks, cut, inside, ngrams, remove_dir, row_key, shared_dir, small_batches, spread_join, table, text_bytes
from .components import components

K = 5
#: Text bytes of one chunk and of one task; tokens of about so many bytes are counted at once.
CHUNK_BYTES, TASK_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20, 8 << 20
#: Token lists of at most so many members meet in full.
SMALL = 16
#: Candidates of one centre that are searched at once.
GROUP = 512
#: Tokens of one block of a cluster.
BLOCK_TOKENS = 1 << 16
#: DivideSkip's cost rule: what a step of the merge costs against a binary probe.
MU = 0.01
#: Entries of short lists up to which the heap is Python's own; above it the runs are merged by a stable sort.
HEAP = 2000


def shingle_sets(column: pa.Array, k: int = K) -> Iterator[np.ndarray]:
    """Of each text: its sorted distinct shingle hashes."""
    off, data = text_bytes(column)
    for lo, hi in blocks(off):
        w = Words(off[lo : hi + 1] - off[lo], data[off[lo] : off[hi]])
        h = w.hashes(lower=True)
        g = ngrams(h, k)
        for i in range(hi - lo):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= k:
                s = np.sort(g[a : b - k + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                yield ngrams(h[a:b], b - a)  # fewer words than k: the whole sequence is the one shingle
            else:
                yield np.zeros(0, np.uint64)


# ---- counting: packed runs of tokens ----
def _pack(tokens: np.ndarray) -> tuple[bytes, bytes]:
    """A sorted run as gaps of four bytes, and (place, upper part) of the few gaps that need more."""
    gaps = np.diff(tokens, prepend=np.uint64(0))
    wide = np.flatnonzero(gaps >> np.uint64(32))
    return gaps.astype("<u4").tobytes(), (wide.astype("<u8") << np.uint64(16) | gaps[wide] >> np.uint64(32)).astype("<u8").tobytes()


def _unpack(low: list[bytes], wide: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of runs, one after the other, and how many each run has."""
    size = np.array([len(x) // 4 for x in low], np.int64)
    first = np.cumsum(size) - size
    gaps = np.frombuffer(b"".join(low), "<u4").astype(np.uint64)
    more = np.frombuffer(b"".join(wide), "<u8")
    at = np.repeat(first, [len(x) // 8 for x in wide]) + (more >> np.uint64(16)).astype(np.int64)
    gaps[at] += (more & np.uint64(0xFFFF)) << np.uint64(32)
    # one running sum, less what it was before each run
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(gaps)])
    return sums[1:] - np.repeat(sums[first], size), size


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Starts of runs of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def _grid(n: np.ndarray) -> np.ndarray:
    """Counts on a grid of eighths of a power of two; 1 becomes 0, and anything above it more."""
    return np.minimum(255, np.ceil(8 * np.log2(np.maximum(n, 1)))).astype(np.uint8)


def _tokens(k: int, buckets: int):
    """The first 48 bits of a chunk's distinct tokens and the number of its documents that hold them, by bucket."""

    def run(chunk: pa.Table) -> pa.Table:
        sets = list(shingle_sets(chunk.column("text"), k))
        flat = np.sort(np.concatenate([np.zeros(0, np.uint64), *sets])) >> np.uint64(16)
        at = _runs(flat)
        tokens, n = flat[at], np.minimum(255, np.diff(np.append(at, len(flat)))).astype(np.uint8)
        bounds = np.searchsorted(tokens, [(i << 48) // buckets + ((i << 48) % buckets > 0) for i in range(buckets + 1)])
        out = [(i, *_pack(tokens[lo:hi]), n[lo:hi].tobytes()) for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if hi > lo]
        number = chunk.column("chunk")[0].as_py() if chunk.num_rows else 0
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([number] * len(out), pa.int32()), *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2, 3))], names=["b", "chunk", "t", "w", "n"])

    return run


def _count(rows: pa.Table) -> pa.Table:
    """For each chunk of a bucket: its tokens that two documents or more hold, and their counts on the grid."""
    n = np.frombuffer(b"".join(rows.column("n").to_pylist()), np.uint8)
    tokens, lengths = _unpack(rows.column("t").to_pylist(), rows.column("w").to_pylist())
    owner = np.repeat(np.arange(len(lengths)), lengths)
    again = np.flatnonzero(n > 1)  # tokens that one chunk holds several times
    more, extra = tokens[again], n[again].astype(np.int64) - 1
    if len(lengths) <= 1 << 16:  # token and owner fit one number, which sorts fastest
        both = np.sort(tokens << np.uint64(16) | owner.astype(np.uint64))
        tokens, owner = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.uint16)
    else:
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
    at = _runs(tokens)
    size = np.diff(np.append(at, len(tokens)))
    total = size.copy()
    np.add.at(total, np.searchsorted(tokens[at], more), extra)
    keep = np.repeat(total > 1, size)
    tokens, owner, rank = tokens[keep], owner[keep], np.repeat(_grid(total), size)[keep]
    order = np.argsort(owner, kind="stable")
    tokens, owner, rank = tokens[order], owner[order], rank[order]
    bounds = np.searchsorted(owner, np.arange(len(lengths) + 1)).tolist()
    some = [i for i in range(len(lengths)) if bounds[i + 1] > bounds[i]]
    packed = [_pack(tokens[bounds[i] : bounds[i + 1]]) for i in some]
    return pa.table(
        [rows.column("chunk").combine_chunks().take(pa.array(some, pa.int64())), *(pa.array([x[i] for x in packed], pa.binary()) for i in (0, 1)), pa.array([rank[bounds[i] : bounds[i + 1]].tobytes() for i in some], pa.binary())],
        names=["chunk", "t", "w", "r"],
    )


_SIGNED = "doc_id long, k long, n long, x binary, shared int, prefix array<long>, tokens binary"


def _signatures(k: int):
    def run(chunk: pa.Table, counted: pa.Table) -> pa.Table:
        known, rank = _unpack(counted.column("t").to_pylist(), counted.column("w").to_pylist())[0], np.frombuffer(b"".join(counted.column("r").to_pylist()), np.uint8)
        order = np.argsort(known)
        known, rank = np.append(known[order], np.uint64(1 << 63)), np.append(rank[order], 0)
        sets = list(shingle_sets(chunk.column("text"), k))
        n = np.array([len(s) for s in sets], np.int64)
        first = np.concatenate([[0], np.cumsum(n)])
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        head = flat >> np.uint64(16)
        at = np.searchsorted(known, head)
        hit = known[at] == head
        ends = np.concatenate([[0], np.cumsum(hit)])
        shared = ends[first[1:]] - ends[first[:-1]]
        left = n // 5 + 1 - (n - shared)
        x = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
        prefix, raw, seen = [None] * len(sets), [None] * len(sets), set()
        for i in np.flatnonzero((left > 0) & (n > 0)).tolist():
            if x[i] in seen:
                continue
            seen.add(x[i])
            some = first[i] + np.flatnonzero(hit[first[i] : first[i + 1]])
            prefix[i] = flat[some[np.argsort(rank[at[some]], kind="stable")[: left[i]]]].view(np.int64)
            raw[i] = sets[i].tobytes()
        return pa.table(
            [chunk.column("doc_id"), chunk.column("k"), pa.array(n), pa.array(x, pa.binary()), pa.array(shared.astype(np.int32)), pa.array(prefix, pa.list_(pa.int64())), pa.array(raw, pa.binary())],
            names=["doc_id", "k", "n", "x", "shared", "prefix", "tokens"],
        )

    return run


def signatures(docs: DataFrame, k: int, path: str) -> DataFrame:
    """One row a document: its key, set size and digest; with prefix and tokens where it may link (once a chunk for equal sets)."""
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, tasks = math.ceil(size / CHUNK_BYTES) or 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))
    keyed = docs.select("doc_id", "text", row_key().alias("k")).withColumn("chunk", F.pmod(F.xxhash64("k"), F.lit(chunks)).cast("int")).repartition(tasks, "chunk")
    buckets = max(tasks, math.ceil(size / BUCKET_BYTES))
    runs = keyed.groupBy("chunk").applyInArrow(_tokens(k, buckets), "b int, chunk int, t binary, w binary, n binary")
    counted = runs.groupBy("b").applyInArrow(_count, "chunk int, t binary, w binary, r binary")
    return cut(keyed.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_signatures(k), _SIGNED), path)


# ---- T-occurrence search ----
class Inverted:
    """Inverted lists over the sets of a block, as one table sorted by (token, member)."""

    def __init__(self, sets: list[np.ndarray]):
        flat, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.tokens, self.owner, self.n = flat[order], owner[order], len(sets)
        self.starts = _runs(self.tokens)
        self.distinct, self.ends = self.tokens[self.starts], np.append(self.starts[1:], len(flat))

    def lists(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the lists of the query's tokens, shortest first."""
        at = np.searchsorted(self.distinct, query)
        at = at[(at < len(self.distinct)) & (self.distinct[np.minimum(at, len(self.distinct) - 1)] == query)] if len(self.distinct) else at[:0]
        size = self.ends[at] - self.starts[at]
        at = at[np.argsort(size, kind="stable")]
        return self.starts[at], self.ends[at]

    def _merge(self, query: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Members that the short lists leave, how often they hold them, and the long lists."""
        lo, hi = self.lists(query)
        if t < 1 or len(lo) < t:
            return lo[:0], lo[:0], lo[:0], hi[:0]
        n_long = long_lists(t, int(hi[-1] - lo[-1]), len(lo))
        n_short, need = len(lo) - n_long, t - n_long
        short = [self.owner[a:b] for a, b in zip(lo[:n_short].tolist(), hi[:n_short].tolist(), strict=True)]
        if sum(map(len, short)) <= HEAP:
            merged = np.fromiter(heapq.merge(*(x.tolist() for x in short)), np.int64)
        else:
            merged = np.sort(np.concatenate(short), kind="stable")  # sorted runs: the same merge, outside the interpreter
        at = _runs(merged)
        counts = np.diff(np.append(at, len(merged)))
        alive = counts >= need
        return merged[at[alive]], counts[alive], lo[n_short:], hi[n_short:]

    def survivors(self, query: np.ndarray, t: int) -> list[int]:
        return self._merge(query, t)[0].tolist()

    def search(self, query: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(members, overlap) of the sets that share at least ``t`` tokens with ``query``."""
        members, overlap, lo, hi = self._merge(query, t)
        if len(lo) and len(members):
            # one sorted table of (list, member): every survivor is probed in every long list by binary search
            length = hi - lo
            place = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
            key = np.repeat(np.arange(len(lo)), length) * self.n + self.owner[place]
            probe = (np.arange(len(lo))[None, :] * self.n + members[:, None]).ravel()
            at = np.minimum(np.searchsorted(key, probe), len(key) - 1)
            overlap = overlap + (key[at] == probe).reshape(len(members), -1).sum(1)
        enough = overlap >= t
        return members[enough], overlap[enough]


def long_lists(t: int, longest: int, lists: int) -> int:
    """How many lists DivideSkip sets aside: more the cheaper a probe is against the merge, fewer than ``t``."""
    return max(0, min(t - 1, lists, int(t / (MU * math.log2(max(2, longest)) + 1))))


def divide_skip(query: np.ndarray, sets: list[np.ndarray], least: list[int]) -> dict[int, int]:
    """Overlap with ``query`` of each set i that shares at least ``least[i]`` tokens with it."""
    if not sets or not len(query):
        return {}
    members, overlap = Inverted(sets).search(query, min(least))
    return {i: o for i, o in zip(members.tolist(), overlap.tolist(), strict=True) if o >= least[i]}


def _needed(a: int, b):
    """Overlap at which sets of these sizes have a similarity of 0.8."""
    return (4 * (a + b) + 8) // 9


def _near(a: int, b):
    """Overlap at which they have one of 0.6."""
    return (3 * (a + b) + 7) // 8


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows of one key, which follow each other; a group is bounded by how its key was dealt."""
    held, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[c] for c in keys)
            if key != now and held:
                yield held
                held = []
            now = key
            held.append(row)
    if held:
        yield held


_FOUND = "c long, y long, linked boolean, distance double"


def _search_centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each centre and its candidates (its own row comes first): those of a similarity of 0.6 or more."""
    out = []
    for rows in _grouped(batches, ["c", "part"]):
        centre, rest = rows[0], rows[1:]
        query, sets = np.frombuffer(centre["tokens"], np.uint64), [np.frombuffer(r["tokens"], np.uint64) for r in rest]
        if not sets:
            continue
        for i, o in divide_skip(query, sets, [_near(len(query), len(x)) for x in sets]).items():
            n = len(sets[i])
            out.append((centre["c"], rest[i]["y"], o >= _needed(len(query), n), 1 - o / (len(query) + n - o)))
        if len(out) > 10_000:
            yield _found(out)
            out = []
    yield _found(out)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.float64())], names=["c", "y", "linked", "distance"])


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components within a pair of blocks, as few as join what links."""
    for rows in _grouped(batches, ["cluster", "i", "j"]):
        left, right = [r for r in rows if r["own"] == r["i"]], [r for r in rows if r["own"] == r["j"]]
        parent: dict[int, int] = {r["label"]: r["label"] for r in rows}

        def root(a: int, parent: dict[int, int] = parent) -> int:
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        right = sorted(right, key=lambda r: r["n"])
        size = np.array([r["n"] for r in right], np.int64)
        index, out = Inverted([np.frombuffer(r["tokens"], np.uint64) for r in right]), []
        for r in left:
            query = np.frombuffer(r["tokens"], np.uint64)
            members, overlap = index.search(query, -(-4 * len(query) // 5))  # sets below 4/5 of its size cannot link
            for i in members[overlap >= _needed(len(query), size[members])].tolist():
                a, b = root(r["label"]), root(right[i]["label"])
                if a != b:
                    parent[a] = b
                    out.append((r["id"], right[i]["id"], True, 0.0))
        yield _found(out)


# ---- the two passes ----
def _by_size(name: str, nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("shared").alias(f"shared_{name}"))


def _star_pass(members: DataFrame, nodes: DataFrame, total: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(what was found around centres, the centre of each long list)."""
    spark = members.sparkSession
    short = members.where(F.col("size") <= SMALL).groupBy("t").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids").distinct()
    pairs = short.select(F.explode("ids").alias("c"), "ids").select("c", F.explode("ids").alias("y")).where("c < y")
    # one order of nodes for all lists, so that lists of one group of copies have the same centre
    centres = members.where(F.col("size") > SMALL).groupBy("t").agg(F.min(F.struct(F.xxhash64("id").alias("r"), F.col("id"))).alias("c"), F.count("*").alias("size")).select("t", F.col("c.id").alias("c"), "size")
    centres = cut(centres, f"{folder}/centres")
    stars = spread_join(members.select("t", F.col("id").alias("y")), centres, "t", "size", total).where("c <> y").select("c", "y")
    todo = pairs.unionByName(stars).distinct()
    # a pair of stars is of use up to a distance of 0.4, so the bound is that of 0.6 for all
    todo = todo.join(_by_size("c", nodes), "c").join(_by_size("y", nodes), "y").where("least(shared_c, shared_y) >= (3 * (n_c + n_y) + 7) div 8").select("c", "y")
    todo = cut(todo, f"{folder}/todo")
    groups = todo.groupBy("c").agg(F.ceil(F.count("*") / GROUP).alias("parts"), F.count("*").alias("n"))
    own = groups.select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("c").alias("y"), F.lit(0).alias("role"))
    others = spread_join(todo, groups, "c", "n", total).select("c", F.pmod(F.xxhash64("y"), F.col("parts")).alias("part"), "y", F.lit(1).alias("role"))
    dealt = own.unionByName(others).join(nodes.select(F.col("id").alias("y"), "tokens"), "y")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c", "part").sortWithinPartitions("c", "part", "role", "y").select("c", "part", "y", "tokens")
    return cut(dealt.mapInArrow(_search_centres, _FOUND), f"{folder}/near"), centres


def _open(members: DataFrame, centres: DataFrame, near: DataFrame, labels: DataFrame, total: int, folder: str) -> DataFrame:
    """(id, label) of members of long lists that the centre did not settle."""
    of = lambda key: labels.select(F.col("node").alias(key), F.col("label").alias(f"{key}_label"))
    named = centres.join(of("c"), "c", "left").withColumn("c_label", F.coalesce("c_label", "c"))
    long_ = spread_join(members.where(F.col("size") > SMALL).select("t", "id"), named, "t", "size", total).where("id <> c")
    both = near.select("c", F.col("y").alias("id"), "linked", "distance").unionByName(near.select(F.col("y").alias("c"), F.col("c").alias("id"), "linked", "distance"))
    seen = long_.join(both, ["c", "id"], "left").join(of("id"), "id", "left")
    seen = cut(seen.select("t", "id", "linked", "distance", F.coalesce("id_label", "id").alias("label"), "c_label"), f"{folder}/seen")
    other = F.col("label") != F.col("c_label")
    # the least distance of another component; those further than 0.4 have none
    lists = seen.groupBy("t").agg(F.min(F.when(other, F.col("distance"))).alias("nearest"), F.max(other).alias("others"), F.count("*").alias("size")).where("others").drop("others")
    settled = (F.col("label") == F.col("c_label")) & F.coalesce(F.col("linked"), F.lit(False)) & (F.col("nearest").isNull() | (F.col("distance") + 0.2 + 1e-9 < F.col("nearest")))
    left = cut(spread_join(seen, lists, "t", "size", total).where(~settled).select("t", "id", "label"), f"{folder}/left")
    many = left.groupBy("t").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low <> high").select("t", "size")
    return spread_join(left, many, "t", "size", total).select("id", "label").distinct()


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 100):
            part = batch.slice(lo, 100)
            sets = [np.frombuffer(x, np.int64) for x in part.column("tokens").to_pylist()]
            index = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets])), part.column("id").take(index), part.column("label").take(index)], names=["t", "id", "label"])


def _block_pass(open_: DataFrame, folder: str) -> DataFrame | None:
    """Links among the open nodes (id, label, n, tokens), each searched against all of its cluster."""
    spark = open_.sparkSession
    tokens = cut(open_.select("id", "label", "tokens").mapInArrow(_explode, "t long, id long, label long"), f"{folder}/tokens")
    # tokens of one component cannot be shared by a pair that matters
    several = tokens.groupBy("t").agg(F.count("*").alias("df"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("t", "df")
    ranked = tokens.join(several, "t").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("some"))
    prefix = ranked.join(open_.select("id", "n"), "id").select("id", F.slice("some", 1, F.greatest(F.lit(0), F.size("some") - F.col("n") + F.floor(F.col("n") / 5) + 1).cast("int")).alias("some"))
    lists = cut(prefix.select("id", F.explode("some.t").alias("t")), f"{folder}/lists")
    edges = lists.join(lists.groupBy("t").agg(F.min("id").alias("low")), "t").select(F.col("id").alias("a"), F.col("low").alias("b")).where("a <> b")
    edges = cut(edges.distinct(), f"{folder}/edges")
    if edges.isEmpty():
        return None
    clusters = components(edges).select(F.col("node").alias("id"), F.col("label").alias("cluster"))
    nodes = cut(open_.join(clusters, "id").select("cluster", "id", "label", "n", "tokens"), f"{folder}/clusters")
    sizes = nodes.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("blocks"))
    own = nodes.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "label", "n", "tokens")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id")
    return cut(dealt.mapInArrow(_search_blocks, _FOUND), f"{folder}/blocks").select(F.col("c").alias("a"), F.col("y").alias("b"))


def _labels(sig: DataFrame, folder: str) -> DataFrame:
    """(x, label) of the nodes that link with another; label is the same for all of a component."""
    own = sig.where("prefix IS NOT NULL").groupBy("x").agg(F.first(F.struct("n", "shared", "prefix", "tokens")).alias("s"))
    nodes = cut(own.select(F.monotonically_increasing_id().alias("id"), "x", "s.*"), f"{folder}/nodes")
    lists = nodes.select("id", F.explode("prefix").alias("t"))
    members = cut(lists.join(lists.groupBy("t").agg(F.count("*").alias("size")).where("size > 1"), "t").select("t", "id", "size"), f"{folder}/members")
    total = members.count()
    near, centres = _star_pass(members, nodes, total, folder)
    links = near.where("linked").select(F.col("c").alias("a"), F.col("y").alias("b"))
    labels = components(links)
    if not centres.isEmpty():
        open_ = cut(_open(members, centres, near, labels, total, folder).join(nodes.select("id", "n", "tokens"), "id"), f"{folder}/open")
        more = _block_pass(open_, folder)
        if more is not None and not more.isEmpty():
            # components of the components found so far
            of = lambda key: labels.select(F.col("node").alias(key), F.col("label").alias(f"{key}_label"))
            joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
            upper = cut(components(joined), f"{folder}/upper")
            old = labels.join(upper.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = cut(old.unionByName(upper.join(labels, "node", "left_anti")), f"{folder}/labels")
    return labels.join(nodes.select(F.col("id").alias("node"), "x"), "node").select("x", "label")


def join(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``: components of similarity >= 0.8.

    Also ``k``, a key of the row's id and text, and ``component``, a key of its component.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = shared_dir(spark, "ngram-join")
    sig = signatures(docs, k, f"{folder}/signatures")
    labels = _labels(sig, folder)
    classes = sig.where("x IS NOT NULL").groupBy("x").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    # sets without a link are a component of their own, named by their digest
    named = classes.join(labels, "x", "left").select("x", "low", "copies", F.coalesce(F.lpad(F.col("label").cast("string"), 20, "0"), F.hex("x")).alias("component"))
    linked = named.where("length(component) = 20").groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(linked, "component", "left").select("x", "copies", "component", F.coalesce("component_id", "low").alias("component_id"))
    named = cut(named, f"{folder}/named")
    rows = spread_join(sig.select("doc_id", F.col("n").alias("n_shingles"), "x", "k"), named, "x", "copies", sig.count(), "left")
    out = cut(rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "k", "component"), f"{folder}-result")
    remove_dir(spark, folder)
    return out


def keep(docs: DataFrame) -> DataFrame:
    """One row of each component (the least id), with all its columns; rows without words all stay."""
    found = join(docs)
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "k")).alias("first")).select("first.k")
    alone = found.where("component IS NULL").select("k")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("k"))
    return keyed.join(first.unionByName(alone).distinct(), "k", "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
