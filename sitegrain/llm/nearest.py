"""Operator 10: exact top-k search by inner product with a KD-tree per shard.

A coarse KD split of a bounded sample parts space into cells of about equal mass. Vectors are
dealt out by their cell, a cell with very many to several tasks, and each task splits what it
gets into shards and each shard by medians of its widest dimension, down to leaves with tight
bounding boxes. A shard is a file; its box stands in the index. So shards lie close together,
and most of them are far from most queries.

Queries are files too, a file a shard, and groups of them are taken from neighbouring cells.
Queries that are rows of the index are searched in their own shard first, and the k-th score
found there is written beside them. Then every group meets every stripe of shards in a task
of its own. It reads the stripe's boxes as one file, opens only the shards whose bound for some
query reaches that one's k-th score, the most promising first, and walks a shard's tree for all
these queries at once: best-first by the greatest bound of an inner product over a box, where
each node keeps the queries that it can still serve, and a leaf is scored for them by one
product of matrices. K-th scores go on from shard to shard. Neither the driver nor a broadcast
holds queries or vectors.
"""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import delete_folder, fresh_dir, materialize, open_uri, release, write_file

FILES = "path string, dims int, n bigint, cell int"
INDEX = FILES + ", lo array<bigint>, hi array<bigint>"
#: Vectors of the sample that the coarse split is made from, and those of it that a cell has at least.
SAMPLE, CELL_SAMPLE = 1 << 16, 32
#: Bounds of queries over boxes that are held at once.
REACHED = 1 << 22
FOUND = "file bigint, place bigint, query_id bigint, vec_id bigint, score bigint"
#: Scores are long; what would be beyond counts as the least or the greatest.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Floating point is exact for whole numbers below this.
EXACT = float(1 << 53)


def quantised(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v, the vector's components as floor(scale * x) with x as double.

    Vectors that are null, or hold a null or non-finite component, are left out, as are
    rows without an id. An empty vector stays. Components beyond long are its ends.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def _leaves(x: np.ndarray, at: np.ndarray, leaf: int) -> Iterator[np.ndarray]:
    """Rows of each leaf: median splits of the widest dimension; equal vectors split by place."""
    if len(at) <= leaf:
        yield at
        return
    own = x[at]
    d = int(np.argmax(own.max(0) - own.min(0))) if own.shape[1] else 0
    order = at[np.argsort(own[:, d], kind="stable")] if own.shape[1] else at
    half = len(at) // 2
    yield from _leaves(x, order[:half], leaf)
    yield from _leaves(x, order[half:], leaf)


def _save(path: str, **arrays: np.ndarray) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    write_file(path, out.getvalue())


def _load(path: str) -> dict[str, np.ndarray]:
    fs, at = open_uri(path)
    with fs.open_input_file(at) as source:
        return dict(np.load(io.BytesIO(source.read())))


def _by_dims(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimensions, ids and vectors of a batch's rows (vec_id, v), for each number of dimensions."""
    ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
    sizes = np.diff(lists.offsets.to_numpy())
    flat, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
    for dims in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dims)
        yield dims, ids[own], flat[(ends - sizes)[own][:, None] + np.arange(dims)].astype(np.int64)


def _files(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))[: len(rows[0])]
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["path", "dims", "n", "cell", "lo", "hi"][: len(kinds)])


class Split:
    """A coarse KD split: cells of about equal mass, numbered so that neighbours have near numbers."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.inner: dict[int, tuple[int, float, int, int]] = {}
        self.cells = 0
        self.root = self._made(sample, cells, 0)

    def _made(self, x: np.ndarray, cells: int, number: int) -> int:
        """A node's number; inner ones are at least 0, a cell is -1 - its number."""
        if cells > 1 and len(x) > 1 and x.shape[1]:
            d = int(np.argmax(x.max(0).astype(np.float64) - x.min(0)))
            order = np.sort(x[:, d])
            cut = float(order[len(order) // 2])
            if cut > order[0]:
                at = len(self.inner)
                self.inner[at] = d, cut, 0, 0
                low = x[:, d] < cut
                self.inner[at] = d, cut, self._made(x[low], cells // 2, number), self._made(x[~low], cells - cells // 2, number)
                return at
        self.cells += 1
        return -self.cells

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if node < 0:
                out[at] = -node - 1
            elif len(at):
                d, cut, below, above = self.inner[node]
                low = x[at, d] < cut
                stack += [(below, at[low]), (above, at[~low])]
        return out


def coarse_splits(vectors: DataFrame, shard_rows: int) -> dict[int, tuple[Split, list[int]]]:
    """By number of dimensions: a split of a sample of all vectors, and how many tasks each cell's vectors are dealt to."""
    sizes = {r.dims: r.n for r in vectors.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).collect()}  # a row a number of dimensions
    total = sum(sizes.values())
    step = max(1, total // SAMPLE)
    own = vectors.where(F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(step)) == 0).select("vec_id", "v").limit(2 * SAMPLE)
    batches = own.toArrow().to_batches()
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for dims, _, x in _by_dims(batch):
            held.setdefault(dims, []).append(x)
    out = {}
    for dims, n in sizes.items():
        x = np.concatenate(held[dims]) if dims in held else np.zeros((0, dims), np.int64)
        split = Split(x, max(1, min(-(-n // shard_rows), len(x) // CELL_SAMPLE)))
        mass = np.bincount(split.cell_of(x), minlength=split.cells) / max(1, len(x)) * n
        out[dims] = split, [max(1, round(m / shard_rows / 2)) for m in mass.tolist()]
    return out


def build_index(vectors: DataFrame, leaf: int = 256, shard_rows: int = 1 << 15) -> DataFrame:
    """Shards of all vectors (columns vec_id and v) in the shared folder: path, dims, n, cell, and the box as lo and hi.

    A shard holds ``shard_rows`` vectors at most, all of one dimension and one cell.
    """
    root = fresh_dir(vectors.sparkSession, "shards")
    vectors = vectors.select("vec_id", "v")
    shared = vectors.sparkSession.sparkContext.broadcast(coarse_splits(vectors, shard_rows))  # bounded as the sample is

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, count = shared.value, 0
        for batch in batches:
            dims, cell, part = pc.list_value_length(batch.column("v")).to_numpy(), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for own, _, x in _by_dims(batch):
                at = np.flatnonzero(dims == own)
                split, parts = splits[own]
                cell[at] = split.cell_of(x)
                part[at] = (count + at) % np.array(parts)[cell[at]]
            count += batch.num_rows
            yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.array(dims, pa.int32()), pa.array(cell), pa.array(part)], names=["vec_id", "v", "dims", "cell", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, rows = None, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, rows
            ids, x = np.concatenate([c[0] for c in held]), np.concatenate([c[1] for c in held])
            held, rows = [], 0
            leaves = list(_leaves(x.astype(np.float64), np.arange(len(ids)), leaf))
            order, path = np.concatenate(leaves), f"{root}/{uuid.uuid4().hex}.npz"
            lo, hi = np.array([x[at].min(0) for at in leaves]), np.array([x[at].max(0) for at in leaves])
            _save(path, ids=ids[order], x=x[order], ends=np.cumsum([len(at) for at in leaves]), lo=lo, hi=hi)
            return _files([(path, x.shape[1], len(ids), key[1], lo.min(0).tolist(), hi.max(0).tolist())])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dims", "cell", "part")], 1)
            bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(bounds, bounds[1:]):
                if held and tuple(keys[begin].tolist()) != key:
                    yield flush()
                key = tuple(keys[begin].tolist())
                while begin < end:
                    take = min(end - begin, shard_rows - rows)
                    for _, ids, x in _by_dims(batch.slice(begin, take).select(["vec_id", "v"])):
                        held.append((ids, x))
                    begin, rows = begin + take, rows + take
                    if rows == shard_rows:
                        yield flush()
        if held:
            yield flush()

    placed = vectors.mapInArrow(place, "vec_id bigint, v array<bigint>, dims int, cell int, part int")
    dealt = placed.repartition("dims", "cell", "part").sortWithinPartitions("dims", "cell", "part")
    return materialize(dealt.mapInArrow(run, INDEX), "index")


class Tree:
    """A shard's leaves under a balanced tree of boxes."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        self.leaves = len(lo)
        boxes_lo, boxes_hi, self.children = list(lo), list(hi), {}
        level = list(range(len(lo)))
        while len(level) > 1:
            above = []
            for i in range(0, len(level) - 1, 2):
                a, b = level[i : i + 2]
                self.children[len(boxes_lo)] = (a, b)
                above.append(len(boxes_lo))
                boxes_lo.append(np.minimum(boxes_lo[a], boxes_lo[b]))
                boxes_hi.append(np.maximum(boxes_hi[a], boxes_hi[b]))
            level = above + level[len(level) - len(level) % 2 :]
        self.root, self.lo, self.hi = level[0], np.array(boxes_lo), np.array(boxes_hi)


def upper_bounds(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Upper bound of each query's inner product over each box, with room for rounding."""
    q, lo, hi = queries.astype(np.float64), lo.astype(np.float64), hi.astype(np.float64)
    most = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T
    bound = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    return np.maximum(np.where(most < EXACT, bound, bound + most * (q.shape[1] + 4) * 2.0**-50), float(LEAST))


class Shard:
    """A shard's vectors under its tree."""

    def __init__(self, path: str):
        held = _load(path)
        self.path, self.ids, self.x, self.ends = path, held["ids"], held["x"], held["ends"]
        self.tree = Tree(held["lo"], held["hi"])
        self.plain = self.x.astype(np.float64)
        self.greatest = float(np.abs(self.plain).max()) if self.x.size else 0.0

    def scores(self, leaf: int, queries: np.ndarray) -> np.ndarray:
        """Exact inner products of a leaf's vectors with queries, a row a query."""
        begin, end = self.span(leaf)
        q = queries.astype(np.float64)
        if self.greatest * float(np.abs(q).max(initial=0.0)) * max(1, q.shape[1]) < EXACT:
            return (q @ self.plain[begin:end].T).astype(np.int64)
        whole = queries.astype(object) @ self.x[begin:end].T.astype(object)
        return np.clip(whole, LEAST, MOST).astype(np.int64)

    def span(self, leaf: int) -> tuple[int, int]:
        return int(self.ends[leaf - 1]) if leaf else 0, int(self.ends[leaf])

    def search(self, best: Best, some: np.ndarray) -> None:
        """Offer ``best`` this shard's candidates for its queries ``some``.

        The node whose bound is the greatest for any query comes first; with it go the queries
        that it can still serve. A query's own row is no candidate.
        """
        tree, queries = self.tree, best.x[some]
        own = np.where(best.shards[some] == self.path, best.rows[some], -1)
        bound = upper_bounds(queries, tree.lo, tree.hi)
        active = np.arange(len(some))
        queue = [(-float(bound[:, tree.root].max(initial=-np.inf)), tree.root, active)]
        while queue:
            _, node, at = heapq.heappop(queue)
            at = at[bound[at, node] >= best.least[some[at]]]
            if not len(at):
                continue
            if node >= tree.leaves:
                for c in tree.children[node]:
                    left = at[bound[at, c] >= best.least[some[at]]]
                    if len(left):
                        heapq.heappush(queue, (-float(bound[left, c].max()), c, left))
                continue
            begin, end = self.span(node)
            scores = self.scores(node, queries[at])
            good = scores >= best.least[some[at]][:, None]
            inside = np.flatnonzero((own[at] >= begin) & (own[at] < end))
            good[inside, own[at[inside]] - begin] = False
            for i in np.flatnonzero(good.any(1)).tolist():
                found = np.flatnonzero(good[i])
                best.offer(int(some[at[i]]), scores[i, found], self.ids[begin + found])


class Best:
    """Queries on their way, and the best k (score, vec_id) of each so far; ``least`` is what a score must reach."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, floors: np.ndarray, rows: np.ndarray, shards: np.ndarray, k: int):
        self.ids, self.x, self.floors, self.rows, self.shards, self.k = ids, x, floors, rows, shards, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.least = floors.copy()

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, v = self.found[query]
        s, v = np.concatenate([s, scores]), np.concatenate([v, ids])
        if len(s) > self.k:
            order = np.lexsort((v, -s))[: self.k] if s.min() > LEAST else np.array(sorted(range(len(s)), key=lambda i: (-int(s[i]), int(v[i])))[: self.k])
            s, v = s[order], v[order]
        self.found[query] = s, v
        if len(s) == self.k:
            self.least[query] = max(int(self.floors[query]), int(s.min()))


def indexed_queries(index: DataFrame, every: int, k: int, together: int = 1024) -> DataFrame:
    """Query files of the index's rows whose vec_id ``every`` divides, a file a shard: path, dims, n and cell.

    Each query comes with its row, which is no candidate, and its k-th score in its own shard.
    """
    root = fresh_dir(index.sparkSession, "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = dict(zip(batch.column("path").to_pylist(), batch.column("cell").to_pylist()))
            for path in cells:
                shard = Shard(path)
                rows = np.flatnonzero(shard.ids % every == 0)
                if not len(rows):
                    continue
                best = Best(shard.ids[rows], shard.x[rows], np.full(len(rows), LEAST, np.int64), rows, np.full(len(rows), path, object), k)
                for begin in range(0, len(rows), together):
                    shard.search(best, np.arange(begin, min(begin + together, len(rows))))
                name = f"{root}/{uuid.uuid4().hex}.npz"
                _save(name, ids=shard.ids[rows], x=shard.x[rows], floors=best.least, rows=rows, shard=np.array([path]))
                yield _files([(name, shard.x.shape[1], len(rows), cells[path])])

    tasks = min(max(1, index.count()), 10_000)
    return materialize(index.select("path", "cell").repartition(tasks, "path").mapInArrow(run, FILES), "own_queries")


def given_queries(queries: DataFrame) -> DataFrame:
    """Query files of any vectors (vec_id, v), which are no rows of the index: path, dims, n and cell (0)."""
    root = fresh_dir(queries.sparkSession, "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, ids, x in _by_dims(batch):
                name = f"{root}/{uuid.uuid4().hex}.npz"
                _save(name, ids=ids, x=x, floors=np.full(len(ids), LEAST, np.int64), rows=np.full(len(ids), -1), shard=np.array([""]))
                yield _files([(name, dims, len(ids), 0)])

    return materialize(queries.select("vec_id", "v").mapInArrow(run, FILES), "given_queries")


def search(index: DataFrame, queries: DataFrame, k: int = 5, group: int = 4096, cells: int | None = None) -> DataFrame:
    """Each query's ``k`` highest inner products over the index, its own row excluded.

    ``index`` and ``queries`` are tables of files; a query is a row of its file, so ids may
    repeat on both sides. Returns query_id, rank from 1, vec_id and score; ties go to the
    smaller vec_id; fewer rows where there are fewer candidates. Only vectors of a query's own
    number of dimensions are its candidates. Scores beyond long count as its ends. About
    ``group`` queries are searched together; shards are parted into as many stripes as make
    ``cells`` tasks (default: four for each core), and a query gives k rows a stripe at most.
    """
    spark = index.sparkSession
    cells = cells or 4 * spark.sparkContext.defaultParallelism
    sums = queries.groupBy("dims").agg(F.ceil(F.sum("n") / group).cast("int").alias("groups"))
    sizes = index.groupBy("dims").agg(F.count("*").alias("shards")).join(sums, "dims")
    sizes = sizes.select("dims", "groups", F.least("shards", F.ceil(F.lit(cells) / F.col("groups"))).cast("int").alias("stripes"))
    # Groups follow the cells' order: a cell's files share the groups that its queries reach over.
    held = queries.groupBy("dims", "cell").agg(F.sum("n").alias("_own"))
    before = F.sum("_own").over(Window.partitionBy("dims").orderBy("cell")) - F.col("_own")  # a row a cell, whose number is bounded by the sample
    begun = held.withColumn("_before", before).withColumn("_all", F.sum("_own").over(Window.partitionBy("dims")))
    share = F.pmod(F.xxhash64("path"), F.lit(1 << 20)) / float(1 << 20)
    at = F.floor((F.col("_before") + share * F.col("_own")) * F.col("groups") / F.col("_all")).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    asked = queries.join(sizes, "dims").join(begun, ["dims", "cell"]).select("path", "dims", F.least(at, F.col("groups") - 1).alias("g"), "stripes")
    asked = asked.select("path", "dims", "g", all_of("stripes").alias("s"), F.lit(0).alias("kind"))
    stripes = _stripes(index.join(sizes, "dims").withColumn("s", F.pmod(F.xxhash64("path"), F.col("stripes")).cast("int")))
    boxes = stripes.join(sizes, "dims").select("path", "dims", all_of("groups").alias("g"), "s", F.lit(1).alias("kind"))
    grid = asked.unionByName(boxes).repartitionByRange(cells, "dims", "g", "s").sortWithinPartitions("dims", "g", "s", "kind", "path")
    found = grid.mapInArrow(_searcher(k), FOUND)
    best = Window.partitionBy("file", "place").orderBy(F.desc("score"), "vec_id")
    found = materialize(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    drop_files(stripes)
    return found


def drop_files(table: DataFrame) -> None:
    """Delete the files that a table of this operator names, and the table, once nothing searches them any more."""
    for row in table.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).distinct().collect():  # one folder
        delete_folder(table.sparkSession, row.folder)
    release(table)


def _stripes(index: DataFrame) -> DataFrame:
    """A file for each stripe (dims, s) of the index with the paths and boxes of its shards: path, dims and s."""
    root = fresh_dir(index.sparkSession, "boxes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault((row["dims"], row["s"]), []).append((row["path"], row["lo"], row["hi"]))
        made = []
        for (dims, s), rows in held.items():
            rows.sort()
            name = f"{root}/{uuid.uuid4().hex}.npz"
            box = [np.array([r[i] for r in rows], np.int64).reshape(len(rows), dims) for i in (1, 2)]
            _save(name, paths=np.array([r[0] for r in rows]), lo=box[0], hi=box[1])
            made.append((name, dims, s))
        yield pa.record_batch([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))], names=["path", "dims", "s"])

    return materialize(index.select("path", "dims", "s", "lo", "hi").repartition("dims", "s").mapInArrow(run, "path string, dims int, s int"), "stripes")


class _Cell:
    """A group of queries on its way over a stripe of shards."""

    def __init__(self, paths: list[str], k: int):
        held = [_load(p) for p in paths]
        sizes = [len(h["ids"]) for h in held]
        join = lambda name: np.concatenate([h[name] for h in held])
        shards = np.repeat(np.array([str(h["shard"][0]) for h in held], object), sizes)
        self.best_of = Best(join("ids"), join("x"), join("floors"), join("rows"), shards, k)
        #: A query is told by its file's number, from the random name, and its place there.
        self.files = np.repeat([int(p.rpartition("/")[2][:15], 16) for p in paths], sizes)
        self.places = np.concatenate([np.arange(n) for n in sizes])
        self.opened = 0

    def walk(self, stripe: str, together: int = 1024) -> None:
        """Search a stripe: shards in the order of their greatest bound, for the queries that each may serve."""
        boxes = _load(stripe)
        best = self.best_of
        lo, hi, some = boxes["lo"], boxes["hi"], max(1, REACHED // max(1, len(best.ids)))
        most = [self._reach(lo[i : i + some], hi[i : i + some]).max(0, initial=-np.inf) for i in range(0, len(lo), some)]
        for i in np.argsort(-np.concatenate(most), kind="stable").tolist():
            wanted = np.flatnonzero(self._reach(lo[i : i + 1], hi[i : i + 1])[:, 0] >= best.least)
            if not len(wanted):
                continue
            self.opened += 1
            shard = Shard(str(boxes["paths"][i]))
            for begin in range(0, len(wanted), together):
                shard.search(best, wanted[begin : begin + together])

    def _reach(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Bounds of all queries over some boxes; scores in floating point may be off by rounding, and twice its room is left."""
        reach = upper_bounds(self.best_of.x, lo, hi)
        return reach + np.abs(reach) * 2.0**-50

    def best(self) -> pa.RecordBatch:
        found = self.best_of.found
        n = [len(s) for s, _ in found]
        scores, ids = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        columns = [np.repeat(self.files, n), np.repeat(self.places, n), np.repeat(self.best_of.ids, n), ids, scores]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["file", "place", "query_id", "vec_id", "score"])


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, paths, cell = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (key := (row["dims"], row["g"], row["s"])) != at:
                    if cell is not None:
                        yield cell.best()
                    at, paths, cell = key, [], None
                if row["kind"] == 0:
                    paths.append(row["path"])
                elif paths:
                    cell = cell or _Cell(paths, k)
                    cell.walk(row["path"])
        if cell is not None:
            yield cell.best()

    return run


def top_k(table: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """Index every vector of ``table`` and search the rows whose vec_id ``every`` divides.

    Candidates are all rows but the query's own: rows that repeat a vec_id are each other's
    candidates, and each is searched. Columns but vec_id and embedding are ignored; an empty
    table gives an empty table.
    """
    index = build_index(quantised(table))
    queries = indexed_queries(index, every, k)
    found = search(index, queries, k)
    drop_files(queries)
    drop_files(index)
    return found
