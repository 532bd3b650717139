"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are put into narrow bands of norm. In a band they get one more component, so that all have its
largest norm and the nearest by distance are those of largest inner product; a query visits every band, so one giant vector does not push all others together. Each of ``TABLES`` tables cuts ``PROJECTIONS`` Gaussian projections into cells; a
query visits its own bucket and the perturbed ones that are likeliest to hold near vectors, in
the order of the squared distances to the cell walls that they cross. Candidates of all
tables are merged and reranked by the exact inner product in double precision. Queries that met fewer candidates than asked for are
compared with all vectors, in blocks of queries that tasks scan their rows with.

Equal vectors are one candidate that carries its smallest ids, and one query whose answer all of them share, so a vector with
very many copies costs no more than another. Work is dealt by table and the first cell coordinates; a cell with more than
``CHUNK`` vectors is cut into chunks that each of its queries visits, so no bucket is capped and none
lands in one task. Only the sizes of cells are broadcast, and only where they were counted to be few: queries dealt to their cells are many
times larger than Spark can guess from the files of their vectors.

Defined cases: vectors that are NULL, zero, or hold NULL, NaN or infinite components, or have another
length than the commonest one, take no part; a NULL id takes no part; rows that repeat an id are one candidate id, its query is
their smallest vector in byte order; equal scores go to the smaller id; fewer candidates than asked for are all returned;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermaweave.functions.lineage import scratch_path, small_side

from .common import map_arrow, map_batches, staged

TABLES, PROJECTIONS, WIDTH, PROBES = 8, 6, 1.5, 140
SEED = 11
CHUNK = 20_000
#: Bands of norm, so many in each factor of two; the last takes all that are smaller still.
FINE, BANDS = 3, 48
#: Queries that are compared with all vectors in one pass, about.
SCANNED = 2048
#: Queries that are dealt to their cells, or scored in a cell, at once.
DEALT, SCORED = 256, 128


class Tables:
    """The random projections of all tables, for vectors scaled to norm 1 at most."""

    def __init__(self, dimension: int, largest: float, tables: int, projections: int, width: float, probes: int):
        rng = np.random.default_rng(SEED)
        self.direction = rng.standard_normal((tables, dimension + 1, projections))
        self.shift = rng.uniform(0, width, (tables, projections))
        self.largest, self.width, self.probes = largest, width, probes
        self.moves = np.array(list(product((-1, 0, 1), repeat=projections)))
        self.odd = np.random.default_rng(5).integers(1, 1 << 62, projections) | 1

    def band(self, x: np.ndarray) -> np.ndarray:
        """Each row's band: 0 holds the largest norms."""
        norm = np.linalg.norm(x.astype(np.float64), axis=1)
        return np.clip(np.floor(np.log2(self.largest / norm) * FINE + 1e-6), 0, BANDS - 1).astype(int)

    def lift(self, x: np.ndarray, query: bool, band: int = 0) -> np.ndarray:
        """Rows with the added component: queries are normalised and get 0."""
        x = x.astype(np.float64)
        norm = np.linalg.norm(x, axis=1)
        if query:
            return np.c_[x / norm[:, None], np.zeros(len(x))]
        largest = self.largest / 2.0 ** (band / FINE)
        return np.c_[x / largest, np.sqrt(np.maximum(0, 1 - (norm / largest) ** 2))]

    def place(self, lifted: np.ndarray, table: int) -> np.ndarray:
        return (lifted @ self.direction[table] + self.shift[table]) / self.width

    def visits(self, place: np.ndarray) -> np.ndarray:
        """Cells to visit (queries, probes, projections): the likeliest."""
        home = np.floor(place).astype(np.int64)
        inside = place - home
        cost = np.zeros((len(place), len(self.moves)))
        for k in range(place.shape[1]):
            wall = np.stack([inside[:, k] ** 2, np.zeros(len(place)), (1 - inside[:, k]) ** 2], axis=1)
            cost += wall[:, self.moves[:, k] + 1]
        first = np.argpartition(cost, self.probes, axis=1)[:, : self.probes + 1] if self.probes < cost.shape[1] else np.tile(np.arange(cost.shape[1]), (len(place), 1))
        return home[:, None, :] + self.moves[first]

    def code(self, cells: np.ndarray, lead: int | None = None) -> np.ndarray:
        """A number for each cell, or for its first ``lead`` coordinates."""
        return (cells[..., :lead] * self.odd[:lead]).sum(axis=-1)


def firsts(who: np.ndarray, exact: np.ndarray, least: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` largest scores of each query, in order, ties to the smaller ``least`` id."""
    order = np.lexsort((least, -exact, who))
    who = who[order]
    return order[np.arange(len(who)) - np.searchsorted(who, who, "left") < most]


def best(q: np.ndarray, x: np.ndarray, least: np.ndarray, most: int, met: np.ndarray | None = None, bucket: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, position and exact score of the ``most`` rows of ``x`` nearest to each row of ``q``, ties to the smaller ``least`` id.

    ``met`` tells the buckets of rows that a query met, if not all. Scores are first bounded in single precision, from above for all rows and from
    below for every eighth: what may belong to the first by these bounds is scored exactly.
    """
    q1 = (q / np.linalg.norm(q.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)
    top = np.abs(x).max(initial=1e-15)
    x1 = x if 1e-15 < top < 1e15 else (x / np.float64(top)).astype(np.float32)
    slack = (max(1e-5, 1.2e-7 * x.shape[1]) * np.linalg.norm(x1, axis=1)).astype(np.float32)
    above = q1 @ x1.T
    above += slack
    some = slice(None, None, 8)
    below = above[:, some] - 2 * slack[some]
    if met is not None:
        below[~met[:, bucket[some]]] = -np.inf
    edge = np.partition(below, below.shape[1] - most, axis=1)[:, below.shape[1] - most] if below.shape[1] >= most else np.full(len(q), -np.inf, np.float32)
    keep = above >= edge[:, None]
    if met is not None and len(few := np.flatnonzero(edge == -np.inf)):
        keep[few] = met[few][:, bucket]
    who, at = np.divmod(np.flatnonzero(keep), len(x))
    if met is not None:
        there = met[who, bucket[at]]
        who, at = who[there], at[there]
    # The same once more among those that are left.
    high = above[who, at]
    low = high - 2 * slack[at]
    last = firsts(who, low, least[at], most)
    edge = np.full(len(q), np.inf, np.float32)
    np.minimum.at(edge, who[last], low[last])
    left = high >= edge[who]
    who, at = who[left], at[left]
    exact = (q[who].astype(np.float64) * x[at].astype(np.float64)).sum(axis=1)
    order = firsts(who, exact, least[at], most)
    return who[order], at[order], exact[order]


def scan(classes: DataFrame, sent, nearest: int) -> DataFrame:
    """query_id, ids, score: the nearest of all vectors, for the queries (names, matrix) of one block, a broadcast."""
    held: list[np.ndarray] = []

    def rows(batch):
        _, q = sent.value
        x, ids = _matrix(batch["vector"]), np.empty(len(batch["ids"]), object)
        ids[:] = batch["ids"]
        least = np.array([k[0] for k in ids])
        for low in range(0, len(q), SCORED):
            part = q[low : low + SCORED]
            who, at, exact = best(part, x, least, nearest + 1)
            held[:] = [np.concatenate(p) for p in zip(held, (who + low, exact, least[at], ids[at]))] if held else [who + low, exact, least[at], ids[at]]
        order = firsts(*held[:3], nearest + 1)
        held[:] = [p[order] for p in held]
        return {"query_id": [], "ids": [], "score": []}

    def take():
        if not held:
            return {"query_id": [], "ids": [], "score": []}
        who, exact, _, ids = held
        made = {"query_id": [sent.value[0][i] for i in who.tolist()], "ids": ids.tolist(), "score": exact.tolist()}
        held.clear()
        return made

    return map_batches(classes.select("vector", "ids"), rows, "query_id bigint, ids array<bigint>, score double", take)


def _matrix(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float32).reshape(len(vectors), -1)


def packed(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """Vectors of one length as their bytes."""
    x, n = batch.column("_v").flatten().to_numpy(), batch.num_rows
    ends = pa.py_buffer(np.linspace(0, x.nbytes, n + 1).astype(np.int32))
    return [pa.record_batch([batch.column("vec_id"), pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(x.tobytes())])], ["vec_id", "vector"])]


def search(
    vectors: DataFrame, every: int = 20, nearest: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, probes: int = PROBES, chunk: int = CHUNK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row whose id is divisible by ``every``."""
    v = F.col(vector_col).cast("array<float>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fit).select(F.col(id_col).alias("vec_id"), v.alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sizes = good.groupBy(F.size("_v").alias("dimension")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest")).orderBy(F.desc("n"), "dimension").first()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], out)
    plan = Tables(sizes.dimension, sizes.largest, tables, projections, width, probes)
    rows = staged(map_arrow(good.where(F.size("_v") == sizes.dimension), packed, "vec_id bigint, vector binary"), "vectors")
    # Only the smallest ids of equal vectors can be among the nearest.
    place = Window.partitionBy("vector").orderBy("vec_id")
    classes = staged(rows.distinct().withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= nearest + 1).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")
    queries = staged(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    # Equal vectors are asked for once, under their smallest id.
    asked = staged(queries.groupBy("vector").agg(F.min("vec_id").alias("query_id")), "asked")
    there = classes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.least(F.size("ids"), F.lit(nearest + 1))), F.lit(0)).alias("ids")).first()
    # Enough leading cell coordinates (each of about four cells) to make pieces of about a chunk; two at least, so that
    # small tables are dealt like larger ones.
    lead = min(projections, max(2, round(math.log(max(there.n / chunk, 1), 4)) + 1))

    def dealt(batch):
        x = _matrix(batch.column("vector").to_pylist())
        band = plan.band(x)
        lifted = np.empty((len(x), x.shape[1] + 1))
        for b in np.unique(band):
            lifted[band == b] = plan.lift(x[band == b], False, b)
        for t in range(tables):
            cell = plan.code(np.floor(plan.place(lifted, t)).astype(np.int64), lead)
            yield pa.record_batch([pa.array(t + tables * band), pa.array(cell), *batch.columns], ["table", "cell", *batch.schema.names])

    def visited(batch):
        """Each query at its cells, which are the same in every band."""
        for part in (batch.slice(low, DEALT) for low in range(0, batch.num_rows, DEALT)):
            lifted = plan.lift(_matrix(part.column("vector").to_pylist()), True)
            for t in range(tables):
                cell = np.sort(plan.code(plan.visits(plan.place(lifted, t)), lead), axis=1)
                who, which = np.nonzero(np.c_[np.ones(len(cell), bool), cell[:, 1:] != cell[:, :-1]])
                columns = [pa.array(cell[who, which]), *part.take(pa.array(who)).columns]
                for b in bands:
                    yield pa.record_batch([pa.array(np.full(len(who), t + tables * b)), *columns], ["table", "cell", "vector", "ids"])

    cells = map_arrow(classes.select("vector"), lambda batch: (made.drop_columns("vector") for made in dealt(batch)), "table int, cell bigint")
    chunks = small_side(cells.groupBy("table", "cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")))
    bands = sorted(r.band for r in chunks.select(F.floor(F.col("table") / tables).alias("band")).distinct().collect())  # BANDS at most

    kind = "table int, cell bigint, vector binary, ids array<bigint>"
    # Spark may broadcast neither side by its own guess: a side that is not marked is merged.
    data = map_arrow(classes.select("vector", "ids"), dealt, kind).hint("merge").join(chunks, ["table", "cell"])
    data = data.withColumn("chunk", F.pmod(F.xxhash64("vector"), F.col("chunks")).cast("int")).withColumn("query", F.lit(False))
    # Queries of a cell without vectors find nothing there.
    sought = map_arrow(asked.select("vector", F.array("query_id").alias("ids")), visited, kind).hint("merge").join(chunks, ["table", "cell"])
    sought = sought.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("query", F.lit(True))

    def near(group: pa.Table) -> pa.Table:
        mine, theirs = group.filter(group["query"]), group.filter(pc.invert(group["query"]))
        own = pa.concat_arrays(theirs["ids"].chunks) if len(theirs) else pa.array([], group.schema.field("ids").type)
        made = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(mine) and len(theirs):
            (band, t), cell = divmod(group["table"][0].as_py(), tables), group["cell"][0].as_py()
            x, q = _matrix(theirs["vector"].to_pylist()), _matrix(mine["vector"].to_pylist())
            buckets, bucket = np.unique(plan.code(np.floor(plan.place(plan.lift(x, False, band), t)).astype(np.int64)), return_inverse=True)
            least, names = pc.list_element(own, 0).to_numpy(), pc.list_element(mine["ids"], 0).to_numpy()
            for low in range(0, len(q), SCORED):
                part = q[low : low + SCORED]
                visit = plan.visits(plan.place(plan.lift(part, True), t))
                who, which = np.nonzero(plan.code(visit, lead) == cell)
                codes = plan.code(visit[who, which])
                at = np.minimum(np.searchsorted(buckets, codes), len(buckets) - 1)
                met, hit = np.zeros((len(part), len(buckets)), bool), buckets[at] == codes
                met[who[hit], at[hit]] = True
                who, at, exact = best(part, x, least, nearest + 1, met, bucket)
                made.append((names[low + who], at, exact))
        names, at, exact = (np.concatenate(p) for p in zip(*made))
        return pa.table({"query_id": pa.array(names), "ids": own.take(pa.array(at)), "score": pa.array(exact)})

    found = data.unionByName(sought).groupBy("table", "cell", "chunk").applyInArrow(near, "query_id bigint, ids array<bigint>, score double")
    # At most nearest + 1 for each query, table, cell and chunk.

    def ranked(found: DataFrame) -> DataFrame:
        """query_id, near: its nearest + 1 ids and their scores in order, its own included."""
        least, query = F.element_at("ids", 1).alias("_least"), Window.partitionBy("query_id")
        once = found.repartition("query_id").distinct().select("*", least)  # a class is met in several tables
        # Ids of a class come after the smallest ids of all classes before it.
        once = once.withColumn("_first", (F.row_number().over(Window.partitionBy("query_id", "_least").orderBy(F.desc("score"))) == 1).cast("int"))
        once = once.withColumn("_n", F.sum("_first").over(query.orderBy(F.desc("score"), "_least"))).where(F.col("_n") <= nearest + 1)
        merged = once.select("query_id", F.explode("ids").alias("vec_id"), "score").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        merged = merged.withColumn("n", F.row_number().over(query.orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= nearest + 1)
        return merged.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))

    met = staged(ranked(found), "met")
    enough = F.size("near") >= min(nearest + 1, there.ids)
    short = staged(asked.join(met.where(enough).select("query_id"), "query_id", "left_anti"), "short")
    lists = met.where(enough)
    if blocks := math.ceil(short.count() / SCANNED):
        short = staged(short.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).repartition("block"), "blocks", ["block"])
        path = scratch_path(vectors.sparkSession, "scanned")
        for b in range(blocks):  # a block of queries at a time comes to the driver, and nothing of it stays there
            part = short.where(F.col("block") == b).collect()
            if part:
                sent = vectors.sparkSession.sparkContext.broadcast(([r.query_id for r in part], _matrix([r.vector for r in part])))
                ranked(scan(classes, sent, nearest)).write.mode("append").parquet(path)
                sent.destroy()
        lists = lists.unionByName(vectors.sparkSession.read.schema(met.schema).parquet(path))
    members = queries.hint("merge").join(asked, "vector").select(F.col("vec_id").alias("_own"), "query_id")
    others = F.slice(F.filter("near", lambda n: n.vec_id != F.col("_own")), 1, nearest)
    out = members.hint("merge").join(lists, "query_id").select(F.col("_own").alias("query_id"), F.posexplode(others).alias("_rank", "_n"))
    return out.select("query_id", (F.col("_rank") + 1).alias("rank"), "_n.vec_id", "_n.score")
