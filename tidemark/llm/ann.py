"""Approximate nearest neighbours by inner product: NN-descent and greedy search.

Distinct vectors are dealt out to shards by a tree of centroids: a cell that
holds more than a shard's rows is split by centroids of its own. Within all
shards at once, NN-descent improves each vector's neighbour list through Spark
joins: a list is joined with the lists of its members (and of those that list
it), and the best of these neighbours of neighbours stay. Queries walk the
graphs of the shards nearest to them greedily, from their own place or from a
few entries, and the shards' finds are merged. Those whose nearest still change
look into twice as many shards, until nothing changes or all are searched: how
many a query needs is a matter of the data. Scores come from the original
vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import dealt

from ._shared import Scratch, discard, materialize, ready, scratch_path, session_of

#: Vectors of a shard, on average: bounds a task's memory.
SHARD_ROWS = 16_384
#: Shards that a query looks into at first; twice as many each time that it has found nearer ones.
PROBES = 16
#: Vectors from which centroids of the first level are learned, and centroids that split one cell, at most: what the driver gets.
SAMPLE_ROWS, CENTROIDS = 16_384, 1024
#: Vectors from which each further centroid is learned, and rows that are dealt out to a cell's parts at once.
LEARN_ROWS, DEAL_ROWS = 32, 32_768
#: Neighbours kept, and reverse neighbours joined with them.
NEIGHBOURS, REVERSE = 20, 20
ROUNDS = 8
#: Share of a round's lists that changed below which the descent ends.
SETTLED = 0.02
#: Candidates that a walk keeps, and how many it expands at a time.
BEAM, EXPAND = 256, 8
ENTRIES = 48
#: Queries of one search task, and lists that one task of the descent improves.
QUERY_BLOCK, LIST_ROWS = 1024, 4096
SEED = 17


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector of doubles) of the vectors that take part.

    Those that are null, empty or zero, hold a null, NaN or infinite component
    or have no id take no part. Repeated ids are rows of their own.
    """
    v = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).dropna()
    return v.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0))


def _matrix(lists: pa.Array, kind=np.float64) -> np.ndarray:
    values = np.asarray(lists.flatten(), dtype=kind)
    return values.reshape(len(lists), -1)


_GRAPH = "shard int, place int, near array<int>, sim array<float>, changed int"


def _lists(x) -> pa.Array:
    flat = np.ascontiguousarray(x)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, max(1, flat.shape[1])) if flat.size else np.zeros(len(flat) + 1), pa.int32()), pa.array(flat.ravel()))


def _unit(x: np.ndarray) -> np.ndarray:
    """In single precision, all by one factor, which keeps every order of nearness and holds any double."""
    top = np.abs(x).max(initial=0.0)
    return np.ascontiguousarray(x / top if top > 0 else x, dtype=np.float32)


def _start(table: pa.Table) -> pa.Table:
    """First lists: the best within cells of a few random hyperplane trees."""
    table = table.sort_by("place")
    x = _unit(_matrix(table.column("vector").combine_chunks()))
    n, k = len(x), min(NEIGHBOURS, len(x) - 1)
    best: list[dict[int, float]] = [{} for _ in range(n)]
    rng = np.random.default_rng(SEED)
    for _ in range(4 if n > 1 else 0):
        cells = [np.arange(n)]
        while cells:
            cell = cells.pop()
            if len(cell) > 96:
                a, b = x[rng.choice(cell, 2, replace=False)]
                order = cell[np.argsort(x[cell] @ (a - b), kind="stable")]
                cells += [order[: len(cell) // 2], order[len(cell) // 2 :]]
                continue
            sims = x[cell] @ x[cell].T
            np.fill_diagonal(sims, -np.inf)
            top = np.argsort(-sims, axis=1, kind="stable")[:, : min(k, len(cell) - 1)]
            for i, row in enumerate(top):
                best[cell[i]].update(zip(cell[row].tolist(), sims[i, row].tolist(), strict=True))
    near, sim = [], []
    for i in range(n):
        got = sorted(best[i].items(), key=lambda e: (-e[1], e[0]))[:k]
        near.append([e[0] for e in got])
        sim.append([e[1] for e in got])
    return pa.table({"shard": table.column("shard"), "place": table.column("place"), "near": pa.array(near, pa.list_(pa.int32())), "sim": pa.array(sim, pa.list_(pa.float32())), "changed": pa.array([len(x) for x in near], pa.int32())})


def _improve(vectors: pa.Table, lists: pa.Table) -> pa.Table:
    """Of each vector's candidates, the best; vectors and candidates of one shard."""
    vectors, lists = vectors.sort_by("place"), lists.sort_by("place")
    x = _unit(_matrix(vectors.column("vector").combine_chunks()))
    cand, old = lists.column("candidates").combine_chunks(), lists.column("near").combine_chunks()
    at, ids = np.asarray(cand.offsets), np.asarray(cand.values)
    old_at, old_ids = np.asarray(old.offsets), np.asarray(old.values)
    places = np.asarray(lists.column("place"))
    near, sim, changed = [], [], []
    for i, p in enumerate(places.tolist()):
        c = ids[at[i] : at[i + 1]]
        c = np.unique(c[c != p])
        s = x[c] @ x[p]
        if len(c) > NEIGHBOURS:
            top = np.argpartition(-s, NEIGHBOURS - 1)[:NEIGHBOURS]
            c, s = c[top], s[top]
        order = np.lexsort((c, -s))
        near.append(c[order])
        sim.append(s[order])
        changed.append(len(np.setdiff1d(c, old_ids[old_at[i] : old_at[i + 1]])))
    shard = pa.array(np.full(len(places), lists.column("shard")[0].as_py() if len(places) else 0), pa.int32())
    return pa.table({"shard": shard, "place": pa.array(places, pa.int32()), "near": pa.array(near, pa.list_(pa.int32())), "sim": pa.array(sim, pa.list_(pa.float32())), "changed": pa.array(changed, pa.int32())})


def _around(graph: DataFrame) -> DataFrame:
    """shard, place, ring: a vector's neighbours and the nearest that list it. Lists are bounded by the shard."""
    edges = graph.select("shard", "place", F.explode(F.arrays_zip("near", "sim")).alias("e")).select("shard", "place", F.col("e.near").alias("to"), F.col("e.sim").alias("sim"))
    back = edges.groupBy("shard", F.col("to").alias("place")).agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("sim", F.col("place").alias("by"))), asc=False), 1, REVERSE), lambda e: e["by"]).alias("back"))
    return graph.select("shard", "place", "near").join(back, ["shard", "place"], "left").select("shard", "place", "near", F.array_distinct(F.concat("near", F.coalesce("back", F.array().cast("array<int>")))).alias("ring"))


def _numbered(counts: DataFrame, key: str, count: str) -> DataFrame:
    """Adds ``first``: how many are counted ahead, in order of the key. One row a shard."""
    return counts.withColumn("first", F.sum(count).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col(count))


def build(vectors: DataFrame, *, rounds: int = ROUNDS, list_rows: int = LIST_ROWS) -> DataFrame:
    """The neighbour graph (shard, place, near, sim) of vectors (shard, place, vector).

    Each task of a round improves ``list_rows`` lists: those of small shards together, those of a large one
    in several tasks, which get all its vectors. A partition is asked for by its number, as hashes of a
    few shards meet.
    """
    spark = session_of(vectors)
    schema = spark.createDataFrame([], _GRAPH).schema
    scratch = Scratch(spark)

    def keep(df: DataFrame) -> tuple[str, DataFrame]:
        path = scratch_path(spark, "graph")
        df.write.parquet(path)
        return path, spark.read.schema(schema).parquet(path)

    # Single precision by one factor a shard, as ``_unit`` has it: half the bytes for every task that needs them.
    top = F.max(F.array_max(F.transform("vector", F.abs)))
    shards = scratch.keep(_numbered(vectors.groupBy("shard").agg(F.count("*").alias("n"), top.alias("top")), "shard", "n"), "shards")
    told = shards.agg(F.count("*"), F.sum("n")).first()
    tasks = max(1, -(-(told[1] or 0) // list_rows))
    unit = F.when(F.col("top") > 0, F.transform("vector", lambda x: (x / F.col("top")).cast("float"))).otherwise(F.col("vector").cast("array<float>"))
    units = scratch.keep(vectors.join(shards, "shard").select("shard", "place", unit.alias("vector"), "first", "n"), "units")
    task = F.floor((F.col("first") + F.col("place")) / F.lit(list_rows)).cast("int").alias("task")
    first = shards.select("shard", "first")
    path, graph = keep(units.select("shard", "place", "vector").repartitionById(max(1, told[0]), F.col("shard")).groupBy("shard").applyInArrow(_start, _GRAPH))
    ends = [F.floor(x / F.lit(list_rows)).cast("int") for x in (F.col("first"), F.col("first") + F.col("n") - 1)]
    spread = units.select(F.explode(F.sequence(*ends)).alias("task"), "shard", "place", "vector").repartitionById(tasks, F.col("task"))
    for _ in range(rounds):
        ring = _around(graph)
        steps = ring.select("shard", "place", F.explode("ring").alias("to"))
        # Neighbours of neighbours: the lists of all that stand in a vector's list.
        met = steps.join(ring.select("shard", F.col("place").alias("to"), F.col("ring").alias("theirs")), ["shard", "to"]).join(first, "shard").select(task, "shard", "place", "theirs")
        beyond = met.repartitionById(tasks, F.col("task")).groupBy("task", "shard", "place").agg(F.array_distinct(F.flatten(F.collect_list("theirs"))).alias("theirs"))
        lists = ring.join(first, "shard").select(task, "shard", "place", "near", "ring").repartitionById(tasks, F.col("task")).join(beyond, ["task", "shard", "place"], "left")
        lists = lists.select("task", "shard", "place", "near", F.array_union("ring", F.coalesce("theirs", F.array().cast("array<int>"))).alias("candidates"))
        before = path
        path, graph = keep(spread.groupBy("task", "shard").cogroup(lists.groupBy("task", "shard")).applyInArrow(_improve, _GRAPH))
        discard(spark, before)
        moved = graph.agg(F.sum("changed") / F.greatest(F.sum(F.size("near")), F.lit(1))).first()[0]
        if moved is None or moved < SETTLED:
            break
    scratch.drop()
    return graph


def _walk(x: np.ndarray, ring: np.ndarray, query: np.ndarray, entry: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of many queries at once: (places, inner products) of the best found.

    Each step expands the best candidates that aren't expanded yet; a walk ends
    when all it keeps are.
    """
    m, n = len(query), len(x)
    beam = min(max(BEAM, want), n)
    ids = np.full((m, beam), -1, dtype=np.int64)
    sims = np.full((m, beam), -np.inf, dtype=np.float32)
    done = np.ones((m, beam), dtype=bool)
    seen = np.zeros((m, n), dtype=bool)
    found = entry
    live = np.arange(m)
    while len(live):
        # Candidates not met before, each once.
        order = np.argsort(found, axis=1, kind="stable")
        found = np.take_along_axis(found, order, 1)
        fresh = found >= 0
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        safe = np.where(found >= 0, found, 0)
        fresh &= ~seen[live[:, None], safe]
        rows, cols = np.nonzero(fresh)
        s = np.full(found.shape, -np.inf, dtype=np.float32)
        got = safe[rows, cols]
        seen[live[rows], got] = True
        s[rows, cols] = np.einsum("ij,ij->i", x[got], query[live[rows]])
        all_ids = np.concatenate((ids[live], safe), axis=1)
        all_sims = np.concatenate((sims[live], s), axis=1)
        all_done = np.concatenate((done[live], ~fresh), axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live], sims[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
        done[live] = np.take_along_axis(all_done, top, 1)
        # What to expand next.
        rank = np.where(done[live], -np.inf, sims[live])
        pick = np.argpartition(-rank, min(EXPAND, beam) - 1, axis=1)[:, : min(EXPAND, beam)]
        open_ = np.take_along_axis(rank, pick, 1) > -np.inf
        go = open_.any(1)
        live, pick, open_ = live[go], pick[go], open_[go]
        chosen = ids[live[:, None], pick]
        flags = done[live]
        np.put_along_axis(flags, pick, True, 1)
        done[live] = flags
        found = np.where(open_[:, :, None], ring[chosen], -1).reshape(len(live), -1) if len(live) else found[:0]
    return ids, sims


def _search(want: int):
    def run(graph: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query": [], "rep": [], "score": []}
        if graph.num_rows and queries.num_rows:
            graph = graph.sort_by("place")
            exact = _matrix(graph.column("vector").combine_chunks())
            x, reps = _unit(exact), np.asarray(graph.column("rep"))
            lists = graph.column("ring").combine_chunks()
            at, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            widest = int(np.diff(at).max(initial=0))
            ring = np.full((len(x), max(1, widest)), -1, dtype=np.int32)
            for i in range(len(x)):
                ring[i, : at[i + 1] - at[i]] = flat[at[i] : at[i + 1]]
            q = _matrix(queries.column("vector").combine_chunks())
            q32, names = _unit(q), np.asarray(queries.column("rep"))
            spot = np.minimum(np.searchsorted(np.sort(reps), names), len(reps) - 1)
            own = np.argsort(reps, kind="stable")[spot]
            own = np.where(reps[own] == names, own, -1)
            seeds = np.random.default_rng(SEED).permutation(len(x))[:ENTRIES]
            for lo in range(0, len(q), 256):
                part = slice(lo, lo + 256)
                entry = np.concatenate((own[part, None], np.tile(seeds, (len(q32[part]), 1))), axis=1)
                ids, sims = _walk(x, ring, q32[part], entry, want)
                keep = min(want, ids.shape[1])
                top = np.argsort(-sims, axis=1, kind="stable")[:, : keep + 4]
                for i, row in enumerate(top):
                    chosen = ids[i, row][sims[i, row] > -np.inf]
                    out["query"].append(np.full(len(chosen), names[lo + i]))
                    out["rep"].append(reps[chosen])
                    out["score"].append(exact[chosen] @ q[lo + i])
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return pa.table({"query": pa.array(cat(out["query"], np.int64)), "rep": pa.array(cat(out["rep"], np.int64)), "score": pa.array(cat(out["score"], np.float64))})

    return run


def _direction(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, initial=0.0, keepdims=True), 1e-300)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _centroids(x: np.ndarray, count: int) -> np.ndarray:
    """Directions around which the vectors lie: spherical k-means."""
    x = _direction(x)
    at = x[np.random.default_rng(SEED).permutation(len(x))[:count]]
    for _ in range(12 if len(at) > 1 else 0):
        own = (x @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        full = np.bincount(own, minlength=len(at)) > 0
        at[full] = _direction(sums[full])
    return at


def fit_centroids(vectors: DataFrame, shard_rows: int, most: int = CENTROIDS) -> dict[int, np.ndarray]:
    """Centroids of the vectors of each length, one for ``shard_rows`` vectors, ``most`` at most.

    The driver gets SAMPLE_ROWS vectors at most, the first by a hash of their values.
    """
    counts = {r["size"]: r["n"] for r in vectors.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return {}
    draw = F.pmod(F.xxhash64(F.lit(SEED), "vector"), F.lit(1 << 40))
    sample = vectors.where(draw < int(min(1.0, 1.2 * SAMPLE_ROWS / total) * (1 << 40))).orderBy(draw, "vector").limit(SAMPLE_ROWS).select("vector").toArrow()["vector"].combine_chunks()
    sizes = np.diff(np.asarray(sample.offsets))
    out = {}
    for size, n in counts.items():
        mine = _matrix(sample.filter(pa.array(sizes == size))).reshape(-1, size)
        want = max(1, min(-(-n // shard_rows), most * n // total))
        out[size] = _centroids(mine, want) if len(mine) else np.ones((1, size), np.float32)
    return out


def _nearest_cells(centroids, probes: int):
    """Adds cells: (name, cosine) of each vector's nearest centroids, nearest first."""

    def run(batches):
        known: dict[int, np.ndarray] = centroids.value
        first, before = {}, 0
        for size, at in sorted(known.items()):
            first[size], before = before, before + len(at)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("vector"))
            edge, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            cells: list = [None] * batch.num_rows
            sizes = np.diff(edge)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                like = _direction(flat[edge[rows][:, None] + np.arange(size)]) @ known[size].T
                near = np.argsort(-like, axis=1, kind="stable")[:, :probes]
                for r, c, v in zip(rows.tolist(), (near + first[size]).tolist(), np.take_along_axis(like, near, 1).tolist(), strict=True):
                    cells[r] = [{"cell": str(x), "like": y} for x, y in zip(c, v, strict=True)]
            kind = pa.list_(pa.struct([("cell", pa.string()), ("like", pa.float32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, kind)], names=[*batch.schema.names, "cells"])

    return run


_VISIT = "rep long, vector array<double>, cell string, like float"


def _in_cells(df: DataFrame, centroids, probes: int) -> DataFrame:
    """Rows (rep, vector), once for each of their nearest cells of the first level, with the cosine of its centroid."""
    near = df.select("rep", "vector").mapInArrow(_nearest_cells(centroids, probes), "rep long, vector array<double>, cells array<struct<cell: string, like: float>>")
    return near.select("rep", "vector", F.explode("cells").alias("e")).select("rep", "vector", "e.cell", "e.like")


def _learn(table: pa.Table) -> pa.Table:
    """A cell's sample -> its centroids."""
    x = _matrix(table.column("vector").combine_chunks())
    at = _centroids(x, int(table.column("want")[0].as_py()))
    return pa.table({"cell": pa.array([table.column("cell")[0].as_py()]), "at": pa.array([at.ravel()], pa.list_(pa.float32()))})


def _descend(probes: int):
    """Rows of a cell -> the same in their nearest parts of it."""

    def run(rows: pa.Table, centroids: pa.Table) -> pa.Table:
        out: list = [[], [], [], []]
        if rows.num_rows and centroids.num_rows:
            vectors = rows.column("vector").combine_chunks()
            x = _direction(_matrix(vectors))
            at = np.asarray(centroids.column("at")[0].values).reshape(-1, x.shape[1])
            like = x @ at.T
            near = np.argsort(-like, axis=1, kind="stable")[:, :probes]
            name, take = rows.column("cell")[0].as_py(), np.repeat(np.arange(len(x)), near.shape[1])
            out = [rows.column("rep").take(pa.array(take)), rows.column("vector").take(pa.array(take)), [f"{name}/{j}" for j in near.ravel().tolist()], np.take_along_axis(like, near, 1).ravel()]
        kinds = (pa.int64(), pa.list_(pa.float64()), pa.string(), pa.float32())
        return pa.table({n: c.cast(t) if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for n, c, t in zip(("rep", "vector", "cell", "like"), out, kinds, strict=True)})

    return run


def _to_parts(rows: DataFrame, sub: DataFrame, probes: int, deal_rows: int, scratch: Scratch) -> DataFrame:
    """Rows of cells that ``sub`` (cell, at) splits, in their nearest parts. A large cell's rows are dealt out to many tasks."""
    held = rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(deal_rows)).cast("int").alias("salts"))
    salts = scratch.keep(held.join(sub.select("cell"), "cell"), "salts")
    salted = rows.join(salts, "cell").select("rep", "vector", "cell", F.pmod(F.xxhash64(F.lit(SEED + 2), "rep"), F.col("salts")).cast("int").alias("salt"))
    spread = sub.join(salts, "cell").select("cell", "at", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return salted.groupBy("cell", "salt").cogroup(spread.groupBy("cell", "salt")).applyInArrow(_descend(probes), _VISIT)


def _grow(held: DataFrame, shard_rows: int, most: int, deal_rows: int, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (rep, vector, cell) in leaves of about ``shard_rows``, and the centroids (cell, at) of each level that was split.

    A cell whose vectors have one direction can't be split by centroids: it
    stays as it is, once a level has left nearly all its rows together.
    """
    levels: list[DataFrame] = []
    held, stuck = scratch.keep(held, "cells"), None
    while True:
        full = held.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 1.5 * shard_rows)
        if levels:  # only what the last level has made, and has made smaller
            parent = F.regexp_replace("cell", "/[0-9]+$", "")
            full = full.join(stuck.select(F.col("cell").alias("above"), F.col("n").alias("of")), (parent == F.col("above")) & (F.col("cell") != F.col("above"))).where("n < 0.9 * of").select("cell", "n")
        full = scratch.keep(full.withColumn("want", F.least(F.lit(most), F.ceil(F.col("n") / F.lit(shard_rows))).cast("int")), "full")
        if full.isEmpty():
            return held, levels
        draw = F.pmod(F.xxhash64(F.lit(SEED + 3), "rep"), F.lit(1 << 40))
        sample = held.join(full, "cell").where(draw < F.lit(float(1 << 40)) * LEARN_ROWS * F.col("want") / F.col("n")).select("cell", "vector", "want")
        sub = scratch.keep(sample.groupBy("cell").applyInArrow(_learn, "cell string, at array<float>"), "centroids")
        parts = _to_parts(held.join(sub.select("cell"), "cell", "left_semi"), sub, 1, deal_rows, scratch).select("rep", "vector", "cell")
        levels.append(sub)
        held, stuck = scratch.keep(held.join(sub.select("cell"), "cell", "left_anti").select("rep", "vector", "cell").unionAll(parts), "cells"), full


def _visits(queries: DataFrame, centroids, levels: list[DataFrame], probes: int, deal_rows: int, scratch: Scratch) -> DataFrame:
    """(rep, vector, cell): of each query the ``probes`` nearest leaves, found level by level."""
    near = _in_cells(queries, centroids, probes)
    for sub in levels:
        near = scratch.keep(near, "visits")
        parts = _to_parts(near.join(sub.select("cell"), "cell", "left_semi"), sub, probes, deal_rows, scratch)
        both = near.join(sub.select("cell"), "cell", "left_anti").select("rep", "vector", "cell", "like").unionAll(parts)
        near = both.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("like"), "cell"))).where(F.col("r") <= probes).drop("r")
    return near.select("rep", "vector", "cell")


def search(table: DataFrame, *, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, probes: int = PROBES, centroids: int = CENTROIDS, deal_rows: int = DEAL_ROWS) -> DataFrame:
    """The k nearest found of each row whose id is divisible by ``every``, against all other rows.

    Returns query_id, rank (from 1), vec_id, score: the inner product of the
    original vectors in double precision, nearest first, ties to the smaller
    id. A query has all other rows if there are no more than k. Equal vectors
    are one node of the graph; all their rows that can be among the first k are
    found. Rows that share an id are rows of their own, as queries and as
    candidates. Vectors of different lengths have no inner product, and are
    searched each length for itself. What takes no part is told by ``usable``.
    A query looks into its ``probes`` nearest shards, then into twice as many as
    long as that has brought it anything nearer. ``centroids`` split one cell at
    most. An empty table gives an empty result.
    """
    spark = session_of(table)
    ready(spark)
    scratch = Scratch(spark)
    rows = scratch.keep(usable(table, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    # Equal vectors: of their rows the k + 1 with the smallest ids are all that any query can need.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id", "row"))
    members = rows.withColumn("r", place).where(F.col("r") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("rows")).withColumn("rep", F.col("rows")[0]["row"])
    members = scratch.keep(members, "members")
    first = spark.sparkContext.broadcast(fit_centroids(members, shard_rows, centroids))
    held, levels = _grow(_in_cells(members, first, 1).select("rep", "vector", "cell"), shard_rows, centroids, deal_rows, scratch)
    # Only vectors of one direction can still be too many for a shard: these are dealt out by hash, and all their shards are searched.
    parts = scratch.keep(held.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(1.5 * shard_rows))).cast("int").alias("parts")), "parts")
    shard = F.struct("cell", F.pmod(F.xxhash64(F.lit(SEED), "rep"), F.col("parts")).cast("int").alias("part"))
    sharded = held.join(parts, "cell").select("rep", "vector", shard.alias("named"))
    names = sharded.groupBy("named").agg(F.count("*").alias("held")).withColumn("shard", (F.row_number().over(Window.orderBy("named")) - 1).cast("int"))
    names = scratch.keep(names, "shards")  # one row a shard
    placed = sharded.join(names.select("named", "shard"), "named").select("rep", "vector", "shard")
    placed = placed.withColumn("place", (F.row_number().over(Window.partitionBy("shard").orderBy("rep")) - 1).cast("int"))
    nodes = scratch.keep(placed, "nodes")
    graph = build(nodes.select("shard", "place", "vector"))
    around = _around(graph).select("shard", "place", "ring").join(nodes, ["shard", "place"])
    # Every query, by its vector's node; queries of equal vectors walk once.
    asked = rows.where(F.col("id") % every == 0).join(members.select("vector", "rep"), "vector").select("id", "row", "rep")
    asked = scratch.keep(asked, "queries")
    active = scratch.keep(asked.select("rep").distinct().join(members.select("rep", "vector"), "rep"), "active")
    shards, best, been = names.count(), None, None
    if probes < shards:
        around = scratch.keep(around, "graph")
    while True:
        visits = _visits(active, first, levels, probes, deal_rows, scratch).join(names.select(F.col("named.cell").alias("cell"), "shard"), "cell").select("rep", "vector", "shard")
        visits = scratch.keep(visits if been is None else visits.join(been, ["rep", "shard"], "left_anti"), "walks")
        # A shard that many queries look into is searched by several tasks.
        blocks = visits.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("blocks"))
        blocks = scratch.keep(_numbered(blocks, "shard", "blocks"), "blocks")
        tasks = max(1, blocks.agg(F.sum("blocks")).first()[0] or 0)
        block = F.pmod(F.xxhash64(F.lit(SEED + 1), "rep"), F.col("blocks")).cast("int")
        number = lambda block: (F.col("first") + block).cast("int").alias("block")
        spread = around.join(blocks, "shard").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(number(F.col("b")), "place", "ring", "rep", "vector").repartitionById(tasks, F.col("block"))
        walks = visits.join(blocks, "shard").select(number(block), "rep", "vector").repartitionById(tasks, F.col("block"))
        found = spread.groupBy("block").cogroup(walks.groupBy("block")).applyInArrow(_search(k + 1), "query long, rep long, score double").withColumn("new", F.lit(True))
        every_find = found if best is None else best.withColumn("new", F.lit(False)).unionAll(found)
        top = every_find.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k + 1).drop("r")
        top = scratch.keep(top, "best")
        best = top.drop("new")
        if probes >= shards:
            break
        active = scratch.keep(active.join(top.where("new").select(F.col("query").alias("rep")).distinct(), "rep", "left_semi"), "active")
        if active.isEmpty():
            break
        gone = visits.select("rep", "shard")
        been = gone if been is None else been.unionAll(gone)
        probes *= 2
    named = best.join(members.select("rep", "rows"), "rep").select("query", F.explode(F.transform("rows", lambda m: F.struct((-F.col("score")).alias("far"), m["id"].alias("id"), m["row"].alias("row")))).alias("e"))
    # k + 1 of k + 1 nodes with k + 1 rows each.
    lists = named.groupBy("query").agg(F.slice(F.sort_array(F.collect_list("e")), 1, k + 1).alias("nearest"))
    # Rows of one vector that is very common have met here: they are dealt out before each gets its k rows.
    own = dealt(asked.join(lists, asked["rep"] == lists["query"]), ["row"])
    ranked = own.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("nearest", lambda e: e["row"] != F.col("row")), 1, k)).alias("at", "e"))
    answer = materialize(ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.far")).alias("score")), "nearest")
    scratch.drop()
    first.destroy()
    return answer
