"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector by M functions floor((a.x + b) / w)
with Gaussian a. A query visits its own bucket and perturbed ones (each
coordinate may step over one of its two walls) in the order of their estimated
success: the sum of squared distances to the walls that are stepped over, smallest first. The
candidates of all buckets and tables are merged and ranked by exact distance.

M follows from the number of vectors, so that buckets keep their mean size;
w is a multiple of the spread of projections. The number of probes is fitted
on a sample of at most ``SAMPLE`` vectors: the smallest one with which
``SAMPLE_QUERIES`` of them find ``TARGET`` of their true neighbours within the
sample. Neighbours in the whole table are nearer than in a sample, so recall
there is higher. Every vector is indexed.

Equal vectors are one entry that carries its smallest k + 1 ids; no other
copy can be among the k nearest, so copies cost nothing and none is lost.
A bucket with more than ``BLOCK`` entries is split into blocks that are
searched side by side, and buckets travel in bundles of about ``BUNDLE``
entries; a bundle returns at most k + 1 candidates for a query.

The number of probes is one figure for all queries, so the buckets of an
isolated vector may hold fewer than k others. Queries that end with fewer
neighbours than there are other ids (k at most) are searched again, exactly,
against all vectors in blocks.

Defined results:

* vectors that are null, zero, hold null or non-finite components, or differ
  in length from most of the table take no part, as query or candidate;
* a null id takes no part; rows that repeat an id are that id once, at its
  smallest distance, and never a query's own neighbour;
* equal distances go to the smaller id; fewer candidates give shorter lists;
* only the id and vector columns are read; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import share, stored, unit_hash

TABLES = 8
WIDTH = 2.0
PER_BUCKET = 48
SLOT_BITS = 1.5
SAMPLE = 20_000
SAMPLE_QUERIES = 100
TARGET = 0.96
MOST_PROBES = 1024
BLOCK = 4096
BUNDLE = 20_000


class Hashing:
    """Hash functions of all tables and the number of probes."""

    def __init__(self, dim: int, functions: int, width: float, tables: int = TABLES, seed: int = 17):
        import numpy as np

        random = np.random.default_rng(seed)
        self.dim, self.functions, self.tables, self.width, self.probes = dim, functions, tables, width, 1
        self.lines = random.normal(size=(dim, tables * functions))
        self.shift = random.uniform(0, 1, tables * functions)
        self.factors = random.integers(0, 1 << 63, (tables, functions + 1), dtype=np.int64) | 1

    def projected(self, vectors):
        """Positions in units of the slot width: rows x tables x functions."""
        return (vectors @ self.lines / self.width + self.shift).reshape(len(vectors), self.tables, self.functions)

    def bucket(self, slots):
        """Names of slots (... x tables x functions): one 64-bit number for each table."""
        import numpy as np

        with np.errstate(over="ignore"):
            mixed = (slots * self.factors[:, :-1]).sum(-1) + self.factors[:, -1]
            return mixed ^ (mixed >> 31)

    def probe_slots(self, place):
        """Slots of one table in the order of estimated success, for a position (functions,)."""
        import numpy as np

        home = np.floor(place)
        inside = place - home
        # Steps down cost the distance to the lower wall, steps up that to the upper one.
        steps = sorted([(float(x) ** 2, i, -1) for i, x in enumerate(inside)]
                       + [(float(1 - x) ** 2, i, 1) for i, x in enumerate(inside)])
        out, heap = [home], [(steps[0][0], (0,))] if steps else []
        while heap and len(out) < self.probes:
            cost, chosen = heapq.heappop(heap)
            if len({steps[i][1] for i in chosen}) == len(chosen):  # one step for a coordinate
                slot = home.copy()
                for i in chosen:
                    slot[steps[i][1]] += steps[i][2]
                out.append(slot)
            last = chosen[-1]
            if last + 1 < len(steps):
                heapq.heappush(heap, (cost + steps[last + 1][0], (*chosen, last + 1)))
                heapq.heappush(heap, (cost + steps[last + 1][0] - steps[last][0], (*chosen[:-1], last + 1)))
        return np.array(out, np.int64)


def fit(sample, n: int, k: int) -> Hashing:
    """Choose functions, width and probes from a bounded array of vectors and the number of all vectors.

    Where ``MOST_PROBES`` buckets do not reach the target, buckets grow: one
    function less, and again.
    """
    import numpy as np

    spread = float(np.std(sample @ np.random.default_rng(5).normal(size=(sample.shape[1], 32)), axis=0).mean())
    near = []
    for q, query in enumerate(sample[:SAMPLE_QUERIES]):
        distance = ((sample - query) ** 2).sum(1)
        distance[q] = np.inf
        near.append(np.argsort(distance, kind="stable")[:min(k, len(sample) - 1)])
    functions = max(2, round(np.log2(max(2.0, n / PER_BUCKET)) / SLOT_BITS))
    while True:
        hashing = Hashing(sample.shape[1], functions, WIDTH * spread if spread > 0 else 1.0)
        hashing.probes = most = min(MOST_PROBES, 3 ** functions)
        needed = _probes_needed(hashing, sample, near)
        if needed <= most or functions == 1:
            hashing.probes = min(most, needed)
            return hashing
        functions -= 1


def _probes_needed(hashing: Hashing, sample, near) -> int:
    """Buckets to visit in each table so that ``TARGET`` of the given neighbours are met."""
    import numpy as np

    slots = np.floor(hashing.projected(sample)).astype(np.int64)
    places = hashing.projected(sample[:len(near)])
    never, found = hashing.probes + 1, []
    for q, others in enumerate(near):
        first = np.full(len(others), never)
        for t in range(hashing.tables):
            at = {tuple(s): i + 1 for i, s in enumerate(hashing.probe_slots(places[q, t]).tolist())}
            first = np.minimum(first, [at.get(tuple(s), never) for s in slots[others, t].tolist()])
        found.extend(first.tolist())
    return int(np.sort(found)[max(0, int(np.ceil(TARGET * len(found))) - 1)]) if found else 1


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _numbers(column, dim: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _indexed(shared):
    def index_batches(batches):
        import numpy as np
        import pyarrow as pa

        hashing = shared()
        for batch in batches:
            vectors = _numbers(batch.column(1), hashing.dim)
            names = hashing.bucket(np.floor(hashing.projected(vectors)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(names.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(len(names)), hashing.tables))),
                pa.array([v.tobytes() for v in vectors for _ in range(hashing.tables)], pa.binary()),
            ], names=["bucket", "uid", "vec"])

    return index_batches


def _probed(shared):
    def probe_batches(batches):
        import numpy as np
        import pyarrow as pa

        hashing = shared()
        for batch in batches:
            vectors = _numbers(batch.column(1), hashing.dim)
            places = hashing.projected(vectors)
            for uid, vector, place in zip(batch.column(0).to_pylist(), vectors, places, strict=True):
                names = []
                for t in range(hashing.tables):
                    slots = np.zeros((hashing.probes, hashing.tables, hashing.functions), np.int64)
                    own = hashing.probe_slots(place[t])
                    slots[:len(own), t] = own
                    names.append(hashing.bucket(slots)[:len(own), t])
                names = np.concatenate(names)
                yield pa.RecordBatch.from_arrays([
                    pa.array(names), pa.array([uid] * len(names), pa.int64()),
                    pa.array([vector.tobytes()] * len(names), pa.binary())], names=["bucket", "quid", "qvec"])

    return probe_batches


def _search(dim: int, k: int):
    def search_bundle(members, probes):
        """The k + 1 nearest entries of a bundle for each query that probes it."""
        import numpy as np
        import pandas as pd

        none = pd.DataFrame({"quid": np.empty(0, np.int64), "uid": np.empty(0, np.int64), "distance": np.empty(0)})
        if members.empty or probes.empty:
            return none
        stack = lambda x: np.frombuffer(b"".join(x), np.float64).reshape(-1, dim)
        vectors = stack(members.vec)
        members, parts = members.reset_index(drop=True), []
        by_bucket = members.groupby(["bucket", "block"]).indices
        for key, own in probes.groupby(["bucket", "block"]):
            at = by_bucket.get(key)
            if at is None:
                continue
            candidates, ids = vectors[at], members.uid.to_numpy()[at]
            asked, quids = stack(own.qvec), own.quid.to_numpy()
            step = max(1, 4_000_000 // (len(at) * dim))
            for start in range(0, len(asked), step):
                distance = np.sqrt(((asked[start:start + step, None, :] - candidates[None]) ** 2).sum(-1))
                if len(at) > k + 1:  # all entries as near as the last one kept
                    last = np.partition(distance, k, axis=1)[:, k:k + 1]
                    row, col = np.nonzero(distance <= last)
                else:
                    row, col = np.indices(distance.shape).reshape(2, -1)
                parts.append(pd.DataFrame({"quid": quids[start + row], "uid": ids[col], "distance": distance[row, col]}))
        if not parts:
            return none
        found = pd.concat(parts).drop_duplicates(["quid", "uid"]).sort_values(["quid", "distance", "uid"])
        return found.groupby("quid").head(k + 1)

    return search_bundle


def _exact(k: int):
    def search_block(members, queries):
        """The k + 1 nearest ids of a block of (id, vec) for each query of a block."""
        import numpy as np
        import pandas as pd

        if members.empty or queries.empty:
            return pd.DataFrame({"quid": np.empty(0, np.int64), "id": np.empty(0, np.int64), "distance": np.empty(0)})
        members, parts = members.sort_values("id"), []
        ids, first = np.unique(members.id.to_numpy(), return_index=True)
        vectors, asked, quids = np.stack(members.vec), np.stack(queries.qvec), queries.quid.to_numpy()
        step = max(1, 4_000_000 // vectors.size)
        for start in range(0, len(asked), step):
            distance = np.sqrt(((asked[start:start + step, None, :] - vectors[None]) ** 2).sum(-1))
            distance = np.minimum.reduceat(distance, first, axis=1)  # an id counts at its nearest vector
            if len(ids) > k + 1:
                row, col = np.nonzero(distance <= np.partition(distance, k, axis=1)[:, k:k + 1])
            else:
                row, col = np.indices(distance.shape).reshape(2, -1)
            found = pd.DataFrame({"quid": quids[start + row], "id": ids[col], "distance": distance[row, col]})
            parts.append(found.sort_values(["quid", "distance", "id"]).groupby("quid").head(k + 1))
        return pd.concat(parts)

    return search_block


def _against_all(short: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """quid, id, distance: the k + 1 nearest ids in each block of all entries, for every short (quid, vec)."""
    members = entries.select(F.explode("ids").alias("id"), "vec")
    blocks, qblocks = max(1, -(-members.count() // BUNDLE)), max(1, -(-short.count() // BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("qblock", every(qblocks))
    queries = short.select("quid", F.col("vec").alias("qvec"), F.pmod(F.xxhash64("quid"), F.lit(qblocks)).cast("int").alias(
        "qblock")).withColumn("block", every(blocks))
    return members.groupBy("block", "qblock").cogroup(queries.groupBy("block", "qblock")).applyInPandas(
        _exact(k), "quid bigint, id bigint, distance double")


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the k nearest other rows of every query row, by Euclidean distance."""
    spark = vectors.sparkSession
    value = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.where(is_query.isNotNull() & F.col(f"`{id_col}`").isNotNull() & usable(F.col(f"`{vector_col}`"))).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), value.alias("vec"), is_query.alias("asks"))
    empty = spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    lengths = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return empty
    dim = lengths[0]["dim"]
    rows = rows.where(F.size("vec") == dim)
    # Equal vectors: one entry with its smallest ids. The window keeps k + 1 rows before it exchanges any.
    smallest = W.partitionBy("vec").orderBy("id")
    # Rows that repeat an id at one vector are one row first, else they would take the places of others.
    firsts = rows.select("id", "vec").distinct().withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= k + 1)
    entries = stored(firsts.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(
        F.col("ids")[0].alias("uid"), "vec", "ids"))
    asked = stored(rows.where("asks").select(F.col("id").alias("query_id"), "vec").distinct().join(
        entries.select("uid", "vec"), "vec").select("query_id", F.col("uid").alias("quid"), "vec"))

    import numpy as np

    drawn = entries.select("uid", "vec").orderBy(unit_hash(F.lit("ann"), F.col("uid")), "uid").limit(SAMPLE)
    sample = np.array([r["vec"] for r in drawn.select("vec").collect()])  # at most SAMPLE vectors
    n = entries.count()
    hashing = fit(sample, n, k)
    shared = share(spark, hashing)

    members = stored(entries.select("uid", "vec").mapInArrow(_indexed(shared), "bucket bigint, uid bigint, vec binary"))
    wide = stored(members.groupBy("bucket").count().where(F.col("count") > BLOCK).select(
        "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    bundles = max(1, -(-n * TABLES // BUNDLE))
    bundle = F.pmod(F.xxhash64("bucket", "block"), F.lit(bundles))
    blocks = F.coalesce("blocks", F.lit(1))
    members = members.join(wide, "bucket", "left").withColumn("block", F.pmod(F.xxhash64("uid"), blocks).cast("int"))
    probes = asked.select("quid", "vec").dropDuplicates(["quid"]).mapInArrow(
        _probed(shared), "bucket bigint, quid bigint, qvec binary")
    probes = probes.join(wide, "bucket", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    found = members.select("bucket", "block", "uid", "vec").groupBy(bundle.alias("bundle")).cogroup(
        probes.select("bucket", "block", "quid", "qvec").groupBy(bundle.alias("bundle"))
    ).applyInPandas(_search(dim, k), "quid bigint, uid bigint, distance double")

    by_entry = W.partitionBy("quid").orderBy("distance", "uid")
    best = found.groupBy("quid", "uid").agg(F.min("distance").alias("distance")).withColumn(
        "at", F.row_number().over(by_entry)).where(F.col("at") <= k + 1)
    near = best.join(entries.select("uid", "ids"), "uid").select("quid", "distance", F.explode("ids").alias("id"))
    asks = asked.select("query_id", "quid")
    listed = stored(_listed(asks, near, k))
    others = rows.select("id").distinct().limit(k + 1).count() - 1
    enough = listed.where(F.col("rank") == others).select("query_id")
    missing = stored(asked.join(enough, "query_id", "left_anti")) if others else asked.limit(0)
    if missing.limit(1).count() == 0:
        return listed
    again = _against_all(missing.select("quid", "vec").dropDuplicates(["quid"]), entries, k)
    return listed.join(enough, "query_id", "left_semi").union(_listed(missing.select("query_id", "quid"), again, k))


def _listed(asks: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score of the k nearest other ids from near (quid, id, distance)."""
    listed = asks.join(near, "quid").where("query_id <> id").groupBy("query_id", "id").agg(F.min("distance").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return listed.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
