"""Exact top-k search by inner product: a Voronoi join of queries and data.

The inner product is turned into a distance: with one more component, all data vectors are as long as the
longest, and the nearest are those of the highest score. Then, as in a kNN join:

1. Queries and data go to the nearest of a bounded set of pivots, data vectors with their distance to it.
2. Summaries per group (the largest distance of a query, the smallest distances of k + 1 ids of data) bound how
   far the k-th neighbour of any query of a group can be. Ids count once there, as a query's own may repeat.
3. By the triangle inequality, a data vector can matter to a group of queries only if its own distance from its
   pivot is large enough. Only such vectors go to the group.
4. Small groups that need mostly the same data are put together, so that such data travel once for all of them.
   How much any two groups share is counted over all data before.
5. Groups are cut into cells of bounded numbers of queries and data, each solved by itself with whole integer
   products; the best k of all cells of a query are the result. Ties go to the smaller id.

Groups of any size are cut by a hash of the whole row, so no group and no id is hot. Pivots are a sample whose
number grows with the rows, but they only decide who meets where; the result is exact for any pivots.

Components are scaled to integers first: floor(scale * x). A vector that is null, or holds a null or
non-finite component, takes no part; nor does one whose scaled length is over 2^31, as products of the others
are sure to fit a long. A query meets vectors of its own number of components only; if there are
fewer than k, it gets them all. Rows that repeat with their id are separate candidates; a query's own row is
left out by its id, repeated or not. If rows of one query id have different vectors of one number of components,
the smallest of them, component by component, is asked. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import scratch_path

#: Least and most pivots; between them a quarter of the square root of the number of rows.
PIVOTS = (16, 256)
#: Groups are put together if they share at least this part of what either needs.
SHARED = 0.5
#: Bounds of a cell.
CELL_QUERIES = 1024
CELL_ROWS = 8192
#: Products whose parts stay below this are exact in doubles.
_EXACT = 2.0**53
#: Squared length at most: no product of two vectors, nor a part of it, is larger.
_LONGEST = 2.0**62
#: Queries of a cell that are multiplied at once.
_SLAB = 128


def scaled(vector: Column, scale: int) -> Column:
    """``array<double>`` of whole numbers; null where the vector takes no part."""
    wide = vector.cast("array<double>")
    odd = F.exists(
        wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return F.when(~odd & (F.size(wide) > 0), F.transform(wide, lambda x: F.floor(x * scale).cast("double")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _distances(x: np.ndarray, own: np.ndarray, pivots: np.ndarray, lift: np.ndarray) -> np.ndarray:
    """Distances of rows with extra component ``own`` to pivots with extra component ``lift``."""
    square = (x * x).sum(axis=1) + own * own
    base = (pivots * pivots).sum(axis=1) + lift * lift
    return np.sqrt(np.maximum(square[:, None] + base - 2 * (x @ pivots.T + np.outer(own, lift)), 0.0))


def _pivots(n_rows: int) -> int:
    return int(min(max(n_rows**0.5 / 4, PIVOTS[0]), PIVOTS[1]))


def _together(sizes: np.ndarray, shared: np.ndarray) -> list[list[int]]:
    """Lists of groups to be solved together, by their numbers of queries and the rows that any two need.

    A group joins the first list whose leader needs mostly the same rows, while the queries fit a cell.
    """
    lists: list[list[int]] = []
    for g in np.argsort(-sizes, kind="stable"):
        for members in lists:
            first = members[0]
            either = shared[g, g] + shared[first, first] - shared[g, first]
            if shared[g, first] >= SHARED * either and sizes[members].sum() + sizes[g] <= CELL_QUERIES:
                members.append(int(g))
                break
        else:
            lists.append([int(g)])
    return lists


def _joined_dimension(
    rows: DataFrame, is_query: DataFrame, dim: int, k: int, longest: float, n_rows: int
) -> DataFrame:
    """Top k for the vectors of one number of components: ``query_id, vec_id, score, rank``."""
    spark = rows.sparkSession
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(_pivots(n_rows)).select("v").toPandas()
    pivots = np.unique(_matrix(chosen["v"]), axis=0)
    lift = np.sqrt(np.maximum(longest**2 - (pivots * pivots).sum(axis=1), 0.0))
    slack = 1e-6 * (longest + 1.0)  # for rounding in distances; scores themselves are whole

    def nearest(data: bool):
        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                x = _matrix(batch["v"])
                own = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0.0)) if data else np.zeros(len(x))
                d = _distances(x, own, pivots, lift)
                at = d.argmin(axis=1)
                batch["pivot"], batch["d"] = at.astype(np.int32), d[np.arange(len(x)), at]
                yield batch[["vec_id", "v", "pivot", "d"]]

        return assign

    kind = "vec_id long, v array<double>, pivot int, d double"
    path = scratch_path(spark, "topk")
    rows.mapInPandas(nearest(True), kind).write.parquet(f"{path}/data")
    is_query.mapInPandas(nearest(False), kind).write.parquet(f"{path}/queries")
    data, queries = spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/queries")

    # summaries: a row per pivot, and the nearest data vectors of k + 1 ids of each
    reach = queries.groupBy("pivot").agg(F.max("d").alias("reach"), F.count(F.lit(1)).alias("n")).toPandas()
    place = F.row_number().over(Window.partitionBy("pivot").orderBy("d"))
    once = data.groupBy("pivot", "vec_id").agg(F.min("d").alias("d"))
    near = once.withColumn("r", place).filter(F.col("r") <= k + 1).toPandas()
    if reach.empty:
        return spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    between = _distances(pivots, lift, pivots, lift)
    groups = reach["pivot"].to_numpy()
    furthest = reach["reach"].to_numpy()
    bound = np.full(len(groups), np.inf)
    for i, (g, far) in enumerate(zip(groups, furthest)):
        # no query of the group is further from a data vector than by way of both pivots
        ways = pd.Series(far + between[g, near["pivot"].to_numpy()] + near["d"].to_numpy())
        ways = np.sort(ways.groupby(near["vec_id"].to_numpy()).min().to_numpy())
        if len(ways) > k:  # one of them may be the query's own id
            bound[i] = ways[k]
    # a query is within its reach of its pivot, so its neighbours are within bound + reach of it
    within = bound + furthest + slack

    def met(batch: pd.DataFrame) -> np.ndarray:
        """Which rows (down) which groups (across) need."""
        return between[groups][:, batch["pivot"].to_numpy()].T - batch["d"].to_numpy()[:, None] <= within

    def overlaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((len(groups), len(groups)))
        for batch in batches:
            need = met(batch).astype(np.float64)
            both += need.T @ need
        a, b = np.nonzero(both)
        yield pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), "n": both[a, b].astype(np.int64)})

    summed = data.select("pivot", "d").mapInPandas(overlaps, "a int, b int, n long").groupBy("a", "b").agg(
        F.sum("n").alias("n")
    ).toPandas()
    shared = np.zeros((len(groups), len(groups)))
    shared[summed["a"].to_numpy(), summed["b"].to_numpy()] = summed["n"].to_numpy()
    sizes = reach["n"].to_numpy()
    lists = _together(sizes, shared)
    blocks = [max(-(-int(sizes[members].sum()) // CELL_QUERIES), 1) for members in lists]
    list_of = {int(groups[g]): i for i, members in enumerate(lists) for g in members}

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            need = met(batch)
            for i, members in enumerate(lists):
                x = batch[["vec_id", "v"]][need[:, members].any(axis=1)]
                if len(x):
                    yield x.assign(**{"group": np.int32(i)})[["group", "vec_id", "v"]]

    wanted = data.mapInPandas(needed, "group int, vec_id long, v array<double>")
    wanted.write.parquet(f"{path}/wanted")
    wanted = spark.read.parquet(f"{path}/wanted")
    counts = {r["group"]: r["n"] for r in wanted.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.createDataFrame(
        [(i, b, -(-counts.get(i, 0) // CELL_ROWS)) for i, b in enumerate(blocks)],
        "group int, blocks int, chunks int",
    )
    places = spark.createDataFrame(list(list_of.items()), "pivot int, group int")
    salt = lambda n: F.pmod(F.xxhash64("vec_id", "v"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = (
        queries.join(F.broadcast(places), "pivot").join(F.broadcast(table), "group").filter("chunks > 0")
        .select("group", "vec_id", "v", salt(F.col("blocks")).alias("block"), upto(F.col("chunks")).alias("chunk"))
    )
    right = (
        wanted.join(F.broadcast(table), "group")
        .select("group", "vec_id", "v", salt(F.col("chunks")).alias("chunk"), upto(F.col("blocks")).alias("block"))
    )

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(q) or not len(x):
            return pd.DataFrame(columns=names)
        a, b, ids = _matrix(q["v"]), _matrix(x["v"]), x["vec_id"].to_numpy()
        whole = np.float64 if np.abs(a).max() * np.abs(b).max() * dim < _EXACT else np.int64
        a, b = a.astype(whole), b.astype(whole).T
        out = []
        for low in range(0, len(a), _SLAB):
            scores = (a[low : low + _SLAB] @ b).astype(np.int64)
            for query, s in zip(q["vec_id"].to_numpy()[low : low + _SLAB], scores):
                at = np.flatnonzero(ids != query)
                if len(at) > k:  # all that could be among the best k, ties included
                    least = np.partition(s[at], len(at) - k)[len(at) - k]
                    at = at[s[at] >= least]
                at = at[np.lexsort((ids[at], -s[at]))][:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at], "score": s[at]}))
        return pd.concat(out)

    cells = left.groupBy("group", "block", "chunk").cogroup(right.groupBy("group", "block", "chunk"))
    best = cells.applyInPandas(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "vec_id", "score", "rank"
    )


def top_k(
    table: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that meets ``is_query``, its ``k`` best others.

    Runs jobs at once: those that choose pivots and sum up groups.
    """
    spark = table.sparkSession
    query = F.coalesce(is_query, F.lit(False))
    whole = table.filter(F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(vector), scale).alias("v"), query.alias("q")
    )
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    whole = whole.filter(square <= _LONGEST)
    told = whole.groupBy(F.size("v").alias("dim")).agg(
        F.sqrt(F.max(square)).alias("longest"), F.max("q").alias("asked"), F.count(F.lit(1)).alias("n")
    ).filter("asked").collect()
    found = None
    for r in sorted(told, key=lambda r: r["dim"]):
        rows = whole.filter(F.size("v") == r["dim"])
        part = _joined_dimension(
            rows.select("vec_id", "v"), rows.filter("q").groupBy("vec_id").agg(F.min("v").alias("v")),
            r["dim"], k, r["longest"], r["n"],
        )
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found.select("query_id", "rank", "vec_id", "score")
