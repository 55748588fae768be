"""Exact top-k search by tiled matrix products.

Vectors become integers, floor(scale * x), packed into shards of bounded size; the query vectors are packed likewise into
blocks. Groups of shards meet groups of blocks in a grid, so each task gets a bounded number of both and every block meets
every shard once. A tile is one block times one shard: a matrix product in doubles, exact while all sums stay below 2^53,
then a partial selection by a key that holds the score and, for ties, the place among rising ids. Each task merges its
tiles, and the lists of a query are merged in a tree, eight at a time.

Defined results: vectors that are null, or that hold components which are null or not finite (also after scaling, which
takes doubles near their limit beyond it), and rows without an id take no part;
vectors of unlike length don't meet; ties go to the smaller id; rows that repeat an id stay rows, and only a query's own
row is left out; fewer than k candidates are all returned; products beyond 64 bits stop at the limits of a long.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm.common import bound_batches, cut, read

SHARD_ROWS, BLOCK_ROWS = 8192, 2048
#: Shards and blocks of a task.
TASK_SHARDS, TASK_BLOCKS = 8, 4
TILE_ROWS = 512
FAN = 8
_EXACT = 2.0**49
_PACKED = "uid long, dim int, n int, big boolean, ids binary, origin binary, data binary"


def _integers(x: np.ndarray, scale: int) -> tuple[np.ndarray, bool]:
    """floor(scale * x) and whether it needs exact big integers."""
    v = np.floor(x.astype(np.float64) * scale)
    return v, bool(v.size and np.abs(v).max() >= 2.0**31)


_PACKED_TYPES = pa.schema([("uid", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("big", pa.bool_()), ("ids", pa.binary()), ("origin", pa.binary()), ("data", pa.binary())])


def _packed(uid: int, v: np.ndarray, big: bool, ids: np.ndarray, origin: np.ndarray) -> pa.RecordBatch:
    row = {"uid": uid, "dim": v.shape[1], "n": len(v), "big": big, "ids": ids.tobytes(), "origin": origin.tobytes(), "data": (v if big else v.astype(np.int32)).tobytes()}
    return pa.RecordBatch.from_pylist([row], schema=_PACKED_TYPES)


def blocks_of(shards: DataFrame, every: int, rows: int) -> DataFrame:
    """Blocks of the rows of shards whose id is divisible by every."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, bool], list] = {}

        def flush(key):
            nonlocal made
            ids, origin, v = (np.concatenate(c) for c in zip(*held.pop(key), strict=True))
            for at in range(0, len(ids), rows):
                made += 1
                yield _packed(part << 32 | made, v[at : at + rows], key[1], ids[at : at + rows], origin[at : at + rows])

        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                take = ids % every == 0
                if take.any():
                    key = (r["dim"], r["big"])
                    held.setdefault(key, []).append((ids[take], np.frombuffer(r["origin"], np.int64)[take], _matrix(r)[take]))
                    if sum(len(x[0]) for x in held[key]) >= rows:
                        yield from flush(key)
        for key in list(held):
            yield from flush(key)

    return shards.select(*_PACKED_TYPES.names).mapInArrow(run, _PACKED)


def pack(df: DataFrame, id_col: str, vec_col: str, rows: int, scale: int) -> DataFrame:
    """Shards of vectors by rising id. origin: a number for each row that is unique in the table."""
    kind = F.col(vec_col).cast("array<double>")
    own = df.select(F.col(id_col).cast("long").alias("i"), kind.alias("v")).filter("i is not null and v is not null")
    bound_batches(df.sparkSession)

    def run(batches):
        part = TaskContext.get().partitionId()
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        count, made, seen = {}, 0, 0

        def flush(dim: int):
            nonlocal made
            ids, origin, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            count.pop(dim)
            order = np.lexsort((origin, ids))
            for at in range(0, len(ids), rows):
                o = order[at : at + rows]
                v, big = _integers(x[o], scale)
                made += 1
                yield _packed(part << 32 | made, v, big, ids[o], origin[o])

        for batch in batches:
            ids = batch.column("i").to_numpy(zero_copy_only=False)
            origin = np.arange(seen, seen + len(ids), dtype=np.int64) + (part << 40)
            seen += len(ids)
            lists = batch.column("v")
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(np.append(0, size))[:-1]
            good = np.ones(len(ids), bool)
            with np.errstate(over="ignore"):
                bad = np.flatnonzero(~np.isfinite(flat * scale))
            good[np.searchsorted(np.cumsum(size), bad, "right")] = False
            for dim in np.unique(size[good]).tolist():
                r = np.flatnonzero(good & (size == dim))
                x = flat[start[r][:, None] + np.arange(dim)[None]] if dim else np.zeros((len(r), 0))
                held.setdefault(dim, []).append((ids[r], origin[r], x))
                count[dim] = count.get(dim, 0) + len(r)
                if count[dim] >= rows:
                    yield from flush(dim)
        for dim in list(held):
            yield from flush(dim)

    return own.mapInArrow(run, _PACKED)


def _numbered(df: DataFrame, name: str, per: int) -> tuple[DataFrame, int]:
    """Packed rows with the number of their group, and how many groups there are. Only the rows' uids are sorted."""
    df = cut(df)
    n = df.count()
    order = df.select("uid").rdd.map(lambda r: r[0]).sortBy(lambda x: x).zipWithIndex() if n > per else None
    if order is None:
        return df.withColumn(name, F.lit(0)), 1 if n else 0
    numbers = df.sparkSession.createDataFrame(order.map(lambda x: (x[0], int(x[1] // per))), f"uid long, {name} int")
    return df.join(numbers, "uid"), -(-n // per)


def _matrix(row: dict) -> np.ndarray:
    kind = np.float64 if row["big"] else np.int32
    return np.frombuffer(row["data"], kind).reshape(row["n"], row["dim"]).astype(np.float64)


def _select(q: np.ndarray, c: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best candidates of each query (place -1: none). own: place of the query's own row, or -1."""
    n, most = len(c), min(k, len(c))
    limit = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if limit >= _EXACT:
        return _select_big(q, c, k, own)
    key = np.rint(q @ c.T).astype(np.int64) * n + np.arange(n - 1, -1, -1)
    low = np.iinfo(np.int64).min
    mine = np.flatnonzero(own >= 0)
    key[mine, own[mine]] = low
    best = -np.sort(-np.partition(key, n - most, axis=1)[:, n - most :], axis=1)
    place = n - 1 - best % n
    return np.where(best == low, -1, place), np.where(best == low, 0, best // n)


def _select_big(q, c, k, own):
    """The same with unbounded integers."""
    most = min(k, len(c))
    place, score = np.full((len(q), most), -1), np.zeros((len(q), most), np.int64)
    whole = [[int(x) for x in r] for r in c]
    for i, r in enumerate(q):
        r = [int(x) for x in r]
        all_ = sorted((-sum(a * b for a, b in zip(r, s, strict=True)), j) for j, s in enumerate(whole) if j != own[i])[:most]
        for j, (s, p) in enumerate(all_):
            place[i, j], score[i, j] = p, max(-(1 << 63), min((1 << 63) - 1, -s))
    return place, score


def _best(ids: np.ndarray, score: np.ndarray, origin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row of lists; origin -1 marks an empty place."""
    empty = origin < 0
    order = np.lexsort((origin, ids, ~score, empty), axis=1)[:, :k]  # ~score falls as score rises and can't overflow
    return tuple(np.take_along_axis(x, order, 1) for x in (ids, score, origin))


_LISTS = "uid long, qids binary, node int, width int, ids binary, scores binary, origin binary"


def _lists(uid: int, qids: bytes, node: int, lists) -> dict:
    ids, score, origin = lists
    return {"uid": uid, "qids": qids, "node": node, "width": ids.shape[1], "ids": ids.tobytes(), "scores": score.tobytes(), "origin": origin.tobytes()}


_LIST_TYPES = pa.schema([("uid", pa.int64()), ("qids", pa.binary()), ("node", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("scores", pa.binary()), ("origin", pa.binary())])


def search(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, the k other rows of highest product."""
    shards, groups = _numbered(pack(df, id_col, vec_col, SHARD_ROWS, scale), "g", TASK_SHARDS)
    blocks, teams = _numbered(blocks_of(shards, every, BLOCK_ROWS), "h", TASK_BLOCKS)
    if not groups or not teams:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = shards.withColumn("h", spread(teams)).withColumn("side", F.lit(0)).unionByName(blocks.withColumn("g", spread(groups)).withColumn("side", F.lit(1)))

    def tiles(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = sorted((r for r in rows if r["side"] == 0), key=lambda r: r["uid"])
        out = []
        for b in (r for r in rows if r["side"] == 1):
            q, origin = _matrix(b), np.frombuffer(b["origin"], np.int64)
            parts = []
            for s in own:
                if s["dim"] != b["dim"]:
                    continue
                c, ids, from_ = _matrix(s), np.frombuffer(s["ids"], np.int64), np.frombuffer(s["origin"], np.int64)
                sort = np.argsort(from_)
                at = np.minimum(np.searchsorted(from_[sort], origin), len(sort) - 1)
                mine = np.where(from_[sort[at]] == origin, sort[at], -1)
                got = [_select(q[a : a + TILE_ROWS], c, k, mine[a : a + TILE_ROWS]) for a in range(0, len(q), TILE_ROWS)]
                place, score = (np.concatenate(x) for x in zip(*got, strict=True))
                parts.append((ids[place], score, np.where(place < 0, -1, from_[place])))
                if len(parts) > FAN:
                    parts = [_best(*(np.concatenate(x, 1) for x in zip(*parts, strict=True)), k)]
            if parts:
                out.append(_lists(b["uid"], b["ids"], rows[0]["g"], _best(*(np.concatenate(x, 1) for x in zip(*parts, strict=True)), k)))
        return pa.Table.from_pylist(out, schema=_LIST_TYPES)

    lists = grid.groupBy("g", "h").applyInArrow(tiles, _LISTS)

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["node"])
        n = len(rows[0]["qids"]) // 8
        each = [tuple(np.frombuffer(r[c], np.int64).reshape(n, r["width"]) for c in ("ids", "scores", "origin")) for r in rows]
        best = reduce(lambda a, b: _best(*(np.concatenate(x, 1) for x in zip(a, b, strict=True)), k), each)
        return pa.Table.from_pylist([_lists(rows[0]["uid"], rows[0]["qids"], rows[0]["node"], best)], schema=_LIST_TYPES)

    while groups > 1:
        lists = lists.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("uid", "node").applyInArrow(merge, _LISTS)
        groups = -(-groups // FAN)

    def unpack(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q = np.frombuffer(r["qids"], np.int64)
                ids, score, origin = (np.frombuffer(r[c], np.int64).reshape(len(q), r["width"]) for c in ("ids", "scores", "origin"))
                i, j = np.nonzero(origin >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array((j + 1).astype(np.int32)), pa.array(ids[i, j]), pa.array(score[i, j])], ["query_id", "rank", "vec_id", "score"])

    return lists.mapInArrow(unpack, "query_id long, rank int, vec_id long, score long")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other rows of every 20th vector."""
    return search(read(spark, sf_dir, "embeddings"))


#: Brute force in SQL, for small tables.
OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM p
)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 20
"""
