"""Problem 4: the k nearest vectors of every vector, by exact scans of shards of several independent partitions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkstrata.plans.staging import join_by_count, small, stage

SHARD = 2000
MOST_SHARDS = 4096
"""At most so many centres are fitted at once; cells of more than BIG x SHARD nodes get centres of their own."""
BIG = 4
SAMPLE = 12_000
FOR_CENTRE = 8
"""Centres are fitted on SAMPLE vectors, or on so many for each where that is more."""
SUB_SAMPLE = 12
"""Vectors for each centre of a cell, SAMPLE a cell at most."""
PROBES = 2
MORE_TABLES = (64, 1024)
"""Beyond so many cells there is one partition more each: a border between cells parts neighbours, and the more cells, the more borders."""
BLOCK = 1024
"""Queries of a shard that are scanned at once."""
NEAR = 2e-6
"""By how much products of unit vectors in float32 may be wrong."""
ASKERS = 6
"""A task's share of a cell's queries is at most ASKERS x SHARD on average."""
LOT = 20_000
LIST = pa.list_(pa.struct([("far", pa.float64()), ("other", pa.int64())]))


def pack(v: np.ndarray) -> list[bytes]:
    """Rows of float32 as byte planes, which the shuffle's codec packs well."""
    n, d = v.shape
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(n, d, 4).transpose(0, 2, 1))
    return [r.tobytes() for r in planes.reshape(n, 4 * d)]


def unpack(rows: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), 4, -1)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(np.float32).reshape(len(rows), -1)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of usable rows, their vectors): not null, ``dim`` finite numbers, not all zero."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    size = np.diff(arr.offsets.to_numpy(zero_copy_only=False))
    ok = arr.is_valid().to_numpy(zero_copy_only=False) & (size == dim)
    at = np.flatnonzero(ok)
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    start = arr.offsets.to_numpy(zero_copy_only=False)[at]
    values = arr.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    v = values[start[:, None] + np.arange(dim)] if len(at) < len(size) else values[start[0] : start[0] + len(at) * dim].reshape(-1, dim)
    good = np.isfinite(v).all(1) & (v != 0).any(1)
    return at[good], np.ascontiguousarray(v[good])


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def centroids(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Spherical k-means with starts drawn from the sample, so dense regions get several centres."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        home = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, sample)
        n = np.linalg.norm(total, axis=1)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def shard_neighbours(v: np.ndarray, asked: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine rounded to 9 decimals) for the ``keep`` nearest of the rows ``asked`` among all rows of ``v``, unit vectors; of ties the first rows.

    Products in float32 leave the candidates, also all that tie with the last; those are computed again in double.
    """
    f, n, out = v.astype(np.float32), len(v), [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
    for at in range(0, len(asked), BLOCK):
        mine = asked[at : at + BLOCK]
        sims = f[mine] @ f.T
        sims[np.arange(len(mine)), mine] = -np.inf
        last = np.partition(sims, n - keep, axis=1)[:, n - keep] if n > keep else np.full(len(mine), -2, np.float32)
        near = sims >= np.maximum(last - NEAR, -2)[:, None]
        many = near.sum(1) > 8 * keep
        for b in np.array_split(np.flatnonzero(many), -(-int(many.sum()) // 64)) if many.any() else ():  # very many alike
            exact = np.round(v[mine[b]] @ v.T, 9)
            exact[~near[b]] = -np.inf
            c = np.argsort(-exact, axis=1, kind="stable")[:, :keep]
            out.append((np.repeat(mine[b], c.shape[1]), c.ravel(), np.take_along_axis(exact, c, 1).ravel()))
        near[many] = False
        q, c = np.nonzero(near)
        exact = np.round(np.concatenate([np.einsum("ij,ij->i", v[mine[q[i : i + 4096]]], v[c[i : i + 4096]]) for i in range(0, len(q), 4096)] or [np.zeros(0)]), 9)
        order = np.lexsort((c, -exact, q))
        q, c, exact = q[order], c[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        out.append((mine[q[place < keep]], c[place < keep], exact[place < keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _nearest_of(v: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    """(vector, n): the n nearest centres, nearest first; of ties the first."""
    s, n = v @ centre.T, min(n, len(centre))
    out = np.empty((len(v), n), np.int64)
    for r in range(n):
        out[:, r] = s.argmax(1)
        s[np.arange(len(v)), out[:, r]] = -np.inf
    return out


def _lots(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


SENT = "cell int, sub int, lot int, node long, base boolean, ask boolean, payload binary"


def _sent(rows: list[tuple], own: np.ndarray, load: list[bytes]) -> pa.RecordBatch:
    """Rows (number, cell, sub, lot, base, ask) with id and vector of each number."""
    return pa.RecordBatch.from_arrays(
        [
            *(pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2, 3)), pa.array(own[[r[0] for r in rows]] if rows else [], pa.int64()),
            *(pa.array([bool(r[k]) for r in rows], pa.bool_()) for k in (4, 5)), pa.array([load[r[0]] for r in rows], pa.binary()),
        ],
        names=["cell", "sub", "lot", "node", "base", "ask", "payload"],
    )


def _asking(i: int, lot: int, cell: int, sub: int, lots: int, home: bool) -> list[tuple]:
    """Where one vector goes in a shard: as a node to every lot of its queries, as a query to one."""
    q = lot % lots
    return [(i, cell, sub, x, True, x == q) for x in range(lots)] if home else [(i, cell, sub, q, False, True)]


def _partition(single: DataFrame, centre: np.ndarray, sizes: np.ndarray, queries: np.ndarray, probes: int, dim: int, k: int) -> DataFrame:
    """(node, list): the k + 1 nearest that each vector meets in each of its cells around ``centre``; ``sizes``, ``queries``: nodes and askers of each cell."""
    big = sizes > BIG * SHARD
    lots = np.where(big, -(-queries // LOT), np.maximum(1, -(-queries // (ASKERS * SHARD))))

    def place(v: np.ndarray) -> np.ndarray:
        return _nearest_of(unit(v).astype(np.float32), centre, probes)

    def send(batches, want_big=False):
        for b in batches:
            at, v = _matrix(b.column("v"), dim)
            if not len(at):
                continue
            near, load = place(v), pack(v)
            own = b.column("id").take(pa.array(at)).to_numpy()
            lot = _lots(own).tolist()
            rows = []
            for i, cs in enumerate(near.tolist()):
                for r, c in enumerate(cs):
                    if big[c] == want_big:
                        rows += [(i, c, -1, lot[i] % lots[c], r == 0, True)] if want_big else _asking(i, lot[i], c, 0, int(lots[c]), r == 0)
            yield _sent(rows, own, load)

    def search(table: pa.Table) -> pa.Table:
        node, ask = (table.column(c).to_numpy() for c in ("node", "ask"))
        order = np.argsort(node, kind="stable")
        node, ask = node[order], ask[order]
        raw = table.column("payload").combine_chunks()
        v = unit(unpack([raw[int(i)].as_py() for i in order]))
        src, dst, exact = shard_neighbours(v, np.flatnonzero(ask), k + 1)
        # What x finds of y is as true of y, which may ask in another lot.
        other = ~ask[dst]
        src, dst, far = np.concatenate([src, dst[other]]), np.concatenate([dst, src[other]]), -np.concatenate([exact, exact[other]])
        order = np.lexsort((node[dst], far, src))
        src, dst, far = src[order], dst[order], far[order]
        first = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if len(src) else np.zeros(0, np.int64)
        place = np.arange(len(src)) - np.repeat(first, np.diff(np.concatenate([first, [len(src)]])))
        src, dst, far = (x[place <= k] for x in (src, dst, far))
        first = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if len(src) else np.zeros(0, np.int64)
        items = pa.StructArray.from_arrays([pa.array(far), pa.array(node[dst])], fields=list(LIST.value_type))
        offsets = pa.array(np.concatenate([first, [len(src)]]).astype(np.int32))
        return pa.table({"node": pa.array(node[src[first]]), "list": pa.ListArray.from_arrays(offsets, items, type=LIST)})

    sent = single.mapInArrow(send, SENT)
    if big.any():
        share_of = np.minimum(SUB_SAMPLE / SHARD, SAMPLE / np.maximum(sizes, 1))

        def pick(batches):
            for b in batches:
                at, v = _matrix(b.column("v"), dim)
                own = b.column("id").take(pa.array(at)).to_numpy()
                home = place(v)[:, 0] if len(at) else np.zeros(0, np.int64)
                use = np.flatnonzero(big[home] & (_lots(own) % np.uint64(1_000_003) < share_of[home] * 1_000_003))
                yield pa.RecordBatch.from_arrays([pa.array(home[use], pa.int32()), pa.array(pack(v[use]), pa.binary())], names=["cell", "payload"])

        def fit(table: pa.Table) -> pa.Table:
            c = table.column("cell")[0].as_py()
            own = unit(unpack(sorted(table.column("payload").to_pylist())[: 2 * SAMPLE])).astype(np.float32)
            n = int(min(MOST_SHARDS, max(1, -(-sizes[c] // SHARD)), len(own)))
            return pa.table({"cell": pa.array([c], pa.int32()), "centres": pa.array([centroids(own, n).tobytes()], pa.binary())})

        def split(left: pa.Table, right: pa.Table) -> pa.Table:
            c = left.column("cell")[0].as_py()
            own_centres = np.frombuffer(right.column("centres")[0].as_py(), np.float32).reshape(-1, dim)
            many = right.column("many")[0].as_py()
            load, own, home = left.column("payload").to_pylist(), left.column("node").to_numpy(), left.column("base").to_pylist()
            near, lot = _nearest_of(unit(unpack(load)).astype(np.float32), own_centres, PROBES).tolist(), _lots(own).tolist()
            rows = [x for i, cs in enumerate(near) for r, s in enumerate(cs) for x in _asking(i, lot[i], c, s, many[s] if many else 1, home[i] and r == 0)]
            return pa.Table.from_batches([_sent(rows, own, load if many else [b""] * len(load))])

        sub = single.mapInArrow(pick, "cell int, payload binary").groupBy("cell").applyInArrow(fit, "cell int, centres binary")
        of = F.create_map(*(x for c in np.flatnonzero(big) for x in (F.lit(int(c)), F.lit(int(lots[c])))))
        none = F.lit(None).cast("array<int>")
        sub = stage(sub.withColumn("lot", F.explode(F.sequence(F.lit(0), of[F.col("cell")] - 1))).withColumn("many", none), "p4-centres")
        far = single.mapInArrow(lambda batches: send(batches, True), SENT).groupBy("cell", "lot")
        # How many ask each of these cells' own cells is counted first, then their queries are sent in lots.
        n = far.cogroup(sub.groupBy("cell", "lot")).applyInArrow(split, SENT).groupBy("cell", "sub").agg(F.count("*").alias("n"))
        n = n.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("sub", F.ceil(F.col("n") / (ASKERS * SHARD)).cast("int").alias("n")))).alias("n"))
        every = F.transform(F.sequence(F.lit(0), (F.length("centres") / (4 * dim) - 1).cast("int")), lambda i: F.coalesce(F.try_element_at("n", i), F.lit(1)))
        sub = stage(sub.join(n, "cell").withColumn("many", every).drop("n"), "p4-centres")
        sent = sent.unionByName(far.cogroup(sub.groupBy("cell", "lot")).applyInArrow(split, SENT))
    return sent.groupBy("cell", "sub", "lot").applyInArrow(search, "node long, list array<struct<far: double, other: long>>")


def nearest(rows: DataFrame, key: str, field: str, k: int = 5) -> DataFrame:
    """(id, other, sim): for each usable vector its k nearest by cosine, in double and rounded to 9 decimals.

    Vectors that are null, all zero, not finite or of another length than most take no part. Ties go to the
    smaller id. Equal directions are one node; a node's rows are represented by their k + 1 smallest
    ids, which is all that can enter a result, so copies of any number cost one row.
    Shards are cells around centres fitted on SAMPLE vectors, or FOR_CENTRE for each. A cell with more than BIG x SHARD nodes has centres of
    its own, fitted where the cell is, so centres form a tree and a partition sends no vector more than 2 x PROBES times, however many there
    are. Each vector goes to its PROBES nearest cells, where all that meet are compared; a cell that very many ask
    takes their queries in lots of ASKERS x SHARD, each with the nodes that are nearest to it. Many cells have many borders, which part
    neighbours, so beyond MORE_TABLES cells further partitions with other centres follow, one after the other.
    """
    spark = rows.sparkSession
    data = rows.select(F.col(key).alias("id"), F.col(field).alias("v")).filter("id is not null and v is not null")
    dims = data.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("v")).alias("nodes")).orderBy(F.desc("n"), "d").first()
    if not dims or not dims.d:
        return spark.createDataFrame([], "id bigint, other bigint, sim double")
    dim, total = dims.d, dims.n
    cells = int(min(MOST_SHARDS, max(1, round(min(dims.nodes, total) / SHARD))))
    tables = 1 + sum(cells > x for x in MORE_TABLES)
    most = max(SAMPLE, FOR_CENTRE * cells)
    share = min(1.0, 1.3 * most / total)
    by = F.xxhash64("id")
    picked = data.filter(F.pmod(by, F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(by, "id").limit(most).select("v").toArrow()
    at, sample = _matrix(picked.column("v"), dim)
    del picked
    if not len(at):
        return spark.createDataFrame([], "id bigint, other bigint, sim double")
    cells = min(cells, len(sample))
    sample = unit(sample).astype(np.float32)
    centres = [centroids(sample, cells, seed=7 + t) for t in range(tables)]
    probes = min(PROBES, cells)

    def describe(batches):
        for b in batches:
            at, v = _matrix(b.column("v"), dim)
            v = unit(v)
            digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in v]
            f = v.astype(np.float32)
            cells_of = np.concatenate([_nearest_of(f, c, probes) for c in centres], 1).tolist() if len(at) else []
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(digest, pa.binary()), pa.array(cells_of, pa.list_(pa.int32()))], names=["id", "digest", "cells"])

    # Which rows are copies, and how many nodes and queries each cell has; the vectors are read again for sending, which is less than to keep them.
    ids = stage(data.mapInArrow(describe, "id long, digest binary, cells array<int>"), "p4-ids")
    groups = ids.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.min("cells").alias("cells"))
    groups = stage(groups, "p4-groups")
    asks = {(r.cell, r.pos): r["count"] for r in groups.select(F.posexplode("cells").alias("pos", "cell")).groupBy("cell", "pos").count().collect()}  # by cell, tables x PROBES x MOST_SHARDS at most
    nodes = join_by_count(ids, groups.select("digest", "node", "n"), ["digest"], "n", total).select("id", "node", "n")
    nodes = stage(nodes, "p4-nodes")
    dropped = stage(nodes.filter("id <> node").select("id"), "p4-dropped")
    single = data.join(small(dropped), "id", "left_anti") if dropped.head(1) else data
    # k + 1 nodes are enough, also where similarities tie: a node's smallest id stands for it, and what is left out has larger ones.
    merge = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    near = None
    for t, centre in enumerate(centres):
        sizes = np.array([asks.get((c, t * probes), 0) for c in range(cells)])
        queries = np.array([sum(asks.get((c, t * probes + r), 0) for r in range(probes)) for c in range(cells)])
        one = _partition(single, centre, sizes, queries, probes, dim, k).groupBy("node").agg(merge(F.flatten(F.collect_list("list"))).alias("list"))  # a list a cell it asked
        one = stage(one, "p4-near")
        near = one if near is None else near.unionByName(one)
    if tables > 1:
        near = stage(near.groupBy("node").agg(merge(F.flatten(F.collect_list("list"))).alias("list")), "p4-near")
    several = nodes.filter("n > 1").select("node", "id", F.row_number().over(Window.partitionBy("node").orderBy("id")).alias("r"))
    several = several.filter(f"r <= {k + 1}").groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("first"))
    several = stage(several, "p4-first")
    copied = several.head(1) is not None
    lists = near
    if copied:
        # Nodes that stand for copies give their first ids; a node's own copies are at similarity 1.
        alone = several.select("node", F.transform("first", lambda i: F.struct(F.lit(-1.0).alias("far"), i.alias("other"))).alias("own"))
        each = near.select("node", F.explode("list").alias("x")).select("node", "x.far", "x.other")
        each = each.join(small(several).withColumnRenamed("node", "other"), "other", "left")
        spread = F.transform(F.coalesce("first", F.array("other")), lambda i: F.struct(F.col("far"), i.alias("other")))
        lists = each.select("node", spread.alias("list")).unionByName(alone.select("node", F.col("own").alias("list")))
        lists = stage(lists.groupBy("node").agg(merge(F.flatten(F.collect_list("list"))).alias("list")), "p4-lists")
    rows_of = lists.select(F.col("node").alias("id"), "list")
    if copied:
        others = nodes.filter("id <> node")
        counted = lists.join(several.select("node"), "node").join(groups.select("node", "n"), "node")
        rows_of = rows_of.unionByName(join_by_count(others.select("id", "node"), counted, ["node"], "n", total).select("id", "list"))
    found = rows_of.select("id", F.explode(F.slice(F.filter("list", lambda x: x["other"] != F.col("id")), 1, k)).alias("x"))
    return found.select("id", F.col("x.other").alias("other"), (-F.col("x.far")).alias("sim"))


def nearest_pairs(rows: DataFrame, key: str, fields: list[str], k: int = 5) -> DataFrame:
    """(field, id_a, id_b, sim), id_a < id_b: pairs of which one is among the other's k nearest, once per field."""
    out = None
    for f in fields:
        one = nearest(rows, key, f, k).select(F.lit(f).alias("field"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), "sim")
        one = one.groupBy("field", "id_a", "id_b").agg(F.max("sim").alias("sim"))
        out = one if out is None else out.unionByName(one)
    return out
