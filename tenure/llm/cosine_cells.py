"""Near copies of embeddings: spherical k-means cells, blocked cosine products inside them.

Vectors are dealt to the cell of their nearest centre. A vector near a border visits the
neighbouring cells as well: a partner at the least cosine, in a direction that is random,
has its centre among the visited ones except with the probability of ``MARGIN`` standard
deviations, and either of the two may be the visitor. Inside a cell, blocks of vectors are
multiplied; blocks of a cell meet in tasks of their own, so that a large cell is spread.

Vectors within half the linking angle of their centre form its core. Any two of them are
linked by the triangle inequality, so a hot group costs one sum and a star of links, and
its vectors are multiplied only with those that lie within one and a half linking angles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.llm.common import col, others
from tenure.llm.components import components
from tenure.session import stage

LEAST_COSINE = 0.9
#: Vectors of a cell aimed at, and of a block; what a task holds are two blocks.
CELL_ROWS, BLOCK_ROWS, CHUNK_ROWS = 4096, 8192, 1024
#: Centres are fitted on about this many sampled vectors for each of them, in so many rounds.
SAMPLE_PER_CELL, ROUNDS = 64, 4
#: What the centres of one vector length may take; beyond it, cells grow and are cut into blocks.
MOST_CENTRE_BYTES = 32 * 2**20
#: Lengths (the most common ones) that get centres; vectors of another length form one cell.
MOST_LENGTHS = 8
#: Centres nearer than this are one.
MERGED = 0.7
MARGIN = 1.5
SAFE = 1e-9
CORE, REST, VISITOR = 0, 1, 2
PRODUCED = ("n_links", "component_id", "kept")


def unit(body: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; large components are scaled down first."""
    x = body.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _stacked(bodies: list[bytes], dtype: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(bodies), dtype).reshape(len(bodies), -1))


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(id, digest, dim, body) of every row, and the type of the components; unusable vectors have no digest."""
    single = vectors.schema[vector_col].dataType.elementType == T.FloatType()
    dtype = "f4" if single else "f8"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            valid = column.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(dtype)
            digests, dims, bodies = [], [], []
            for ok, a, b in zip(valid.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                x = flat[a:b] + 0.0  # minus zero becomes zero
                if ok and len(x) and np.isfinite(x).all() and x.any():
                    body = x.astype(dtype).tobytes()
                    digests.append(xxhash.xxh3_128_digest(body))
                    dims.append(len(x))
                    bodies.append(body)
                else:
                    digests.append(None)
                    dims.append(None)
                    bodies.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(dims, pa.int32()), pa.array(bodies, pa.binary())], names=["id", "digest", "dim", "body"]
            )

    given = vectors.select(col(id_col).cast("long").alias("id"), col(vector_col).cast(f"array<{'float' if single else 'double'}>").alias("v"))
    return given.mapInArrow(read, "id long, digest binary, dim int, body binary"), dtype


def _apart(candidates: np.ndarray, most: int) -> np.ndarray:
    """Rows that are not nearer than ``MERGED`` to an earlier one, at most ``most``."""
    kept = np.zeros((0, candidates.shape[1]))
    for i in range(0, len(candidates), 512):
        part = candidates[i : i + 512]
        part = part[(part @ kept.T).max(axis=1, initial=-1.0) < MERGED]
        own = []
        for j, near in enumerate(part @ part.T >= MERGED):
            if not any(near[o] for o in own):
                own.append(j)
        kept = np.concatenate([kept, part[own]])
        if len(kept) >= most:
            break
    return kept[:most]


def _centres(classes: DataFrame, dim: int, rows: int, dtype: str) -> np.ndarray:
    """Spherical k-means on a bounded sample; its rounds are Spark sums per centre."""
    spark = classes.sparkSession
    k = int(np.clip(-(-rows // CELL_ROWS), 1, max(1, MOST_CENTRE_BYTES // (8 * dim))))
    own = classes.where(F.col("dim") == dim).select("digest", "body")
    if k == 1:
        return _stacked([bytes(r["body"]) for r in own.orderBy("digest").limit(1).collect()], dtype)
    share = max(1, rows // (k * SAMPLE_PER_CELL))
    sample = stage(own.where(F.pmod(F.xxhash64("digest"), F.lit(share)) == 0))
    first = sample.orderBy(F.xxhash64("digest", F.lit(1)), "digest").limit(2 * k).collect()
    centres = _apart(_stacked([bytes(r["body"]) for r in first], dtype), k)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            total, n = np.zeros(c.shape), np.zeros(len(c), np.int64)
            for batch in batches:
                bodies = batch.column(0).to_pylist()
                for i in range(0, len(bodies), CHUNK_ROWS):
                    x = _stacked(bodies[i : i + CHUNK_ROWS], dtype)
                    at = (x @ c.T).argmax(axis=1)
                    np.add.at(total, at, x)
                    n += np.bincount(at, minlength=len(c))
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n[met]), pa.array([total[i].tobytes() for i in met], pa.binary())], names=["centre", "n", "total"])

        def add(parts: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(b, np.float64) for b in parts["total"].to_pylist()], axis=0)
            return pa.table({"centre": parts["centre"][:1], "n": pa.array([sum(parts["n"].to_pylist())], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

        parts = sample.select("body").mapInArrow(sums, "centre int, n long, total binary")
        moved = sorted(parts.groupBy("centre").applyInArrow(add, "centre int, n long, total binary").collect(), key=lambda r: (-r["n"], r["centre"]))
        totals = np.array([np.frombuffer(r["total"], np.float64) for r in moved])
        sizes = np.linalg.norm(totals, axis=1)
        centres = _apart(totals[sizes > 0] / sizes[sizes > 0, None], k)
        shared.unpersist()
    return centres


def _places(classes: DataFrame, centres: dict[int, np.ndarray], dtype: str, least: float) -> DataFrame:
    """One row for each cell that a vector lives in or visits.

    ``cell`` is numbered by length and centre, ``to_core`` tells whether a core vector of the
    cell can be linked, ``visits`` are the cells a vector visits (given where it lives).
    """
    shared = classes.sparkSession.sparkContext.broadcast(centres)
    angle = np.arccos(least)
    core, reach, sine = np.cos(angle / 2) + SAFE, np.cos(min(np.pi, 1.5 * angle)) - SAFE, np.sin(angle)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch):
                yield from settle(part, part.column("dim")[0].as_py())

    def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            own = batch.filter(pa.array(dims == dim))
            step = max(16, 2**21 // max(1, len(shared.value.get(dim, ()))))
            for i in range(0, own.num_rows, step):
                yield own.slice(i, step)

    def settle(part: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
        c, rows, base = shared.value.get(dim), part.num_rows, dim << 32
        if c is None:
            home, near, visit = np.zeros(rows, np.int64), np.zeros((rows, 1)) - 1, np.zeros((rows, 1), bool)
            to_core = visit
        else:
            near = _stacked(part.column("body").to_pylist(), dtype) @ c.T
            home = near.argmax(axis=1)
            # The partner's share along the difference of two centres is s * x + sqrt(1 - s^2) * random.
            margin = min(2 * sine, MARGIN * sine / least * np.sqrt(2 / max(1, dim - 1))) if least > 0 else 2.0
            visit = near.max(axis=1)[:, None] - near <= margin
            visit[np.arange(rows), home] = False
            to_core = near >= reach
        at = near[np.arange(rows), home]
        kinds = np.where(at >= core, CORE, REST)
        visits = [(base + np.flatnonzero(v)).tolist() for v in visit]
        who, where = np.nonzero(visit)
        index = np.concatenate([np.arange(rows), who])
        cell = np.concatenate([home, where])
        taken = part.select(["digest", "n", "body"]).take(pa.array(index))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(base + cell, pa.int64()), pa.array(base + home[index], pa.int64()),
                pa.array(np.concatenate([kinds, np.full(len(who), VISITOR)]), pa.int32()), pa.array(to_core[index, cell]),
                pa.array(visits + [None] * len(who), pa.list_(pa.int64())), *taken.columns,
            ],
            names=["cell", "home", "kind", "to_core", "visits", "digest", "n", "body"],
        )

    return classes.select("digest", "dim", "n", "body").mapInArrow(
        place, "cell long, home long, kind int, to_core boolean, visits array<long>, digest binary, n long, body binary"
    )


#: Pairs of blocks a row takes part in; ``b`` is its own block, the counts are those of its cell.
_LATER = "transform(sequence(b, greatest(rests, 1) - 1), j -> named_struct('x', concat('R', b), 'y', concat('R', j), 'side', if(j = b, 'xy', 'x')))"
_EARLIER = "if(b > 0, transform(sequence(0, b - 1), j -> named_struct('x', concat('R', j), 'y', concat('R', b), 'side', 'y')), array())"
_MEETINGS = f"""
case kind
when {CORE} then if(shells > 0, concat(
  if(rests > 0, transform(sequence(0, rests - 1), j -> named_struct('x', concat('C', b), 'y', concat('R', j), 'side', 'x')), array()),
  if(visitors > 0, transform(sequence(0, visitors - 1), j -> named_struct('x', concat('C', b), 'y', concat('V', j), 'side', 'x')), array())), array())
when {REST} then concat({_LATER}, {_EARLIER},
  if(to_core and cores > 0, transform(sequence(0, cores - 1), j -> named_struct('x', concat('C', j), 'y', concat('R', b), 'side', 'y')), array()),
  if(visitors > 0, transform(sequence(0, visitors - 1), j -> named_struct('x', concat('R', b), 'y', concat('V', j), 'side', 'x')), array()))
else concat(
  if(to_core and cores > 0, transform(sequence(0, cores - 1), j -> named_struct('x', concat('C', j), 'y', concat('V', b), 'side', 'y')), array()),
  if(rests > 0, transform(sequence(0, rests - 1), j -> named_struct('x', concat('R', j), 'y', concat('V', b), 'side', 'y')), array()))
end
"""


def _compare(dtype: str, least: float):
    """Links between two blocks: (a, b) of a spanning forest, and (a, n) linked rows of each vector."""

    def forest(label: np.ndarray, x: int, ys: np.ndarray, width: int, edges: list[tuple[int, int]]) -> None:
        found, first = np.unique(label[width + ys], return_index=True)
        new = found != label[x]
        edges += [(x, width + y) for y in ys[first[new]].tolist()]
        if new.any():
            label[np.isin(label, found)] = label[x]

    def compare(rows: pa.Table) -> pa.Table:
        side = np.array(rows["side"].to_pylist())
        xs, ys, same = np.flatnonzero(side != "y"), np.flatnonzero(side != "x"), bool((side == "xy").any())
        if not len(xs) or not len(ys):
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        body, n, digest = rows["body"].to_pylist(), rows["n"].to_numpy(), rows["digest"].to_pylist()
        cell, home = rows["cell"][0].as_py(), rows["home"].to_numpy()[ys]
        y = _stacked([body[i] for i in ys], dtype)
        # Two vectors that visit each other's cells meet twice; the cell with the smaller number counts.
        twice = np.unique(home[home < cell])
        places = np.searchsorted(twice, home)
        visits = rows["visits"].to_pylist()
        n_x, n_y = np.zeros(len(xs), np.int64), np.zeros(len(ys), np.int64)
        label, edges = np.arange(len(xs) + len(ys)), []
        if same:
            label[len(xs) :] = label[: len(xs)]
        for i in range(0, len(xs), CHUNK_ROWS):
            part = xs[i : i + CHUNK_ROWS]
            linked = _stacked([body[j] for j in part], dtype) @ y.T >= least
            if same:
                linked &= np.arange(len(ys))[None, :] > np.arange(i, i + len(part))[:, None]
            if len(twice):
                seen = np.zeros((len(part), len(twice) + 1), bool)
                for r, j in enumerate(part.tolist()):
                    seen[r, :-1] = np.isin(twice, visits[j] or ())
                linked &= ~(seen[:, np.where(home < cell, places, len(twice))])
            n_x[i : i + len(part)] = linked @ n[ys]
            n_y += n[part] @ linked
            for r in np.flatnonzero(linked.any(axis=1)).tolist():
                forest(label, i + r, np.flatnonzero(linked[r]), len(xs), edges)
        order = np.concatenate([xs, ys])
        counts = [(digest[j], None, int(c)) for j, c in zip(order.tolist(), np.concatenate([n_x, n_y]).tolist(), strict=True) if c]
        out = counts + [(digest[order[a]], digest[order[b]], 0) for a, b in edges]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array(c, pa.int64())})

    return compare


def _links(classes: DataFrame, dtype: str, least: float) -> DataFrame:
    """(a, b, n): links between vectors (b given) and numbers of linked rows (b null)."""
    lengths = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_LENGTHS).collect()
    centres = {r["dim"]: _centres(classes, r["dim"], r["count"], dtype) for r in lengths}
    places = stage(_places(classes, centres, dtype, least))

    def blocks(kind: int):
        return F.ceil(F.count(F.when(F.col("kind") == kind, 1)) / BLOCK_ROWS).cast("int")

    cells = stage(
        places.groupBy("cell").agg(
            blocks(CORE).alias("cores"), blocks(REST).alias("rests"), blocks(VISITOR).alias("visitors"),
            F.count(F.when(F.col("to_core") & (F.col("kind") != CORE), 1)).alias("shells"),
            F.sum(F.when(F.col("kind") == CORE, F.col("n"))).alias("core_n"), F.min(F.when(F.col("kind") == CORE, F.col("digest"))).alias("head"),
        )
    )
    placed = places.join(cells, "cell")
    own = F.when(F.col("kind") == CORE, F.col("cores")).when(F.col("kind") == REST, F.col("rests")).otherwise(F.col("visitors"))
    dealt = placed.withColumn("b", F.pmod(F.xxhash64("digest", F.lit(7)), own.cast("long")).cast("int"))
    met = dealt.select("cell", "home", "visits", "digest", "n", "body", F.explode(F.expr(_MEETINGS)).alias("m")).select("*", "m.*").drop("m")
    # A block without a partner meets nothing; what stays is two blocks a task.
    compared = met.groupBy("cell", "x", "y").applyInArrow(_compare(dtype, least), "a binary, b binary, n long")
    core = placed.where(F.col("kind") == CORE)
    stars = core.where("digest <> head").select(F.col("digest").alias("a"), F.col("head").alias("b"), F.lit(0).cast("long").alias("n"))
    sums = core.select(F.col("digest").alias("a"), F.lit(None).cast("binary").alias("b"), (F.col("core_n") - F.col("n")).alias("n"))
    return stage(compared.union(stars).union(sums.where("n > 0")))


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(id, ``n_links``, ``component_id``, ``kept``) of every row of ``vectors``.

    Two rows are linked when the cosine of their vectors, in double precision, is at least
    ``least_cosine`` (above 0). ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable over links, and a row is kept when that is
    its own. No pair below the threshold is linked; a pair above it is missed only if neither
    vector visits the other's cell (``MARGIN``).

    Vectors that are null, empty or zero, or hold null or non-finite components, and vectors
    of different lengths, are linked with nothing. Equal vectors are compared once. A row
    without an id has a null component, is linked with nothing and kept. Rows that repeat an
    id are judged each by its own vector. An empty table gives an empty table. Other columns,
    whatever their names, are not read.
    """
    read, dtype = _rows(vectors, id_col, vector_col)
    rows = stage(read)
    classes = stage(rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("body").alias("body")))
    links = _links(classes, dtype, least_cosine)
    # The core of a cell is linked as a whole, so what is left has few links for each vector.
    labels = stage(components(links.where("b is not null").select("a", "b")))
    ids = classes.select("digest", "id").join(labels.select(F.col("id").alias("digest"), F.col("component").alias("root")), "digest", "left")
    ids = stage(ids.select("digest", "id", F.coalesce("root", "digest").alias("root")))
    least = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    counted = links.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("n").alias("others"))
    found = ids.join(least, "root").select("digest", "component_id").join(classes.select("digest", "n"), "digest").join(counted, "digest", "left")
    found = stage(found.select("digest", "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    judged = rows.select("id", "digest").join(found, "digest", "left")
    component = F.coalesce("component_id", "id")
    return judged.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least_cosine: float = LEAST_COSINE) -> DataFrame:
    """Rows of ``vectors`` with the smallest id of their group, all columns as they are; edge cases as in ``link_vectors``.

    Of rows that repeat an id, all stay if one of them does.
    """
    judged = link_vectors(vectors.select(*[col(c) for c in (id_col, vector_col)]), id_col, vector_col, least_cosine).where(col(id_col).isNotNull())
    away = judged.groupBy(col(id_col).alias("__away")).agg(F.max("kept").alias("stays")).where("not stays")
    left = [col(c) for c in [*others(vectors, "__away")]]
    return vectors.join(stage(away.select("__away")), col(id_col).cast("long") == F.col("__away"), "left_anti").select(*left)
