"""Near-duplicate embeddings: spherical k-means cells, and blocked cosine products within cells.

Vectors compare only within their label. Each has a home cell, that of its nearest centre. A
vector is also a guest in a cell of a lower number if the plane midway between that centre and
its own is so near that a partner may lie beyond it; so every pair over the limit meets exactly
once, in the lower of its two home cells. Cells are cut into blocks, and each pair of blocks is
one product of matrices. A product returns each vector's number of links and one link to the
smallest id of its local component, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gannet.llm.common import cut
from gannet.llm.components import connected, least_labels

COSINE = 0.98
#: Bytes, as doubles, of the vectors that a block holds, and that a cell should; and of the sample that centres are fitted on, the first by a hash of their id. Every vector is compared.
BLOCK_BYTES, SAMPLE_BYTES = 1 << 23, 1 << 26
#: Vectors of the sample for each centre. There are as many cells as the largest label needs, but no more than the sample gives; larger cells are more blocks.
FOR_CENTRE, STEPS = 8, 12
_PART = 1 << 21  # entries of a matrix of products that is held at once


def _parts(rows: int, columns: int) -> Iterator[slice]:
    step = max(_PART // max(columns, 1), 1)
    return (slice(at, at + step) for at in range(0, rows, step))


def spherical_kmeans(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 1) -> np.ndarray:
    """k unit centres of the unit vectors x."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(steps if k > 1 else 0):
        own = np.concatenate([(x[part] @ centres.T).argmax(axis=1) for part in _parts(len(x), k)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def places(x: np.ndarray, centres: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each unit vector; and the vectors and cells of all guests."""
    reach = np.sqrt(max(2 - 2 * cosine, 0)) + 1e-9
    homes, who, cells = [], [], []
    for part in _parts(len(x), len(centres)):
        dot = x[part] @ centres.T
        home = dot.argmax(axis=1)
        apart = np.sqrt(np.maximum(2 - 2 * (centres[home] @ centres.T), 0)) + 1e-7
        beyond = dot[np.arange(len(dot)), home][:, None] - dot
        row, cell = np.nonzero((beyond <= reach * apart) & (np.arange(len(centres))[None, :] < home[:, None]))
        homes.append(home)
        who.append(row + part.start)
        cells.append(cell)
    none = np.zeros(0, np.int64)
    return np.concatenate(homes or [none]), np.concatenate(who or [none]), np.concatenate(cells or [none])


def _unit(col: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _assign(sent, cosine: float):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for whole in source:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                home = np.zeros(batch.num_rows, dtype=np.int64)
                who, cell = np.zeros(0, np.int64), np.zeros(0, np.int64)
                size = batch.column(1).to_numpy()
                fits = np.flatnonzero(size == centres.shape[1])
                if len(fits):
                    home[fits], who, cell = places(_unit(batch.column(4).take(pa.array(fits)), centres.shape[1]), centres, cosine)
                    who = fits[who]
                rows = np.concatenate([np.arange(batch.num_rows), who])
                cells = np.concatenate([home, cell])
                out = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cells.astype(np.int32)), pa.array(np.arange(len(rows)) < batch.num_rows)], [*batch.schema.names, "cell", "home"])

    return run


def _product(cosine: float):
    """Of two blocks of a cell: each vector's number of links, and the smallest id of its component there."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        x, home = _unit(group["v"], group["size"][0].as_py()), group["home"].to_numpy()
        block, weight, ids = group["block"].to_numpy(), group["n"].to_numpy(), group["id"].to_numpy()
        low, high = group["lo"][0].as_py(), group["hi"][0].as_py()
        first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
        links, root = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for part in _parts(len(first), len(second)):
            i = first[part]
            near = (x[i] @ x[second].T) >= cosine
            near &= home[i][:, None] | home[second][None, :]
            near &= i[:, None] != second[None, :]
            links[i] += near @ weight[second]
            if low != high:
                links[second] += weight[i] @ near
            a, b = np.nonzero(near)
            a, b = root[i[a]], root[second[b]]
            if (a != b).any():
                node, least = least_labels(a[a != b], b[a != b])
                new = np.arange(len(x))
                new[node] = least
                root = new[root]
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array(ids[some]), "b": pa.array(ids[root[some]]), "n": pa.array(links[some])})

    return run


def link(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row for each row of vectors.

    Two vectors of one label (not null) and one length are linked if their cosine, in double
    precision, is at least `cosine`. n_links counts other rows linked directly, component_id is
    the smallest id reachable. Vectors that are null, empty, of zero length, or hold null or
    non-finite components link with nothing; neither do rows with a null id, which are kept with
    a null component. Repeated rows are vectors of their own and link with each other. Other
    columns are left out, so names can't clash.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    inf = float("inf")
    sound = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < inf))
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)
    ok = F.coalesce(sound & (norm > 0) & (norm < inf), F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = cut(rows.withColumn("ok", ok))
    # equal vectors are one, with a weight
    kinds = cut(rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("label", F.size("v").alias("size"), "id", "n", "v"))
    most = kinds.groupBy("size", "label").count().groupBy("size").agg(F.max("count").alias("most"), F.sum("count").alias("all")).orderBy(F.desc("all"), "size").limit(1).collect()
    size, most = (most[0]["size"], most[0]["most"]) if most else (1, 0)
    k = max(min(-(-most * size * 8 // block_bytes), SAMPLE_BYTES // (8 * size) // FOR_CENTRE), 1)
    picked = kinds.where(F.col("size") == size).orderBy(F.xxhash64("id"), "id").limit(FOR_CENTRE * k if k > 1 else 1).select("v").toArrow()
    x = _unit(picked["v"], size) if picked.num_rows else np.ones((1, 1))
    sent = spark.sparkContext.broadcast(spherical_kmeans(x, k))

    out = kinds.select("label", "size", "id", "n", "v")
    schema = T.StructType([*out.schema.fields, *T.StructType.fromDDL("cell int, home boolean").fields])
    placed = cut(out.mapInArrow(_assign(sent, cosine), schema))
    group = ["label", "size", "cell"]
    blocks = placed.groupBy(*group).agg(F.ceil(F.count("*") * 8 * F.col("size") / block_bytes).cast("int").alias("blocks"))
    number = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cast = placed.join(blocks, group).withColumn("block", number).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cast = cast.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other")
    found = cut(cast.groupBy(*group, "lo", "hi").applyInArrow(_product(cosine), "a long, b long, n long"), placed)

    direct = found.groupBy(F.col("a").alias("kind")).agg(F.sum("n").alias("direct"))
    joined = connected(found.where("a != b").select("a", "b"))
    component = joined.select(F.col("id").alias("kind"), "component")
    known = kinds.select("label", "v", F.col("id").alias("kind"), "n").join(direct, "kind", "left").join(component, "kind", "left")
    whole = rows.where("ok").join(known, ["label", "v"]).select("id", (F.col("n") - 1 + F.coalesce("direct", F.lit(0))).alias("n_links"), F.coalesce("component", "kind").alias("c"))
    whole = whole.union(rows.where("not ok").select("id", F.lit(0).cast("long"), "id"))
    return cut(whole.select(F.col("id").alias("vec_id"), "n_links", F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept")), rows, kinds, found, joined)
