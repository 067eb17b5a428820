"""Near-duplicate vectors from int8 tile products with rigorous error bounds.

Vectors are scaled to unit length and quantised to int8 with a scale of their
own; the length of what quantisation left over is kept with each vector. For
two vectors x = a + r and y = b + s (a, b quantised; r, s left over)

    |x.y - a.b| <= |a||s| + |r||y|,  |y| = 1,

so the integer product of two tiles tells which pairs can reach the threshold
at all, and only those are recomputed in double precision. A label's vectors
are packed into tiles of fixed size and every pair of a label's tiles is one
piece of work, so a label that holds a third of all rows is spread over many
tasks. A pair of tiles reports per vector the number of links and the smallest
vector it is connected with inside the pair, never the pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import checkpointed, connected_components, read

THRESHOLD = 0.93
TILE = 1024
_TILES = "label long, tile string, size int, dim int, ids binary, ints binary, scales binary, vecs binary"
_LINKS = "vec_id long, links long, root long"
# Slack for rounding in the double-precision bound itself.
_ROUNDING = 1e-9


def quantise(vectors: np.ndarray):
    """int8 rows, scale, length of the quantised part, length of the rest."""
    lengths = np.sqrt((vectors ** 2).sum(axis=1, keepdims=True))
    unit = vectors / lengths
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    ints = np.rint(unit / scale).astype(np.int8)
    part = ints * scale
    rest = np.sqrt(((unit - part) ** 2).sum(axis=1))
    return ints, np.stack([scale[:, 0], np.sqrt((part ** 2).sum(axis=1)), rest], axis=1)


def tiles(vectors: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles of at most ``size`` vectors of one label and dimension."""
    def build(batches):
        from pyspark import TaskContext

        held: dict[tuple, list] = {}
        task, made = TaskContext.get().partitionId(), 0

        def row(key):
            nonlocal made
            ids, rows = zip(*held.pop(key))
            vecs = np.array(rows, "<f8")
            ints, scales = quantise(vecs)
            made += 1
            return (key[0], f"{task:08d}-{made:08d}", len(ids), key[1],
                    np.array(ids, "<i8").tobytes(), ints.tobytes(), scales.tobytes(),
                    vecs.tobytes())

        for batch in batches:
            out = []
            for label, vec_id, vec in zip(*(batch.column(i).to_pylist() for i in range(3))):
                key = (label, len(vec))
                held.setdefault(key, []).append((vec_id, vec))
                if len(held[key]) == size:
                    out.append(row(key))
            if out:
                yield _tile_batch(out)
        out = [row(key) for key in list(held)]
        if out:
            yield _tile_batch(out)

    return vectors.mapInArrow(build, _TILES)


def _tile_batch(rows):
    columns = list(zip(*rows))
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)],
        names=["label", "tile", "size", "dim", "ids", "ints", "scales", "vecs"])


def linked(a: dict, b: dict, threshold: float, same: bool):
    """Index arrays (i, j) of the linked vectors of two tiles (i < j if the same)."""
    # Sums of integers below 2**24 are exact in single precision.
    exact = np.float32 if a["ints"].shape[1] * 127 * 127 < 2 ** 24 else np.float64
    products = a["ints"].astype(exact) @ b["ints"].T.astype(exact)
    near = products.astype(np.float64) * np.outer(a["scales"][:, 0], b["scales"][:, 0])
    error = np.outer(a["scales"][:, 1], b["scales"][:, 2]) + a["scales"][:, 2][:, None]
    possible = near + error + _ROUNDING >= threshold
    if same:
        possible = np.triu(possible, 1)
    i, j = np.nonzero(possible)
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 65536):  # bounded memory where very many are possible
        part = slice(at, at + 65536)
        x, y = a["vecs"][i[part]], b["vecs"][j[part]]
        cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
        keep[part] = cosine >= threshold
    return i[keep], j[keep]


def _tile(row: dict, side: str) -> dict:
    dim = row["dim"]
    return {"ids": np.frombuffer(row[f"{side}_ids"], "<i8"),
            "ints": np.frombuffer(row[f"{side}_ints"], np.int8).reshape(-1, dim),
            "scales": np.frombuffer(row[f"{side}_scales"], "<f8").reshape(-1, 3),
            "vecs": np.frombuffer(row[f"{side}_vecs"], "<f8").reshape(-1, dim)}


def _roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest id connected with each vector over the links (i, j)."""
    root = ids.copy()
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (root == before).all():
            return root


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", threshold: float = THRESHOLD,
                    tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per id.

    Two vectors of different ids link if their labels are equal and their cosine in double
    precision is at least ``threshold``. A null label, a null, empty or zero
    vector, a null or non-finite component, or a null id links with nothing
    (its row has 0 links and is its own component; a null id has a null
    component and is kept). Vectors of different dimension do not link.
    Rows that repeat id, label and vector count once. Rows that repeat an id
    with another label or vector are vectors of that id: all of them are
    compared, and the id has the links of all. Other columns are ignored; an empty table gives an empty result.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"),
                          F.col(label_col).cast("long").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (rows.where("vec_id is not null and label is not null and size(vec) > 0")
              .where(finite & F.exists("vec", lambda x: x != 0))
              .dropDuplicates(["label", "vec_id", "vec"]).select("label", "vec_id", "vec"))
    # The hash spreads the rows of an id that comes very often.
    spread = usable.repartitionByRange("label", "vec_id", F.xxhash64("vec"))
    made = checkpointed(tiles(spread, tile), "tiles")
    keys = made.select("label", "dim", "tile")
    pairs = (keys.withColumnRenamed("tile", "a_tile")
             .join(keys.withColumnRenamed("tile", "b_tile"), ["label", "dim"])
             .where("a_tile <= b_tile"))
    side = lambda s: made.select(F.col("tile").alias(f"{s}_tile"), *[
        F.col(c).alias(f"{s}_{c}") for c in ("ids", "ints", "scales", "vecs")])
    work = pairs.join(side("a"), "a_tile").join(side("b"), "b_tile")

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = _tile(row, "a"), _tile(row, "b")
                same = row["a_tile"] == row["b_tile"]
                i, j = linked(a, b, threshold, same)
                other = a["ids"][i] != b["ids"][j]
                i, j = i[other], j[other]
                if not len(i):
                    continue
                ids = a["ids"] if same else np.concatenate([a["ids"], b["ids"]])
                if not same:
                    j = j + len(a["ids"])
                links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                root = _roots(ids, i, j)
                hit = links > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[hit]), pa.array(links[hit]), pa.array(root[hit])],
                    names=["vec_id", "links", "root"])

    found = checkpointed(work.mapInArrow(compare, _LINKS), "links")
    counts = found.groupBy(F.col("vec_id").alias("id")).agg(F.sum("links").alias("n_links"))
    groups = connected_components(found, "vec_id", "root")
    linked_rows = counts.join(groups, "id", "left")
    return (rows.select("vec_id").distinct()
            .join(linked_rows, F.col("vec_id") == F.col("id"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def op6_embedding_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "embeddings"))
