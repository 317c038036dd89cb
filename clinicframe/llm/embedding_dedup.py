"""Near copies among embeddings by tiled comparison in PCA order.

Vectors of one label are compared by cosine. Equal vectors are one vector with a number
of copies and a number of its own, which tiles, links and components use; only a finished
component takes the smallest vec_id of its rows. Rows without vec_id, or with the same one,
are therefore linked by their vectors alone. A rotation to the principal axes of a bounded sample leaves products as they
are and puts most of a vector's length into its leading components. The same sample
gives a tree of median cuts along these axes; a leaf's vectors make up tiles of about
``TILE_ROWS`` rows. Two tiles are compared only if their boxes come within the distance
that the threshold allows, and a pair of tiles adds up products from the leading
components on: when what has been added plus the product of the two remaining lengths
cannot reach the threshold, the pair of vectors is given up. What is left is decided on
the vectors as given, in double precision. The sample decides only how much is pruned,
never the result. Partial counts and links leave a pair of tiles one row per vector.

Nulls: vectors that are null, of length zero, or with null or non-finite components, and
vectors without label, are linked with nothing; vectors of different dimensions too. A
null vec_id sorts last and is returned as null. Repeated rows are linked with each other.
An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicframe.llm.common import LAST_ID, identifier, smallest
from clinicframe.llm.components import components
from clinicframe.operators.skew import join_grouped
from clinicframe.session import ensure_checkpoint_dir

THRESHOLD = 0.93
TILE_ROWS = 1024
SAMPLE_ROWS = 4096
#: Leading axes that a tile's box covers, and the places where products are looked at.
BOX_AXES = 8
STEPS = (4, 8, 16, 32)
#: Room for rounding in the bounds; the decision itself has none.
MARGIN = 1e-9


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that squares stay in range."""
    out = vectors.astype(np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


class Axes:
    """A rotation and a tree of median cuts for one dimension."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        rows = unit(sample)
        values, vectors = np.linalg.eigh(rows.T @ rows)
        self.rotation = np.ascontiguousarray(vectors[:, np.argsort(-values)])
        depth = min(int(np.ceil(np.log2(max(1, leaves)))), max(0, int(np.log2(len(rows))) - 3))
        turned = rows @ self.rotation
        leaf = np.zeros(len(rows), np.int64)
        self.cuts: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(depth):
            axis, cut = np.zeros(leaf.max() + 1, np.int64), np.zeros(leaf.max() + 1)
            for k in range(len(axis)):
                own = turned[leaf == k]
                if len(own):
                    axis[k] = np.argmax(own.var(axis=0))
                    cut[k] = np.median(own[:, axis[k]])
            self.cuts.append((axis, cut))
            leaf = 2 * leaf + (turned[np.arange(len(rows)), axis[leaf]] > cut[leaf])

    def leaf(self, turned: np.ndarray) -> np.ndarray:
        out = np.zeros(len(turned), np.int64)
        for axis, cut in self.cuts:
            known = np.minimum(out, len(axis) - 1)
            out = 2 * out + (turned[np.arange(len(turned)), axis[known]] > cut[known])
        return out


def links_between(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with cosine of a[i] and b[j] at or above the threshold."""
    x, y = unit(a) @ rotation, unit(b) @ rotation
    steps = [0, *(s for s in STEPS if s < x.shape[1]), x.shape[1]]
    so_far = np.zeros((len(x), len(y)))
    i = j = None
    for low, high in zip(steps, steps[1:]):
        rest = [np.sqrt((m[:, high:] ** 2).sum(axis=1)) for m in (x, y)]
        if i is None:
            so_far += x[:, low:high] @ y[:, low:high].T
            alive = so_far + np.outer(*rest) >= threshold - MARGIN
            if alive.sum() * 8 < alive.size:
                i, j = np.nonzero(alive)
                so_far = so_far[i, j]
        else:
            so_far += np.einsum("ij,ij->i", x[i, low:high], y[j, low:high])
            alive = so_far + rest[0][i] * rest[1][j] >= threshold - MARGIN
            i, j, so_far = i[alive], j[alive], so_far[alive]
        if i is not None and not len(i):
            break
    if i is None:
        i, j = np.nonzero(alive)
    u, v = a.astype(np.float64), b.astype(np.float64)
    u /= np.abs(u).max(axis=1, keepdims=True)
    v /= np.abs(v).max(axis=1, keepdims=True)
    size_u, size_v = ((m * m).sum(axis=1) for m in (u, v))
    fits = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 16):
        p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        fits[s : s + (1 << 16)] = np.einsum("ij,ij->i", u[p], v[q]) / np.sqrt(size_u[p] * size_v[q]) >= threshold
    return i[fits], j[fits]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches by the links."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tile(frame: pd.DataFrame, kind: str, axes: dict[int, Axes]) -> pd.DataFrame:
    """One row for a tile: its vectors and its box on the leading axes."""
    frame = frame.sort_values("rep")
    vectors = np.stack(frame["embedding"].to_numpy()).astype(kind)
    turned = (unit(vectors) @ rotation(axes, vectors.shape[1]))[:, :BOX_AXES]
    first = frame.iloc[0]
    return pd.DataFrame(
        [(first["label"], first["dim"], f"{first['leaf']}:{first['part']}", frame["rep"].to_numpy("<i8").tobytes(), frame["copies"].to_numpy("<i8").tobytes(),
          vectors.tobytes(), turned.min(axis=0).tolist(), turned.max(axis=0).tolist())],
        columns=["label", "dim", "tile", "reps", "copies", "vectors", "low", "high"],
    )


def rotation(axes: dict[int, Axes], dim: int) -> np.ndarray:
    return axes[dim].rotation if dim in axes else np.eye(dim)


def _compared(frames: Iterator[pd.DataFrame], kind: str, axes: dict[int, Axes], threshold: float) -> Iterator[pd.DataFrame]:
    """For each pair of tiles a row per linked vector: its links, in rows, and the smallest vector it reaches here."""
    for frame in frames:
        for row in frame.itertuples():
            ids = [np.frombuffer(x, "<i8") for x in (row.reps, row.reps_b)]
            copies = [np.frombuffer(x, "<i8") for x in (row.copies, row.copies_b)]
            tiles = [np.frombuffer(x, kind).reshape(-1, row.dim) for x in (row.vectors, row.vectors_b)]
            i, j = links_between(*tiles, rotation(axes, row.dim), threshold)
            if row.tile == row.tile_b:
                i, j = i[i < j], j[i < j]
                names, own, offset = ids[0], copies[0], 0
            else:
                names, own, offset = np.concatenate(ids), np.concatenate(copies), len(ids[0])
            order = np.argsort(names, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            p, q = place[i], place[j + offset]
            names, own = names[order], own[order]
            links = np.zeros(len(names), np.int64)
            np.add.at(links, p, own[q])
            np.add.at(links, q, own[p])
            any_link = links > 0
            yield pd.DataFrame({"rep": names[any_link], "links": links[any_link], "root": names[roots(len(names), p, q)][any_link]})


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    base = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST_ID)).alias("vec_order"), "label", "embedding")
    kind = "<f4" if dict(base.dtypes)["embedding"] == "array<float>" else "<f8"
    good = F.col("label").isNotNull() & usable(F.col("embedding"))
    distinct = base.filter(good).groupBy("label", "embedding").agg(F.min("vec_order").alias("first"), F.count("*").alias("copies"))
    # The checkpoint freezes the numbers.
    distinct = distinct.withColumn("rep", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")).checkpoint()
    sample = smallest(distinct.select("label", "dim", "embedding"), [F.xxhash64("embedding", "label")], SAMPLE_ROWS).toPandas()
    leaves = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    axes = {int(d): Axes(np.stack(rows.to_numpy()), leaves // TILE_ROWS) for d, rows in sample.groupby("dim")["embedding"]}

    def leaf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = np.zeros(len(frame), np.int64)
            for dim, rows in frame.reset_index(drop=True).groupby("dim").indices.items():
                if dim in axes:
                    out[rows] = axes[dim].leaf(unit(np.stack(frame["embedding"].to_numpy()[rows])) @ axes[dim].rotation)
            yield frame.assign(leaf=out)

    element = dict(base.dtypes)["embedding"]
    label = dict(base.dtypes)["label"]
    placed = distinct.drop("first").mapInPandas(leaf, f"label {label}, embedding {element}, rep long, copies long, dim int, leaf long")
    sizes = placed.groupBy("label", "dim", "leaf").agg(F.ceil(F.count("*") / TILE_ROWS).alias("parts"))
    # Sizes are grouped by these columns; the fourth has them shuffled anew, so that a leaf with very many vectors can be split.
    tag = F.hash("label", "dim", "leaf")
    placed = placed.withColumn("tag", tag).join(sizes.withColumn("tag", tag), ["label", "dim", "leaf", "tag"]).drop("tag").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    tiles = placed.groupBy("label", "dim", "leaf", "part").applyInPandas(
        lambda f: _tile(f, kind, axes),
        f"label {label}, dim int, tile string, reps binary, copies binary, vectors binary, low array<double>, high array<double>",
    ).checkpoint()

    # Tiles meet where their ranges on the first axis come near each other, then by their boxes.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + MARGIN)
    bin_of = lambda c: F.floor(c / reach).cast("long")
    first_low, first_high = F.element_at("low", 1), F.element_at("high", 1)
    near = tiles.select("label", "dim", "tile", "low", "high")
    left = near.withColumn("bin", F.explode(F.sequence(bin_of(first_low), bin_of(first_high))))
    right = near.select("label", "dim", *[F.col(c).alias(f"{c}_b") for c in ("tile", "low", "high")], F.explode(F.sequence(bin_of(first_low - reach), bin_of(first_high + reach))).alias("bin"))
    gap = F.aggregate(
        F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("low_b", "high_b"), lambda a, b: F.greatest(a["low"] - b["high_b"], b["low_b"] - a["high"], F.lit(0.0))),
        F.lit(0.0), lambda total, g: total + g * g,
    )
    pairs = left.join(right, ["label", "dim", "bin"]).filter("tile <= tile_b").filter(gap <= reach * reach)
    pairs = pairs.select("label", "dim", "tile", "tile_b").distinct()
    payload = tiles.select("label", "dim", "tile", "reps", "copies", "vectors")
    other = payload.select("label", "dim", *[F.col(c).alias(f"{c}_b") for c in ("tile", "reps", "copies", "vectors")])
    jobs = pairs.join(payload, ["label", "dim", "tile"]).join(other, ["label", "dim", "tile_b"])
    found = jobs.mapInPandas(lambda f: _compared(f, kind, axes, threshold), "rep long, links long, root long").checkpoint()

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = links.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = distinct.select("label", "embedding", "rep", "first", "copies").join(linked, "rep", "left").select(
        "label", "embedding", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("part")
    )
    least = named.groupBy("part").agg(F.min("first").alias("component"))
    named = join_grouped(named.drop("first"), least, "part").drop("part")
    inside = base.filter(good).join(named, ["label", "embedding"]).select("vec_order", "n_links", "component")
    outside = base.filter(~good).select("vec_order", F.lit(0).cast("long").alias("n_links"), F.col("vec_order").alias("component"))
    return inside.unionByName(outside).select(
        identifier("vec_order").alias("vec_id"), "n_links", identifier("component").alias("component_id"), (F.col("vec_order") == F.col("component")).alias("kept")
    )
