"""Pooling, covariance diagnostics and normality statistics of embeddings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterset.functions import vectors
from utterset.functions.hashing import draw_normal, order_key
from utterset.functions.normal import inverse_normal

# Fixed values of the diagnostics.
COLLAPSED_STD = 1.0e-3
SMALL = 1.0e-12


# -- frames and pooling -----------------------------------------------------


def frames_of(x: Column, dim: int) -> Column:
    """Reshape a flat array into frames of ``dim`` values."""
    return F.transform(
        F.sequence(F.lit(0), F.floor(F.size(x) / dim).cast("int") - 1),
        lambda t: F.slice(x, t * dim + 1, dim),
    )


def pool_array(frames: Column, mode: str, valid: Column | None = None) -> Column:
    """Mean, or mean and population deviation, over the (valid) frames."""
    if mode not in ("mean", "meanstd"):
        raise ValueError(f"unknown pool mode {mode!r}")
    used = frames if valid is None else F.slice(frames, 1, valid.cast("int"))
    n = F.size(used)
    zeros = F.transform(F.element_at(frames, 1), lambda _: F.lit(0.0))

    def summed(change) -> Column:
        return F.aggregate(used, zeros, lambda acc, f: F.zip_with(acc, change(f), lambda a, b: a + b))

    means = F.transform(summed(lambda f: f), lambda s: s / n)
    if mode == "mean":
        return means

    def with_deviation(m: Column) -> Column:
        squares = summed(lambda f: F.zip_with(f, m, lambda x, c: (x - c) * (x - c)))
        return F.concat(m, F.transform(squares, lambda s: F.sqrt(s / n)))

    return vectors.let(means, with_deviation)


def pool_long(df: DataFrame, *, utt: str, dim: str, value: str, mode: str) -> DataFrame:
    """Pooling of long-form frames (utt, frame, dim, value)."""
    out = df.groupBy(utt, dim).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out if mode == "meanstd" else out.drop("std")


def normalize_item(df: DataFrame, *, item: str, bin_col: str, value: str) -> DataFrame:
    """(x - mean) / (sample deviation + 1e-5) per item and bin.

    The statistics are aggregated and joined back, so no item is gathered.
    """
    stats = df.groupBy(item, bin_col).agg(
        F.avg(value).alias("_m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_s")
    )
    return df.join(stats, [item, bin_col]).withColumn(
        value, (F.col(value) - F.col("_m")) / (F.col("_s") + F.lit(1e-5))
    ).drop("_m", "_s")


# -- covariance -------------------------------------------------------------


def gram(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, sxy, si, sj, n) for i <= j: sums over all rows.

    Each task multiplies its Arrow batches and emits one D x D partial, so the
    shuffle carries tasks * D^2 numbers instead of rows * D^2.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums, count = None, None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy()).astype(np.float64)
            if total is None:
                total, sums = np.zeros((x.shape[1], x.shape[1])), np.zeros(x.shape[1])
            total += x.T @ x
            sums += x.sum(axis=0)
            count += len(x)
        if total is None:
            return
        i, j = np.triu_indices(len(sums))
        yield pd.DataFrame(
            {"i": i, "j": j, "sxy": total[i, j], "si": sums[i], "sj": sums[j], "n": count}
        )

    parts = df.select(vectors.as_double(F.col(vector)).alias("x")).mapInPandas(
        partial, "i int, j int, sxy double, si double, sj double, n long"
    )
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("sxy", "si", "sj", "n")])


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, c, mean_i): sample covariance for i <= j."""
    c = (F.col("sxy") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)
    return gram(df, vector).select(
        "i", "j", c.alias("c"), (F.col("si") / F.col("n")).alias("mean_i"), "n"
    )


def covariance_stats(df: DataFrame, vector: str, *, collapsed_std: float = COLLAPSED_STD) -> DataFrame:
    """One row of diagnostics that need no eigenvalues.

    Effective rank is trace^2 / |C|^2 because the eigenvalues sum to the trace
    and their squares to the squared Frobenius norm.
    """
    cov = covariance(df, vector)
    diagonal = F.col("i") == F.col("j")
    std = F.when(diagonal, F.sqrt(F.greatest(F.col("c"), F.lit(0.0))))
    square = F.col("c") * F.col("c")
    # every off-diagonal entry stands for two
    one = cov.agg(
        F.count_if(diagonal).alias("dims"),
        F.max("n").alias("rows"),
        F.avg(std).alias("dim_std_mean"),
        F.min(std).alias("dim_std_min"),
        F.max(std).alias("dim_std_max"),
        F.percentile(std, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"),
        F.avg(F.when(diagonal, (std < collapsed_std).cast("double"))).alias("collapsed_dim_frac"),
        F.avg(F.when(diagonal, F.abs("mean_i"))).alias("mean_abs"),
        F.avg(F.when(diagonal, F.col("c"))).alias("cov_diag_mean"),
        F.coalesce(F.sum(F.when(~diagonal, 2 * F.abs("c"))), F.lit(0.0)).alias("off_abs"),
        F.coalesce(F.sum(F.when(~diagonal, 2 * square)), F.lit(0.0)).alias("off_sq"),
        F.sum(F.when(diagonal, F.col("c"))).alias("trace"),
        F.sum(F.when(diagonal, square)).alias("diag_sq"),
    )
    pairs = F.greatest(F.col("dims") * F.col("dims") - F.col("dims"), F.lit(1))
    return one.select(
        "dims",
        "rows",
        "dim_std_mean",
        "dim_std_min",
        F.col("q")[0].alias("dim_std_p05"),
        F.col("q")[1].alias("dim_std_median"),
        F.col("q")[2].alias("dim_std_p95"),
        "dim_std_max",
        "collapsed_dim_frac",
        "mean_abs",
        "cov_diag_mean",
        (F.col("off_abs") / pairs).alias("cov_offdiag_abs_mean"),
        F.sqrt(F.col("off_sq") / pairs).alias("cov_offdiag_rms"),
        (F.col("trace") * F.col("trace") / F.greatest(F.col("diag_sq") + F.col("off_sq"), F.lit(SMALL))).alias(
            "effective_rank"
        ),
    )


def covariance_spectrum(df: DataFrame, vector: str) -> DataFrame:
    """Top-eigenvalue fraction and isotropy, from the aggregated D x D matrix."""

    def eigen(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["j"].max()) + 1
        matrix = np.zeros((d, d))
        matrix[pdf["i"], pdf["j"]] = pdf["c"]
        matrix[pdf["j"], pdf["i"]] = pdf["c"]
        values = np.clip(np.linalg.eigvalsh(matrix), 0.0, None)
        trace, top = values.sum(), values[-1]
        return pd.DataFrame(
            {
                "top_eigenvalue_fraction": [top / max(trace, SMALL)],
                "isotropy_ratio": [values[0] / max(top, SMALL)],
                "effective_rank": [trace**2 / max((values**2).sum(), SMALL)],
            }
        )

    return (
        covariance(df, vector)
        .groupBy(F.lit(0).alias("all"))
        .applyInPandas(eigen, "top_eigenvalue_fraction double, isotropy_ratio double, effective_rank double")
    )


def embedding_stats(df: DataFrame, vector: str) -> DataFrame:
    """Collapse gauge: dimension, rows and effective rank (0 without spread)."""
    stats = covariance_stats(df, vector)
    rank = F.when(
        (F.col("rows") >= 2) & (F.col("cov_diag_mean") > 0), F.col("effective_rank")
    ).otherwise(F.lit(0.0))
    return stats.select(
        F.col("dims").alias("embed_dim"), F.col("rows").alias("embed_num_samples"),
        F.coalesce(rank, F.lit(0.0)).alias("embed_effective_rank"),
    )


# -- views ------------------------------------------------------------------


def view_consistency(df: DataFrame, *, item: str, view: str, vector: str, is_global: str) -> DataFrame:
    """Mean squared distance of global and local views to the global centre."""
    long = df.select(item, view, is_global, F.posexplode(vectors.as_double(F.col(vector))).alias("dim", "x"))
    centre = long.where(F.col(is_global)).groupBy(item, "dim").agg(F.avg("x").alias("c"))
    gap = F.pow(F.col("x") - F.col("c"), F.lit(2.0))
    return (
        long.join(centre, [item, "dim"])
        .agg(
            F.avg(F.when(F.col(is_global), gap)).alias("global_mse"),
            F.avg(F.when(~F.col(is_global), gap)).alias("local_mse"),
        )
        .withColumn("total", F.col("global_mse") + F.coalesce("local_mse", F.lit(0.0)))
    )


def view_pairs(clean: DataFrame, augmented: DataFrame, *, pos: str, n: int) -> DataFrame:
    """Each clean item with its own view and with its predecessor's (cyclic)."""
    other = augmented.select(F.col(pos).alias("_p"), F.struct(*augmented.columns).alias("view"))
    own = clean.withColumn("_p", F.col(pos)).withColumn("kind", F.lit("positive"))
    previous = clean.withColumn("_p", F.pmod(F.col(pos) - 1, F.lit(n))).withColumn("kind", F.lit("negative"))
    return own.unionByName(previous).join(other, "_p").drop("_p")


def pair_contrast(pairs: DataFrame, clean: str, view: str) -> DataFrame:
    """Frame and utterance MSE of positive and negative pairs and their ratio.

    ``clean`` and ``view`` are arrays of frames of equal shape.
    """
    x, y = F.flatten(F.col(clean)), F.flatten(F.col(view))
    frame = vectors.mean(F.zip_with(x, y, lambda a, b: F.pow(a - b, F.lit(2.0))))
    utt = vectors.mean(
        F.zip_with(
            pool_array(F.col(clean), "mean"), pool_array(F.col(view), "mean"),
            lambda a, b: F.pow(a - b, F.lit(2.0)),
        )
    )
    scored = pairs.select("kind", frame.alias("frame"), utt.alias("utt"))
    positive = F.col("kind") == "positive"
    out = scored.agg(
        *[
            F.avg(F.when(flag, F.col(level))).alias(f"{name}_{level}_mse")
            for level in ("frame", "utt")
            for name, flag in (("pos", positive), ("neg", ~positive))
        ]
    )
    for level in ("frame", "utt"):
        out = out.withColumn(
            f"{level}_contrast",
            F.col(f"neg_{level}_mse") / F.greatest(F.col(f"pos_{level}_mse"), F.lit(1e-8)),
        )
    return out


# -- normality --------------------------------------------------------------


def projections(spark, dims: int, slices: int, seed: int) -> DataFrame:
    """(slice, dim, a): unit directions uniform on the sphere, from hash draws."""
    raw = spark.range(slices * dims).select(
        F.floor(F.col("id") / dims).cast("int").alias("slice"),
        F.pmod("id", F.lit(dims)).cast("int").alias("dim"),
    ).withColumn("g", draw_normal(order_key(seed, "slice", "slice", "dim")))
    norms = raw.groupBy("slice").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("norm"))
    return raw.join(norms, "slice").select("slice", "dim", (F.col("g") / F.col("norm")).alias("a"))


def _projection_matrix(spark, dims: int, slices: int, seed: int) -> np.ndarray:
    rows = projections(spark, dims, slices, seed).collect()  # dims * slices numbers
    matrix = np.zeros((dims, slices))
    for r in rows:
        matrix[r["dim"], r["slice"]] = r["a"]
    return matrix


def _width(df: DataFrame, vector: str) -> int:
    return int(df.select(F.size(vector).alias("d")).first()["d"])


def sliced_normality(
    df: DataFrame, vector: str, *, slices: int = 256, t_max: float = 5.0, points: int = 17, seed: int = 0
) -> DataFrame:
    """(slice, statistic): characteristic-function distance to N(0, 1).

    Tasks project their rows and emit the sums of cos and sin per (slice, t).
    """
    if points % 2 != 1:
        raise ValueError("points must be odd")
    spark = df.sparkSession
    grid = np.linspace(-t_max, t_max, points)
    matrix = _projection_matrix(spark, _width(df, vector), slices, seed)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cos, sin, count = np.zeros((slices, points)), np.zeros((slices, points)), 0
        for pdf in batches:
            if not len(pdf):
                continue
            y = np.stack(pdf["x"].to_numpy()).astype(np.float64) @ matrix
            for k, t in enumerate(grid):
                cos[:, k] += np.cos(y * t).sum(axis=0)
                sin[:, k] += np.sin(y * t).sum(axis=0)
            count += len(y)
        if count:
            s, k = np.divmod(np.arange(slices * points), points)
            yield pd.DataFrame({"slice": s, "k": k, "c": cos.ravel(), "s": sin.ravel(), "n": count})

    sums = (
        df.select(vectors.as_double(F.col(vector)).alias("x"))
        .mapInPandas(partial, "slice int, k int, c double, s double, n long")
        .groupBy("slice", "k")
        .agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    )
    step = 2.0 * t_max / (points - 1)
    t = F.lit(-t_max) + F.col("k") * F.lit(step)
    phi = F.exp(-t * t / 2)
    edge = (F.col("k") == 0) | (F.col("k") == points - 1)
    weight = F.when(edge, F.lit(step / 2)).otherwise(F.lit(step)) * phi
    gap = F.pow(F.col("c") / F.col("n") - phi, F.lit(2.0)) + F.pow(F.col("s") / F.col("n"), F.lit(2.0))
    return sums.groupBy("slice").agg((F.sum(gap * weight) * F.max("n")).alias("statistic"))


def gaussian_moments(df: DataFrame, vector: str) -> DataFrame:
    """Centre and scale losses against N(0, I): one row."""
    per_dim = df.select(F.posexplode(vectors.as_double(F.col(vector))).alias("dim", "x")).groupBy("dim").agg(
        F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd")
    )
    return per_dim.agg(
        F.avg(F.col("mu") * F.col("mu")).alias("center_loss"),
        F.avg(F.pow(F.col("sd") + F.lit(1e-6) - 1.0, F.lit(2.0))).alias("scale_loss"),
    )


BINS = 1024  # of a slice's histogram
RANKED = 1_000_000  # values that one task ranks at once


def _bin_edges() -> np.ndarray:
    """Bounds of the histogram: equally likely bins of the normal distribution."""
    return inverse_normal(np.arange(1, BINS) / BINS)


def gaussian_shape(df: DataFrame, vector: str, *, slices: int = 256, seed: int = 0) -> DataFrame:
    """(slice, shape): mean squared gap of sorted projections to normal quantiles, one row per slice.

    A first pass adds up one histogram per slice, which gives every bin its first
    rank and joins neighbouring bins to stretches of at most about ``RANKED`` values.
    A second pass sends values to their stretch as arrays of distinct values and
    counts, so neither a value nor a tie is a row; a stretch ranks its values and
    compares them with their quantiles.
    """
    spark = df.sparkSession
    dims = _width(df, vector)
    rows = df.select(vectors.as_double(F.col(vector)).alias("x"))
    matrix = _projection_matrix(spark, dims, slices, seed)
    stats = {
        r["dim"]: (r["mu"], r["sd"])
        for r in rows.select(F.posexplode("x").alias("dim", "x"))
        .groupBy("dim").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd")).collect()
    }
    mu = np.array([stats[d][0] for d in range(dims)])
    sd = np.array([stats[d][1] for d in range(dims)]) + 1e-6
    edges = _bin_edges()

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for pdf in batches:
            if len(pdf):
                yield ((np.stack(pdf["x"].to_numpy()) - mu) / sd) @ matrix

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((slices, BINS), dtype=np.int64)
        for y in projected(batches):
            for s in range(slices):
                counts[s] += np.bincount(np.searchsorted(edges, y[:, s], side="right"), minlength=BINS)
        s, k = np.nonzero(counts)
        yield pd.DataFrame({"slice": s, "bin": k, "c": counts[s, k]})

    found = rows.mapInPandas(histogram, "slice int, bin int, c long").groupBy("slice", "bin").agg(F.sum("c").alias("c"))
    # slices times BINS numbers
    counts = np.zeros((slices, BINS), dtype=np.int64)
    for r in found.collect():
        counts[r["slice"], r["bin"]] = r["c"]
    n = int(counts[0].sum())
    before = np.cumsum(counts, axis=1) - counts
    stretch_of = before // RANKED

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for y in projected(batches):
            parts = []
            for s in range(slices):
                values, times = np.unique(y[:, s], return_counts=True)
                own = stretch_of[s, np.searchsorted(edges, values, side="right")]
                cuts = np.flatnonzero(np.diff(own)) + 1
                for v, c, k in zip(np.split(values, cuts), np.split(times, cuts), np.split(own, cuts), strict=True):
                    parts.append((s, int(k[0]), v, c))
            yield pd.DataFrame(parts, columns=["slice", "stretch", "values", "times"])

    def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole stretches of a sorted partition, one at a time."""
        key, held = None, []

        def settle() -> pd.DataFrame:
            values = np.concatenate([v for v, _ in held])
            times = np.concatenate([c for _, c in held])
            y = np.sort(np.repeat(values, times))
            first = before[key[0]][stretch_of[key[0]] == key[1]].min()
            target = inverse_normal((first + 1 + np.arange(len(y))) / (n + 1))
            return pd.DataFrame({"slice": [key[0]], "gap": [float(((y - target) ** 2).sum())]})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if key != (row.slice, row.stretch):
                    if held:
                        yield settle()
                    key, held = (row.slice, row.stretch), []
                held.append((row.values, row.times))
        if held:
            yield settle()

    sent = rows.mapInPandas(stretches, "slice int, stretch int, values array<double>, times array<long>")
    laid = sent.repartition("slice", "stretch").sortWithinPartitions("slice", "stretch")
    return laid.mapInPandas(gaps, "slice int, gap double").groupBy("slice").agg((F.sum("gap") / n).alias("shape"))


# -- projection -------------------------------------------------------------


def pca_2d(df: DataFrame, vector: str, keep: Sequence[str]) -> DataFrame:
    """First two principal components, each signed by its largest loading."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = df.select(*keep, array_to_vector(vectors.as_double(F.col(vector))).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(ready)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(2)])
    share = model.explainedVariance.toArray()
    out = model.transform(ready).withColumn("_a", vector_to_array("_p"))
    return out.select(
        *keep,
        *[(F.col("_a")[i] * float(signs[i])).alias(f"pc{i + 1}") for i in range(2)],
        *[F.lit(float(share[i])).alias(f"explained{i + 1}") for i in range(2)],
    )
