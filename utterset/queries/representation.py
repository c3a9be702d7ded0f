"""Queries over embeddings, frames and sample pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterset.functions import vectors
from utterset.functions.normal import sql_inverse_normal
from utterset.operators import embeddings, probes, sampling, signals
from utterset.plans.ordering import beside
from utterset.queries.common import (
    SQL_UTTERANCES,
    dealt,
    rounded,
    sql_hash,
    sql_round,
    table,
    utterances,
)
from utterset.session import scratch_path
from utterset.streaming import features


def embedding_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.covariance_stats(table(spark, sf_dir, "embeddings"), "embedding")
    return rounded(out, *[c for c in out.columns if c not in ("dims", "rows")])


SQL_COVARIANCE = f"""
WITH x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
cov AS (SELECT a.i AS i, b.i AS j, covar_samp(a.v, b.v) AS c FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY a.i, b.i),
d AS (SELECT i, avg(v) AS m FROM x GROUP BY i),
s AS (SELECT sqrt(c) AS std, c FROM cov WHERE i = j)
SELECT 64::BIGINT AS dims, (SELECT count(*) FROM embeddings) AS rows, {sql_round('avg(std)')} AS dim_std_mean, {sql_round('min(std)')} AS dim_std_min,
       {sql_round('quantile_cont(std, 0.05)')} AS dim_std_p05, {sql_round('quantile_cont(std, 0.5)')} AS dim_std_median,
       {sql_round('quantile_cont(std, 0.95)')} AS dim_std_p95, {sql_round('max(std)')} AS dim_std_max,
       {sql_round('avg((std < 0.001)::INT)')} AS collapsed_dim_frac, {sql_round('(SELECT avg(abs(m)) FROM d)')} AS mean_abs,
       {sql_round('avg(c)')} AS cov_diag_mean,
       {sql_round('(SELECT sum(abs(c)) / (64 * 63) FROM cov WHERE i <> j)')} AS cov_offdiag_abs_mean,
       {sql_round('(SELECT sqrt(sum(c * c) / (64 * 63)) FROM cov WHERE i <> j)')} AS cov_offdiag_rms,
       {sql_round('sum(c) * sum(c) / (SELECT sum(c * c) FROM cov)')} AS effective_rank
FROM s
"""


def covariance_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.covariance_spectrum(table(spark, sf_dir, "embeddings"), "embedding")
    return rounded(out, *out.columns)


def frame_pooling_meanstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over 8 x 8 frames, per vector and dimension."""
    pooled = table(spark, sf_dir, "embeddings").select(
        "vec_id", embeddings.pool_array(embeddings.frames_of(vectors.as_double(F.col("embedding")), 8), "meanstd").alias("p")
    )
    return rounded(pooled.select("vec_id", F.posexplode("p").alias("dim", "value")), "value")


SQL_POOLING = f"""
WITH x AS (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
p AS (SELECT vec_id, k % 8 AS d, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY vec_id, k % 8)
SELECT vec_id, d::INTEGER AS dim, {sql_round('m')} AS value FROM p UNION ALL SELECT vec_id, (d + 8)::INTEGER, {sql_round('s')} FROM p
"""

SLICES, POINTS = 256, 17


def sliced_normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.sliced_normality(
        table(spark, sf_dir, "embeddings"), "embedding", slices=SLICES, points=POINTS, seed=67
    )
    return rounded(out, "statistic")


def _sql_uniform(key: str, start: int) -> str:
    return f"((('0x' || substr({key}, {start}, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


SQL_NORMALITY = f"""
WITH h AS (SELECT s, d, {sql_hash(67, 'slice', 's', 'd')} AS h FROM range({SLICES}) a(s), range(64) b(d)),
g AS (SELECT s, d, sqrt(-2 * ln({_sql_uniform('h', 1)})) * cos(6.283185307179586::DOUBLE * {_sql_uniform('h', 9)}) AS g FROM h),
a AS (SELECT s, d, g / sqrt(sum(g * g) OVER (PARTITION BY s)) AS a FROM g),
m AS (SELECT s, list(a ORDER BY d) AS a FROM a GROUP BY s),
y AS (SELECT s, list_dot_product(embedding::DOUBLE[], a) AS y FROM embeddings, m),
t AS (SELECT k, -5 + k * 0.625::DOUBLE AS t, exp(-((-5 + k * 0.625::DOUBLE) ** 2) / 2) AS phi, CASE WHEN k IN (0, 16) THEN 0.3125::DOUBLE ELSE 0.625::DOUBLE END AS w FROM range({POINTS}) r(k)),
c AS (SELECT s, k, any_value(phi) AS phi, any_value(w) AS w, avg(cos(y * t)) AS c, avg(sin(y * t)) AS sn, count(*) AS n FROM y, t GROUP BY s, k)
SELECT s::INTEGER AS slice, {sql_round('sum(((c - phi) ** 2 + sn ** 2) * w * phi) * max(n)')} AS statistic FROM c GROUP BY s
"""


def gaussian_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.gaussian_moments(table(spark, sf_dir, "embeddings"), "embedding")
    return rounded(out, "center_loss", "scale_loss")


SQL_MOMENTS = f"""
WITH x AS (SELECT unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
d AS (SELECT i, avg(v) AS mu, stddev_pop(v) + 1e-6 AS sd FROM x GROUP BY i)
SELECT {sql_round('avg(mu * mu)')} AS center_loss, {sql_round('avg((sd - 1) ** 2)')} AS scale_loss FROM d
"""


def gaussian_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.gaussian_shape(table(spark, sf_dir, "embeddings"), "embedding", slices=SLICES, seed=71)
    return rounded(out, "shape")


SQL_SHAPE = f"""
WITH h AS (SELECT s, d, {sql_hash(71, 'slice', 's', 'd')} AS h FROM range({SLICES}) a(s), range(64) b(d)),
g AS (SELECT s, d, sqrt(-2 * ln({_sql_uniform('h', 1)})) * cos(6.283185307179586::DOUBLE * {_sql_uniform('h', 9)}) AS g FROM h),
a AS (SELECT s, d, g / sqrt(sum(g * g) OVER (PARTITION BY s)) AS a FROM g),
m AS (SELECT s, list(a ORDER BY d) AS a FROM a GROUP BY s),
x AS (SELECT vec_id, unnest(range(64)) AS d, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
z AS (SELECT vec_id, d, (x - avg(x) OVER (PARTITION BY d)) / (stddev_pop(x) OVER (PARTITION BY d) + 1e-6) AS z FROM x),
v AS (SELECT vec_id, list(z ORDER BY d) AS z FROM z GROUP BY vec_id),
y AS (SELECT s, list_dot_product(z, a) AS y FROM v, m),
r AS (SELECT s, y, row_number() OVER (PARTITION BY s ORDER BY y) / (count(*) OVER (PARTITION BY s) + 1.0::DOUBLE) AS p FROM y)
SELECT s::INTEGER AS slice, {sql_round(f"avg((y - ({sql_inverse_normal('p')})) ** 2)")} AS shape FROM r GROUP BY s
"""


def view_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global and local views around their centre, and clean against shifted copies."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.as_double(F.col("embedding")).alias("x"))

    def scaled(a: float, b: float):
        return F.transform("x", lambda e: e * a + b)

    views = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("view"), F.lit(g).alias("is_global"), scaled(a, b).alias("v"))
                for i, (g, a, b) in enumerate(((True, 1.0, 0.0), (True, 0.9, 0.01), (False, 0.5, 0.0)))
            ]
        )
    )
    consistency = embeddings.view_consistency(
        rows.select("vec_id", views.alias("w")).select("vec_id", "w.*"), item="vec_id", view="view", vector="v", is_global="is_global"
    )
    n = rows.count()
    clean = rows.select(F.col("vec_id").alias("pos"), embeddings.frames_of(F.col("x"), 8).alias("clean"))
    moved = rows.select(
        F.col("vec_id").alias("pos"), embeddings.frames_of(scaled(0.9, 0.02), 8).alias("z")
    )
    pairs = embeddings.view_pairs(clean, moved, pos="pos", n=n).withColumn("aug", F.col("view.z"))
    contrast = embeddings.pair_contrast(pairs, "clean", "aug")
    both = beside(consistency, contrast)
    return rounded(both, *both.columns)


SQL_VIEWS = f"""
WITH x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
c AS (SELECT v, (v + v * 0.9 + 0.01) / 2 AS ctr FROM x),
cons AS (SELECT avg(((v - ctr) ** 2 + (v * 0.9 + 0.01 - ctr) ** 2) / 2) AS g, avg((v * 0.5 - ctr) ** 2) AS l FROM c),
n AS (SELECT count(*) AS n FROM embeddings),
f AS (SELECT avg((a.v - (a.v * 0.9 + 0.02)) ** 2) AS pos, avg((a.v - (b.v * 0.9 + 0.02)) ** 2) AS neg
      FROM x a, n JOIN x b ON b.i = a.i AND b.vec_id = (a.vec_id - 1 + n.n) % n.n),
p AS (SELECT vec_id, i % 8 AS d, avg(v) AS m FROM x GROUP BY vec_id, i % 8),
u AS (SELECT avg((a.m - (a.m * 0.9 + 0.02)) ** 2) AS pos, avg((a.m - (b.m * 0.9 + 0.02)) ** 2) AS neg
      FROM p a, n JOIN p b ON b.d = a.d AND b.vec_id = (a.vec_id - 1 + n.n) % n.n)
SELECT {sql_round('g')} AS global_mse, {sql_round('l')} AS local_mse, {sql_round('g + l')} AS total,
       {sql_round('f.pos')} AS pos_frame_mse, {sql_round('f.neg')} AS neg_frame_mse, {sql_round('u.pos')} AS pos_utt_mse, {sql_round('u.neg')} AS neg_utt_mse,
       {sql_round('f.neg / greatest(f.pos, 1e-8)')} AS frame_contrast, {sql_round('u.neg / greatest(u.pos, 1e-8)')} AS utt_contrast
FROM cons, f, u
"""


# -- samples ----------------------------------------------------------------


def si_sdr_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance over the declared prefix; vectors of label 9 are silent."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", vectors.as_double(F.col("embedding")).alias("x"),
        F.when(F.col("label") == 8, F.lit(None)).otherwise((F.pmod("vec_id", F.lit(70)) + 5) / 100.0).alias("duration"),
    )
    n = vectors.valid_prefix(F.size("x"), F.col("duration"), 100)
    cut = rows.withColumn("n", n).withColumn(
        "ref", F.transform(F.slice("x", F.lit(1), F.col("n").cast("int")), lambda v: F.when(F.col("label") == 9, F.lit(0.0)).otherwise(v))
    ).withColumn("est", F.transform(F.slice("x", F.lit(1), F.col("n").cast("int")), lambda v, i: v * 0.9 + 0.05 * F.pmod(i, F.lit(2))))
    scored = signals.si_sdr(dealt(cut), reference="ref", estimate="est")
    out = scored.select("vec_id", "n", "wav_l1", "si_sdr_db", F.col("si_sdr_error").isNotNull().alias("failed"))
    return rounded(out, "wav_l1", "si_sdr_db")


SQL_SISDR = f"""
WITH r AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, CASE WHEN label = 8 THEN 64 ELSE least(64, greatest(1, round_even((vec_id % 70 + 5) / 100.0::DOUBLE * 100, 0)))::BIGINT END AS n FROM embeddings),
e AS (SELECT vec_id, n, i, CASE WHEN label = 9 THEN 0.0 ELSE x[i + 1] END AS a, x[i + 1] * 0.9 + 0.05 * (i % 2) AS b FROM r, range(64) t(i) WHERE i < n),
s AS (SELECT vec_id, n, avg(abs(a - b)) AS l1, sum(a * a) - sum(a) * sum(a) / count(*) AS xx0, var_pop(a) * count(*) AS xx, var_pop(b) * count(*) AS yy, covar_pop(a, b) * count(*) AS xy FROM e GROUP BY vec_id, n)
SELECT vec_id, n, {sql_round('l1')} AS wav_l1,
       CASE WHEN xx > 1e-8 THEN {sql_round('10 * log10(greatest((xy * xy / xx) / greatest(yy - xy * xy / xx, 1e-8), 1e-8))')} END AS si_sdr_db,
       NOT (xx > 1e-8) AS failed FROM s
"""


def fixed_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels mixed, cut into windows of ten, flattened and put together."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.as_double(F.col("embedding")).alias("x"))
    mono = rows.select("vec_id", vectors.to_mono(F.array(F.col("x"), F.reverse("x"))).alias("x"))
    chunks = signals.chunk(mono, item="vec_id", samples="x", n=10)
    whole = signals.reassemble(chunks, item="vec_id", samples="x").select("vec_id", F.size("x").alias("length"))
    flat = signals.flatten_frames(
        mono.select("vec_id", embeddings.frames_of(F.col("x"), 8).alias("f")), item="vec_id", frames="f", max_frames=8
    )
    packed = signals.unflatten_frames(flat, item="vec_id").select("vec_id", F.col("length").alias("frames"))
    sums = chunks.select("vec_id", "chunk", vectors.total(F.col("x")).alias("total"))
    return rounded(sums.join(whole, "vec_id").join(packed, "vec_id"), "total")


SQL_CHUNKS = f"""
WITH x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
m AS (SELECT a.vec_id, a.i, (a.v + b.v) / 2 AS v FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.i = 63 - a.i)
SELECT vec_id, (i // 10)::INTEGER AS chunk, {sql_round('sum(v)')} AS total, 70 AS length, 8::BIGINT AS frames FROM m GROUP BY vec_id, i // 10
"""


def mrstft_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors repeated to 4,096 samples against attenuated, offset copies."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.flatten(F.array_repeat(vectors.as_double(F.col("embedding")), 64)).alias("x")
    ).withColumn("y", F.transform("x", lambda v: v * 0.8 + 0.01))
    out = signals.mrstft(dealt(rows), reference="x", estimate="y").select(
        "vec_id", "stft_sc", "stft_mag", "stft_log", "stft_loss"
    )
    return rounded(out, "stft_sc", "stft_mag", "stft_log", "stft_loss")


AUGMENT = signals.EFFECTS | {"cutoff": signals.Effect(0.5, 1000.0, 7000.0), "clip": signals.Effect(0.5, 0.5, 0.99)}


def view_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn gain and noise level of two global and two local views per vector."""
    rows = signals.view_rows(table(spark, sf_dir, "embeddings").select("vec_id"), global_views=2, local_views=2)
    out = signals.draw_parameters(rows, AUGMENT, key="vec_id", seed=73).select("vec_id", "view", "is_global", "gain", "snr_db")
    return rounded(out, "gain", "snr_db")


SQL_PARAMETERS = f"""
WITH r AS (SELECT vec_id, v AS view, {sql_hash(73, 'gain', 'vec_id', 'v')} AS g, {sql_hash(73, 'noise', 'vec_id', 'v')} AS s FROM embeddings, range(4) t(v))
SELECT vec_id, view::INTEGER AS view, view < 2 AS is_global,
       CASE WHEN {_sql_uniform('g', 1)} < 0.5 THEN {sql_round('0.5 + ' + _sql_uniform('g', 9))} END AS gain,
       CASE WHEN {_sql_uniform('s', 1)} < 0.5 THEN {sql_round('5 + ' + _sql_uniform('s', 9) + ' * 25')} END AS snr_db FROM r
"""


def augmented_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of every augmented view and the share of its masked frames."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    views = signals.augment_views(
        dealt(rows), AUGMENT, key="vec_id", samples="embedding", sample_rate=16000, global_views=2, local_views=2, seed=73
    )
    masked = signals.span_masks(
        views.withColumn("frames", F.lit(16)).withColumn("mkey", F.concat_ws(":", "vec_id", "view")),
        key="mkey", frames="frames", ratio=0.3, min_span=2, max_span=4, seed=79,
    )
    kept = signals.mask_samples(F.col("embedding"), F.col("mask"), 4)
    return rounded(
        masked.select(
            "vec_id", "view", vectors.dot(F.col("embedding"), F.col("embedding")).alias("energy"),
            vectors.dot(kept, kept).alias("kept_energy"),
            F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("masked_frames"),
        ),
        "energy", "kept_energy",
    )


# -- probes and projections -------------------------------------------------


def linear_probe_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold speaker predictions over folds of hashed vectors."""
    rows = utterances(spark, sf_dir).select(
        "vec_id", F.col("speaker").cast("string").alias("speaker"), "embedding", F.pmod(F.crc32(F.col("vec_id").cast("string")), F.lit(5)).cast("int").alias("fold")
    )
    return probes.linear_probe(rows, vector="embedding", label="speaker").select(
        "vec_id", "fold", F.col("speaker").alias("gold"), "prediction"
    )


def mlp_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.holdout_per_group(
        utterances(spark, sf_dir).select("vec_id", F.col("speaker").cast("string").alias("speaker"), "embedding"), "vec_id", "speaker", 10, 83
    )
    out = probes.mlp_probe(
        rows.where(F.col("role") == "train"), rows.where(F.col("role") == "test"), vector="embedding", label="speaker", hidden=256
    )
    return out.select("vec_id", F.col("speaker").alias("gold"), "prediction")


def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.pca_2d(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id", "label"])
    return rounded(out, "pc1", "pc2", "explained1", "explained2")


def incremental_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a growing table: changed content is extracted again,
    changed labels are only read again."""
    path = scratch_path(spark, "features")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item"), "label", vectors.as_double(F.col("embedding")).alias("x")
    )

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("content_hash", features.content_hash(F.to_json("x"))).withColumn("extractor", F.lit("sum-v1"))

    def extract(df: DataFrame) -> DataFrame:
        return df.withColumn("features", F.array(vectors.total(F.col("x")), vectors.norm(F.col("x"))))

    first = keyed(rows.where(F.col("label") < 5))
    changed = rows.withColumn("x", F.when(F.col("label") == 0, F.transform("x", lambda v: v * 2)).otherwise(F.col("x")))
    second = keyed(changed.withColumn("label", F.col("label") + 100))
    one = features.update_features(spark, first, path, extract)
    two = features.update_features(spark, second, path, extract)
    out = features.with_features(second, spark, path).select(
        "item", "label", F.col("features")[0].alias("total"), F.lit(one).cast("long").alias("first_run"), F.lit(two).cast("long").alias("second_run")
    )
    return rounded(out, "total")


SQL_INCREMENTAL = f"""
SELECT vec_id AS item, (label + 100)::INTEGER AS label,
       {sql_round('list_sum(embedding::DOUBLE[]) * CASE WHEN label = 0 THEN 2 ELSE 1 END')} AS total,
       (SELECT count(*) FROM embeddings WHERE label < 5) AS first_run, (SELECT count(*) FROM embeddings WHERE label >= 5 OR label = 0) AS second_run
FROM embeddings
"""

QUERIES = {
    "embedding_covariance": embedding_covariance,
    "covariance_spectrum": covariance_spectrum,
    "frame_pooling_meanstd": frame_pooling_meanstd,
    "sliced_normality": sliced_normality,
    "gaussian_moments": gaussian_moments,
    "gaussian_shape": gaussian_shape,
    "view_contrast": view_contrast,
    "si_sdr_l1": si_sdr_l1,
    "fixed_window_chunks": fixed_window_chunks,
    "mrstft_distance": mrstft_distance,
    "view_parameters": view_parameters,
    "augmented_views": augmented_views,
    "linear_probe_oof": linear_probe_oof,
    "mlp_probe": mlp_probe,
    "pca_2d": pca_2d,
    "incremental_features": incremental_features,
}

ORACLES = {
    "embedding_covariance": SQL_COVARIANCE,
    "frame_pooling_meanstd": SQL_POOLING,
    "sliced_normality": SQL_NORMALITY,
    "gaussian_moments": SQL_MOMENTS,
    "gaussian_shape": SQL_SHAPE,
    "view_contrast": SQL_VIEWS,
    "si_sdr_l1": SQL_SISDR,
    "fixed_window_chunks": SQL_CHUNKS,
    "view_parameters": SQL_PARAMETERS,
    "incremental_features": SQL_INCREMENTAL,
}
