"""Registered queries over the given tables, one for each operator or use of one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectroloom.functions import models, rng
from spectroloom.functions import vectors as V
from spectroloom.operators.augment import SpectraAugmenter, SpectraAugmenterConfig
from spectroloom.operators.kmeans import CosineKMeans, elbow_ckmeans
from spectroloom.operators.masks import evaluate, fixed_visible, masked_losses_by, masked_mse, patch_aligned, patch_mask, visible_mask
from spectroloom.operators.matrix import unit
from spectroloom.operators.network import AutoencoderConfig, MaskedAutoencoder
from spectroloom.operators.preprocess import SNVScaler, cosine_fps_downsample, grouped_fps
from spectroloom.operators.quality import silhouette_samples_cosine
from spectroloom.operators.schedule import moving_average, ordered_average, warmup_cosine
from spectroloom.operators.selection import elbow_table, elbows
from spectroloom.operators.vmf import VMFMixture, elbow_vmf
from spectroloom.sources import npy
from spectroloom.sources import spectra as S
from spectroloom.streaming import score

Query = Callable[[SparkSession, str], DataFrame]

#: Clusters, passes and seeds that the fixed-start queries use.
K, PASSES, SEED = 5, 4, 42
MIX, STEPS = 4, 3


def rounded(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)


def long(df: DataFrame, x: str = "x", value: str = "v") -> DataFrame:
    """One row a value: ``(row_id, pos, value)``."""
    return df.select("row_id", F.posexplode(x).alias("pos", "v")).select("row_id", "pos", rounded("v").alias(value))


def first_rows(df: DataFrame, k: int) -> np.ndarray:
    return np.array([r["x"] for r in df.where(F.col("row_id") < k).orderBy("row_id").select("x").collect()])


def snv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(SNVScaler().transform(S.embeddings(spark, sf_dir)), "y", "y")


def snv_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = SNVScaler(transform_stats=True).transform(S.embeddings(spark, sf_dir))
    return out.select("row_id", rounded("mu").alias("mu"), rounded("sd").alias("sd"))


def snv_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaler = SNVScaler(transform_stats=True)
    out = scaler.inverse_transform(scaler.transform(S.embeddings(spark, sf_dir)), output="back")
    return long(out, "back")


def snv_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one, two and three values; a single one has no spread but eps."""
    rows = S.embeddings(spark, sf_dir).withColumn("x", F.slice("x", 1, (F.col("row_id") % 3 + 1).cast("int")))
    return SNVScaler(transform_stats=True).transform(rows).select("row_id", F.posexplode("y").alias("pos", "y"), "sd").select("row_id", "pos", rounded("y").alias("y"), rounded("sd").alias("sd"))


def snv_part_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(SNVScaler().transform(S.part_month(spark, sf_dir)), "y", "y")


def spectra_part_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(S.part_month(spark, sf_dir))


def spectra_supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(S.supplier_month(spark, sf_dir))


def spectra_user_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(S.user_hour(spark, sf_dir))


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(S.part_month(spark, sf_dir).select("row_id", V.l2_normalize(F.col("x")).alias("x")))


def cosine_to_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dissimilarity of every row to the first K."""
    rows = S.embeddings(spark, sf_dir).select("row_id", V.l2_normalize(F.col("x")).alias("x"))
    firsts = rows.where(F.col("row_id") < K).select(F.col("row_id").alias("other"), F.col("x").alias("y"))
    pairs = rows.join(F.broadcast(firsts))  # K rows, whatever the table holds
    return pairs.select("row_id", "other", rounded(V.cosine_dissimilarity(F.col("x"), F.col("y"))).alias("dissimilarity"))


def _fixed_kmeans(spark: SparkSession, sf_dir: str, max_iter: int) -> tuple[DataFrame, CosineKMeans]:
    rows = S.embeddings(spark, sf_dir)
    return rows, CosineKMeans(K, tol=0.0, max_iter=max_iter).fit(rows, init=first_rows(rows, K))


def _labels(model: CosineKMeans, rows: DataFrame) -> DataFrame:
    out = model.predict(rows, return_dist=True)
    return out.select("row_id", "label", rounded(F.array_min("dist")).alias("dist"))


def cosine_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = S.embeddings(spark, sf_dir), CosineKMeans(K)
    model.centroids = unit(first_rows(rows, K))
    return _labels(model, rows)


def kmeans_lloyd_t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _fixed_kmeans(spark, sf_dir, PASSES)
    return _labels(model, rows)


def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded k-means++ and passes to convergence: the clusters' sizes and mean distances."""
    rows = S.part_month(spark, sf_dir).persist()
    model = CosineKMeans(K, random_state=SEED).fit(rows)
    return _labels(model, rows).groupBy("label").agg(F.count("*").alias("n"), rounded(F.avg("dist")).alias("mean_dist"))


def kmeans_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three equal first centroids: two clusters are empty and restart at the rows farthest from theirs."""
    rows = S.embeddings(spark, sf_dir)
    start = np.repeat(first_rows(rows, 1), 3, 0)
    return _labels(CosineKMeans(3, tol=0.0, max_iter=2).fit(rows, init=start), rows)


def elbow_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K = 1..8 from the first rows, PASSES passes each, and the elbow of the inertias."""
    rows = S.embeddings(spark, sf_dir)
    ks, inertias, _, at, _ = elbow_ckmeans(rows, 8, tol=0.0, max_iter=PASSES, init=first_rows(rows, 8))
    return elbow_table(spark, ks, inertias, at).select("k", rounded("score").alias("inertia"), "is_elbow")


def elbow_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each customer's orders, largest first, stop falling fast: the elbow of every customer's curve at once."""
    orders = S.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("score"))
    ranked = orders.withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("score"), "o_orderkey")))
    out = elbows(ranked, ["o_custkey"]).where("is_elbow")
    return out.select("o_custkey", "k", "score", rounded("curvature").alias("curvature"))


def silhouette_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silhouette_samples_cosine(S.embeddings(spark, sf_dir)).select("row_id", "label", rounded("silhouette").alias("silhouette"))


def silhouette_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: how well the given labels fit the embeddings."""
    out = silhouette_samples_cosine(S.embeddings(spark, sf_dir))
    return out.groupBy("label").agg(F.count("*").alias("n"), rounded(F.avg("silhouette")).alias("mean_silhouette"))


def silhouette_part_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue profiles of parts, scored by the parts' sizes."""
    sizes = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").alias("label"))
    out = silhouette_samples_cosine(S.part_month(spark, sf_dir).join(sizes, "row_id"))
    return out.groupBy("label").agg(F.count("*").alias("n"), rounded(F.avg("silhouette")).alias("mean_silhouette"))


def silhouette_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same profiles and sizes, with tasks that may hold no more than ten sizes' sums at a time."""
    sizes = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").alias("label"))
    out = silhouette_samples_cosine(S.part_month(spark, sf_dir).join(sizes, "row_id"), most=256)
    return out.select("row_id", "label", rounded("silhouette").alias("silhouette"))


def _delta() -> Column:
    return F.lit(-2.0) + rng.uniform(rng.digest(SEED, F.col("row_id"), "delta")) * F.lit(4.0)


def fractional_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(S.embeddings(spark, sf_dir).select("row_id", V.fractional_shift(F.col("x"), _delta()).alias("x")))


def tangent_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row turned by its own angle towards its own random direction."""
    config = SpectraAugmenterConfig(shift_prob=0.0, noise_prob=1.0, shuffle_order_per_batch=False)
    return long(SpectraAugmenter(config, SEED).transform(S.embeddings(spark, sf_dir)))


def shift_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows shifted and brought back to their sphere."""
    config = SpectraAugmenterConfig(shift_prob=0.5, noise_prob=0.0, shuffle_order_per_batch=False)
    return long(SpectraAugmenter(config, SEED).transform(S.embeddings(spark, sf_dir)))


def noise_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise that decides by batch. With eps 5, rows of 4 values have no tangent: all of batch 3, half of batch 5."""
    rows = S.embeddings(spark, sf_dir).withColumn("batch", F.col("row_id") % 8)
    short = (F.col("batch") == 3) | (F.col("row_id") % 16 == 5)
    rows = rows.withColumn("x", F.when(short, F.slice("x", 1, 4)).otherwise(F.col("x")))
    config = SpectraAugmenterConfig(shift_prob=0.0, noise_prob=0.5, shuffle_order_per_batch=False, renorm_to_input_norm=False, eps=5.0)
    return long(SpectraAugmenter(config, SEED).transform(rows, batch="batch"))


def augmented_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the full augmentation turns the rows, by label."""
    rows = S.embeddings(spark, sf_dir)
    out = SpectraAugmenter(seed=SEED).transform(rows.withColumn("batch", F.col("row_id") % 16), output="y", batch="batch")
    cosine = V.dot(V.l2_normalize(F.col("x")), V.l2_normalize(F.col("y")))
    return out.groupBy("label").agg(F.count("*").alias("n"), rounded(F.avg(cosine), 4).alias("mean_cosine"))


def patch_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.embeddings(spark, sf_dir).select("row_id", F.posexplode(patch_mask(F.col("row_id"), 64, 16, 4, SEED)).alias("pos", "masked"))
    return rows.select("row_id", (F.col("pos") / 4).cast("int").alias("patch"), "masked").distinct()


def visible_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many positions each row sees, and whether its mask, and the mask moved by one place, keep to patches."""
    rows = S.embeddings(spark, sf_dir).select("row_id", visible_mask(F.col("row_id"), 64, 16, 4, SEED).alias("visible"))
    moved = F.concat(F.slice("visible", 64, 1), F.slice("visible", 1, 63))
    return rows.select("row_id", F.size(F.filter("visible", lambda v: v)).alias("n_visible"), patch_aligned(F.col("visible"), 16).alias("aligned"), patch_aligned(moved, 16).alias("moved_aligned"))


def fixed_mask_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One visible mask for all rows, every second patch of four."""
    rows = fixed_visible(_recon(spark, sf_dir).drop("masked"), [p // 4 % 2 == 0 for p in range(64)])
    return masked_mse(rows, by=["label"]).select("label", rounded("loss").alias("loss"))


def _recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, their shifted selves in place of a reconstruction, and masks."""
    rows = S.embeddings(spark, sf_dir)
    return rows.withColumns({"x_recon": V.fractional_shift(F.col("x"), _delta()), "masked": patch_mask(F.col("row_id"), 64, 16, 4, SEED), "batch_id": F.floor(F.col("row_id") / 48)})


def masked_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three reductions, from one aggregation of the rows."""
    losses = masked_losses_by(_recon(spark, sf_dir), by=["label"])
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("reduction"), F.col(r).alias("loss")) for r in ("sum", "mean", "batch_mean")])).alias("r")
    return losses.select("label", each).select("label", "r.reduction", rounded("r.loss").alias("loss"))


def masked_mse_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_mse(_recon(spark, sf_dir), by=["label"]).select("label", rounded("loss").alias("loss"))


def evaluate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch-weighted loss that depends on batching."""
    return evaluate(_recon(spark, sf_dir), "sse", "sum").select(rounded("loss").alias("loss"), "n_rows")


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate's multiplier at each step of 50 events, with a tenth of the steps as warm-up."""
    steps = S.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 50).alias("step")).distinct()
    total = steps.agg((F.max("step") + 1).alias("total"))
    rows = steps.join(F.broadcast(total))  # a single row
    return rows.select("step", rounded(warmup_cosine(F.col("step"), F.floor(F.col("total") / 10), F.col("total")), 9).alias("lr_scale"))


def ema_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.part_month(spark, sf_dir).select("row_id", rounded(moving_average(F.col("x"), 0.9), 4).alias("ema"))


def ema_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average of each user's event values at the user's last event."""
    out = ordered_average(S.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 0.9)
    return out.select("user_id", "n", rounded("average").alias("average"))


def ema_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the whole table as one series."""
    out = ordered_average(S.table(spark, sf_dir, "events"), [], ["ts", "event_id"], "value", 0.999)
    return out.select("n", rounded("average").alias("average"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by their place in the table's files."""
    return npy.with_positions(spark, f"{sf_dir}/events.parquet").select("row_id", "event_id")


def npy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings written to matrix files in the order of their ids, and read again by ranges of rows."""
    folder = f"{_shared(spark)}/npy-{uuid.uuid4().hex}"
    npy.write_npy(S.embeddings(spark, sf_dir), folder, rows=200)
    return long(npy.read_npy(spark, folder, rows=64))


def sql_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved model called from SQL."""
    rows, model = S.embeddings(spark, sf_dir), CosineKMeans(K)
    model.centroids = unit(first_rows(rows, K))
    folder = f"{_shared(spark)}/model-{uuid.uuid4().hex}"
    model.save_centroids(spark, folder)
    models.register_model(spark, "nearest_of_five", folder)
    return spark.sql("SELECT row_id, nearest_of_five(x) AS label FROM {rows}", rows=rows)


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, VMFMixture]:
    rows = S.embeddings(spark, sf_dir)
    return rows, VMFMixture(MIX, tol=0.0, max_iter=STEPS).fit(rows, mus=first_rows(rows, MIX))


def vmf_em_t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration, weight and log normaliser of each component after STEPS steps, and the log likelihood before the last."""
    _, model = _mixture(spark, sf_dir)
    s = model.state_dict()
    out = [(k, float(s["kappas"][k]), float(np.exp(s["logpi"][k])), float(s["logC"][k]), model.lower_bound_) for k in range(MIX)]
    df = spark.createDataFrame(out, "k int, kappa double, pi double, log_c double, loglik double")
    return df.select("k", *[rounded(c, 4).alias(c) for c in ("kappa", "pi", "log_c", "loglik")])


def vmf_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _mixture(spark, sf_dir)
    out = model.predict_proba(rows)
    return out.select("row_id", "label", rounded(F.array_max("gamma"), 5).alias("gamma"), rounded("loglik", 4).alias("loglik"))


def sql_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved mixture called from SQL: labels and log likelihoods."""
    rows, model = _mixture(spark, sf_dir)
    folder = f"{_shared(spark)}/model-{uuid.uuid4().hex}"
    model.save(spark, folder)
    models.register_model(spark, "component_of_four", folder)
    return spark.sql("SELECT row_id, component_of_four(x) AS label, round(component_of_four_loglik(x), 4) + 0.0D AS loglik FROM {rows}", rows=rows)


def vmf_subset_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts at which a mixture of six starts when it is seeded on the 300 parts with the least digests."""
    rows = S.part_month(spark, sf_dir).persist()
    ids, _ = VMFMixture(6, random_state=SEED, start_rows=300).drawn(rows, rows.count())
    rows.unpersist()
    return spark.createDataFrame(list(enumerate(ids)), "k int, row_id long")


def vmf_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BIC of mixtures of 1 to 4 components after STEPS steps from the first rows, and the least one."""
    rows = S.embeddings(spark, sf_dir)
    ks, scores, _, at, _, best = elbow_vmf(rows, 4, tol=0.0, max_iter=STEPS, mus=first_rows(rows, 4))
    return elbow_table(spark, ks, scores, at).select("k", rounded("score", 3).alias("bic"), "is_elbow", (F.col("k") == best).alias("is_best"))


def vmf_elbow_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the mean negative log likelihood."""
    rows = S.embeddings(spark, sf_dir)
    ks, scores, _, at, _, best = elbow_vmf(rows, 4, criterion="nll", tol=0.0, max_iter=STEPS, mus=first_rows(rows, 4))
    return elbow_table(spark, ks, scores, at).select("k", rounded("score", 5).alias("nll"), "is_elbow", (F.col("k") == best).alias("is_best"))


def fps_k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_fps_downsample(S.embeddings(spark, sf_dir), k=12, init=0).select("rank", "row_id")


def fps_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_fps(S.embeddings(spark, sf_dir), "label", ratio=0.1).select(F.col("group").cast("int").alias("label"), "rank", "row_id")


#: A small network, so that the query's cost is in the rows.
NETWORK = AutoencoderConfig(seq_len=64, n_patches=16, d_model=32, nhead=4, num_layers=2, latent_dim=8)


def extract_latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MaskedAutoencoder(NETWORK, seed=SEED).encode(S.embeddings(spark, sf_dir))


def reconstruction_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked error of the network's reconstructions from the visible patches, by label."""
    rows = S.embeddings(spark, sf_dir).withColumn("masked", patch_mask(F.col("row_id"), 64, 16, 4, SEED)).withColumn("visible", F.transform("masked", lambda m: ~m))
    recon = MaskedAutoencoder(NETWORK, seed=SEED).reconstruct(rows, visible="visible")
    return masked_mse(rows.join(recon, "row_id"), by=["label"])


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a stream of files: SNV, then the nearest of the first rows."""
    rows, model = S.embeddings(spark, sf_dir), CosineKMeans(K)
    model.centroids = unit(first_rows(rows, K))
    folder = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    rows.select("row_id", "x").write.parquet(f"{folder}/in")
    stream = score.read_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in"))
    score.write_stream(score.score_stream(stream, model), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("row_id long, label int").parquet(f"{folder}/out")


def _shared(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local session without it."""
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-stream-")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    snv, snv_stats, snv_inverse, snv_short, snv_part_month, spectra_part_month, spectra_supplier_month, spectra_user_hour, l2_normalize, cosine_to_first_rows,
    cosine_assign, kmeans_lloyd_t4, kmeans_fit, kmeans_repair, elbow_kmeans, elbow_by_group, silhouette_samples, silhouette_by_label, silhouette_part_size, silhouette_in_blocks, fractional_shift, tangent_noise,
    shift_augmented, noise_by_batch, augmented_angles, patch_masks, visible_patches, fixed_mask_mse, masked_losses, masked_mse_by_label, evaluate_batches, lr_schedule, ema_fold, ema_by_user, ema_events, positions, npy_round_trip, sql_assign, vmf_em_t3, vmf_posterior,
    vmf_subset_start, sql_mixture, vmf_elbow, vmf_elbow_nll, fps_k12, fps_by_label, extract_latents, reconstruction_loss, stream_scores,
)}
