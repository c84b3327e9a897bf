"""Registered queries over the operators, each over its whole tables."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipsift.functions import encode, text
from clipsift.operators import atlas, building, calibration, cascade, catalog, commits, exporting, feedback, islands, layout, ledger, order, pca, projects, screening, selection, vectors, windows
from clipsift.operators import intervals as iv
from clipsift.session import checkpointed, remove_folder, shared_folder
from clipsift.sinks.files import write_matrices
from clipsift.sources.clips import clips, coverage, key_values
from clipsift.sources import remote
from clipsift.sources.files import chunk_end, chunk_start, null_rate, read_matrices
from clipsift.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
POLYGON = [(-0.5, -0.5), (0.6, -0.4), (0.5, 0.6), (-0.4, 0.5)]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def vector(c: DataFrame, row: int) -> list[float]:
    return [float(x) for x in c.where(F.col("row") == row).select("vec").first()[0]]


def screen_of(c: DataFrame, rows: tuple[int, ...] = (0,)) -> selection.Screen:
    return selection.Screen([vector(c, r) for r in rows], vectors.scales(c))


def out(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def exact(c: DataFrame, row: int = 0) -> DataFrame:
    return c.withColumn("score", F.round(vectors.dot(F.col("vec"), vectors.literal(vector(c, row))), 9))


@query
def screen_topk(s, d):
    c = clips(s, d)
    return out(exporting.ranked(selection.select(c, screen_of(c), k=25, refine=False)), "rank", "row", "run_uuid", "score")


@query
def screen_threshold(s, d):
    c = clips(s, d)
    return out(selection.select(c, screen_of(c), tau=0.15, refine=False), "row", "score", "class")


@query
def classify_counts(s, d):
    c = clips(s, d)
    sc = screen_of(c)
    return sc.apply(c).groupBy(selection.classify(F.col("score"), 0.15, sc.eps).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query
def eps_bounds(s, d):
    c = clips(s, d)
    scale = vectors.scales(c)
    return s.createDataFrame([(round(vectors.bound_cauchy(scale), 9), round(vectors.bound_hoelder(vector(c, 0), scale), 9))], "cauchy double, hoelder double")


@query
def cascade_topk_refined(s, d):
    c = clips(s, d)
    return out(selection.select(c, screen_of(c), k=50), "row", "exact")


@query
def cascade_tau_refined(s, d):
    c = clips(s, d)
    return out(selection.select(c, screen_of(c), tau=0.15), "row", "score", "class")


@query
def maxsim_topk(s, d):
    c = clips(s, d)
    sc = screen_of(c, (0, 3, 7))
    return out(selection.ordered(sc.apply(c)).limit(20), "row", "score")


@query
def exact_cosine_topk(s, d):
    return out(selection.ordered(exact(clips(s, d))).limit(20), "row", "score")


@query
def arrow_exact_scores(s, d):
    c = clips(s, d)
    return out(vectors.arrow_scores(c, [vector(c, 0)]), "row", "score")


@query
def filter_vehicle_date(s, d):
    return selection.filtered(clips(s, d), vehicles=["v0", "v2"], since=1704067200 + 86400, until=1704067200 + 5 * 86400).select("row", "vehicle", "chunk_start_unix")


@query
def filter_run_segment(s, d):
    c = clips(s, d)
    return selection.filtered(c, runs=["run-1", "run-2", "run-3"], segments=key_values(c.where("row % 5 = 0")).withColumnRenamed("key", "segment_id")).select("row", "run_uuid", "segment_id")


@query
def filter_exclude(s, d):
    return selection.filtered(clips(s, d), exclude=[0, 1, 2, 3, 10_000_000]).select("row")


@query
def window_rows_overlap(s, d):
    return selection.window_rows(clips(s, d), run="run-2", start=1704067200 + 2 * 86400 + 30, end=1704067200 + 2 * 86400 + 90).select("row", "chunk_start_unix", "chunk_end_unix")


@query
def window_meanpool_topk(s, d):
    c = clips(s, d)
    w = selection.window_rows(c, run="run-2", start=1704067200 + 2 * 86400 + 30, end=1704067200 + 2 * 86400 + 90)
    q = selection.window_directions(w)[0]
    return out(selection.ordered(c.withColumn("score", F.round(vectors.dot(F.col("vec"), vectors.literal(q)), 9))).limit(15), "row", "score")


@query
def resolve_chunk_ids(s, d):
    c = clips(s, d)
    wanted = c.where("row % 7 = 0").select(exporting.chunk_id().alias("chunk_id")).union(s.createDataFrame([("no-run#t5",), ("bad",), ("run-1#tx",)], "chunk_id string"))
    return selection.resolve_chunks(c, wanted)


@query
def first_per_segment(s, d):
    return out(exporting.first_per_segment(exact(clips(s, d))), "row", "segment_id", "score")


@query
def dedupe_export_rerank(s, d):
    return out(exporting.ranked(exporting.first_per_segment(exact(clips(s, d)), empty_is_none=True)), "rank", "row", "segment_id", "score")


@query
def export_projection(s, d):
    return exporting.export_columns(exporting.ranked(exact(clips(s, d))), "tag_a", "clips/")


@query
def confidence_margin(s, d):
    c = exact(clips(s, d)).where("score >= 0.05")
    return out(exporting.confidence(c, 0.05), "row", "score", "confidence")


@query
def passthrough_join(s, d):
    c = exact(clips(s, d))
    source = c.where("segment_id is not null").groupBy("segment_id").agg(F.count(F.lit(1)).alias("clips_in_segment"))
    return out(exporting.passthrough(c.select("row", "segment_id", "score"), source), "row", "segment_id", "score", "clips_in_segment")


@query
def since_version(s, d):
    return clips(s, d).where(F.col("created_at_unix_s") >= 1704067200 + 4 * 86400).select("row", "created_at_unix_s")


@query
def result_page(s, d):
    return out(exporting.page_of(exact(clips(s, d)), 3, 20), "rank", "row", "score")


@query
def drive_cells(s, d):
    return out(iv.cells(exact(clips(s, d))), "run_uuid", "m", "cell", "peak_row", "centre")


@query
def intervals(s, d):
    return out(iv.intervals(exact(clips(s, d)), 0.05), "run_uuid", "start_s", "end_s", "peak", "mean", "num_cells", "peak_row", digits=4)


@query
def interval_tau_pooled_k(s, d):
    return out(iv.pooled_threshold(exact(clips(s, d)), 30), "tau")


@query
def score_stats(s, d):
    return calibration.score_stats(exact(clips(s, d)))


@query
def heuristic_tau(s, d):
    return calibration.heuristic_tau(calibration.score_stats(exact(clips(s, d))))


@query
def score_histogram(s, d):
    return calibration.histogram(exact(clips(s, d)))


def labelled(s: SparkSession, d: str) -> DataFrame:
    docs, labels = read(s, d, "documents"), read(s, d, "labels")
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))


@query
def pr_sweep(s, d):
    return out(calibration.sweep(labelled(s, d)), "tau", "tp", "fp", "precision", "recall", "fpr")


@query
def average_precision(s, d):
    return calibration.average_precision(calibration.sweep(labelled(s, d)))


@query
def pick_tau_f1(s, d):
    return calibration.pick_tau(calibration.sweep(labelled(s, d)))


@query
def pick_tau_youden(s, d):
    return calibration.pick_tau(calibration.sweep(labelled(s, d)), "youden")


@query
def pick_tau_precision(s, d):
    return calibration.pick_tau(calibration.sweep(labelled(s, d)), "precision", floor=0.9)


@query
def rocchio_topk(s, d):
    c = clips(s, d)
    q = vectors.rocchio([vector(c, r) for r in (0, 5, 9)], [vector(c, r) for r in (2, 4)], vector(c, 1))
    return out(selection.ordered(c.withColumn("score", F.round(vectors.dot(F.col("vec"), vectors.literal(q)), 9))).limit(15), "row", "score")


@query
def boundary_sample(s, d):
    return out(calibration.boundary_sample(exact(clips(s, d)), 0.1, 0.02, 12, [0, 1, 2]), "row", "score")


@query
def latest_tag_versions(s, d):
    return catalog.latest(catalog.tag_versions(read(s, d, "events")), ["tag"], ["version"]).select("tag", "version", F.round("threshold", 6).alias("threshold"), "project")


@query
def list_tags_page(s, d):
    return catalog.list_tags(catalog.tag_versions(read(s, d, "events")), text="u1", number=2, size=10).select("tag", "version", "project")


@query
def marks_latest(s, d):
    return catalog.marks(read(s, d, "events"))


@query
def export_reclaim(s, d):
    e = read(s, d, "events").where("event_type = 'purchase'")
    status = F.element_at(F.array(F.lit("pending"), F.lit("running"), F.lit("ready"), F.lit("error")), (F.col("event_id") % 4 + 1).cast("int"))
    newest = e.agg(F.max("ts")).first()[0]
    return catalog.reclaimable(e.select("event_id", status.alias("status"), F.col("ts").alias("started_at")), F.lit(newest)).select("event_id", "status")


@query
def feedback_totals(s, d):
    return read(s, d, "events").agg(F.count_if(F.col("event_type") == "click").alias("up"), F.count_if(F.col("event_type") == "error").alias("down"), F.countDistinct("user_id").alias("users"))


@query
def top_queries(s, d):
    return catalog.usage(read(s, d, "events")).limit(40).select("query", "n")


@query
def visits_per_user(s, d):
    return read(s, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("visits"), F.max("event_id").alias("last_event"))


@query
def cap_per_run(s, d):
    return atlas.cap_per_run(clips(s, d), 20).select("row", "run_uuid")


@query
def uniform_sample(s, d):
    return atlas.uniform_sample(clips(s, d), 100).select("row")


@query
def seeded_sample(s, d):
    return atlas.seeded_sample(clips(s, d), 100, seed=7, cap=12).select("row")


@query
def knn_cosine(s, d):
    c = clips(s, d)
    return atlas.neighbours(c, vector(c, 11), 11, 24)


@query
def minmax_box(s, d):
    return out(atlas.scaled_points(clips(s, d)), "row", "x", "y")


@query
def lasso_polygon(s, d):
    return out(atlas.lasso(atlas.scaled_points(clips(s, d)), POLYGON), "row", "d2")


@query
def density_buckets(s, d):
    return atlas.density(atlas.scaled_points(clips(s, d)), bins=16)


@query
def category_coloring(s, d):
    return atlas.colouring(clips(s, d), "segment_id", top=5)


@query
def coverage_report(s, d):
    return coverage(clips(s, d), "segment_id")


@query
def bitmap_members(s, d):
    """Rows of clips with a segment as bitmaps, and of every clip whether its bit is set."""
    c = clips(s, d)
    bucket, bit = F.bitmap_bucket_number("row"), F.bitmap_bit_position("row")
    maps = c.where("segment_id is not null and segment_id != ''").groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)), F.lit(2)) == 1
    return c.select("row", bucket.alias("bucket"), bit.alias("bit")).join(maps, "bucket", "left").select("row", F.coalesce(held, F.lit(False)).alias("member"))


@query
def vehicle_from_segment(s, d):
    e = read(s, d, "events")
    seg = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("2026-01-0"), (F.col("event_id") % 9 + 1).cast("string"), F.lit("_x_truck"), F.col("user_id").cast("string"), F.lit("-123456789012345"))).otherwise(F.concat(F.lit("truck"), F.col("user_id").cast("string"), F.lit("_y")))
    return e.select("event_id", text.vehicle_of(seg).alias("vehicle"))


@query
def slugify(s, d):
    return read(s, d, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query
def utc_format(s, d):
    return clips(s, d).select("row", text.utc(F.col("chunk_start_unix")).alias("utc"))


@query
def window_individual_topk(s, d):
    c = clips(s, d)
    w = selection.window_rows(c, run="run-2", start=1704067200 + 2 * 86400 + 30, end=1704067200 + 2 * 86400 + 90)
    q = selection.window_directions(w, pooling="individual")
    return out(selection.ordered(c.withColumn("score", F.round(vectors.maxsim(F.col("vec"), q), 9))).limit(15), "row", "score")


@query
def unresolved_chunk_ids(s, d):
    c = clips(s, d)
    wanted = c.where("row % 7 = 0").select(exporting.chunk_id().alias("chunk_id")).union(s.createDataFrame([("no-run#t5",), ("bad",), ("run-1#tx",)], "chunk_id string"))
    return selection.unresolved_chunks(c, wanted)


@query
def include_below_threshold(s, d):
    return out(exporting.export(exact(clips(s, d)), 0.1, include_below=True), "rank", "row", "score", "above", "confidence")


@query
def export_build(s, d):
    return out(exporting.export(exact(clips(s, d)), 0.02, since=1704067200 + 3 * 86400, dedupe=True), "rank", "row", "segment_id", "score", "confidence")


@query
def interval_rows(s, d):
    c = clips(s, d)
    return exporting.interval_rows(iv.intervals(exact(c), 0.05), c).drop("rank")


@query
def score_page(s, d):
    return exporting.page_of_score(exporting.ranked(exact(clips(s, d))), 0.05, 20)


@query
def hist_fraction_above(s, d):
    c = exact(clips(s, d))
    ends = c.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    return calibration.fraction_above(calibration.histogram(c), ends["lo"], ends["hi"], 0.1)


@query
def threshold_of_k(s, d):
    return calibration.threshold_for(exact(clips(s, d)), k=40)


@query
def separation_note(s, d):
    c = clips(s, d)
    return out(calibration.separation(exact(c), vectors.bound_cauchy(vectors.scales(c))), "top", "low", "spread", "times_eps")


@query
def sweep_counts(s, d):
    return calibration.metrics_at(labelled(s, d), 2000.0)


@query
def fit_held_out(s, d):
    docs, labels = read(s, d, "documents"), read(s, d, "labels")
    rows = labels.join(docs.select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))
    return calibration.fit_threshold(rows, held_out=F.col("doc_id") % 5 == 0)


@query
def rocchio_vector(s, d):
    c = clips(s, d)
    q = vectors.rocchio([vector(c, r) for r in (0, 5, 9)], [vector(c, r) for r in (2, 4)], vector(c, 1))
    return s.createDataFrame([(i, round(x, 6)) for i, x in enumerate(q)], "d int, x double")


@query
def stale_thresholds(s, d):
    return out(ledger.thresholds_by_project(catalog.tag_versions(read(s, d, "events"))), "tag", "project", "threshold", "version", "stale")


@query
def segment_set_usage(s, d):
    e = read(s, d, "events").where("event_type = 'view'")
    uses = e.select(F.get_json_object("props", "$.k").alias("uuid"), F.concat(F.lit("set "), F.col("user_id").cast("string")).alias("name"), "ts", F.col("event_id").alias("n_rows"))
    return ledger.set_usage(uses)


@query
def dedupe_tags(s, d):
    e = read(s, d, "events")
    return ledger.one_per_tag(e.select(F.concat_ws("_", "event_type", (F.col("user_id") % 10).cast("string")).alias("tag"), (F.col("event_id") % 3 == 0).alias("has_vector"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))).select("tag", "id")


def export_log(s: SparkSession, d: str) -> DataFrame:
    """Export log over `events`: two segments each, as JSON."""
    k = F.get_json_object("props", "$.k").cast("int")
    seg = lambda x: F.concat(F.lit("s"), x.cast("string"))
    return read(s, d, "events").select(
        F.col("event_id").alias("id"), text.query_key(F.concat(F.lit("  Q "), F.col("event_type"), F.lit("  "))).alias("query"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("user_email"),
        F.to_json(F.array(seg(k), seg(k + 1))).alias("segment_ids"),
    )


@query
def export_marks(s, d):
    """Marks that exports imply and the ledger, which knows those of older ones, lacks."""
    log = export_log(s, d).withColumn("segments", F.from_json("segment_ids", "array<string>"))
    newest = log.agg(F.max("id")).first()[0]
    known = log.where(F.col("id") <= newest // 5).select("query", "user_email", F.explode("segments").alias("segment_id"))
    return catalog.feedback_backfill(log, known).select("id", "query", "user_email", "segment_id")


@query
def newest_exports(s, d):
    return export_log(s, d).select("id", "query", F.json_array_length("segment_ids").alias("n_segments")).orderBy(F.col("id").desc()).limit(50)


@query
def segment_set(s, d):
    return ledger.register_set(exact(clips(s, d)).where("score >= 0.05"))


@query
def list_segment_sets(s, d):
    e = read(s, d, "events")
    sets = e.select(F.concat_ws(" ", F.lit("Set"), "event_type", F.col("user_id").cast("string")).alias("name"), F.when(F.col("event_id") % 7 != 0, F.col("event_id").cast("string")).alias("uuid"), (F.col("event_id") % 4).alias("version"))
    return ledger.find_sets(sets, "click 11").select("name", "version", "uuid")


@query
def internal_id_lookup(s, d):
    c = clips(s, d)
    return ledger.internal_ids(c, c.where("row % 3 = 0").select("row", (F.col("row") * 7 + 1000).alias("internal_id"))).select("row", "internal_id")


@query
def zipped_internal_ids(s, d):
    c = ledger.register_set(clips(s, d))
    n = c.count()
    return ledger.zipped_ids(c, s.range(n).select((F.col("id") * 3 + 7).alias("internal_id")))


@query
def null_fraction(s, d):
    return s.createDataFrame([(round(null_rate(clips(s, d), "segment_id", rows=None), 6),)], "fraction double")


@query
def corpus_health(s, d):
    return selection.span(clips(s, d))


@query
def take_rows(s, d):
    return selection.take(clips(s, d), [30, 2, 11, 2, 10_000_000], "run_uuid")


@query
def rescored_rows(s, d):
    c = clips(s, d)
    names = c.where("row % 10 = 3").select("row", exporting.chunk_id().alias("chunk_id"))
    return out(selection.rescore(c, names, F.round(vectors.dot(F.col("vec"), vectors.literal(vector(c, 0))), 9), exporting.chunk_id()), "row", "chunk_id", "score")


@query
def chunk_id_parse(s, d):
    name = F.when(F.col("row") % 9 == 0, F.lit("broken#t")).otherwise(exporting.chunk_id())
    return clips(s, d).select("row", text.chunk_run(name).alias("run"), text.chunk_start(name).alias("start_s"))


@query
def address_parts(s, d):
    a = F.concat(F.when(F.col("page_id") % 3 == 0, "s3a://bucket-").otherwise("s3://bucket-"), (F.col("page_id") % 4).cast("string"), F.lit("/a/b c/"), F.col("page_id").cast("string"), F.lit(" x.parquet"))
    return read(s, d, "pages").select("page_id", text.bucket_of(a).alias("bucket"), text.path_of(a).alias("path"), text.uri_key(a).alias("cache_key"))


@query
def score_classes(s, d):
    c = exact(clips(s, d))
    return c.groupBy(text.score_class(F.col("score")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query
def pca_explained_variance(s, d):
    """No SQL: eigenvectors. Tested against numpy."""
    b = pca.fit(clips(s, d), 16)
    return s.createDataFrame([(i, round(float(x), 6), b.effective_rank()) for i, x in enumerate(b.ratio)], "axis int, ratio double, effective_rank int")


@query
def pca_projection(s, d):
    """No SQL: eigenvectors. The first eight places of each clip along the axes, tested against numpy."""
    c = clips(s, d)
    p = pca.project(c, pca.fit(c, 8))
    return p.select("row", F.transform("projected", lambda x: F.round(x, 5)).alias("projected"))


@query
def pca_sketched_variance(s, d):
    """No SQL: eigenvectors. Unit vectors, as the map takes them; tested against numpy."""
    b = pca.fit_sketched(clips(s, d), 16, unit=True)
    return s.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(b.ratio)], "axis int, ratio double")


@query
def real_projection(s, d):
    c = clips(s, d)
    scale = vectors.scales(c)
    sample = atlas.uniform_sample(c, 64).withColumn("i8", vectors.quantise(F.col("vec"), scale))
    return s.createDataFrame([(pca.real_projection(sample, scale),)], "usable boolean")


@query
def stream_upsert_clips(s, d):
    """Clips written as a folder of events, some twice, and upserted by a stream; its final state."""
    base, kind = f"{shared_folder(s, 'streams')}/stream-{uuid.uuid4().hex}", "chunk_id string, row long, event_time timestamp"
    c = clips(s, d).select(exporting.chunk_id().alias("chunk_id"), "row", F.timestamp_seconds("chunk_start_unix").alias("event_time"))
    c.unionByName(c.where("row % 4 = 0").withColumn("event_time", F.col("event_time") + F.expr("interval 10 minutes")).withColumn("row", F.col("row") + 1_000_000)).write.parquet(f"{base}/in")
    ingest.upsert(ingest.read_clips(s, f"{base}/in", kind), f"{base}/log", f"{base}/state").awaitTermination()
    found = checkpointed(ingest.current(s, f"{base}/log", kind).select("chunk_id", "row"))
    remove_folder(s, base)
    return found


@query
def stream_hit_runs(s, d):
    """Scored clips in files that mix all times, read two files at a time, as sessions of hits: late clips join and merge sessions
    that are open. The watermark waits 400 days; two later events close what is left."""
    base, kind = f"{shared_folder(s, 'streams')}/runs-{uuid.uuid4().hex}", "run_uuid string, event_time timestamp, score double"
    c = exact(clips(s, d)).select("run_uuid", F.timestamp_seconds("chunk_start_unix").alias("event_time"), "score", F.pmod(F.xxhash64("row"), F.lit(6)).alias("file"))
    c.repartition(6, "file").drop("file").write.parquet(f"{base}/in")
    read_all = lambda: s.readStream.schema(kind).option("maxFilesPerTrigger", 2).parquet(f"{base}/in").withWatermark("event_time", "400 days")
    for days in (0, 1000, 2000):
        if days:
            s.createDataFrame([("later", 1.0)], "run_uuid string, score double").select("run_uuid", (F.timestamp_seconds(F.lit(1704067200)) + F.make_dt_interval(F.lit(days))).alias("event_time"), "score").write.mode("append").parquet(f"{base}/in")
        ingest.write_runs(ingest.hit_runs(read_all(), 0.05), f"{base}/out", f"{base}/state").awaitTermination()
    found = checkpointed(s.read.parquet(f"{base}/out").where("run_uuid != 'later'").select("run_uuid", F.unix_timestamp("start").alias("start"), F.unix_timestamp("last").alias("last"), "n", F.round("peak", 6).alias("peak")))
    remove_folder(s, base)
    return found


@query
def claimed_exports(s, d):
    """Purchases as claims of export jobs in a log with commits: of each hour's claims on one export the first wins."""
    e = read(s, d, "events").where("event_type = 'purchase'").select(F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("export_id"), F.floor(F.unix_timestamp("ts") / 3600).alias("hour"), "event_id")
    base = f"{shared_folder(s, 'a log')}/claims-{uuid.uuid4().hex}"
    log = commits.Commits(s, base, "export_id string, hour long, event_id long")
    first = lambda rows: catalog.latest(rows, ["export_id", "hour"], [F.col("event_id").asc()])
    for part in range(3):
        mine = first(e.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).select("export_id", F.col("hour").cast("long").alias("hour"), "event_id"))
        log.change(lambda rows, _, mine=mine: mine)
    log.compact(lambda rows: first(rows).coalesce(1))
    found = checkpointed(log.rows())
    remove_folder(s, base)
    return found


@query
def refine_feedback(s, d):
    c = clips(s, d)
    marks = c.where("row % 20 = 0").select("row", F.when(F.col("row") % 40 == 0, 1).otherwise(0).alias("label")).union(s.createDataFrame([(10_000_000, 1)], "row long, label int"))
    return feedback.refine(c, marks, vector(c, 1))[1]


@query
def calibrate_filtered(s, d):
    c = exact(clips(s, d))
    return feedback.calibrate(c, selection.filtered(c, vehicles=["v0", "v2"]), tau=0.05)


@query
def tag_record(s, d):
    return ledger.tag_record(catalog.tag_versions(read(s, d, "events")))


@query
def export_backfill(s, d):
    e = read(s, d, "events")
    log = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 6 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("tag"), (F.col("event_id") % 4 != 0).alias("has_vector"), ((F.col("event_id") % 10 - 2) / 10).alias("threshold"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x/"), F.col("event_id").cast("string"))).otherwise("").alias("uri"))
    return out(ledger.backfill(log, log.where("id % 500 = 0")), "tag", "threshold", "uri", "status")


def stored_screen(s: SparkSession, d: str) -> tuple[DataFrame, selection.Screen]:
    """The int8 corpus and a screen of it."""
    c = clips(s, d)
    sc = screen_of(c)
    return screening.store(c, sc.scale), sc


@query
def stored_screen_topk(s, d):
    stored, sc = stored_screen(s, d)
    return out(selection.ordered(screening.screened(stored, sc)).limit(25), "row", "run_uuid", "score")


@query
def candidate_counts(s, d):
    c = selection.filtered(clips(s, d), vehicles=["v0", "v2"])
    sc = screen_of(clips(s, d))
    scored = sc.apply(c)
    return s.createDataFrame([("k", screening.candidates(scored, sc)), ("tau", screening.candidates(scored, sc, tau=0.1))], "mode string, n long")


@query
def cut_selection(s, d):
    c = clips(s, d)
    got = screening.selection(c, screen_of(c), tau=0.05, max_rows=30, refine="never")
    return out(got.rows.withColumn("truncated", F.lit(got.truncated)), "row", "score", "truncated")


@query
def refine_falls_back(s, d):
    c = clips(s, d)
    return out(screening.selection(c, screen_of(c), k=20, refine="auto", usable=False).rows, "row", "score")


@query
def alignment_check(s, d):
    named = clips(s, d).select("row", exporting.chunk_id().alias("chunk_id"))
    return screening.spot_check(named, named.withColumn("chunk_id", F.when(F.col("row") == 0, F.lit("moved")).otherwise(F.col("chunk_id"))))


def described_tags(s: SparkSession, d: str) -> DataFrame:
    v = catalog.tag_versions(read(s, d, "events"))
    return v.withColumn("created_by", F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string"))).withColumn("description", F.concat(F.lit("About "), F.col("project")))


@query
def tags_by_creator(s, d):
    return catalog.list_tags(described_tags(s, d), text="CLICK", creator="c3", number=1, size=50).select("tag", "version", "created_by", "description")


@query
def tag_exports(s, d):
    e = read(s, d, "events")
    exports = e.where("event_type = 'purchase'").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tag"), F.col("event_id").alias("export_id"), F.col("event_id").alias("finished_at"))
    r = catalog.record(catalog.tag_versions(e), exports)
    return r.select("tag", F.array_join(F.col("versions").cast("array<string>"), ",").alias("versions"), F.array_join(F.col("exports").cast("array<string>"), ",").alias("exports"))


@query
def version_marks(s, d):
    e = read(s, d, "events")
    given = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tag"), (F.col("event_id") % 3).alias("version"), F.get_json_object("props", "$.k").alias("chunk"), F.when(F.col("event_type") == "error", "down").otherwise("up").alias("mark"), "ts", "event_id")
    marks, n = catalog.version_marks(given, order=["ts", "event_id"])
    return marks.withColumn("processed", F.lit(n).cast("long"))


@query
def refresh_decisions(s, d):
    k = F.col("event_id")
    status = F.when(k % 5 == 0, "loading").otherwise("ready")
    held, latest = F.when(k % 4 != 0, k % 7), F.when(k % 6 != 0, k % 3)
    return read(s, d, "events").select("event_id", projects.refresh_decision(status, held, latest, k % 11 != 0).alias("decision"))


@query
def project_lists(s, d):
    names = F.concat_ws(" , ", "event_type", F.lit("Click"), F.lit(""), F.lit("other"), F.lit("CLICK"))
    return read(s, d, "events").select("event_id", F.array_join(projects.enabled(F.when(F.col("event_type") != "error", names), ("click", "view", "purchase"), "view"), ",").alias("projects"))


@query
def since_corpus_version(s, d):
    c = clips(s, d)
    versions = s.createDataFrame([(1, 1704067200.0), (2, 1704067200.0 + 3 * 86400), (3, 1704067200.0 + 6 * 86400)], "version int, committed_at double")
    return remote.since_version(c, versions, 2).select("row", "created_at_unix_s")


@query
def segment_set_rows(s, d):
    c = clips(s, d)
    ids = c.where("vehicle = 'v1' and segment_id != ''").select("segment_id")
    return remote.set_filter(c, ids).select("row", "segment_id")


@query
def vector_text(s, d):
    return clips(s, d).select("row", encode.vector_json(F.col("vec"), 3).alias("json"))


@query
def comma_segments(s, d):
    given = F.concat_ws(",", F.col("event_type"), F.concat(F.lit(" s "), F.col("user_id").cast("string")), F.lit(" "), F.lit("x y"))
    return read(s, d, "events").select("event_id", F.explode(encode.comma_items(given)).alias("segment"))


@query
def comma_members(s, d):
    joined = F.concat(F.lit(","), "event_type", F.lit(",u"), F.col("user_id").cast("string"), F.lit(","))
    return read(s, d, "events").where(encode.in_commas(joined, F.lit("u1")) | encode.in_commas(joined, F.lit("view"))).select("event_id")


@query
def checkpoint_names(s, d):
    uri = F.concat(F.lit("s3://models/run-"), (F.col("event_id") % 9).cast("string"), F.lit("/step_"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "/").otherwise(""))
    return read(s, d, "events").select("event_id", encode.checkpoint_name(uri).alias("checkpoint"))


@query
def dictionary_decode(s, d):
    """Codes of the segments, joined back to their values."""
    c = clips(s, d)
    values = encode.dictionary(c, "segment_id")
    coded = c.join(values, c["segment_id"] == values["value"], "left").select("row", "code")
    return coded.join(values, "code", "left").select("row", "code", "value")


@query
def first_occurrences(s, d):
    return encode.first_occurrences(read(s, d, "events").where("event_type is not null"), "user_id", "event_id")


@query
def point_detail(s, d):
    return out(atlas.point_detail(atlas.scaled_points(clips(s, d)), 11, "clips/"), "row", "chunk_id", "run_uuid", "dt", "chunk_start_unix", "source_media_uri", "x", "y")


@query
def interval_export(s, d):
    c = clips(s, d)
    return exporting.interval_export(iv.intervals(exact(c), 0.05), c, "tag_a", "clips/").drop("rank")


@query
def histogram_summary(s, d):
    return calibration.histogram_summary(exact(clips(s, d)), 0.1)


@query
def unique_users(s, d):
    e = read(s, d, "events").where("event_type = 'view'")
    return e.agg(F.count(F.lit(1)).alias("visits"), F.countDistinct("user_id").alias("users"))


@query
def curve_points(s, d):
    return out(calibration.curve_points(calibration.sweep(labelled(s, d)), 50), "tau", "precision", "recall")


@query
def topped_up_sample(s, d):
    return out(calibration.topped_up_sample(exact(clips(s, d)), 0.1, 0.00001, 12, [0, 1, 2]), "row", "score")


@query
def packed_points(s, d):
    """Sizes of the packed form; that it unpacks to the same points is tested."""
    p = encode.packed_points(atlas.scaled_points(clips(s, d)).withColumn("code", F.lit(3)), "code")
    return p.agg(F.sum("n").alias("n"), F.sum(F.octet_length("xy")).alias("xy_bytes"), F.sum(F.octet_length("code")).alias("code_bytes"))


@query
def reduced_points(s, d):
    """No SQL: eigenvectors. Tested against numpy."""
    return atlas.reduced(clips(s, d)).select("row", F.transform("position", lambda x: F.round(x, 5)).alias("position"))


def written_corpus(s: SparkSession, d: str, select: Callable[[cascade.Written, selection.Screen], DataFrame]) -> DataFrame:
    """What `select` gives of the corpus written as codes and vectors; both are removed when it is done."""
    folder = f"{shared_folder(s, 'a written corpus')}/corpus-{uuid.uuid4().hex}"
    c = clips(s, d)
    sc = screen_of(c)
    found = checkpointed(select(cascade.write(c, sc.scale, folder), sc))
    remove_folder(s, folder)
    return found


@query
def written_topk(s, d):
    return written_corpus(s, d, lambda c, sc: out(cascade.select(c, sc, k=50), "row", "run_uuid", "exact"))


@query
def written_tau(s, d):
    return written_corpus(s, d, lambda c, sc: out(cascade.select(c, sc, tau=0.15), "row", "segment_id", "score", "class"))


@query
def written_large_k(s, d):
    """More than half of the rows by exact scores, found by brackets and a shuffled fetch, as a table of any size would be."""
    return written_corpus(s, d, lambda c, sc: out(cascade.select(c, sc, k=300, few=50, most_sent=0), "row", "exact"))


def built(s: SparkSession, d: str, request: building.Request, source: Callable[[DataFrame], DataFrame] | None = None) -> tuple[building.Built, DataFrame, dict]:
    """An export of a corpus that is written for it, its rows as read back from its artifact, and what its set says of itself."""
    folder = f"{shared_folder(s, 'an export')}/export-{uuid.uuid4().hex}"
    c = clips(s, d)
    sc = screen_of(c)
    if request.segment_set:
        request = dataclasses.replace(request, segment_set=f"{folder}/set")
    made = building.build(cascade.write(c, sc.scale, f"{folder}/corpus"), sc, request, f"{folder}/made", source=source and source(c))
    rows = checkpointed(s.read.parquet(made.path))
    about = building.provenance(s, request.segment_set) if request.segment_set else {}
    remove_folder(s, folder)
    return made, rows, about


@query
def build_clips(s, d):
    """The best clip of each segment of two vehicles, with confidence and the segments' other columns."""
    source = lambda c: c.where("segment_id is not null").groupBy("segment_id").agg(F.count(F.lit(1)).alias("clips_in_segment"), F.max("vehicle").alias("vehicle"))
    request = building.Request("tag_a", 2, "road", "7", "clips/", tau=0.02, filters={"vehicles": ["v0", "v2"]}, since=1704067200 + 3 * 86400, by_segment=True, confidence=True)
    rows = built(s, d, request, source)[1]
    return out(rows, *rows.columns)


@query
def build_all(s, d):
    """All clips, those that reach the score of the 40th marked as above."""
    rows = built(s, d, building.Request("tag_a", 2, "road", "7", "clips/", k=40, below=True))[1]
    return out(rows, *rows.columns)


@query
def build_best(s, d):
    rows = built(s, d, building.Request("tag_a", 2, "road", "7", "clips/", k=60, confidence=True))[1]
    return out(rows, "rank", "score", "corpus_row", "confidence")


@query
def build_intervals(s, d):
    rows = built(s, d, building.Request("tag_a", 2, "road", "7", "clips/", tau=0.05, below=True, by_interval=True))[1].drop("rank")
    return out(rows, *rows.columns)


@query
def build_figures(s, d):
    """What an export says of itself and of the set of its segments."""
    made, rows, about = built(s, d, building.Request("tag_a", 2, "road", "7", "clips/", tau=0.05, filters={"vehicles": ["v1"]}, segment_set="set"))
    return s.createDataFrame(
        [(made.num_rows, rows.count(), float(made.cutoff), made.rows_unscorable, made.set_segments, about["num_segments"], ",".join(about["vehicles"]), "since" in about)],
        "num_rows long, read_rows long, cutoff double, rows_unscorable long, set_segments long, num_segments long, vehicles string, since boolean",
    )


@query
def probed_selection(s, d):
    """By top k, refined as a probe of the vectors finds that they say more than the codes."""

    def select(c, sc):
        found, refined = cascade.selection(c, sc, k=30)
        return out(found, "row", "exact").withColumn("refined", F.lit(refined))

    return written_corpus(s, d, select)


@query
def refine_sample(s, d):
    """The best three clips of a refined tag."""
    c = clips(s, d)
    marks = c.where("row % 20 = 0").select("row", F.when(F.col("row") % 40 == 0, 1).otherwise(0).alias("label"))
    return feedback.sample(feedback.refine(c, marks, [vector(c, 1)])[0], exporting.chunk_id())


@query
def downsampled_clips(s, d):
    """Clips of the scenarios of one vehicle, and those of the runs of another."""
    c = clips(s, d)
    scenarios = c.where("vehicle = 'v1'").select(F.col("segment_id").alias("scenario_id"), "run_uuid")
    runs = c.where("vehicle = 'v2'").select("run_uuid", "vehicle")
    by = lambda table, name: selection.downsampled(c, table).select("row", F.lit(name).alias("by"))
    return by(scenarios, "scenario").unionByName(by(runs, "run"))


@query
def clip_bounds(s, d):
    """Starts and ends told from the columns of an export."""
    made = exporting.export_columns(exporting.ranked(exact(clips(s, d))), "tag_a", "clips/")
    names = [c for c in made.columns if c != "chunk_id"]
    return made.select("corpus_row", chunk_start(names).alias("start"), chunk_end(names).alias("end"), chunk_start(["chunk_id"]).alias("named"))


@query
def living_marks(s, d):
    """Marks of clips by users' tags; a purchase deletes the tag and begins it anew."""
    e = read(s, d, "events").withColumn("tag", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    gone = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    lives = e.withColumn("born", F.coalesce(F.max(gone).over(Window.partitionBy("tag").orderBy("event_id")), F.lit(-1)))
    marks = lives.where("event_type in ('click', 'error')").select("tag", F.lit(1).cast("long").alias("version"), "born", F.get_json_object("props", "$.k").alias("chunk_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "up").otherwise("down").alias("mark"))
    return ledger.living_marks(marks, e.groupBy("tag").agg(F.coalesce(F.max(gone), F.lit(-1)).alias("born")))


@query
def large_topk(s, d):
    """The best 300 lines of orders by price, many with ties, without sorting them together."""
    rows = read(s, d, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return order.top(rows, 300, score="l_quantity", few=100).select("row", "l_quantity")


@query
def exact_quantiles(s, d):
    """Of line prices, by brackets."""
    p = order.quantiles(read(s, d, "lineitem"), "l_extendedprice", [0.0, 0.25, 0.5, 0.999, 1.0], few=1000)
    return s.createDataFrame([tuple(round(x, 4) for x in p)], "p0 double, p25 double, p50 double, p999 double, p100 double")


def event_scores(s: SparkSession, d: str) -> DataFrame:
    """Events as clips of their user, with their value as score."""
    return read(s, d, "events").select(F.col("user_id").cast("string").alias("run_uuid"), F.col("event_id").alias("row"), F.unix_timestamp("ts").alias("chunk_start_unix"), F.round(F.col("value") / 97, 9).alias("score"))


EVENT_INTERVAL = ("run_uuid", "start_s", "end_s", "peak", "mean", "num_cells", "peak_row")


@query
def event_intervals(s, d):
    """Bursts of events of each user, cut into short ranges and blocks and put together again."""
    return out(iv.intervals(event_scores(s, d), 0.3, span=3600, block=64), *EVENT_INTERVAL, digits=4)


@query
def interval_function(s, d):
    """The same by a table function that takes the cells of a run and block in order, called in SQL."""
    islands.table_function(s)
    cells = islands.blocks(iv.cells(event_scores(s, d), span=3600), 64)
    parts = s.sql("SELECT * FROM islands(TABLE({cells}) PARTITION BY (run_uuid, block) ORDER BY (m), 0.3D)", cells=cells)
    return out(iv.merged(parts, 64), *EVENT_INTERVAL, digits=4)


@query
def interval_arrow(s, d):
    """The same by a function of Arrow groups, in blocks of another size."""
    return out(islands.intervals_by_arrow(event_scores(s, d), 0.3, span=3600, block=4096), *EVENT_INTERVAL, digits=4)


@query
def window_overlaps(s, d):
    """A window for each event, over all clips of its run at once: how many overlap it, and the first and last of them."""
    run = F.col("event_id") % 10
    start = F.lit(1704067200) + 86400 * run + (F.col("event_id") * 7) % 600
    w = read(s, d, "events").select(F.col("event_id").alias("window_id"), F.concat(F.lit("run-"), run.cast("string")).alias("run_uuid"), start.alias("start"), (start + 20 + (F.col("event_id") % 5) * 30).alias("end"))
    pairs = windows.overlaps(clips(s, d), w, width=60)
    return pairs.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"), F.max("row").alias("last"))


@query
def npy_matrices(s, d):
    """The vectors written as matrices in order of row, read again by ranges of 16 KB beside the metadata of the same place."""
    folder = f"{shared_folder(s, 'matrices')}/matrices-{uuid.uuid4().hex}"
    c = clips(s, d).where("vec is not null").withColumn("_down", -F.col("row"))
    placed = exporting.ranked(c, "_down").withColumn("place", F.col("rank") - 1)
    write_matrices(placed, folder, row="place", batch=300)
    back = read_matrices(s, folder, placed.select("place", "row", "run_uuid"), row="place", split=1 << 14)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    found = checkpointed(back.select("row", "run_uuid", F.round(total, 4).alias("total")))
    remove_folder(s, folder)
    return found


@query
def neighbour_graph(s, d):
    """The 10 nearest neighbours of every clip in a sample of up to 2000, by similarity."""
    c = clips(s, d)
    found = layout.nearest(c, *layout.sample_matrix(atlas.seeded_sample(c, 2000, 0)), k=10)
    return found.select("row", F.posexplode("similarity").alias("place", "similarity")).withColumn("similarity", F.round("similarity", 4))


@query
def map_layout(s, d):
    """No SQL: a random descent. All clips on a map by neighbourhood, from unit vectors along 50 axes; its trust is tested."""
    c = clips(s, d)
    p = pca.project(c, pca.fit_sketched(c, 50, unit=True), unit=True).withColumnRenamed("projected", "vec")
    at = checkpointed(layout.laid_out(p, atlas.seeded_sample(p, layout.MOST, 0)).withColumnRenamed("position", "vec"))
    return out(atlas.scaled_points(at), "row", "x", "y", digits=4)
