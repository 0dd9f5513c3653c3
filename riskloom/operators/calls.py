"""Call recordings: parsed names, per-call features, linking to applications through the
link table (file name first, phone as fallback), coverage, conflicts and orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.functions import calls as FC
from riskloom.functions.calls import linked_file_name
from riskloom.operators.events import BUSINESS_FROM, BUSINESS_TO, NIGHT_FROM, NIGHT_TO, WEEKEND_FROM
from riskloom.session import cut_lineage

KEY = S.CANONICAL_KEY
BYTES_PER_SECOND = 32000  # fixed value: size-based duration estimate
MAX_CODE_COLUMNS = 3


def parse_calls(listing: DataFrame, name_col: str = "file_name") -> DataFrame:
    """file listing (path, file_name, file_size) -> parsed call rows.

    Stem, parts and pieces are separate projections, so each is computed once per row
    (Catalyst keeps a projection apart when merging it would repeat a costly expression)."""
    x = listing.select("*", FC.call_stem(F.col(name_col)).alias("_stem"))
    x = x.select("*", FC.call_parts(F.col("_stem")).alias("_parts"))
    x = x.select("*", FC.call_pieces(F.col("_parts")).alias("_pieces"))
    f = FC.call_fields(F.col("_stem"), F.col("_parts"), F.col("_pieces"))
    return x.select(*listing.columns, *f[:4], f[4].alias("file_user"))


def call_features(calls: DataFrame, app_col: str | None = None) -> DataFrame:
    """Per call: time, phone, code and size features; key = linked application, else call id."""
    t, phone, codes = F.col("call_time"), F.col("phone"), F.col("codes")
    h, wd = F.hour(t), F.weekday(t)
    key = F.coalesce(F.col(app_col), F.col("call_id")) if app_col else F.col("call_id")
    cols = [
        F.col("file_name"), key.alias(KEY),
        h.alias("audio_call_hour"), wd.alias("audio_call_weekday"),
        (wd >= WEEKEND_FROM).cast("int").alias("audio_call_is_weekend"),
        ((h >= NIGHT_FROM) | (h <= NIGHT_TO)).cast("int").alias("audio_call_is_night"),
        ((h >= BUSINESS_FROM) & (h <= BUSINESS_TO)).cast("int").alias("audio_call_is_business_hours"),
        F.length(phone).alias("audio_phone_length"),
        phone.startswith("7").cast("int").alias("audio_phone_starts_with_7"),
        phone.startswith("8").cast("int").alias("audio_phone_starts_with_8"),
        (F.length(phone) > 10).cast("int").alias("audio_phone_has_country_code"),
        F.size(codes).alias("audio_codes_count"), (F.size(codes) > 0).cast("int").alias("audio_has_codes"),
        *[F.get(codes, i).alias(f"audio_code_{i + 1}") for i in range(MAX_CODE_COLUMNS)],
        F.col("file_size").alias("audio_file_size_bytes"),
        (F.col("file_size") / (1024 * 1024)).alias("audio_file_size_mb"),
        (F.col("file_size") / BYTES_PER_SECOND).alias("audio_estimated_duration"),
    ]
    return calls.select(*cols)


def file_map(link: DataFrame, file_col: str | None = None, app_col: str | None = None,
             order_col: str = "link_row", time_col: str | None = None) -> DataFrame:
    """link rows -> (file_name, application id[, link_time]); the last row (by ``order_col``) of a file wins.
    ``time_col``: the link table's call time, a timestamp or its text."""
    file_col = file_col or S.file_name_column(link)
    app_col = app_col or S.application_column(link)
    if file_col is None or app_col is None:
        raise ValueError(f"link table needs a file and an application column: {link.columns}")
    rows = link.where(F.col(f"`{file_col}`").isNotNull() & F.col(f"`{app_col}`").isNotNull())
    more = [F.max_by(F.try_to_timestamp(F.col(f"`{time_col}`").cast("string")).cast("timestamp_ntz"), F.col(order_col)).alias("link_time")] if time_col else []
    return rows.groupBy(linked_file_name(F.col(f"`{file_col}`").cast("string")).alias("file_name")).agg(
        F.max_by(F.col(f"`{app_col}`").cast("string"), F.col(order_col)).alias(KEY), *more)


def phone_map(link: DataFrame, phone_col: str, app_col: str | None = None, order_col: str = "link_row") -> DataFrame:
    app_col = app_col or S.application_column(link)
    rows = link.where(F.col(f"`{phone_col}`").isNotNull() & F.col(f"`{app_col}`").isNotNull())
    return rows.groupBy(F.col(f"`{phone_col}`").cast("string").alias("phone")).agg(
        F.max_by(F.col(f"`{app_col}`").cast("string"), F.col(order_col)).alias("_phone_app"))


def link_calls(calls: DataFrame, link: DataFrame, **kw) -> DataFrame:
    """Left join of calls with the file map; unmatched calls get a NULL application id.

    The map has one row per file; Spark/AQE broadcasts it only when its measured size is under
    the broadcast threshold, otherwise both sides shuffle on the file name."""
    return calls.join(file_map(link, **kw), "file_name", "left")


def link_calls_fallback(calls: DataFrame, link: DataFrame, phone_col: str, **kw) -> DataFrame:
    """File-name link first; calls it misses are looked up by phone.

    Only calls that are still open and have a phone go into the second join; its map is
    written first, so that both sides are shuffled and a hot phone can be split."""
    by_file = cut_lineage(link_calls(calls, link, **kw))
    open_calls = F.col(KEY).isNull() & F.col("phone").isNotNull()
    settled = by_file.where(~open_calls).withColumn("link_method", F.when(F.col(KEY).isNotNull(), "file"))
    found = by_file.where(open_calls).join(cut_lineage(phone_map(link, phone_col)), "phone", "left")
    found = found.withColumn(KEY, F.col("_phone_app")).withColumn("link_method", F.when(F.col(KEY).isNotNull(), "phone"))
    return settled.unionByName(found.drop("_phone_app").select(*settled.columns))


def link_coverage(linked: DataFrame) -> DataFrame:
    """One row: total calls, linked calls, link rate and its grade (>90 %, 70-90 %, <70 %)."""
    rate = F.avg(F.col(KEY).isNotNull().cast("double"))
    return linked.agg(F.count(F.lit(1)).alias("total_calls"), F.count(KEY).alias("linked_calls"),
                      rate.alias("link_rate")).withColumn("link_grade", F.coalesce(grade(F.col("link_rate")), F.lit("critical")))


def data_coverage(rows: DataFrame, id_col: str = KEY, recording_col: str = "file_name", label_col: str = "label") -> DataFrame:
    """One row: how many records have an application id, a recording and a label, with shares, and the
    recordings without an id."""
    n = F.count(F.lit(1))
    out = [n.alias("total_records")]
    for name, c in (("id", id_col), ("recording", recording_col), ("label", label_col)):
        out += [F.count(c).alias(f"with_{name}"), F.try_divide(F.count(c).cast("double"), n.cast("double")).alias(f"{name}_coverage")]
    return rows.agg(*out, F.count(F.when(F.col(id_col).isNull() & F.col(recording_col).isNotNull(), 1)).alias("orphan_recordings"))


def latest_per_key(linked: DataFrame, time_col: str = "call_time", tiebreak: str = "file_name") -> DataFrame:
    """The whole latest call row per application (by time, then file name), the number of calls
    it had and how many of them were superseded."""
    rows = linked.where(F.col(KEY).isNotNull())
    others = [c for c in rows.columns if c not in (KEY, time_col, tiebreak)]
    last = F.max(F.struct(F.col(time_col), F.col(tiebreak), *others)).alias("_last")
    n = F.count(F.lit(1))
    return rows.groupBy(KEY).agg(last, n.alias("n_calls"), (n - 1).alias("n_superseded")).select(
        KEY, *[F.col("_last")[c].alias(c) for c in rows.columns if c != KEY], "n_calls", "n_superseded")


def orphan_calls(calls: DataFrame, link: DataFrame, phone_col: str | None = None, **kw) -> DataFrame:
    """Calls no link row reaches (anti-joins on file name, then phone)."""
    out = calls.join(file_map(link, **kw), "file_name", "left_anti")
    if phone_col:
        out = out.join(phone_map(link, phone_col), "phone", "left_anti")
    return out


def time_agreement(linked: DataFrame, time_col: str = "call_time", link_time_col: str = "link_time", tolerance_seconds: int = 60) -> DataFrame:
    """One row: linked calls, those with both times, how many of these agree within the tolerance, their share and its grade, and the
    largest difference in seconds."""
    apart = F.abs(F.unix_micros(F.col(time_col).cast("timestamp")) - F.unix_micros(F.col(link_time_col).cast("timestamp"))) / 1_000_000
    out = linked.where(F.col(KEY).isNotNull()).agg(
        F.count(F.lit(1)).alias("linked_calls"), F.count(apart).alias("with_times"), F.count(F.when(apart <= tolerance_seconds, 1)).alias("agreeing"),
        F.max(apart).alias("largest_difference"))
    share = F.try_divide(F.col("agreeing").cast("double"), F.col("with_times").cast("double"))
    return out.withColumn("time_agreement", share).withColumn("time_grade", grade(F.col("time_agreement")))


def grade(rate: Column) -> Column:
    return F.when(rate > 0.9, "excellent").when(rate >= 0.7, "acceptable").when(rate.isNotNull(), "critical")


def call_profile(calls: DataFrame, approx: bool = False) -> DataFrame:
    """One row: files, distinct call ids, bytes, share of names with a parsed time.  ``approx`` counts the ids by
    sketch (``call_sketches``), whose memory does not grow with them."""
    ids = F.hll_sketch_estimate(F.hll_sketch_agg("call_id", SKETCH_BITS)) if approx else F.count_distinct("call_id")
    return calls.agg(F.count(F.lit(1)).alias("n_files"), ids.alias("n_call_ids"),
                     F.sum("file_size").alias("total_bytes"),
                     F.avg(F.col("call_time").isNotNull().cast("double")).alias("time_parsed_share"))


#: log2 of a sketch's registers; its relative standard error is 1.04 / sqrt(2 ** bits), 1.6 % here.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / (1 << SKETCH_BITS) ** 0.5


def call_kind() -> Column:
    """Whether a call's name carries codes."""
    return F.when(F.size("codes") > 0, "coded").otherwise("plain")


def call_sketches(calls: DataFrame) -> DataFrame:
    """Distinct call ids as mergeable sketches: (day, kind, n_files, sketch), one row per day (NULL: no time) and call kind.

    The rows are to be stored as they arrive; ``merged_call_counts`` answers for any grouping of them without the calls."""
    return calls.groupBy(F.to_date("call_time").alias("day"), call_kind().alias("kind")).agg(
        F.count(F.lit(1)).alias("n_files"), F.hll_sketch_agg("call_id", SKETCH_BITS).alias("sketch"))


def merged_call_counts(sketches: DataFrame, *by: str) -> DataFrame:
    """(by..., n_files, n_call_ids): files, and distinct call ids as the union of the stored sketches estimates them."""
    return sketches.groupBy(*by).agg(F.sum("n_files").alias("n_files"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_call_ids"))


def calls_per_application(features: DataFrame) -> DataFrame:
    """File-level call features reduced to one row per application before any join."""
    return features.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("audio_calls_count"),
        F.avg("audio_estimated_duration").alias("audio_duration_mean"),
        F.max("audio_estimated_duration").alias("audio_duration_max"),
        F.avg("audio_call_is_night").alias("audio_night_call_ratio"),
        F.avg("audio_call_is_business_hours").alias("audio_business_call_ratio"))
