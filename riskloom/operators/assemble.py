"""Assembly of sources into merged, labelled, training and prediction tables.

Every right-hand side is reduced to one row per application before it is joined (application
features, call aggregates, labels), so the wide left joins never multiply rows and a hot key
is never paired with itself.  The per-application tables are joined with each other first and
written; the rows meet them in one join, of which both sides are shuffled, so that adaptive
execution can split a hot key.  Right-hand name collisions get a suffix per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.operators import apps as A
from riskloom.operators import quality as Q
from riskloom.session import cut_lineage, stored

KEY = S.CANONICAL_KEY
# Suffixes for colliding right-hand columns, per source.
SUFFIXES = {"applications": "_app", "calls": "_audio", "link": "_svod", "labels": "_target"}
# Id columns never used as features.
ID_COLUMNS = ("application_id", "APPLICATIONID", "applicationid", "session_id", "sample_id", "ID", "id",
              "call_id", "user_id", "client_id")


def _suffix_collisions(left: DataFrame, right: DataFrame, suffix: str, key: str = KEY) -> DataFrame:
    clash = set(left.columns) & set(right.columns) - {key}
    return right.select(*[F.col(f"`{c}`").alias(f"{c}{suffix}" if c in clash else c) for c in right.columns])


def join_left(left: DataFrame, right: DataFrame, source: str, key: str = KEY) -> DataFrame:
    """Left join on the canonical key after renaming collisions; ``right`` must be one row per
    key (checked by construction: every caller passes an aggregate)."""
    return left.join(_suffix_collisions(left, right, SUFFIXES.get(source, f"_{source}"), key), key, "left")


def merge_all_left(events: DataFrame, app_features: DataFrame | None = None,
                   call_aggregates: DataFrame | None = None) -> DataFrame:
    """Events with the per-application tables; a key without a row there gets NULLs."""
    return _with_sides(events, [("applications", app_features), ("calls", call_aggregates)])


def _with_sides(events: DataFrame, sides: list[tuple[str, DataFrame | None]], labels: DataFrame | None = None) -> DataFrame:
    """``labels`` (one row per key) may ride along: their rows are the only keys that stay then."""
    rows, names, per_key = events.where(F.col(KEY).isNotNull()), events, labels
    for source, side in sides:
        if side is not None:
            side = _suffix_collisions(names, side, SUFFIXES.get(source, f"_{source}"))
            per_key = side if per_key is None else per_key.join(side, KEY, "full" if labels is None else "left")
            names = names.limit(0).join(side.limit(0), KEY, "left")  # for its columns
    return rows if per_key is None else rows.join(cut_lineage(per_key), KEY, "left" if labels is None else "inner")


def one_label_per_key(labels: DataFrame, label: str | None = None) -> DataFrame:
    """Rows without a key dropped, the label named ``label``; of several rows of a key the one
    with the largest label stays (then the largest of the other columns, in their order)."""
    label = label or S.label_column(labels.drop(KEY))
    rows = labels.where(F.col(KEY).isNotNull()).withColumnRenamed(label, "label")
    others = [c for c in rows.columns if c not in (KEY, "label")]
    best = F.max(F.struct("label", *others)).alias("_best")
    return rows.groupBy(KEY).agg(best).select(KEY, *[F.col("_best")[c].alias(c) for c in rows.columns if c != KEY])


def merge_with_labels(merged: DataFrame, labels: DataFrame, label: str | None = None,
                      drop_collisions: bool = True) -> DataFrame:
    """Inner join with the label table (one row per key); the label stays a column named
    ``label``; colliding label-table columns get ``_target`` and are dropped by default.

    For rows that still have to meet the per-application tables, ``merge_all`` joins once."""
    lab = _suffix_collisions(merged, one_label_per_key(labels, label), SUFFIXES["labels"])
    out = merged.join(cut_lineage(lab), KEY, "inner")
    if drop_collisions:
        out = out.drop(*[c for c in out.columns if c.endswith(SUFFIXES["labels"])])
    return out


def merge_all(events: DataFrame, app_features: DataFrame | None, call_aggregates: DataFrame | None,
              labels: DataFrame, label: str | None = None) -> DataFrame:
    """``merge_with_labels(merge_all_left(...))`` with one join of the event rows."""
    lab = one_label_per_key(labels, label)
    sides = [("applications", app_features), ("calls", call_aggregates)]
    names = set(events.columns).union(*(d.columns for _, d in sides if d is not None)) - {KEY}
    lab = lab.select(KEY, *[c for c in lab.columns if c != KEY and c not in names])
    out = _with_sides(events, sides, lab)
    own = [c for c in lab.columns if c != KEY]
    return out.select(*[c for c in out.columns if c not in own], *own)


def feature_columns(df: DataFrame, label: str = "label", extra_drop: tuple[str, ...] = ()) -> list[str]:
    """Ids, ``*_y`` collision columns, the label and non-numeric columns left out."""
    out = []
    for f in df.schema.fields:
        if f.name in ID_COLUMNS or f.name == label or f.name in extra_drop or f.name.endswith("_y"):
            continue
        if S.is_numeric(f.dataType) or S.is_time(f.dataType) or S.is_string(f.dataType):
            out.append(f.name)
    return out


def require_overlap(features: DataFrame, labels: DataFrame, key: str = KEY, examples: int = 5) -> None:
    """Fails, with example keys of either side, when no key is in both."""
    if features.join(labels, key, "left_semi").limit(1).count():
        return
    left, right = ([r[0] for r in d.select(key).distinct().orderBy(key).limit(examples).collect()] for d in (features, labels))
    raise ValueError(f"features and labels have no key in common; features have {left}, labels have {right}")


def training_matrix(applications: DataFrame, labels: DataFrame, app_key: str, label: str,
                    include_label_columns: bool = False) -> tuple[DataFrame, list[str]]:
    """Application features -> inner join with labels -> ids dropped -> cleaned numeric matrix.

    Label-table side columns (delinquency counters and the like) are left out unless
    ``include_label_columns``: they leak the outcome and are absent at scoring time."""
    feats = A.app_features(applications, app_key)
    lab = labels.select(F.col(app_key).alias(KEY), *[c for c in labels.columns if c != app_key])
    lab = lab.withColumnRenamed(label, "label")
    if not include_label_columns:
        lab = lab.select(KEY, "label")
    feats, lab = cut_lineage(feats), cut_lineage(lab)
    require_overlap(feats, lab)
    joined = feats.join(_suffix_collisions(feats, lab, "_y"), KEY, "inner")
    x = joined.select(KEY, "label", *feature_columns(joined))
    return Q.clean_features(x, keep=(KEY, "label"))


def prediction_matrix(applications: DataFrame, app_key: str, features: list[str] | None = None) -> DataFrame:
    """Application features cleaned; aligned to a trained feature list when one is given."""
    feats = A.app_features(applications, app_key)
    x = feats.select(KEY, *feature_columns(feats))
    if features is not None:
        return Q.align_features(Q.finite(Q.datetime_to_epoch(x), keep=(KEY,)), features, keep=(KEY,))
    cleaned, _ = Q.clean_features(x, keep=(KEY,))
    return cleaned


def temporal_join(apps: DataFrame, app_id: str, app_time: str, events: DataFrame, event_time: str,
                  order: list[str], window_days: int = 1) -> DataFrame:
    """Each application takes the earliest event (by ``order``) dated within +-``window_days``
    of its own date; applications without one are dropped.

    Plan: earliest event per calendar day (partial aggregation), spread to the 2w+1 days it
    can serve and reduced again, so the lookup table has one row per day of the events' date
    range (+2w).  It is stored, so that Spark broadcasts it while it is small; otherwise both
    sides of the equi-join on the day are shuffled and a hot day can be split."""
    ev_cols = list(events.columns)
    first = F.min(F.struct(*[F.col(c).alias(f"o_{i}") for i, c in enumerate(order)],
                           *[F.col(c).alias(f"e_{c}") for c in ev_cols]))
    dated = events.where(F.col(event_time).isNotNull())
    per_day = dated.groupBy(F.to_date(event_time).alias("_day")).agg(first.alias("_e"))
    reach = per_day.select(F.explode(F.sequence(F.date_sub("_day", window_days), F.date_add("_day", window_days))).alias("_day"),
                           "_e").groupBy("_day").agg(F.min("_e").alias("_e"))
    j = apps.where(F.col(app_time).isNotNull()).join(stored(reach, "days"), F.to_date(app_time) == F.col("_day"), "inner")
    others = [c for c in apps.columns if c != app_id]
    return j.select(app_id, *others, *[F.col("_e")[f"e_{c}"].alias(c if c not in apps.columns else f"{c}_event")
                                       for c in ev_cols])
