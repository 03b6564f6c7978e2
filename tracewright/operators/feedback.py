"""Excavation feedback: revisions of the truth table and figures read from it.

``truth`` rows are (defect_id, line_id, revision, chainage_m, defect_type,
source, verified_at, valid_from, valid_to); ``valid_to`` NULL is the present
revision. A changed table is always a new full version.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import days_between
from ..session import cut
from .guards import GuardError, assert_unique
from .matching import first_seen, nearest
from .metrics import coverage_vs_nominal
from .ordered import before, order_rows, total
from .quantiles import quantiles

TOLERANCE_M = 15.0
#: Verifications and objects of one stretch that one task walks; longer stretches go by rounds.
WALK_ROWS = 100_000


def locate(verifications: DataFrame, indications: DataFrame, surveys: DataFrame) -> DataFrame:
    """Verifications with the survey, line and chainage of their indication; an unknown one is an error."""
    known = indications.select("indication_id", "survey_id", F.col("chainage_peak_m").alias("chainage_m"))
    out = verifications.join(known, "indication_id", "left").join(surveys.select("survey_id", "line_id"), "survey_id", "left")
    lost = [r[0] for r in out.filter("line_id is null").select("indication_id").limit(5).collect()]
    if lost:
        raise GuardError(f"unknown indications: {lost}")
    return out


def record_excavations(
    verifications: DataFrame, truth: DataFrame, tolerance: float = TOLERANCE_M, walk_rows: int = WALK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """New version of the truth table after a batch of verifications, and the object each one went to.

    ``verifications``: (verification_id, line_id, chainage_m, defect_type,
    verified_at). Same result as taking them one after another in time: each
    closes the nearest present revision of its line within the tolerance and
    opens the next one at its own place, or starts an object.

    A line falls into stretches, across which nothing can be within the tolerance;
    objects that no verification can reach stay out. A stretch of at most
    ``walk_rows`` rows is walked in time order in one task, which keeps only the
    places of its objects, many stretches to a task; a longer one goes by rounds.
    The truth table itself is read once for its present revisions and joined once
    with the revisions that closed, however long the chains are.

    A verification without line, place or time, or with a repeated id, is an error.
    Without verifications the table stays as it is. If ``truth`` has a column
    ``verification_id``, the new revisions carry theirs there.
    """
    place = F.floor(F.col("chainage_m") / (2 * tolerance)).cast("long")
    new_id = F.concat(F.lit("excavation_"), F.substring(F.sha2(F.concat_ws("|", "line_id", "verification_id"), 256), 1, 12))
    checks = cut(verifications.select("verification_id", "line_id", "chainage_m", "defect_type", "verified_at", place.alias("__b"), new_id.alias("__new")))
    incomplete = F.greatest(*[F.col(c).isNull() for c in ("verification_id", "line_id", "__b", "verified_at")])
    lost = [r[0] for r in checks.filter(incomplete).select("verification_id").limit(5).collect()]
    if lost:
        raise GuardError(f"verifications without id, line, place or time: {lost}")
    assert_unique(checks, ["verification_id"], "verifications")

    present = truth.filter("valid_to is null").select("line_id", "defect_id", "revision", "chainage_m", place.alias("__b"))
    around = checks.select("line_id", F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1)).alias("__b")).distinct()
    objects = cut(present.join(around, ["line_id", "__b"], "left_semi"))
    stretches = cut(_stretches(checks.select("line_id", "__b").unionByName(objects.select("line_id", "__b")).distinct()))
    rows = checks.unionByName(objects, allowMissingColumns=True).join(stretches, ["line_id", "__b"])
    rows = cut(rows.withColumn("__check", F.col("verification_id").isNotNull()))
    sizes = rows.groupBy("line_id", "__st").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > walk_rows)
    long = cut(sizes.select("line_id", "__st"))

    walked = _walk_in_time(rows.join(long, ["line_id", "__st"], "left_anti"), tolerance)
    shown = F.col("verification_id").cast("string") == F.col("__id")
    routes = [checks.drop("__b", "__new").join(walked, shown).drop("__id")]
    if not long.isEmpty():
        crowded = rows.join(long, ["line_id", "__st"], "left_semi")
        routes += _by_rounds(crowded.filter("__check").select(*checks.columns), crowded.filter("not __check").select(*objects.columns), tolerance)
    steps = cut(reduce(DataFrame.unionByName, routes))

    types = {f.name: f.dataType for f in truth.schema.fields}
    opened = steps.select(
        "verification_id", "defect_id", "line_id", (F.coalesce("closed_revision", F.lit(-1)) + 1).cast(types["revision"]).alias("revision"),
        "chainage_m", F.coalesce("defect_type", F.lit("unknown")).alias("defect_type"), F.lit("excavation").alias("source"),
        "verified_at", F.col("verified_at").alias("valid_from"), F.lit(None).cast(types["valid_to"]).alias("valid_to"),
    )
    # a revision closes once, be it one of the table or one opened by this batch
    closed = steps.filter("closed_revision is not null").select(
        "defect_id", F.col("closed_revision").cast(types["revision"]).alias("revision"), F.col("verified_at").alias("__close")
    )
    own = opened.select(*[c for c in opened.columns if c in types])
    every = truth.unionByName(own, allowMissingColumns=True).join(closed, ["defect_id", "revision"], "left")
    table = every.withColumn("valid_to", F.coalesce("__close", "valid_to").cast(types["valid_to"])).select(*truth.columns)
    return cut(table), steps.select("verification_id", "defect_id", "closed_revision")


def _stretches(cells: DataFrame) -> DataFrame:
    """Number ``__st`` of the run of neighbouring cells each cell of a line belongs to; an empty cell ends a run."""
    series = order_rows(cells, ["line_id"], ["__b"], idx="__i")
    near = series.running(__pb=before(F.col("__b")))
    return near.running(__st=total(F.coalesce((F.col("__b") - F.col("__pb") > 1).cast("long"), F.lit(0)))).df.select("line_id", "__b", "__st")


def _walk_in_time(rows: DataFrame, tolerance: float) -> DataFrame:
    """Object and closed revision of each verification, stretch by stretch; objects come before verifications."""
    key = F.concat_ws("|", F.col("line_id").cast("string"), "__st")
    flat = rows.select(
        key.alias("key"), F.col("chainage_m").alias("x"), "__check", "verified_at", "verification_id", F.col("verification_id").cast("string").alias("id"),
        F.coalesce("defect_id", "__new").alias("object"), F.coalesce(F.col("revision").cast("long"), F.lit(0)).alias("revision"),
    )
    ordered = flat.repartition("key").sortWithinPartitions("key", "__check", "verified_at", "verification_id", "object").drop("verified_at", "verification_id")

    def walk(batches):
        here, objects = None, []
        for pdf in batches:
            out = []
            for key, x, check, vid, name, revision in zip(pdf["key"], pdf["x"], pdf["__check"], pdf["id"], pdf["object"], pdf["revision"]):
                if key != here:
                    here, objects = key, []
                if not check:
                    insort(objects, (x, name, revision))
                    continue
                i = bisect_left(objects, (x,))
                # of objects at one place the smallest id, of two as near the lower place
                sides = ([bisect_left(objects, (objects[i - 1][0],))] if i else []) + ([i] if i < len(objects) else [])
                best = min(sides, key=lambda j: abs(objects[j][0] - x), default=None)
                if best is not None and abs(objects[best][0] - x) <= tolerance:
                    _, name, closed = objects.pop(best)
                    insort(objects, (x, name, closed + 1))
                else:
                    closed = None
                    insort(objects, (x, name, 0))
                out.append((vid, name, closed))
            got = pd.DataFrame(out, columns=["__id", "defect_id", "closed_revision"])
            yield got.astype({"closed_revision": "Int64"})

    return ordered.mapInPandas(walk, "__id string, defect_id string, closed_revision long")


def _by_rounds(rest: DataFrame, objects: DataFrame, tolerance: float) -> list[DataFrame]:
    """As the walk, for stretches beyond one task.

    A round takes every verification with no earlier one left within two
    tolerances, since only those can change what it finds; rounds go on until none
    is left. Only objects in reach are carried from round to round.
    """
    routes, order = [], F.struct("verified_at", "verification_id")
    rest, present = cut(rest), objects.select("line_id", "defect_id", F.col("revision").cast("long").alias("revision"), F.col("chainage_m").alias("at_m"))
    while not rest.isEmpty():
        first = rest.groupBy("line_id", "__b").agg(F.min(order).alias("__first"))
        near = first.select("line_id", F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1)).alias("__b"), "__first")
        lowest = near.groupBy("line_id", "__b").agg(F.min("__first").alias("__first"))
        ready = cut(rest.join(lowest, ["line_id", "__b"]).filter(order == F.col("__first")).drop("__first"))
        found = nearest(ready, present, ["line_id"], "chainage_m", "at_m", "defect_id", ["revision"])
        hit = F.col("distance_m") <= tolerance
        step = cut(found.select(
            *[c for c in ready.columns if c not in ("__b", "__new")], F.when(hit, F.col("defect_id")).otherwise(F.col("__new")).alias("defect_id"),
            F.when(hit, F.col("revision")).alias("closed_revision"),
        ))
        moved = step.select("line_id", "defect_id", (F.coalesce("closed_revision", F.lit(-1)) + 1).cast("long").alias("revision"), F.col("chainage_m").alias("at_m"))
        present = cut(present.join(step.select("defect_id"), "defect_id", "left_anti").unionByName(moved))
        routes.append(step)
        rest = cut(rest.join(ready.select("verification_id"), "verification_id", "left_anti"))
    return routes


def upsert_observations(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Observations with the new severities replacing older ones of the same object and survey."""
    return existing.join(new, ["defect_id", "survey_id"], "left_anti").unionByName(new)


def days_to_verification(truth: DataFrame, indications: DataFrame, tolerance: float = TOLERANCE_M) -> DataFrame:
    """Per excavation: days since the earliest indication of that place made before it."""
    dug = truth.filter("source = 'excavation'").select(
        "line_id", F.concat_ws("#", "defect_id", "revision").alias("excavation"), "chainage_m", "verified_at"
    )
    seen = indications.select("line_id", "chainage_peak_m", "created_at")
    got = first_seen(dug, seen, ["line_id"], "chainage_m", "chainage_peak_m", "excavation", "verified_at", "created_at", tolerance)
    return got.withColumn("days", days_between(F.col("first_seen"), F.col("verified_at")))


def median_days(truth: DataFrame, indications: DataFrame, tolerance: float = TOLERANCE_M) -> DataFrame:
    return quantiles(days_to_verification(truth, indications, tolerance), [], "days", {"median_days": 0.5})


def verified_coverage(
    observations: DataFrame, truth: DataFrame, indications: DataFrame, version: str, nominal: float, tolerance: float = TOLERANCE_M
) -> DataFrame:
    """Share of verified severities inside the interval of the nearest indication of the same survey and release."""
    present = truth.filter("source = 'excavation' and valid_to is null").select("defect_id", "chainage_m")
    dug = observations.join(present, "defect_id")
    shown = indications.filter((F.col("pipeline_version") == version) & F.col("sev_lo").isNotNull() & F.col("sev_hi").isNotNull())
    near = nearest(dug, shown.select("survey_id", "indication_id", "chainage_peak_m", "sev_lo", "sev_hi"), ["survey_id"], "chainage_m", "chainage_peak_m", "indication_id", ["sev_lo", "sev_hi"])
    return coverage_vs_nominal(near.filter(F.col("distance_m") <= tolerance), "severity_smys", "sev_lo", "sev_hi", nominal)
