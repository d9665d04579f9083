"""Live prediction smoothing and the most prominent detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid.functions.text import let
from motorgrid.operators.skew import cut_by_ranges, running_total

# Rows of one slot that a single window task sorts at most.
SLOT_BLOCK_ROWS = 200_000


def mode_vote(history: Column) -> Column:
    """struct(label, class_id, confidence) of the most frequent label in a short history.

    Confidence is the mean over the winner's rows; ties by higher mean, then by name. The class
    id is the one of the label's first row.
    """

    def tally(label: Column) -> Column:
        def entry(own: Column) -> Column:
            total = F.aggregate(own, F.lit(0.0), lambda acc, h: acc + h["confidence"])
            return F.struct(
                (-F.size(own)).alias("a"), (-total / F.size(own)).alias("b"),
                label.alias("label"), F.get(own, F.lit(0))["class_id"].alias("class_id"))

        return let(F.filter(history, lambda h: h["label"] == label), entry)

    labels = F.array_distinct(F.transform(history, lambda h: h["label"]))
    return let(F.array_min(F.transform(labels, tally)), lambda w: F.struct(
        w["label"].alias("label"), w["class_id"].alias("class_id"), (-w["b"]).alias("confidence")))


def smooth_predictions(rows: DataFrame, window: int = K.SMOOTHING_WINDOW,
                       block_rows: int = SLOT_BLOCK_ROWS) -> DataFrame:
    """Vote over the last ``window`` predictions of a slot, one output row per input row.

    Needs slot, ts, seq, label, class_id and confidence; seq tells rows of one ts apart. Positions
    come from a prefix scan over sampled ranges, so a slot may have any number of rows at one time.
    A busy slot is then cut into blocks of consecutive rows; the last rows of a block are repeated in
    front of the next one.
    """
    ranged = cut_by_ranges(rows, ["slot"], ["ts", "seq"])
    placed = running_total(
        ranged, ["slot"], ["ts", "seq"], F.col("_piece"), F.lit(1), "_pos").drop("_cell", "_bucket")
    own = F.floor(F.col("_pos") / block_rows)
    at_end = F.pmod("_pos", F.lit(block_rows)) >= block_rows - (window - 1)
    copied = placed.withColumn("_own", own).withColumn("_block", F.explode(
        F.when(at_end, F.array(own, own + 1)).otherwise(F.array(own))))
    last = Window.partitionBy("slot", "_block").orderBy("_pos").rowsBetween(-(window - 1), 0)
    history = F.collect_list(F.struct("label", "class_id", "confidence")).over(last)
    voted = copied.withColumn("_vote", history).where("_block = _own").withColumn(
        "_vote", mode_vote(F.col("_vote")))
    return voted.select(
        *rows.columns, F.col("_vote.label").alias("smoothed_label"),
        F.col("_vote.class_id").alias("smoothed_class_id"),
        F.col("_vote.confidence").alias("smoothed_confidence"))


def most_prominent(detections: DataFrame) -> DataFrame:
    """Vehicle detection with the largest area × confidence per frame.

    Needs frame_id, detection_id, label, confidence, width and height.
    """
    kept = detections.where(
        F.col("label").isin(*K.DETECTED_VEHICLES)
        & (F.col("confidence") >= K.DETECTION_MIN_CONFIDENCE))
    score = F.col("width") * F.col("height") * F.col("confidence")
    best = kept.groupBy("frame_id").agg(F.min_by(
        F.struct("detection_id", "label", "confidence", score.alias("score")),
        F.struct((-score).alias("s"), F.col("detection_id").alias("i"))).alias("_b"))
    return best.select("frame_id", "_b.*")
