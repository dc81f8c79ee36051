"""Edit logs: replay, undo and redo."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ``edits``: image_id, seq, sp_id, class_id, mode (add, remove, undo, redo).


def replay(clicks: DataFrame) -> DataFrame:
    """Selected superpixels after all clicks: ``image_id, sp_id, class_id``.

    Adding moves a superpixel to one class, so for a class only its own clicks and additions to
    other classes matter: the last such event decides.  That makes the log a plain aggregate, with
    no order between images or superpixels.
    """
    keyed = clicks.select("image_id", "sp_id", "class_id", "mode", "seq")
    own = keyed.groupBy("image_id", "sp_id", "class_id").agg(
        F.max_by("mode", "seq").alias("_mode"), F.max("seq").alias("_seq")
    )
    taken = keyed.where("mode = 'add'").groupBy("image_id", "sp_id").agg(
        F.max_by("class_id", "seq").alias("_owner"), F.max("seq").alias("_at")
    )
    last = own.join(taken, ["image_id", "sp_id"], "left")
    kept = (F.col("_mode") == "add") & (F.col("_owner") == F.col("class_id"))
    return last.where(kept).select("image_id", "sp_id", "class_id")


def surviving_frozen(frozen_px: DataFrame, clicks: DataFrame, segments: DataFrame) -> DataFrame:
    """Frozen pixels no click has cleared: additions clear every class under the superpixel,
    removals only their own class."""
    added = clicks.where("mode = 'add'").select("image_id", "sp_id").distinct()
    removed = clicks.where("mode = 'remove'").select("image_id", "sp_id", "class_id").distinct()
    placed = frozen_px.join(
        segments.select("image_id", "row", "col", F.col("seg_id").alias("sp_id")).hint("merge"), ["image_id", "row", "col"]
    )
    return placed.join(added, ["image_id", "sp_id"], "left_anti").join(
        removed, ["image_id", "sp_id", "class_id"], "left_anti"
    ).select("image_id", "class_id", "row", "col")


def class_masks(selected: DataFrame, segments: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """Pixels of every class mask: selected superpixels plus surviving frozen pixels."""
    px = segments.select("image_id", "row", "col", F.col("seg_id").alias("sp_id")).join(
        selected, ["image_id", "sp_id"]
    ).select("image_id", "class_id", "row", "col")
    return px if frozen is None else px.unionByName(frozen).distinct()


def effective_edits(edits: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """Clicks left after undo and redo: ``image_id, seq, sp_id, class_id, mode``.

    An undo takes back the last click that changed anything; whether a click changed anything
    depends on everything before it, so one image's log is read in order.  Logs are sorted inside
    hash partitions and *streamed* through: memory holds the current selection (at most one class
    set per superpixel) and the undo stack, never the log.

    ``frozen``: image_id, sp_id, class_id of superpixels with frozen pixels, which clicks clear.
    """
    columns = ["image_id", "seq", "sp_id", "class_id", "mode"]
    rows = edits.select(*columns)
    if frozen is not None:
        rows = rows.unionByName(frozen.select(
            "image_id", F.lit(-1).cast("bigint").alias("seq"), "sp_id", "class_id", F.lit("frozen").alias("mode")
        ).distinct())
    ordered = rows.repartition("image_id").sortWithinPartitions("image_id", "seq")
    return ordered.mapInPandas(_fold_logs, "image_id bigint, seq bigint, sp_id int, class_id int, mode string")


class _Log:
    """Selected and frozen classes per superpixel of one image, with its undo and redo stacks."""

    def __init__(self):
        self.state: dict[int, tuple[frozenset, frozenset]] = {}
        self.done: list[tuple] = []
        self.undone: list[tuple] = []

    def feed(self, seq: int, sp: int, cls: int, mode: str) -> None:
        selected, frozen = self.state.get(sp, (frozenset(), frozenset()))
        if mode == "frozen":
            self.state[sp] = (selected, frozen | {cls})
        elif mode == "undo":
            if self.done:
                entry = self.done.pop()
                self.state[entry[1]] = entry[4]
                self.undone.append(entry)
        elif mode == "redo":
            if self.undone:
                entry = self.undone.pop()
                self.state[entry[1]] = entry[5]
                self.done.append(entry)
        else:
            before = (selected, frozen)
            gone = {cls}
            after = (frozenset(gone), frozenset()) if mode == "add" else (selected - gone, frozen - gone)
            if after != before:
                self.done.append((seq, sp, cls, mode, before, after))
                self.undone.clear()
                self.state[sp] = after


def _fold_logs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    image, log = None, _Log()

    def flush():
        rows = [(image, seq, sp, cls, mode) for seq, sp, cls, mode, *_ in log.done]
        return pd.DataFrame(rows, columns=["image_id", "seq", "sp_id", "class_id", "mode"])

    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.image_id != image:
                if image is not None:
                    yield flush()
                image, log = row.image_id, _Log()
            log.feed(row.seq, row.sp_id, row.class_id, row.mode)
    if image is not None:
        yield flush()
