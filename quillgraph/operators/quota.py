"""Quotas filled in order without a group that holds all rows.

Taken one by one, each document goes to the first of its categories that isn't full. That is what documents proposing to
categories come to when every category prefers small ids, so it is found in rounds: a category keeps a cutoff, the
largest id that it can still take; each document stands at its first category whose cutoff it passes; where more stand than
the quota, the cutoff falls to the quota-th id. Cutoffs only fall, and the last round moves none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ranking import ranked

#: Cutoffs that are broadcast; more are joined.
BROADCAST_ROWS = 100_000


def fill(choices: DataFrame, quota: int) -> DataFrame:
    """doc_id, category of choices (doc_id, place, category). A category counts once a document, at its first place; documents whose categories are all full have no row; a quota under 1 takes none."""
    first = choices.where("doc_id is not null and category is not null").groupBy("doc_id", "category").agg(F.min("place").alias("place"))
    if quota < 1:
        return first.limit(0).select("doc_id", "category")
    own = stored(first)
    cutoffs = None
    while True:
        left = own
        if cutoffs is not None:
            few = F.broadcast(cutoffs) if cutoffs.count() <= BROADCAST_ROWS else cutoffs
            left = own.join(few, "category", "left").where("cutoff is null or doc_id <= cutoff")
        at = stored(left.groupBy("doc_id").agg(F.min_by("category", F.struct("place", "category")).alias("category")))
        over = stored(at.groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") > quota).select("category"))
        if over.isEmpty():
            return at
        crowded = at.join(F.broadcast(over) if over.count() <= BROADCAST_ROWS else over, "category", "left_semi")
        fallen = ranked(crowded, "category", [F.col("doc_id")], "rank").where(F.col("rank") == quota).select("category", F.col("doc_id").alias("cutoff"))
        cutoffs = stored(fallen if cutoffs is None else fallen.unionByName(cutoffs.join(over, "category", "left_anti")))
