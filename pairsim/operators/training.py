"""Training elements end to end: scored pairs -> balanced split -> entities of the split -> label, weight, features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsim.functions.scores import banded_weight
from pairsim.operators.pairs import pair_features, semi_members
from pairsim.operators.split import balanced_parts
from pairsim.session import stored


def split_part(pairs: DataFrame, key: str, split: str, score: str = "score") -> DataFrame:
    """The pairs of one part (train, validation or test) of the balanced split; pairs without a score are in none."""
    return balanced_parts(pairs, key, [split], score)


def training_elements(part: DataFrame, entities: DataFrame, group: str = "group_id", ident: str = "entity_id",
                      feature: str = "encoding", score: str = "score") -> DataFrame:
    """(group, id1, id2, label, weight, <feature>1, <feature>2) of the pairs of a split.

    Only entities that the split refers to take part in the feature lookup;
    a pair carries both features from there on, so ``part`` should be
    candidates, not all pairs.
    """
    part = stored(part.select(group, "id1", "id2", score))  # read by both steps
    used = semi_members(entities.select(group, ident, feature), part, group, ident)
    out = pair_features(part.select(group, "id1", "id2", F.col(score).alias("label")), used, group, ident, feature)
    return out.withColumn("weight", banded_weight(F.col("label")))
