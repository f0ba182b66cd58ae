"""Scoring rules as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from reviewflow.functions.binding import let

# Length limits of a draft and the score below or up to each.
TEMPLATE_BANDS = {"below": ((100, 0.20), (200, 0.50)), "up_to": ((500, 1.00), (800, 0.80)),
                  "longer": 0.60}
# Share of the score an approval earns by size of the edit.
APPROVAL_BANDS = ((1, 0.60), (50, 0.45), (200, 0.30))
RATING_WEIGHT = 0.40
# Upper limits of the edit classes.
EDIT_BANDS = ((50, "minor"), (200, "major"))
EDIT_REWRITE = "complete_rewrite"
# Draft length classes.
LENGTH_BANDS = ((100, "Very Short"), (250, "Short"), (500, "Medium"), (1000, "Long"))
LENGTH_REST = "Very Long"
# Phrases that mark a greeting and a closing.
GREETINGS = ("hi", "hello", "dear", "good morning", "good afternoon")
CLOSINGS = ("best regards", "sincerely", "regards", "thanks", "thank you")


def template_score(length: Column) -> Column:
    score = None
    for limit, value in TEMPLATE_BANDS["below"]:
        score = (F.when if score is None else score.when)(length < limit, F.lit(value))
    for limit, value in TEMPLATE_BANDS["up_to"]:
        score = score.when(length <= limit, F.lit(value))
    return score.otherwise(F.lit(TEMPLATE_BANDS["longer"]))


def scored_length(final_length: Column, draft_length: Column) -> Column:
    """The final length counts when there is one and it is not zero."""
    return F.coalesce(F.nullif(final_length, F.lit(0)), draft_length)


def quality_score(action: Column, rating: Column, edit_distance: Column) -> Column:
    approved = F.lit(0.0)
    for limit, value in reversed(APPROVAL_BANDS):
        approved = F.when(edit_distance < limit, F.lit(value)).otherwise(approved)
    rated = F.coalesce(rating, F.lit(0)) / F.lit(5.0)
    review = F.when(action == "approved", approved).otherwise(F.lit(0.0))
    score = F.when((action == "rated") & (F.coalesce(rating, F.lit(0)) != 0), rated).otherwise(
        review + rated * F.lit(RATING_WEIGHT))
    return F.bround(F.least(score, F.lit(1.0)), 4)


def edit_type(distance: Column) -> Column:
    named = F.lit(EDIT_REWRITE)
    for limit, label in reversed(EDIT_BANDS):
        named = F.when(distance < limit, F.lit(label)).otherwise(named)
    return F.when(distance > 0, named)


@F.arrow_udf(IntegerType())
def _differences(before: pa.Array, after: pa.Array) -> pa.Array:
    """Texts are taken from the batch one pair at a time."""
    def count(a: str, b: str) -> int:
        x, y = (np.frombuffer(v.encode("utf-32-le"), dtype="<u4") for v in (a, b))
        shared = min(len(x), len(y))
        return abs(len(x) - len(y)) + int(np.count_nonzero(x[:shared] != y[:shared]))

    return pa.array((count(a.as_py(), b.as_py()) for a, b in zip(before, after)), pa.int32(), size=len(before))


def edit_distance(before: Column, after: Column) -> Column:
    """Difference in length plus the number of positions where the shared part differs.

    Characters are compared as whole arrays; an array function would make a value of each
    character and is some fifty times slower on long drafts.
    """
    return _differences(F.coalesce(before, F.lit("")), F.coalesce(after, F.lit("")))


def length_category(length: Column) -> Column:
    named = None
    for limit, label in LENGTH_BANDS:
        named = (F.when if named is None else named.when)(length < limit, F.lit(label))
    return named.otherwise(F.lit(LENGTH_REST))


def draft_indicators(draft: Column, signer: str) -> Column:
    """0 to 3: opens with a greeting, holds a closing, names the signer."""
    any_of = lambda tests: F.greatest(*[t.cast("int") for t in tests])
    return let(F.lower(draft), lambda low: (
        any_of([low.startswith(g) for g in GREETINGS])
        + any_of([low.contains(c) for c in CLOSINGS])
        + low.contains(signer.lower()).cast("int")))


def with_signature(draft: Column, signature: str, endings: list[str]) -> Column:
    def sign(trimmed):
        signed = F.lit(False)
        for ending in endings:
            signed = signed | trimmed.endswith(ending)
        return F.when(signed, draft).otherwise(F.concat(trimmed, F.lit(signature)))

    return let(F.regexp_replace(draft, r"\s+$", ""), sign)
