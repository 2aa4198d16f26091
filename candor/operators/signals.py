"""Plain-language reasons for a score: the strongest contributions, in words."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.operators.model import SoftModel, explain

TOP = 3


def _whole(v: float) -> int:
    return int(round(v))


def _unit(n: int, one: str) -> str:
    return f"{n} {one if n == 1 else one + 's'}"


def _side(v: float) -> str:
    return "above" if v > 0 else "below"


def _few(none: str, few: str) -> Callable[[float], str]:
    return lambda v: none if _whole(v) == 0 else few.format(_whole(v))


def _age(v: float) -> str:
    return "Account created the same day as the review" if _whole(v) <= 0 else f"Account created {_unit(_whole(v), 'day')} before the review"


# Wordings that callers rely on.
WORDING: dict[str, str | Callable[[float], str]] = {
    "account_age_days_at_review": _age,
    "max_sim_to_user_history": lambda v: f"Text {round(v * 100)}% similar to another review by the same user",
    "max_sim_to_business_reviews": lambda v: f"Text {round(v * 100)}% similar to another review of this business",
    "is_in_burst_window": "Posted during a burst of reviews on this business",
    "total_reviews": lambda v: "This is among the reviewer's very first reviews" if _whole(v) <= 1 else f"Reviewer has only {_whole(v)} total reviews",
    "friend_count": _few("Reviewer has no friends on the platform", "Friends of the reviewer: {}"),
    "stars": lambda v: f"An extreme {_whole(v)}-star rating",
}
WORDING |= {
    "char_length": lambda v: f"The text has just {_unit(_whole(v), 'character')}",
    "word_count": lambda v: f"The text has just {_unit(_whole(v), 'word')}",
    "sentence_count": lambda v: f"The text ends {_unit(_whole(v), 'sentence')}",
    "exclamation_ratio": "Many of the characters are exclamation marks",
    "caps_ratio": "Many of the letters are capitals",
    "first_person_ratio": "The writer speaks of themselves more or less than others do",
    "vader_compound": lambda v: f"The text as a whole is {'praise' if v > 0 else 'complaint'}",
    "vader_pos": "Nearly every telling word is praise",
    "vader_neg": "Nearly every telling word is a complaint",
    "vader_neu": "The text shows hardly any feeling",
    "flesch_reading_ease": "The text is easier or harder to read than most",
    "stars_delta_from_business_mean": lambda v: f"{abs(v):.1f} stars {_side(v)} what others give this business",
    "stars_delta_from_user_mean": lambda v: f"{abs(v):.1f} stars {_side(v)} what this reviewer usually gives",
    "hours_since_prev_review_on_business": lambda v: "Came within the hour of the review before it" if v < 1 else f"Came {_unit(_whole(v), 'hour')} after the review before it",
    "business_review_count_at_time": lambda v: f"Number {_whole(v)} of the reviews of this business",
    "fan_count": _few("Nobody follows the reviewer", "Followers of the reviewer: {}"),
    "photo_count": _few("No photo of the reviewer's has been praised", "Praised photos of the reviewer: {}"),
    "account_age_days_snapshot": lambda v: f"The account is {_unit(_whole(v), 'day')} old",
    "reviews_per_month": lambda v: f"The reviewer writes {v:.1f} reviews a month",
    "rating_variance": "The reviewer's ratings hardly differ",
    "rating_skew": "The reviewer's ratings lean to one side",
    "avg_review_length": lambda v: f"The reviewer's texts have {_unit(_whole(v), 'character')} on average",
    "fraction_extreme_ratings": lambda v: f"{round(v * 100)}% of what the reviewer gives is one star or five",
    "posting_hour_entropy": "The reviewer posts at much the same hours",
}


def render(feature: str, value: float) -> str:
    wording = WORDING.get(feature)
    if wording is None:
        return f"Atypical value for {feature.replace('_', ' ')}"
    return wording if isinstance(wording, str) else wording(float(value))


def top_signals(features: list[str], values: list[float], contributions: list[float], k: int = TOP) -> list[str]:
    """The k largest contributions above zero, the largest first."""
    raising = sorted((i for i, c in enumerate(contributions) if c > 0), key=lambda i: -contributions[i])
    return [render(features[i], values[i]) for i in raising[:k]]


def with_signals(rows: DataFrame, model: SoftModel, id_col: str = "review_id") -> DataFrame:
    """The feature rows with signals: the strongest contributions of known values, in words."""
    names = list(model.features)

    def tell(values: pd.Series, contributions: pd.Series) -> pd.Series:
        return pd.Series([top_signals(names, v, [c if x == x else 0.0 for x, c in zip(v, told, strict=True)]) for v, told in zip(values, contributions, strict=True)])

    # nulls as NaN, which compares unequal to itself
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names])
    told = explain(rows, model, id_col).drop("base")
    joined = rows.join(told, id_col)
    return joined.withColumn("signals", F.pandas_udf(tell, "array<string>")(values, F.col("contributions"))).drop("contributions")
