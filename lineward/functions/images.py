"""Placement of recognised text in an image."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of the middle and bottom parts, and the least confidence kept.
MIDDLE_FROM, BOTTOM_FROM = 0.33, 0.66
MIN_CONFIDENCE = 0.7


def position(y_top: Column, y_bottom: Column, height: Column) -> Column:
    """Third of the image the middle of a text box lies in; empty when it cannot be told."""
    ratio = F.try_divide((y_top + y_bottom) / 2, height)
    return (F.when(ratio < MIDDLE_FROM, "top").when(ratio < BOTTOM_FROM, "middle")
            .when(ratio.isNotNull(), "bottom").otherwise(""))
