from freshet.functions.calendar import bucket, bucket_origin, in_months, not_feb29
from freshet.functions.nulls import div, finite, number

__all__ = ["bucket", "bucket_origin", "div", "finite", "in_months", "not_feb29", "number"]
