"""Alert lines as columns, so that they are made on the executors."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# words of a search: runs of letters and digits of any script
TERM = r"[\p{L}\p{N}]+"

# fixed value: how a window bound is written in an alert line
STAMP = "yyyy-MM-dd HH:mm:ss"


def format_alert(
    threshold: int = 2,
    timerange: str = "10 minutes",
    user: str = "username",
    start: str = "window_start",
    end: str = "window_end",
    count: str = "count",
) -> Column:
    """The line of a burst alert."""
    return F.format_string(
        'Alert fired; user=%s, window="%s to %s", count=%d, threshold=%d, timerange=%s',
        F.col(user).cast("string"),
        F.date_format(start, STAMP),
        F.date_format(end, STAMP),
        F.col(count),
        F.lit(threshold),
        F.lit(timerange),
    )


def format_denial_alert(user: str = "username", count: str = "denied_count") -> Column:
    """The line of a denied-then-accessed alert."""
    return F.format_string(
        "ALERT: User %s accessed after %d denials", F.col(user).cast("string"), F.col(count)
    )


def terms_of(text: str | Column) -> Column:
    """The words of a text in order, in lower case, as an array; null for a null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
