"""Text, id and time expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlink.config import SHORTEN_PLACEHOLDER


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def asset_id(*cols, n: int = 12) -> Column:
    """First ``n`` hex chars of sha256 over the ``:``-joined stable fields.

    Re-ingesting the same item gives the same id (a uuid would not).
    """
    joined = F.concat_ws(":", *[_c(c).cast("string") for c in cols])
    return F.substring(F.sha2(joined, 256), 1, n)


#: White space as ``str.split`` sees it.
_BLANKS = r"(?U)[\s\x1c-\x1f]+"
#: Pieces a line may be cut between: blanks, dashes between words, words up to an inner hyphen, words. As textwrap splits.
_PIECES = (r"""(?U) +|(?<=[\w!"'&.,?])-{2,}(?=\w)"""
           r"|[^ ]+?(?:-(?:(?<=[^\d\W]{2}-)|(?<=[^\d\W]-[^\d\W]-))(?=[^\d\W]-?[^\d\W])"
           r"""|(?= |\z)|(?<=[\w!"'&.,?])(?=-{2,}\w))""")


def shorten(s, width: int, placeholder: str = SHORTEN_PLACEHOLDER) -> Column:
    """``textwrap.shorten(s, width)``: white space collapsed, cut between words or behind hyphens.

    The text is split into pieces, and a fold fills the line: it keeps the end
    of the last piece that leaves room for the placeholder. A piece longer than
    the whole width is cut behind its last hyphen in the line, or where the
    line ends. Equal to Python, whose Unicode tables decide what a letter is.
    """
    if len(placeholder.lstrip()) > width:
        raise ValueError("placeholder too large for max width")
    collapsed = F.trim(F.regexp_replace(_c(s), _BLANKS, " "))
    room = width - len(placeholder)
    # What lies behind twice the width can't change the first line.
    pieces = F.regexp_extract_all(F.substring(collapsed, 1, 2 * width + 8), F.lit(_PIECES), 0)

    def fill(line: Column, piece: Column) -> Column:
        at, best, more = line["at"], line["best"], line["more"]
        n = F.length(piece)
        end = at + n
        fits = more & (end <= width)
        left = F.lit(width) - at
        head = F.regexp_extract(piece.substr(F.lit(1), left), "(?s)^(.*)-", 1)
        cut = at + F.when(head.rlike("[^-]"), F.length(head) + 1).otherwise(left)
        keep = (F.when(fits & (piece != " ") & (end <= room), end)
                .when(more & (n > width) & (left > 0) & (cut <= room), cut).otherwise(best))
        return F.struct(F.when(fits, end).otherwise(at).alias("at"), keep.alias("best"), fits.alias("more"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("best"), F.lit(True).alias("more"))
    kept = F.aggregate(pieces, start, fill, lambda line: line["best"])
    cut = F.when(kept == 0, F.lit(placeholder.lstrip())).otherwise(
        F.concat(collapsed.substr(F.lit(1), kept), F.lit(placeholder)))
    return F.when(F.length(collapsed) <= width, collapsed).otherwise(cut)


def shorten_exact(s, width: int, placeholder: str = SHORTEN_PLACEHOLDER) -> Column:
    """``textwrap.shorten`` itself, as a vectorized (Arrow) pandas UDF.

    Exact also at hyphens, but Python: use it on few rows (after a top-k, as
    :func:`fieldlink.operators.activity.newest` does with ``exact=True``).
    """
    @F.pandas_udf("string")
    def _shorten(col: pd.Series) -> pd.Series:
        import textwrap

        return col.map(lambda v: None if v is None else textwrap.shorten(v, width, placeholder=placeholder))

    return _shorten(_c(s))


def timedelta_text(seconds) -> Column:
    """``str(datetime.timedelta(seconds=n))`` for whole seconds, e.g. ``1 day, 2:03:04``."""
    s = _c(seconds).cast("bigint")
    days = F.floor(s / F.lit(86400)).cast("bigint")
    rem = s - days * F.lit(86400)
    hms = F.format_string("%d:%02d:%02d", (rem / 3600).cast("bigint"),
                          ((rem % 3600) / 60).cast("bigint"), rem % 60)
    day_part = F.concat(days.cast("string"),
                        F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, ")))
    return F.when(days == 0, hms).otherwise(F.concat(day_part, hms))


def ms_to_seconds(ms) -> Column:
    """Milliseconds to whole seconds rounded toward zero, like ``int(ms / 1000)``."""
    c = _c(ms).cast("bigint")
    return F.when(c >= 0, F.floor(c / 1000)).otherwise(-F.floor(-c / 1000)).cast("bigint")


def epoch_millis(ts) -> Column:
    """Epoch milliseconds of a wall-clock (``timestamp_ntz``) value, truncated.

    Computed as a difference of wall-clock values, so the session time zone
    does not enter.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", epoch, _c(ts).cast("timestamp_ntz"))


def quote_plus(s) -> Column:
    """``urllib.parse.quote_plus``: Java's encoder differs only on ``*`` and ``~``."""
    enc = F.url_encode(_c(s))
    return F.replace(F.replace(enc, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def second_word(s) -> Column:
    """``s.split(' ')[1]``, null when there is no second word."""
    return F.try_element_at(F.split(_c(s), " "), F.lit(2))


def utf8_roundtrip(s) -> Column:
    """Encode to UTF-8 bytes and decode back, as the topic client does."""
    return F.decode(F.encode(_c(s), "UTF-8"), "UTF-8")
