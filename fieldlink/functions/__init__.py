"""Scalar expressions, all built from Spark's own functions (no UDF)."""

from fieldlink.functions.paths import (  # noqa: F401
    asset_path,
    basename,
    basename_normpath,
    last_segment,
    relative_to,
    topic_address,
)
from fieldlink.functions.text import (  # noqa: F401
    asset_id,
    epoch_millis,
    ms_to_seconds,
    quote_plus,
    second_word,
    shorten,
    shorten_exact,
    timedelta_text,
    utf8_roundtrip,
)
