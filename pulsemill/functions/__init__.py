"""Column expressions: each takes columns and returns one column."""

from .counts import first_metric, parse_count, safe_int
from .links import author_handle, canonical_url, status_id
from .scores import combined_signal, engagement_weight, keyword_signal, lexicon_polarity
from .tags import comma_text, hashtags, json_text, mentions, split_tags, tags_or_extract
from .text import nfkc, normalize_text, squeeze_space, strip_space, strip_zero_width, token_set
from .times import coerce_instant, date_key, hour_start, parse_instant

__all__ = [
    "author_handle",
    "canonical_url",
    "coerce_instant",
    "combined_signal",
    "comma_text",
    "date_key",
    "engagement_weight",
    "first_metric",
    "hashtags",
    "hour_start",
    "json_text",
    "keyword_signal",
    "lexicon_polarity",
    "mentions",
    "nfkc",
    "normalize_text",
    "parse_count",
    "parse_instant",
    "safe_int",
    "split_tags",
    "squeeze_space",
    "status_id",
    "strip_space",
    "strip_zero_width",
    "tags_or_extract",
    "token_set",
]
