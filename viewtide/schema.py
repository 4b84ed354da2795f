"""Canonical table schemas (DDL strings Spark parses)."""

VIEW_REQUESTS = "request_id string, ts timestamp, post_ids array<bigint>, headers map<string,string>"
# Feeds that send one id as a scalar or ids as text are read with raw string ids.
RAW_REQUESTS = "request_id string, ts timestamp, post_id string, headers map<string,string>"
ENGAGEMENT = (
    "event_id bigint, post_id bigint, client_id string, session_id string, ts timestamp, "
    "dwell_ms bigint, scroll_pct double"
)
VIEWS = "event_id bigint, post_id bigint, ts timestamp, ip_hash string"
POSTS = (
    "post_id bigint, post_type string, status string, author_id bigint, published_at timestamp, "
    "title string, link string, excerpt string, thumbnail string"
)
POST_TERMS = "post_id bigint, taxonomy string, term_id bigint, slug string, name string"
ENGAGEMENT_METRICS = "post_id bigint, comments bigint, likes bigint, shares bigint"
COUNTERS = (
    "post_id bigint, total bigint, day bigint, week bigint, month bigint, "
    "yesterday bigint, last_week bigint, last_month bigint"
)
DAILY_BINS = "site_day date, hour_bins array<bigint>, total bigint"
SHAPE = "hour array<double>, wday array<double>"
TREND_STATE = (
    "segment string, post_id bigint, ewma double, ewma_at timestamp, last_score double, "
    "score_at timestamp, streak int, streak_at timestamp"
)
