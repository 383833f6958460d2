"""Bounds of the search interface (fixed values)."""

MAX_QUERY_BYTES = 4096
MAX_QUERY_GROUPS = 32
MAX_QUERY_TERMS = 128
MAX_REGEX_TERMS = 8
MAX_PAGE_ROWS = 64
MAX_VOLUMES = 26
MAX_LIVE_RESULTS = 64
EVENT_QUEUE = 256
MAX_PATH_BYTES = 98_301
#: Compiled size of a regular expression, in states, about.
MAX_REGEX_STATES = 20_000
