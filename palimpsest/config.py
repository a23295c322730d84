"""Constants of the page store that results depend on."""

#: Bytes: default, smallest and largest page.
PAGE_BYTES, MIN_PAGE_BYTES, MAX_PAGE_BYTES = 64 * 1024, 4 * 1024, 16 * 1024 * 1024
#: Overlays on top of each other before a commit writes a flat manifest.
MAX_OVERLAY_DEPTH = 8
#: Most entries of a warm set, for each kind.
WARM_SET_CAP = 512
#: A log segment is sealed after the transaction that reaches this many bytes.
SEGMENT_BYTES = 4 * 1024 * 1024
#: A longer record counts as torn.
MAX_RECORD_BYTES = 16 * 1024 * 1024
DAY_MS = 86_400_000
#: How far a clock may stand behind its high-water mark without a warning.
CLOCK_DRIFT_DAYS = 30
#: Rows of a key range that share a page.
ROWS_PER_PAGE = 64
