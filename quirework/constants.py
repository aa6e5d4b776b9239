"""Thresholds of the structural checks. Fixed values."""

#: Pages of text: coordinates are fractions of the page.
DECIMALS = 5
BAND_TOP, BAND_BOTTOM = 0.14, 0.86
#: Rectangles.
CLAMP, LEAST_WIDTH, LEAST_HEIGHT = 0.005, 0.02, 0.01
SHARED_SHARE, SHARED_HEIGHT, SAME_PLACE = 0.05, 0.004, 0.001
LINT_SHARE, TOUCH = 0.1, 0.005
TALLEST, NARROWEST, SMALLEST = 0.45, 0.05, 0.002
UNIT_TOLERANCE = 0.002
#: Numbered sequences.
OUTLIER_FACTOR, COVERAGE_PERCENT, COLUMN_GAP, BLOCK_GAP = 3, 80, 0.08, 1.7
LONG_GAP = 10_000
#: Repeated lines.
HEADER_SAMPLE, RUNNING_PAGES, RUNNING_CHARS = 12, 3, 16
#: Census of numbered runs.
MIN_RUN, MIN_RUN_COVERED, MAX_STEP, PAGES_BACK, COLUMN_TOLERANCE = 5, 8, 2, 2, 0.04
#: Samples.
SAMPLE_ITEMS, SAMPLE_ANSWERS = 40, 20
#: Names.
MAX_ID, MAX_SECTION, MAX_LABEL, MAX_REGIONS, MAX_ANSWERS = 40, 60, 24, 8, 16
