"""Fixed values of the data formats and rules that this engine reads, applies and writes."""

# The columns of the catalog's CSV file, by position (its own header line names one less).
CSV_COLUMNS = [
    "AppID",
    "Name",
    "Release date",
    "Estimated owners",
    "Peak CCU",
    "Required age",
    "Price",
    "Discount",
    "DLC count",
    "About the game",
    "Supported languages",
    "Full audio languages",
    "Reviews",
    "Header image",
    "Website",
    "Support url",
    "Support email",
    "Windows",
    "Mac",
    "Linux",
    "Metacritic score",
    "Metacritic url",
    "User score",
    "Positive",
    "Negative",
    "Score rank",
    "Achievements",
    "Recommendations",
    "Notes",
    "Average playtime forever",
    "Average playtime two weeks",
    "Median playtime forever",
    "Median playtime two weeks",
    "Developers",
    "Publishers",
    "Categories",
    "Genres",
    "Tags",
    "Screenshots",
    "Movies",
]

# Genres that are software or video; an item that has no other isn't kept.
SOFTWARE_GENRES = [
    "Utilities",
    "Design & Illustration",
    "Animation & Modeling",
    "Video Production",
    "Audio Production",
    "Photo Editing",
    "Web Publishing",
    "Software Training",
    "Game Development",
    "Accounting",
    "Documentary",
    "Episodic",
    "Short",
    "Movie",
    "Tutorial",
]

# Names with one of these anywhere aren't items of their own.
NAME_ANYWHERE = [
    r"\bdemo\b",
    r"\bplaytest\b",
    r"\bbeta test\b",
    r"\bsoundtrack\b",
    r"\boriginal score\b",
    r"\bmusic pack\b",
    r"\bart\s?book\b",
    r"\bwallpaper\b",
    r"\bseason pass\b",
    r"\bexpansion pass\b",
    r"\bcontent pack\b",
    r"\bteaser\b",
    r"\bdedicated server\b",
    r"\btest server\b",
    r"\bbenchmark\b",
    r"\bupgrade pack\b",
    r"\bskin pack\b",
    r"\bcosmetic pack\b",
    r"\bepisode \d+ pack\b",
]

# Words of real titles too, which count only in these places.
NAME_ANCHORED = [
    r"\(\s*dlc\s*\)",
    r"[-–—:]\s*dlc\b",
    r"\bdlc pack\b",
    r"\bost\b\s*$",
    r"[-–—:]\s*ost\b",
    r"\bartwork pack\b",
    r"\btrailer pack\b",
    r"\bsdk\b\s*$",
]

# The tile format. Bit 0 of the flags says that each field is a block of its own.
TILE_MAGIC, TILE_VERSION, TILE_BLOCKS = b"ATLS", 1, 1
TILE_HEADER = "<4sHHI4f"  # magic, version, flags, points, bounding box
TILE_FIELDS = [("x", "<f4"), ("y", "<f4"), ("id", "<u4"), ("category", "<u4"), ("importance", "<u2")]

# The neighbour table's header (magic, version, neighbours a row, rows), then rows of 32-bit ids.
NEIGHBOUR_MAGIC, NEIGHBOUR_VERSION, NEIGHBOUR_HEADER = b"AKNN", 1, "<4sHHI"

# Bands of a share of positive reviews, lower bounds.
SCORE_WORDS = [
    (0.95, "Overwhelmingly positive"),
    (0.8, "Very positive"),
    (0.7, "Mostly positive"),
    (0.4, "Mixed"),
    (0.2, "Mostly negative"),
    (0.1, "Very negative"),
    (0.0, "Overwhelmingly negative"),
]

# Upper bounds of cluster sizes that a purity baseline is drawn for; larger ones count as the last.
SIZE_BINS, LAST_SIZE_BIN = [50, 100, 150, 200, 300, 400, 600, 800, 1200, 1800, 2600, 4000], 10_000

# Rows of one metadata shard, tags of an item in it.
SHARD_ROWS, SHARD_TAGS = 4096, 5

# A node with children and less purity than this is no place of its own; pixels outside the canvas that labels may have.
PRUNE_PURITY, CULL_MARGIN = 0.35, 90
