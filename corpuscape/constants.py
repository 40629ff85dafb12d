"""Fixed values. Results depend on them, so they are stated once, here, as plain text."""

# Characters. Java's \w and \s are ASCII; these classes are the Unicode ones.
WORD_CHAR = r"[\p{L}\p{N}_]"
SPACE_CHAR = r"[\s\p{Z}\x1c-\x1f\x85]"
NON_SPACE_CHAR = r"[^\s\p{Z}\x1c-\x1f\x85]"
SYMBOL_CHAR = r"[^\s\p{Z}\x1c-\x1f\x85\p{L}\p{N}_]"
SMALL_NUMBER = r"[1-9]?[0-9]"

# Length profile of a corpus, in words.
HISTOGRAM_BINS = 50
LENGTH_RANGE = (0, 10_000)
LENGTH_STEP = 500
SHORT_CAP = 2_000
SHORT_BINS = 40
BAND_EDGES = (500, 1_000)
BAND_STEP = 25
CDF_BINS = 100
WHISKER = 1.5
TINY_DOC_WORDS = 10
LONG_DOC_WORDS = 2_200
TOP_LONGEST = 20

# Token reports.
TOKEN_SAMPLE = 50_000
TOP_SAMPLE_TOKENS = 30
TOP_SHORT_TOKENS = 20
TOP_CORPUS_TOKENS = 100
TOP_CLEANED_TOKENS = 20
PROBE_WORD = "der"

# Limits that fit a text into an encoder.
CLIP_CHARS = 1_000
WORD_CAP = 450
CHAR_CAP = 2_015
TOKEN_CAP = 500
MODEL_TOKEN_LIMIT = 514
TOKEN_RANGE = (490, 514)
PASSAGE_PREFIX = "passage: "
ENCODE_BATCH = 64

# TF-IDF and topic grouping.
MAX_FEATURES = 200_000
MIN_DOC_FREQ = 5
MAX_DOC_SHARE = 0.5
SVD_COMPONENTS = 100
K_RANGE = (2, 30)
SILHOUETTE_SAMPLE = 20_000
TERMS_PER_CLUSTER = 10

# Vector grouping.
LARGE_K = 15_000
KMEANS_ROUNDS = 20
PCA_DIMS = 100
NEIGHBOURS = 30
GRAPH_DIMS = 10
WIDE_GRAPH_DIMS = 200
MIN_CLUSTER_SIZE = 30
COARSE_MIN_CLUSTER_SIZE = 200
NOISE = -1

# Exploration and classification.
EXAMPLES_PER_CLUSTER = 5
CLUSTERS_SHOWN = 50
STRATIFIED_CLUSTERS = 10
STRATIFIED_ROWS = 1_000
PLOT_ROWS = 10_000
TEST_SHARE = 0.2
TREES = 100
TREE_DEPTH = 16
SEED = 42
