"""Defaults and bounds of the query surface (fixed values)."""

EMBEDDING_DIM = 384
ENCODE_BATCH = 64
SENTIMENT_BATCH = 256
PRODUCT_TEXT_CHARS = 512
OVERSAMPLE = 8
DEFAULT_TOP_K = 5
MAX_TOP_K = 50
MAX_OVERSAMPLE = 100
IVF_LISTS = 50
IVF_PROBES = 1
ROLLING_WINDOW = 200
CONTEXT_REVIEWS = 15
PROMPT_REVIEWS = 10
CHARS_PER_TOKEN = 4

# Columns a caller may project, and the ones projected when none are named.
PRODUCT_FIELDS = [
    "parent_asin", "title", "subtitle", "author", "main_category", "store",
    "average_rating", "rating_number", "price_raw", "price", "features",
    "description", "categories", "details", "images", "bought_together",
    "ingested_at",
]
DEFAULT_FIELDS = ["parent_asin", "title", "store", "average_rating", "price", "main_category"]
LISTING_FIELDS = [
    "parent_asin", "title", "store", "main_category", "average_rating", "price", "rating_number",
]
DETAIL_FIELDS = [
    "parent_asin", "title", "subtitle", "author", "main_category", "store",
    "average_rating", "rating_number", "price", "price_raw",
    "features", "description", "categories", "details", "images",
]
REVIEW_FIELDS = [
    "review_id", "user_id", "rating", "title", "review_text", "helpful_vote",
    "verified_purchase", "reviewed_at", "sentiment_label", "sentiment_score",
]
SENTIMENT_LABELS = ("positive", "negative")


def bounded(name: str, value, low, high):
    """Check an argument of a public operator against its allowed range."""
    if value is not None and not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value}")
    return value
