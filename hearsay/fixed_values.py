"""Word lists, patterns and constants that determine results.

They are part of the definition of the operators, so they are stated here
together and in their natural order.
"""

# --- fixed values: sentiment lexicon ---
POSITIVE_WORDS = [
    "love", "amazing", "great", "best", "perfect", "beautiful", "gorgeous",
    "talented", "queen", "king", "icon", "legend", "ate", "slayed", "fire",
    "obsessed", "adorable", "stunning", "incredible", "phenomenal",
]
NEGATIVE_WORDS = [
    "hate", "terrible", "worst", "awful", "disgusting", "cringe", "yikes",
    "toxic", "problematic", "cancelled", "flop", "trash", "mess", "disaster",
]
POSITIVE_EMOJIS = ["❤️", "😍", "🥰", "😊", "🔥", "✨", "👑", "💯", "🙌", "👏"]
NEGATIVE_EMOJIS = ["😡", "🤮", "💔", "😤", "🙄", "😬", "👎", "😒"]

# --- fixed values: scoring constants ---
MIN_LEXICON_HITS = 2
ESCALATE_BELOW_CONFIDENCE = 0.7
ESCALATE_BELOW_STRENGTH = 0.2
RULE_MODEL = "rule_based"

# --- fixed values: entity matching ---
PRONOUNS = ["she", "her", "hers", "he", "him", "his"]
TOKEN_PATTERN = r"(?U)\b[a-zA-Z']+\b"
CONFIDENCE_NAME = 1.0
CONFIDENCE_ALIAS = 0.9
CONFIDENCE_FIRST_IN_CONTEXT = 0.75
CONFIDENCE_FIRST_UNIQUE = 0.65
CONFIDENCE_LAST_IN_CONTEXT = 0.7
CONFIDENCE_LAST_UNIQUE = 0.6
CONFIDENCE_PRONOUN = 0.45
CONFIDENCE_DISCOVERED = 0.7

# --- fixed values: multi-signal analyses ---
EMOTIONS = ["anger", "disgust", "joy", "disappointment", "sarcasm", "neutral"]
STANCES = ["support", "oppose", "neutral"]
DEFAULT_ENTITY_CONFIDENCE = 0.8
MIN_ENTITY_CONFIDENCE = 0.7
EMOTION_CONFIDENCE = 0.8
TOPIC_CONFIDENCE = 0.7
TOXICITY_CONFIDENCE = 0.8
SARCASM_CONFIDENCE = 0.7
STANCE_FALLBACK_CONFIDENCE = 0.7
STANCE_FALLBACK_SCORE = 0.5
DISAMBIGUATION_HINTS = [
    (("Justin", "Baldoni"), " (the director, not Justin Bieber)"),
    (("Blake", "Lively"), " (the actress, not Blake Shelton)"),
]

# --- fixed values: names that are not entities ---
NOT_SCORED_NAMES = [
    "omg", "lol", "wtf", "idk", "tbh", "imo", "imho", "fyi", "btw",
    "mexico", "america", "usa", "uk", "canada",
    "today", "tomorrow", "yesterday", "here", "there",
    "love", "hate", "best", "worst", "amazing", "beautiful",
    "photo", "video", "image", "picture", "story", "stories",
]
FUNCTION_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "must", "can",
]
BOILERPLATE_NAMES = [
    "getty images", "getty", "swipe", "universe", "tap", "link", "bio",
    "comment", "comments", "like", "share", "follow", "click",
    "harper", "bazaar", "vogue", "elle", "glamour", "cosmopolitan",
    "photo", "video", "image", "picture", "story", "stories",
    "instagram", "facebook", "twitter", "tiktok", "youtube",
    "today", "tomorrow", "yesterday", "week", "month", "year",
    "love", "hate", "best", "worst", "amazing", "beautiful",
    "images", "see more", "link in bio", "linkinbio", "link in description",
    "double tap", "follow me", "dm", "dm me", "highlight", "highlights",
    "reels", "reel", "post", "posts", "feed", "grid", "save", "bookmark",
    "tag", "tags", "hashtag", "hashtags", "ad", "sponsored", "paid",
    "collaboration", "collab", "partnership", "partner", "credit", "credits",
    "photographer", "caption", "insta", "ig", "more", "magazine", "mag",
]
BOILERPLATE_PHRASES = [
    "getty images", "swipe to see", "link in bio", "see more",
    "double tap", "follow me", "dm me", "link in description",
    "harper's bazaar", "vanity fair", "link in story", "check story",
    "people magazine",
]
REPORT_BLOCKLIST = [
    "getty images", "getty", "swipe", "universe", "tap", "link", "bio",
    "comment", "comments", "like", "share", "follow", "click",
    "harper", "bazaar", "vogue", "elle", "glamour", "cosmopolitan",
    "photo", "video", "image", "picture", "story", "stories",
    "instagram", "facebook", "twitter", "tiktok", "youtube",
    "today", "tomorrow", "yesterday", "week", "month", "year",
    "love", "hate", "best", "worst", "amazing", "beautiful",
    "images", "see more", "link in bio", "linkinbio", "more", "magazine", "mag",
    "omg", "lol", "wtf", "idk", "tbh", "imo", "imho", "fyi", "btw",
    "mexico", "america", "usa", "uk", "canada",
]
# Unicode ranges of emoji; the wide range also rejects CJK text on purpose.
EMOJI_ONLY_PATTERN = r"^[\x{1F300}-\x{1F9FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F1E0}-\x{1F1FF}]+$"
WIDE_SYMBOL_PATTERN = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
    r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]"
)

# --- fixed values: storylines ---
STORYLINES = [
    "divorce", "pregnancy", "breakup", "engagement",
    "controversy", "scandal", "lawsuit", "feud",
    "collab", "collaboration", "comeback", "retirement",
    "new album", "new movie", "new show", "tour",
    "award", "nomination", "win", "loss",
]
STORYLINE_MIN_LIKES = 10
STORYLINE_COMMENTS = 200
STORYLINE_MIN_HITS = 3
STORYLINE_KEEP = 5

# --- fixed values: report limits ---
TOP_ENTITIES_NARRATIVE = 3
TOP_ENTITIES_TABLE = 10
TREND_ENTITIES = 7
MAX_VELOCITY_ALERTS = 8
MAX_DISCOVERED = 10
ALERT_PERCENT = 30
CRITICAL_PERCENT = 50
VELOCITY_HOURS = 72
