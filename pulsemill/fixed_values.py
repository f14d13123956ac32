"""Values that results depend on. Every operator takes them as parameters; these are the defaults."""

# Terms that count as bullish.
BULLISH_TERMS = (
    "buy", "bull", "bullish", "breakout", "long", "support", "target", "rally",
    "profit", "gain", "moon", "rocket", "accumulate", "hold", "bounce",
    "teji", "badhat", "kharido", "munafa", "uchaal", "paisa banega",
    "तेज़ी", "खरीदो", "मुनाफा", "बढ़त", "ऊपर जाएगा",
)

# Terms that count as bearish.
BEARISH_TERMS = (
    "sell", "bear", "bearish", "short", "breakdown", "resistance", "downside",
    "crash", "dump", "panic", "drop", "loss", "exit", "correction",
    "mandi", "girawat", "becho", "nuksan", "jahar", "bahar nikal jao", "trap",
    "मंदी", "गिरावट", "बेचो", "जहर", "बर्बाद", "धड़ाम",
)

# A post is promotion when its text holds one of these.
SPAM_TERMS = ("t.me/", "wa.me/", "whatsapp", "telegram", "join channel", "join group")

# An author is automated when the handle holds one of these.
BOT_TERMS = ("bot", "alert", "signal", "algo")

# Ordered topic rules, label and query text (OR between clauses, AND within one).
TOPIC_RULES = (
    ("Q1", "#nifty50"),
    ("Q2", "#sensex OR #bse"),
    ("Q3", "#banknifty OR #banknifty50"),
    ("Q4", "nifty intraday"),
    ("Q5", "nifty options"),
    ("Q6", "sensex today OR nifty today"),
    ("Q7", "indian stock market"),
    ("Q8", "nifty futures OR banknifty futures"),
)

MIN_CONTENT_CHARS = 20

# Weights of one like, one retweet and one reply.
LIKE_WEIGHT, RETWEET_WEIGHT, REPLY_WEIGHT = 1.0, 2.0, 0.5

# Shares of the lexicon and the latent score in the combined signal.
KEYWORD_SHARE, TFIDF_SHARE = 0.6, 0.4

TFIDF_MAX_TERMS = 200
TFIDF_MIN_DOCS = 2
TFIDF_MAX_DOC_SHARE = 0.7
TFIDF_MIN_POSTS = 10

BOOTSTRAP_REPLICATES = 1000
BOOTSTRAP_ALPHA = 0.05
BOOTSTRAP_SEED = 42

# Spark's English stop words, without those holding an apostrophe or
# only one letter, which the term pattern can never produce.
ENGLISH_STOP_WORDS = tuple(
    """
    me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what
    which who whom this that these those am is are was were be been being have has had
    having do does did doing an the and but if or because as until while of at by for
    with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how
    all any both each few more most other some such no nor not only own same so than too
    very can will just don should now cannot could ought would
    """.split()
)

# White space as a regular expression class, valid for both Java and RE2.
SPACE_CLASS = (
    r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# The same characters.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Letters of every script, numbers and underscore.
WORD_CLASS = r"[\p{L}\p{N}_]"

ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"

TOKEN_EDGE_PUNCTUATION = ".,!?:;()[]{}\"'"
