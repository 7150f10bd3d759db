"""Fixed values.

Everything in this file is a value that decides results (word lists, patterns,
limits, formats).  Nothing here is logic.  Patterns are written for Java's regex
engine; ``(?U)`` makes ``\\b``, ``\\d``, ``\\w`` and ``\\s`` Unicode-aware.
"""

# ---- fixed values: limits -------------------------------------------------
DEFAULT_INTERVAL_SEC = 300
MIN_GAP_SEC = 120
GAP_FACTOR = 2.5
TITLE_CHARS = 80
SLEEP_TOLERANCE_SEC = 900
HOUR_MIN_SEC = 120
HOUR_BATCH_ITEMS, HOUR_BATCH_CHARS = 6, 32000
DAY_BATCH_ITEMS, DAY_BATCH_CHARS = 4, 6000
ENRICH_BATCH_ITEMS, ENRICH_BATCH_CHARS = 4, 5000
MIN_BATCH_CHARS = 512
OUTPUT_RETENTION_DAYS = 14
SNAPSHOT_RETENTION_DAYS = 20
RETRY_DELAY_MIN = 10
BLOCK_CHARS = 2000
BLOCKS_PER_BATCH = 100
SIMILARITY_THRESHOLD = 0.88
USD_TO_JPY = 150

# ---- fixed values: whitespace as a text split sees it ---------------------
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_CODES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
            0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# ---- fixed values: default exclusion rules --------------------------------
EXCLUDED_APPS = ["1Password"]
LOCKED_APP = "loginwindow"
DOMAIN_KEYWORDS = [
    "bank", "netbank", "onlinebank", "atm", "creditunion", "login", "signin", "auth", "sso",
    "oauth", "account", "pay", "payment", "checkout", "billing", "invoice", "stripe", "paypal",
]
TEXT_KEYWORDS = [
    "ログイン", "サインイン", "パスワード", "暗証番号", "二段階", "認証", "カード番号",
    "セキュリティコード", "お支払い", "請求", "Sign in", "Login", "Password", "One-time", "2FA",
    "Verification", "Card number", "CVV", "Security code", "Billing",
]

# ---- fixed values: redaction patterns and tags ----------------------------
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?U)\b(?:\+?\d{1,3}[- ]?)?(?:\(?\d{2,4}\)?[- ]?)?\d{2,4}[- ]?\d{3,4}\b"
CARD = r"(?U)\b(?:\d[ -]?){13,19}\b"
AUTH_HINTS = [
    "password", "passcode", "otp", "one[- ]time", "2fa", "verification", "secret", "cvv",
    "security code", "card number",
]
EMAIL_TAG, PHONE_TAG, CARD_TAG, AUTH_TAG = (
    "[REDACTED_EMAIL]", "[REDACTED_PHONE]", "[REDACTED_CARD]", "[REDACTED_AUTH]",
)
# (pattern, tag, text that every match holds)
SECRET_PATTERNS = [
    (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----",
     "[REDACTED_PRIVATE_KEY]", "PRIVATE KEY-----"),
    (r"(?U)\bsk-[A-Za-z0-9]{10,}\b", "[REDACTED_API_KEY]", "sk-"),
    (r"(?U)\b(?:ghp|gho|ghu|ghs|github_pat)_[A-Za-z0-9_]{10,}\b", "[REDACTED_TOKEN]", "_"),
    (r"(?U)\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[REDACTED_TOKEN]", "xox"),
    (r"(?U)\bAKIA[0-9A-Z]{16}\b", "[REDACTED_TOKEN]", "AKIA"),
    (r"(?U)\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[REDACTED_TOKEN]", "eyJ"),
]
SECRET_KEY_NAMES = [
    "api[-_]?key", "access[-_]?token", "refresh[-_]?token", "id[-_]?token", "secret",
    "client[-_]?secret", "password", "passcode", "otp", "one[- ]time", "verification[_ -]?code",
    "session", "cookie",
]
SECRET_VALUE = "[^\\s'\"`]{6,}"
SECRET_TAG = "[REDACTED_SECRET]"
# (pattern, tag, texts of which every match holds one; case-blind where the pattern is)
SENSITIVE_PATTERNS = [
    (r"(?iU)\b(?:porn|pornhub|onlyfans|hentai)\b", "[REDACTED_ADULT]", ["porn", "onlyfans", "hentai"]),
    (r"(?iU)\b(?:sex|sexual|xxx)\b", "[REDACTED_ADULT]", ["sex", "xxx"]),
    (r"(?:エロ|アダルト|ポルノ|性行為|自慰|オナニー|AV|エッチ)", "[REDACTED_ADULT]",
     ["エロ", "アダルト", "ポルノ", "性行為", "自慰", "オナニー", "av", "エッチ"]),
    (r"(?iU)\b(?:suicide|self[- ]harm)\b", "[REDACTED_SELF_HARM]", ["suicide", "self"]),
    (r"(?:自殺|自傷)", "[REDACTED_SELF_HARM]", ["自殺", "自傷"]),
]
DERIVED_KEY = r"(?U)\bsk-[A-Za-z0-9_\-]{12,}\b"
DERIVED_KEY_TAG = "sk-…"

# ---- fixed values: entity patterns ----------------------------------------
FILE_EXTENSIONS = (
    "py|md|txt|json|jsonl|toml|ya?ml|sh|zsh|bash|ts|js|tsx|jsx|go|rs|swift|java|kt|rb|php|"
    "csv|tsv|log|env|ini|cfg|conf|sql|sqlite|db|png|jpe?g|gif|webp|pdf|zip|gz|tgz|tar|app"
)
FILE_TOKEN = r"(?iU)(?<![\w/.-])[\w./-]*\.?(?:[\w./-]+)\.(?:" + FILE_EXTENSIONS + r")\b"
WORD = r"[A-Za-z0-9_./-]{4,}"
JA_RUN = r"[\u3040-\u30ff\u4e00-\u9faf]{2,}"
URL = r"(?iU)\bhttps?://[^\s<>()]+"
DOMAIN_ENDS = ["com", "net", "org", "io", "ai", "app", "dev", "co", "jp"]
DOMAIN_PATH = r"(?iU)\b(?:[A-Za-z0-9-]+\.)+(?:" + "|".join(DOMAIN_ENDS) + r")(?:/[^\s<>()]+)?\b"
DOMAIN_END = r"(?iU)\.(?:" + "|".join(DOMAIN_ENDS) + ")"  # whatever DOMAIN_PATH finds holds one
POSIX_PATH = (
    r"(?iU)(?:(?<=\s)|^)(/(?:Users|Applications|System|Volumes|opt|etc|var|tmp|private|Library)/[^\s]+)"
)
URL_TAIL = r"[).,;:】]+$"
URL_ANCHORS = ["platform.openai.com", "calendar.google.com", "chatgpt.com", "github.com"]
API_KEYS_ANCHOR = ("platform.openai.com", "/api-keys")
KEYWORD_MARKERS = ["2>&1", "platform.openai.com", "chatgpt.com", "github.com"]
TRUNCATED_TAILS = ["Con", "Cont", "Conte"]
DEV_SLASH = r"(?U)\bDEV[l|](?=[A-Za-z])"

# ---- fixed values: sentence and equality normalisation --------------------
BULLETS = "▶→・|•"
SENTENCE_ENDS = "。.!?！？"
FIRST_SENTENCE = r"^.*?(?:[。.!?！？▶→・|•](?= )|$)"
QUOTES = "\"'“”‘’（）()【】[]<>"
PUNCT = "、。.!?！？・|•▶→"
SIMILARITY_STRIP = (
    r"(?U)[\s\u3000、。.,!?！？:：;；\-–—/\\()（）「」『』【】\[\]{}<>＜＞\"'・]"
)
FILENAME_FORBIDDEN = r"[\\/:*?\"<>|]"

# ---- fixed values: snippet scores -----------------------------------------
NOISE_LINE = r"(?U)^[•\s←→-]+$"
SHORT_CODE = r"^[A-Z0-9]{1,3}$"
PLAIN_NUMBER = r"(?U)^\d+(?:\.\d+)?$"
SNIPPET_SCORES = {
    "noise": -10, "short": -6, "url": 6, "path": 7, "file": 4, "output": 2, "repo": 3, "api": 3,
    "ja": 1, "sized": 1, "long": -2,
}
OUTPUT_MARKERS = ["2>&1", "stderr", "stdout"]
EVIDENCE_CONTAINS = [
    ("platform.openai.com", 8), ("openai.com", 5), ("github.com", 7), ("chatgpt.com", 5), ("2>&1", 3),
]
EVIDENCE_HOST_PATH = r"(?i)(github\.com|openai\.com|chatgpt\.com|calendar\.google\.com)/"
EVIDENCE_EXTENSION = r"(?U)\.[A-Za-z0-9]{2,5}\b"
EVIDENCE_README = r"(?iU)\bREADME\.md\b"
EVIDENCE_COUNT_PREFIX = (
    r"(?iU)^\d+\s+(?=(github\.com|platform\.openai\.com|chatgpt\.com|calendar\.google\.com))"
)

# ---- fixed values: text predicates ----------------------------------------
TOOLISH_MARKERS = ["http", ".com", " / ", "Google Chrome"]
CONCRETE_TOKEN = (
    r"(?i)(~/|/Users/|github\.com|openai\.com|chatgpt\.com|\.py|\.md|\.jsonl?|\.app|2>&1)"
)
ABSTRACT_MARKERS = [
    "確認", "探索", "参照", "閲覧", "整理", "操作", "作業", "調査", "対応", "実施", "短時間",
    "長時間", "データ", "情報", "関連", "追加", "小規模", "簡易", "前段", "継続",
]
RETRYABLE_TOKENS = [
    "timed out", "timeout", "tempor", "rate limit", "429", "500", "502", "503", "504",
    "service unavailable", "connection reset", "broken pipe",
]

# ---- fixed values: power log ----------------------------------------------
POWER_LINE = (
    r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) ([+-]\d{4})\s+(Sleep|DarkWake|Wake) +\t"
)
ASSERTION_LINE = r"^(\S+)\s+(\d+)$"
SLEEP_STATES = ["Sleep", "DarkWake"]

# ---- fixed values: labels and formats -------------------------------------
UNKNOWN_LABEL = "(unknown)"
REDACTED_TITLE = "[REDACTED]"
UNNAMED_TASK = "（名称未設定）"
WEEKDAYS = ["月", "火", "水", "木", "金", "土", "日"]
TIER_TOP, TIER_HIGH, TIER_MID, TIER_LOW = "最多", "多", "中", "少"
CATEGORIES = ["dev", "meeting", "research", "writing", "admin", "other"]

# ---- fixed values: token prices, USD per 1M (tier, model, in, cached, out) -
TOKEN_PRICES = [
    ("standard", "gpt-5-nano", 0.05, 0.005, 0.40),
    ("flex", "gpt-5-nano", 0.025, 0.0025, 0.20),
    ("batch", "gpt-5-nano", 0.025, 0.0025, 0.20),
]
DEFAULT_MODEL = "gpt-5-nano"

# ---- fixed values: report and week texts ------------------------------------
DAY_SUFFIX = "の日"
WEEK_PAGE_PREFIX = "週次レポート "
WEEK_TEXTS = {
    "title_join": "と", "title_end": "を進めた週", "title_limit": 36, "title_plain": " の振り返り",
    "axis": ("今週は", "を軸に進めた。"),
    "many": "日分の記録から、前半から後半にかけて論点を整理しながら作業を前進させたことが読み取れる。",
    "few": "記録のある日は限られるものの、継続的に進めたテーマが確認できる。",
    "summary_none": "今週の記録をもとに主要テーマを振り返った。",
    "whole": ("週全体では", "を中心に、関連する判断や整理を積み重ねていた。"),
    "next": "次のアクションは、週内で整理した論点を具体的な実装や連携作業へ落とし込むことにある。",
    "detail_none": "週全体の詳細を組み立てるだけの十分な記録はありませんでした。",
    "day_none": "記録不足のため、この日の自然言語要約は生成できませんでした。",
    "week_none": "今週の記録から十分な総括を作れませんでした。",
}
NOTE_TEXTS = {
    "points": ("主な論点は", "、", "。"),
    "overview": "を中心に進めた。",
    "keys": ("週報用の要点として、", "を整理した。"),
}
NOT_RUN = "未実行"

# ---- fixed values: texts of report lines -------------------------------------
UNKNOWN_HOUR, INTENT_HIDDEN, TOTAL = "（不明）", "（観測の要約と近いため省略）", "合計"

# ---- fixed values: states of the day job and the week job --------------------
HOURS_MISSING, HOURS_UNAVAILABLE = "hourly_llm_missing:", "hourly_llm_unavailable"
WEEK_ERRORS = {"partial": "report_written_with_partial_snapshots", "fallback": "report_written_with_fallback_clustering"}
