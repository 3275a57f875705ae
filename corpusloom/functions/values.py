"""Word lists, patterns and limits that results depend on."""

# These must be exactly what earlier results were made with.
STOPWORDS = ("yang", "dan", "di", "ke", "untuk", "dengan", "ini", "itu", "atau", "dari", "pada", "juga")
BLOCK_WINDOW = 200
BLOCK_PHRASES = ("access denied", "enable javascript and cookies", "checking your browser", "attention required")
SOFT_PHRASES = ("captcha", "login", "sign in", "subscribe", "berlangganan", "cookie", "privacy policy", "all rights reserved")
SOFT_PENALTY = 8
QUALITY_THRESHOLD = 80
MAX_LENGTH = 20000
MIN_LENGTH = 500
MIN_PARAGRAPHS = 5
MAX_HTML = 1500000
TITLE_THRESHOLD = 0.15
LENGTH_POINTS = ((1000, 25), (500, 15), (300, 10))
WORD_POINTS = ((150, 25), (70, 15), (40, 5))

# Patterns of the normaliser.
URL = r"https?://\S+|www\.\S+"
EMAIL = r"[\w\.-]+@[\w\.-]+\.\w+"
PORTAL_PATTERNS = (
    r"(?i)(baca juga|simak juga|berita terkait)\s*:[^.\n]*\.?",
    r"(?i)(reporter|editor|penulis|pewarta|jurnalis)\s*:\s*[^.\n]*\.?",
    r"(?i)(berlangganan|iklan|advertisement|sponsor)\s*[^.\n]*\.?",
    r"(?i)(copyright|©|hak cipta)\s*[^.\n]*\.?",
    r"(?i)(scroll ke bawah|mau berita terbaru|pilihan untuk lu)\s*[^.\n]*\.?",
)
PHOTO_CREDIT = r"(?i)\(\s*(Foto|Instagram|Dok|Istimewa|Antara)[^)]*\)"
#: What a text must hold, in lower case, for the pattern of the same place to match.
PORTAL_SIGNS = (("baca juga", "simak juga", "berita terkait"), ("reporter", "editor", "penulis", "pewarta", "jurnalis"), ("berlangganan", "iklan", "advertisement", "sponsor"), ("copyright", "©", "hak cipta"), ("scroll ke bawah", "mau berita terbaru", "pilihan untuk lu"))
TITLE_MARKS = r"""[\[\]\(\)\{\}"':;,!?./]"""

# Patterns of the enrichment cleaner.
INTERFACE_PATTERNS = (
    r"(?i)(Tags\s*:|Berita Lainnya|Dark/Light Mode|BREAKINGNEWS).*?(?=\n|$|\.)",
    r"(?i)Gambas\s*:\s*Video\s*\w+",
    r"(?i)Dilarang keras mengambil konten.*?(?=\n|$|\.)",
    r"(?i)Baca berita selengkapnya.*?(?=\n|$|\.)",
    r"(?i)(Simak juga|Baca Juga|Berita Terkait)\s*:.*?(?=\n|$|\.)",
    r"(?i)(Reporter|Editor|Penulis|Pewarta|Jurnalis)\s*:\s*.*?(?=\n|$|\.)",
    r"(?i)(Pilihan untuk lu|Sumber:).*?(?=\n|$|\.)",
    r"(?i)Sponsor.*?(?=\n|$|\.)",
)

#: What a text must hold, in lower case, for the pattern of the same place to match.
INTERFACE_SIGNS = (("tags", "berita lainnya", "dark/light mode", "breakingnews"), ("gambas",), ("dilarang keras",), ("baca berita",), ("simak juga", "baca juga", "berita terkait"), ("reporter", "editor", "penulis", "pewarta", "jurnalis"), ("pilihan untuk lu", "sumber:"), ("sponsor",))

# Signs of a page that is shown instead of the article.
INTERSTITIAL_PATTERNS = (
    r"just a moment",
    r"checking your browser before accessing",
    r"attention required.{0,10}cloudflare",
    r"verify you are human",
    r"ddos protection by cloudflare",
    r"enable javascript and cookies to continue",
    r"unusual traffic from your computer network",
    r"sedang memeriksa browser anda",
)
HOMEPAGE_PATHS = ("", "/", "/index.html", "/index.php")

# Reasons of failure and their categories.
REASON_CATEGORY = {
    "media_timeout": "timeout",
    "shortener_timeout": "timeout",
    "waf_cloudflare": "blocked",
    "shortener_failed": "dead_link",
    "empty_url": "dead_link",
    "media_error": "network_error",
    "shortener_error": "network_error",
    "thread_crash": "network_error",
    "extract_empty": "extract_empty",
    "max_retries_exceeded": "max_retries_exceeded",
}
RETRYABLE = ("max_retries_exceeded", "media_timeout", "shortener_timeout", "http_403", "http_429", "http_500", "http_502", "http_503", "media_error", "shortener_error")
MAX_ATTEMPTS = 3

# Words of the lexicon baseline.
POSITIVE = (
    "baik", "bagus", "sukses", "dukung", "positif", "berhasil", "prestasi", "maju", "apresiasi", "puji", "unggul", "menguntungkan", "cerdas", "juara", "memuaskan",
    "stabil", "aman", " sejahtera", "tumbuh", "naik", "optimis", "solusi", "setuju", "tepat", "bangga", "harmonis", "kompak", "menguat", "mantap",
)
NEGATIVE = (
    "buruk", "gagal", "korupsi", "skandal", "kritik", "negatif", "turun", "rugi", "tersangka", "konflik", "demo", "tuntut", "salah", "kecewa", "rusak", "krisis",
    "anjlok", "jatuh", "ancaman", "pelanggaran", "diduga", "terlibat", "didakwa", "desak", "bentrok", "tegas", "kritisi", "cabut", "batal", "murka", "kecam",
)

# Words that steer the context window.
ACTIVE_MARKERS = (
    "mengkritik", "menyindir", "menolak", "mengecam", "menegaskan", "menyatakan", "mengatakan", "menuding", "menyerang", "membela", "menilai", "mengaku", "mengklaim",
    "mengimbau", "mengingatkan", "menyampaikan", "menjelaskan", "menambahkan",
)
PASSIVE_MARKERS = ("dikecam", "dikritik", "dipuji", "ditahan", "dipecat", "dituding", "dituduh", "dilaporkan", "dicekal", "disindir")
ATTRIBUTION = ("kata", "ujar", "tegas", "tutur", "sebut", "ungkap", "papar", "jelaskan", "tambahkan", "nyatakan")
PRONOUNS = ("dia", "ia", "beliau", "mereka", "nya")
QUOTES = "\"“”‘’"
MAX_CONTEXT_WORDS = 180

# Words of the name discovery.
NOT_A_PERSON = (
    "indonesia", "jakarta", "jawa", "sumatera", "sulawesi", "kalimantan", "bali", "pemerintah", "kementerian", "dpr", "mpr", "bawaslu", "kpu", "golkar", "pdip",
    "partai", "koalisi", "oposisi", "kabinet", "pemilu", "pilkada", "republik", "pers", "media", "tv", "kompas", "detik", "tribun", "rakyat", "umum", "nasional",
)
TITLE_KEYWORDS = ("politik", "presiden", "wapres", "menteri", "gubernur", "bupati", "walikota", "capres", "cawapres", "ketua", "sekjen", "partai", "pemilu", "pilkada")

# Boiler-plate of the full-text audit and of the curation.
AUDIT_BOILERPLATE = r"(?i)(Baca Juga|Simak Juga|Berita Terkait|Advertisement|Iklan)"
AUDIT_HITS = 5
AUDIT_STOPWORDS = ("yang", "dan", "di", "ke", "untuk", "dengan", "ini", "itu", "atau")
CURATION_BOILERPLATE = r"(?i)(Baca Juga|Simak Juga|Berita Terkait|Advertisement|Ikuti Kami|Copyright|©|Reportase:|Jurnalis:|Editor:).*?(?=\n|$)"
MAX_BOILERPLATE = 0.20
MAX_PER_MEDIA = 500
MAX_PER_ENTITY = 300

# Words of our own before a name that make it a modifier, for lack of a parser.
DEPENDENTS = ("milik", "dari", "of", "von", "de", "del")

# Frequent words by language, for lack of a language detector.
PROFILES = {
    "id": ("yang", "dan", "di", "untuk", "dengan", "ini", "itu", "dari", "pada", "tidak", "akan", "dalam"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "with"),
    "fr": ("le", "la", "les", "des", "et", "est", "dans", "pour", "que", "une", "du", "sur"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "auf", "ist", "nicht"),
    "es": ("el", "los", "las", "que", "y", "en", "por", "con", "una", "para", "del", "se"),
}

# Words of the synthetic corpus, for the same operators on it.
CORPUS_STOPWORDS = ("the", "of", "and", "to", "in", "is", "it", "for", "was", "on", "are", "as")
CORPUS_POSITIVE = ("the", "that", "with", "est", "und", "que")
CORPUS_NEGATIVE = ("idiot", "loser", "stupid", "trash", "scum", "moron", "clown", "pathetic", "worthless", "disgusting")
