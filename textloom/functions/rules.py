"""Word lists, patterns, limits and messages that results depend on. Nothing here is logic."""

# ---- query normalisation: abbreviation -> full name, applied in this order, case ignored
ABBREVIATIONS = [
    (r"\bdm\b", "District Magistrate and Collector"),
    (r"\bdc\b", "District Collector"),
    (r"\bsdm\b", "Sub-Divisional Magistrate"),
    (r"\bsdo\b", "Sub-Divisional Officer"),
    (r"\bbdo\b", "Block Development Officer"),
    (r"\bdrda\b", "District Rural Development Agency"),
    (r"\bceo\b", "Chief Executive Officer"),
    (r"\badm\b", "Additional District Magistrate"),
    (r"\bdm office\b", "District Magistrate Office Agartala"),
]
REGION_WORD = "tripura"
REGION_SUFFIX = " West Tripura"
DISTRICT = "West Tripura"
DEFAULT_TITLE = "West Tripura Information"
DEFAULT_SOURCE_TITLE = "West Tripura document"

# ---- romanised Bengali words that mark a query as bn_en
ROMANISED = ["kivabe", "kibhabe", "kora", "korbo", "pabo", "jonno", "dorkar", "khobor", "somoy", "ki", "ta", "er", "amar", "ache", "kothay", "number", "office", "lagbe", "chai"]

# ---- intent
GREETING = r"^(hi|hello|hey|namaste|নমস্কার|হ্যালো|good morning|good evening|good afternoon)\b"
THANKS = r"\b(thank you|thanks|ধন্যবাদ|thnx)\b"
THANKS_REPLY = r"\b(thank|thanks)\b|ধন্যবাদ"
SMALL_TALK = ["ok", "okay", "bye", "ধন্যবাদ"]
GENERAL = r"\b(joke|poem|story|movie|song|recipe|weather|capital of|who won|what is ai|what is blockchain)\b"
SIMPLE_FACT = r"\b(phone|number|contact|email|address|location|where|who is|helpline|office)\b|\b(নম্বর|ফোন|যোগাযোগ|ঠিকানা|কোথায়|কে)\b"
SIMPLE_FACT_WORDS = 12

# ---- query analysis: (office, pattern) in order
OFFICES = [
    ("District Magistrate", r"\b(dm|district magistrate|collector)\b|জেলা শাসক|জেলাশাসক"),
    ("Sub-Divisional Magistrate", r"\b(sdm|sub[ -]?divisional magistrate)\b"),
    ("Block Development Officer", r"\b(bdo|block development officer)\b"),
]
TOPICS_V1 = [
    ("contact", r"\b(phone|number|contact|email|helpline)\b|নম্বর|ফোন|যোগাযোগ"),
    ("procedure", r"\b(apply|application|eligib|documents|required|কিভাবে|করব|আবেদন|যোগ্য)\b"),
    ("scheme", r"\b(scheme|yojana|pmay|pm kisan|pension|স্কিম|প্রকল্প)\b"),
]
TOPICS_V2 = [
    ("contact", r"\b(phone|number|contact|email|helpline)\b|নম্বর|ফোন|যোগাযোগ"),
    ("procedure", r"\b(apply|application|eligib|document|documents|required|certificate|register|registration|how do i|where do i|birth|marriage|death)\b|কিভাবে|করব|আবেদন|যোগ্য|নথি|ডকুমেন্ট|শংসাপত্র|সার্টিফিকেট|নিবন্ধন|জন্ম|বিবাহ|মৃত্যু"),
    ("scheme", r"\b(scheme|yojana|pmay|pm kisan|pension|benefit)\b|স্কিম|প্রকল্প|যোজনা|পেনশন"),
]
PROCEDURE_EXPANSION = "application process required documents official form notification PDF"

# ---- retrieval
CANDIDATES, CANDIDATES_PER_HIT, TOP_K, RERANK_TOP_K = 40, 6, 5, 5
RRF_K, ALPHA, MAX_PER_URL = 60, 0.6, 3
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
MIN_INDEXED_CHARS = 20
DENSE_SCORE_FLOOR = 0.40
SOURCE_DENSE, SOURCE_SPARSE, SOURCE_BOTH = "pinecone", "bm25", "hybrid_rrf"
CONFIDENCE_WEIGHTS = {"rerank": 0.55, "lexical": 0.20, "entity": 0.15, "support": 0.05, "gap": 0.05}
CONFIDENCE_LEVELS = [(0.70, "high", "strong_retrieval_evidence"), (0.45, "medium", "retrieval_needs_confirmation"), (None, "low", "insufficient_retrieval_evidence")]
NO_CANDIDATES = "no_candidates"
MAX_EXTRA_CHUNKS = 2
CACHE_PREFIX, CACHE_TTL = "rag:answer:", 300
SESSION_TURNS, SESSION_HISTORY, SESSION_TTL = 8, 4, 7200
RATE_LIMIT, RATE_WINDOW = 60, 60
RATE_EXEMPT = ["/health", "/ready", "/live", "/version"]

# ---- document links
LINK_TYPES = [(".pdf", "PDF"), (".doc", "DOC"), (".docx", "DOCX"), (".xls", "XLS"), (".xlsx", "XLSX"), (".csv", "CSV")]
LINK = r"(?i)https?://[^\s<>\]\[\)\"']+"
LINK_TAIL = ".,;)]"
ASSET_EXTENSIONS = [".pdf", ".docx", ".doc", ".xlsx", ".xls", ".csv", ".txt"]
TRUSTED_HOSTS = ["westtripura.nic.in", "cdn.s3waas.gov.in", "s3waas.gov.in", "drive.google.com"]
TRUSTED_SUFFIX = ".s3waas.gov.in"
DRIVE_HOST = "drive.google.com"
DRIVE_DOWNLOAD = "https://drive.usercontent.google.com/download?id=%s&export=download&confirm=t"

# ---- crawl
SITE = "westtripura.nic.in"
HOME = "https://westtripura.nic.in/"
PRIORITY_WORDS = [
    "citizen", "service", "services", "certificate", "certificates", "form", "forms",
    "scheme", "schemes", "document", "documents", "download", "notice", "announcement",
    "notification", "helpline", "contact", "who-is-who", "division", "office", "department",
    "e-governance", "public-utility", "utility", "bill", "supply", "magisterial", "revenue",
    "social-security", "social", "hospital", "school", "bank", "postal", "electricity",
    "subdivision", "block", "tehsil", "village", "panchayat", "rti", "grievance",
    "recruitment", "tender", "order", "government-order", "disaster", "emergency", "phone",
    "email", "address", "pin-code",
]
PRIORITY_WEIGHT = 0.9
LOW_VALUE_URLS = [
    "*/login*", "*/logout*", "*/admin*", "*/wp-admin*", "*/wp-login*",
    "*/feed*", "*/search*", "*/tag/*", "*/gallery/*", "*/media-gallery*",
    "*/photo-gallery*", "*/audio-gallery*", "*/video-gallery*",
    "*.css", "*.js", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.svg",
    "*.webp", "*.ico", "*.woff", "*.woff2", "*.ttf", "*.xml", "*.json", "*.zip",
]
MAX_DEPTH, MAX_PAGES, MOST_PAGES = 4, 400, 2000

# ---- classification: (category, pattern), first match wins, case ignored
URL_CATEGORIES = [
    ("admission", r"admission|admit|merit.?list|spot.?round|lateral"),
    ("tender", r"tender|quotation"),
    ("syllabus", r"syllabus|syllabi|curriculum"),
    ("scholarship", r"scholarship"),
    ("form", r"form|application"),
    ("gallery", r"gallery"),
    ("newsletter", r"newsletter"),
    ("academic_calendar", r"academic.?calend|calender|semester"),
    ("committee", r"committee|anti.?ragging|council"),
    ("report", r"eoa|aicte|approval"),
    ("contact", r"contact.?us|contactus"),
    ("service", r"service|public.?utility"),
    ("event", r"event"),
    ("about", r"about|history|location|principal"),
    ("faculty_staff", r"faculty|staff|office.?staff"),
    ("department", r"department|cst|itcs|etce|mlt|ft"),
    ("notice", r"notice|notification|circular|past.?notice"),
    ("fee", r"fee.?structure|fee_"),
]
CONTENT_CATEGORIES = [
    ("admission", r"admission|merit list|spot round|lateral entry|ভর্তি"),
    ("tender", r"tender|quotation|দরপত্র"),
    ("syllabus", r"syllabus|curriculum|semester|পাঠ্যক্রম"),
    ("scholarship", r"scholarship|বৃত্তি"),
    ("newsletter", r"newsletter"),
    ("report", r"eoa|aicte|approval process"),
    ("committee", r"committee|anti.?ragging|council|কমিটি"),
    ("fee", r"fee structure|fees?|টিউশন ফি"),
    ("form", r"form|registration|ফর্ম"),
    ("contact", r"contact|যোগাযোগ"),
    ("service", r"service|public.*utility|পরিষেবা"),
    ("gallery", r"gallery|ছবি"),
    ("event", r"event|কার্যক্রম"),
    ("about", r"about|history|location|পরিচিতি"),
    ("faculty_staff", r"faculty|staff|principal|teacher|শিক্ষক"),
    ("department", r"department|cst|itcs|etce|mlt|ft|বিভাগ"),
    ("notice", r"notice|notification|circular|announcement|বিজ্ঞপ্তি|নোটিশ"),
]
DEFAULT_CATEGORY = "general"
CLASSIFIED_CHARS = 2000

# ---- noise: (pattern, flags) removed in this order; i ignores case, m lets ^ and $ meet at lines
PAGE_NOISE = [
    (r"\[.*?Skip to main content.*?\]\(.*?\)", "i"),
    (r"\[.*?সরাসরি মূল কন্টেন্টে.*?\]\(.*?\)", ""),
    (r"^\s*\*?\s*(Search|অনুসন্ধান)\s+(Search|অনুসন্ধান)\s*$", "m"),
    (r"^\s*\*?\s*\[.*?Search.*?\]", "m"),
    (r"\[Site Map\].*?Sitemap.*?\]", "i"),
    (r"\[সাইট ম্যাপ\].*?সাইটম্যাপ.*?\]", ""),
    (r"\[Social Media Links\].*?\]", "i"),
    (r"\[সামাজিক মিডিয়া লিঙ্ক\].*?\]", ""),
    (r"(?:Color Contrast|Text Size|Other Controls|Accessibility Tools)[\s\S]*?(?=\n\S|\Z)", "i"),
    (r"^[\*\- ]*(High Contrast|Normal Contrast|Highlight Links|Invert|Saturation).*$", "im"),
    (r"^[\*\- ]*(Font Size Increase|Normal Font|Font Size Decrease|Text Spacing|Line Height).*$", "im"),
    (r"^[\*\- ]*(Big Cursor|Hide Image|Hide images|Show images).*$", "im"),
    (r"^[\*\- ]*(ফন্ট সাইজ|নর্মাল ফন্ট|ফন্ট সাইজ বৃদ্ধি|ফন্ট সাইজ হ্রাস).*$", "m"),
    (r"\[.*!\[.*\]\(.*\)\]\(.*back2top.*\)", ""),
    (r"!\[.*back2top.*\]\(.*\)", ""),
    (r"!\[.*bar\d?\.gif.*\]\(.*\)", ""),
    (r"^\|?\s*!\[.*logo.*\]\(.*\)\s*\|?\s*$", "im"),
    (r"^\s*!\[.*\]\(.*\)\s*$", "m"),
    (r"^\|[\|\s\-:]+\|$", "m"),
    (r"^\|[\s\|\[\]\(\)\w\d\s\.\/\-\_]+$", "m"),
    (r"\[!\[.*\]\(.*\)\]\(.*\)", ""),
    (r"(?:Copyright|©|Disclaimer|Terms\s*&\s*Conditions|Privacy\s*Policy).*$", "im"),
    (r"^#\s*Server\s*Error$", "im"),
    (r"^##\s*404\s*-", "im"),
]
ERROR_PAGE = [(r"^#\s*Server\s*Error", "im"), (r"^##\s*404\s*-", "im")]
BARE_LINES = ["|", "||", "-", "---", "****", "**", ""]
MIN_CLEAN_CHARS = 100
DOCUMENT_NOISE = [
    (r"!\[[^\]]*\]\([^)]*\)", "i"),
    (r"\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)", "i"),
    (r"\[\s*Back to Top\s*\]\([^)]*\)", "i"),
    (r"^\s*(Copyright|©|Hosted and maintained by NIC|Hosted by NIC).*?$", "im"),
    (r"^\s*(Disclaimer|Privacy Policy|Terms & Conditions).*$", "im"),
    (r"\blogo\b", "i"),
    (r"\bbar\d+\.gif\b", "i"),
    (r"\bback2top\b", "i"),
    (r"^\s*\*{0,2}\s*(Home|About|Contact|Courses|Faculty|Office Staff|Tenders|Alumni|Syllabus|Scholarships|Academic Calender|Newsletters)\s*\*{0,2}\s*$", "im"),
    (r"^\s*\|\s*\[.*?\]\(.*?\)\s*\|.*\|\s*$", "im"),
    (r"^\s*\|\s*\*\*.*?\*\*\s*\|\s*$", "im"),
    (r"^\s*\|\s*\[.*\]\(.*\)\s*$", "im"),
    (r"^\s*\|\s*$", "im"),
    (r"^\s*\[.*\]\(.*\)\s*$", "im"),
    (r"^\s*\*{0,2}\s*(The Institute|The Departments|Other Activities|Objectives|Information for Admission|Financial Requirements|Disciplinary guidelines)\s*\*{0,2}\s*$", "im"),
]
CHUNK_NOISE = [
    (r"\[\s*\]\([^)]*#[Ss]kip[Cc]ontent[^)]*\)\s*\"Skip to main content\"", "i"),
    (r"\[\s*\]\([^)]*#[Ss]kip[Cc]ontent[^)]*\)", "i"),
    (r"\[.*?সরাসরি মূল কন্টেন্টে.*?\]\(.*?\)", ""),
    (r"^[\*\- ]*Search\s+Search", "im"),
    (r"^[\*\- ]*অনুসন্ধান\s+অনুসন্ধান", "m"),
    (r"\[\s*Social Media Links\s*\]", "i"),
    (r"\[\s*Site Map\s*\]", "i"),
    (r"\[\s*সাইট ম্যাপ\s*\]", ""),
    (r"\[\s*সামাজিক মিডিয়া লিঙ্ক\s*\]", ""),
    (r"^(?:[\*\- ]*)?(?:ফন্ট সাইজ|নর্মাল ফন্ট|ফন্ট সাইজ বৃদ্ধি|ফন্ট সাইজ হ্রাস).*$", "m"),
    (r"^(?:[\*\- ]*)?(?:High Contrast|Normal Contrast|Highlight Links|Invert|Saturation|Font Size Increase|Normal Font|Font Size Decrease|Text Spacing|Line Height|Big Cursor|Hide Image|Hide images|Show images|Color Contrast|Other Controls|Text Size).*$", "im"),
    (r"^\s*Accessibility Tools\s*$", "im"),
    (r"^#+\s+More Menu\s*$", "im"),
    (r"^[\*\- ]*\[.*?\]\(.*?\)\s*\"[^\"]*\"$", "m"),
    (r"^[\*\- ]*\[.*?\]\(.*?\)\s*$", "m"),
    (r"!\[.*back2top.*\]\(.*\)", ""),
    (r"!\[.*bar\d?\.gif.*\]\(.*\)", ""),
    (r"!\[.*logo.*\]\(.*\)", "i"),
    (r"^\s*!\[.*\]\(.*\)\s*$", "m"),
    (r"\[!\[.*\]\(.*\)\]\(.*\)", ""),
    (r"\[\s*\]\([^)]*\)\s*", ""),
    (r"\(https?://[^)]*\)", ""),
    (r"\[\s*Government of State Name .*?\]\(.*?\)", ""),
    (r"(?:Content Owned by.*$|Developed and hosted by.*$|Hosted by NIC.*$|Copyright.*$|©|Disclaimer.*$|Privacy Policy.*$|Terms & Conditions.*$|Last Updated:.*$|সর্বশেষ সংষ্করণ:.*$)", "im"),
    (r"^#\s*Server\s*Error", "im"),
    (r"^##\s*404\s*-", "im"),
    (r"^\|[\|\s\-:]+\|$", "m"),
    (r"^\|[\s\[\]\(\)\w\d\s\.\/\-\_]+\|$", "m"),
]
CONTENT_START = r"^#{1,2}\s+(?!More Menu|Home|Skip|Search)"

# ---- chunks
TARGET_TOKENS, MAX_TOKENS, MIN_TOKENS, OVERLAP_TOKENS = 550, 700, 100, 60
LEGACY_MAX_WORDS, LEGACY_MIN_WORDS, LEGACY_LEAST_WORDS = 1000, 30, 3
MIN_CHUNKED_CHARS = 50
SECTION_TOKENS = 300
SEMANTIC_MIN_TOKENS = 80
FIXED_CHARS, FIXED_OVERLAP, FIXED_LEAST_CHARS = 600, 80, 50
SPLIT_TARGET, SPLIT_MAX, SPLIT_OVERLAP, TOKENS_PER_WORD = 400, 500, 50, 1.3
SENTENCE_END = r"(?<=[.!?।])\s+|\n\n+"

# ---- chunk gates
GATE_TOKENS = 30
ERROR_WORDS = ["file or directory not found", "server error", "404", "the resource you are looking for", "temporarily unavailable"]
MENU_TITLES = ["more menu", "navigation", "menu", "sitemap"]
MENU_TOKENS, MENU_LINKS, MENU_PERIODS = 150, 5, 3
PREFIX_CHARS = 150
EMBED_CHARS, EMBED_LEAST_CHARS, EMBED_SPACE_SHARE = 2048, 20, 0.8
HTML_LEAST_WORDS, OTHER_LEAST_WORDS = 10, 5
OCR_WORDS_PER_PAGE = 10
CHAT_CHARS, CHAT_LEAST_CUT = 4000, 500
SHOWN = 5

# ---- messages by language
CONVERSATIONAL = {
    "en": "Hello! 👋 I’m the West Tripura citizen information assistant. How can I help you?",
    "bn": "নমস্কার! 👋 আমি পশ্চিম ত্রিপুরার নাগরিক তথ্য সহায়ক। কী তথ্য জানতে চান?",
    "bn_en": "Nomoskar! 👋 Ami West Tripura citizen information assistant. Ki information jante chan?",
}
THANKED = {
    "en": "You're welcome! 😊 If you need any West Tripura government information, just ask.",
    "bn": "স্বাগতম! 😊 পশ্চিম ত্রিপুরার সরকারি তথ্য জানতে চাইলে জিজ্ঞাসা করুন।",
    "bn_en": "You're welcome! 😊 West Tripura government information lagle just ask.",
}
NOT_VERIFIED = {
    "en": "I couldn't verify this information in the West Tripura government knowledge base. Please verify it through the official district portal.",
    "bn": "আমি পশ্চিম ত্রিপুরার সরকারি তথ্যভাণ্ডারে এই তথ্যটি যাচাই করতে পারিনি। অনুগ্রহ করে অফিসিয়াল জেলা পোর্টাল থেকে যাচাই করুন।",
    "bn_en": "Ami West Tripura official database-e ei information verify korte parini. Official district portal theke verify korun.",
}
DISCLAIMER = {
    "en": "This is general information, not verified West Tripura government information.",
    "bn": "এটি সাধারণ তথ্য; এটি পশ্চিম ত্রিপুরা জেলার সরকারি তথ্য হিসেবে বিবেচনা করবেন না।",
    "bn_en": "Eta general information; etake West Tripura district-er official information hisebe dhorben na.",
}
DOCUMENTS_HEADING = {"en": "📄 Documents you can download", "bn": "📄 ডাউনলোডযোগ্য নথি", "bn_en": "📄 Downloadable documents"}
