"""Values that must equal the reference behaviour for results to match.

FIXED VALUES — kept verbatim, in their natural order. Do not edit them to make a
test pass; they define the semantics.
"""

from __future__ import annotations

# --- FIXED VALUES: url normalisation ------------------------------------------
# Query parameters removed by normalize_url (compared on the lower-cased,
# percent-decoded name).
TRACKING_PARAMS = [
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "utm_id",
    "gclid",
    "fbclid",
    "mc_cid",
    "mc_eid",
    "ref",
    "source",
]

# Schemes whose last path segment may carry ";params" (Python urllib).
SCHEMES_WITH_PARAMS = [
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp",
    "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel",
]

# Schemes that get an explicit "//" authority marker when rebuilt (Python urllib).
SCHEMES_WITH_NETLOC = [
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
    "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync",
    "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss",
    "itms-services",
]

# --- FIXED VALUES: relevance scoring ------------------------------------------
# Category -> keywords. A category is active when its name is a substring of the
# lower-cased topic; each of its keywords found in the haystack adds 5.
TOPIC_KEYWORDS = {
    "ai": ["ai", "llm", "model", "agent", "inference", "rag", "copilot", "openai", "anthropic"],
    "devops": ["devops", "platform", "sre", "observability", "ci/cd", "deployment", "incident"],
    "kubernetes": ["kubernetes", "k8s", "container", "pod", "cluster", "helm", "operator"],
    "aws": ["aws", "amazon", "lambda", "eks", "ec2", "s3", "rds", "iam", "bedrock"],
    "terraform": ["terraform", "opentofu", "iac", "infrastructure as code"],
    "security": ["security", "vulnerability", "cve", "zero trust", "supply chain", "auth"],
    "data": ["data", "warehouse", "lakehouse", "iceberg", "delta", "analytics", "pipeline"],
    "local ai": ["local", "ollama", "llama.cpp", "gguf", "on-device", "private ai"],
}
TOPIC_WORD_POINTS = 8
KEYWORD_POINTS = 5
TOPIC_SPLIT_PATTERN = "[^a-z0-9.+#-]+"
TOPIC_MIN_WORD_LEN = 3  # words of length > 2

DEFAULT_FEED_WEIGHT = 0.5
RECENCY_BONUS_DAYS = 14
DEFAULT_DAYS = 14
DEFAULT_LIMIT = 6
MAX_PER_SOURCE = 2

# --- FIXED VALUES: page extraction --------------------------------------------
MAX_DOWNLOAD_BYTES = 2_000_000
MIN_EXTRACTED_CHARS = 700
MAX_ANALYSIS_CHARS = 18_000
TRUNCATION_MARKER = "[Truncated for analysis]"
MIN_BLOCK_CHARS = 20
MAX_FALLBACK_CONTAINERS = 200

BOILERPLATE_TAGS = [
    "script", "style", "noscript", "svg", "canvas", "iframe", "form", "nav",
    "header", "footer", "aside", "button",
]
NOISE_ATTRIBUTE_PATTERN = "cookie|consent|subscribe|newsletter|signup|sign-up|social|share|related|advert|promo|modal|paywall|breadcrumb|comments"
# Elements that never have content (HTML, with the obsolete ones that parsers still know).
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer",
]
NOISE_ATTRIBUTES = ["id", "class", "role", "aria-label"]
POSITIVE_CONTAINER_PATTERN = "article|post|content|main|entry|story"
NEGATIVE_CONTAINER_PATTERN = "nav|menu|footer|header|sidebar|related"
BLOCK_TAGS = ["h1", "h2", "h3", "p", "li", "blockquote", "pre"]
HEADING_TAGS = ["h1", "h2", "h3"]
# Preferred container selectors, in priority order; the fallback list is used
# only when none of them matches.
PREFERRED_CONTAINER_SELECTORS = [
    "article",
    "main article",
    "main",
    "[role='main']",
    ".post-content",
    ".entry-content",
    ".article-content",
    ".blog-post",
    ".content",
]
FALLBACK_CONTAINER_TAGS = ["article", "main", "section", "div"]

EXTRACTION_STATUSES = [
    "unsupported-url", "http-error", "url-error", "timeout", "fetch-error",
    "non-html", "too-short", "ok",
]

# --- FIXED VALUES: model output -----------------------------------------------
VALID_RECOMMENDATIONS = ["read", "skim", "watch", "ignore"]
RECOMMENDATION_ORDER = {"read": 0, "skim": 1, "watch": 2, "ignore": 3}
DEFAULT_RECOMMENDATION = "watch"
SPINNER_FRAMES = "⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏"
RAW_SUMMARY_CHARS = 500
SCORE_FIELDS = ["signal_score", "fluff_score", "technical_depth", "novelty", "relevance"]
TEXT_FIELDS = ["summary", "why_selected", "skeptical_take", "suggested_action"]
LIST_FIELDS = [
    "technically_sound_claims", "marketing_or_hype", "claims_to_verify",
    "why_it_matters_to_me", "tags",
]
# Field order of the normalised analysis record.
ANALYSIS_FIELDS = [
    "recommendation", "signal_score", "fluff_score", "technical_depth", "novelty",
    "relevance", "summary", "why_selected", "technically_sound_claims",
    "marketing_or_hype", "claims_to_verify", "why_it_matters_to_me",
    "skeptical_take", "suggested_action", "tags",
]
ERROR_WHY_SELECTED = "Analysis failed."
ERROR_SKEPTICAL_TAKE = "No useful judgment was produced because analysis failed."
ERROR_SUGGESTED_ACTION = "Check the local model/runtime configuration."
ERROR_TAG = "analysis-error"

# --- FIXED VALUES: report -------------------------------------------------------
EMPTY_FIELD_VALUES = [
    "",
    "not specified.",
    "no skeptical take produced.",
    "no action suggested.",
    "none called out.",
]
NO_SUMMARY_TEXT = "No useful summary produced."
UNKNOWN_SOURCE = "unknown source"
UNTITLED = "Untitled"
NO_ARTICLES_TEXT = "No articles cleared the attention filter."
DIGEST_INTRO = "This digest is ranked for signal, relevance, technical substance, and low tolerance for vendor fluff."
MANUAL_INTRO = "This is an ad-hoc skeptical analysis of manually supplied URLs."
MANUAL_CONTENT = "Manual URL submission. Use extracted article text if available; otherwise analyze this URL cautiously with fallback metadata."
CONTENT_SOURCE_EXTRACTED = "extracted_article_text"
CONTENT_SOURCE_FALLBACK = "search_excerpt_fallback"
SLUG_DEFAULT = "manual-analysis"
SLUG_MAX_LEN = 60
RECENT_LIMIT = 5

# --- FIXED VALUES: status messages of the extraction ladder ---------------------
MSG_UNSUPPORTED_URL = "Only http/https URLs are supported"
MSG_TIMEOUT = "Timed out after {seconds}s"
MSG_NON_HTML = "Unsupported content type: "
MSG_UNKNOWN_CHARSET = "unknown encoding: "
MSG_TOO_SHORT = "Extracted text too short ({n} chars)"

# --- FIXED VALUES: digest text --------------------------------------------------
DIGEST_TITLE_PREFIX = "# 🔍 Topic: "
MANUAL_TITLE_PREFIX = "# Manual article analysis: "
WORTH_ATTENTION = "# Worth attention"
REJECTED_SECTION = "# Rejected / low signal"
BEST_CANDIDATE_PREFIX = "Best candidate: "
COUNTS_LINE = "Today: {read} read, {skim} skim, {watch} watch, {ignore} ignore."
DETAIL_TITLES = [
    ("technically_sound_claims", "Technically sound claims"),
    ("marketing_or_hype", "Marketing / hype / weak spots"),
    ("claims_to_verify", "Claims to verify"),
    ("why_it_matters_to_me", "Why it may matter to me"),
]

# --- FIXED VALUES: the analysis prompt template and its placeholders (replaced in this order)
ANALYSIS_PROMPT = """You are a skeptical technical analyst filtering articles for a senior DevOps/platform engineer.

The reader is interested in practical infrastructure, AWS, Kubernetes, Terraform, DevOps/platform engineering, AI agents/tools, local/private AI, data infrastructure, security/ops risk, and useful emerging technology.

The reader has limited time and dislikes vendor fluff, generic trend pieces, SEO explainers, recycled content, and ungrounded hype.

Analyze the article candidate below. Decide whether it is worth the reader's attention. Separate technically meaningful claims from marketing language. Penalize thin vendor announcements and generic trend content. Prefer concrete technical details, independent evidence, operational lessons, architecture, benchmarks, failure modes, and practical implications.

Important limitation: the content_source field says whether the text is extracted article text or only a search-generated excerpt/summary. If evidence is thin, reflect that in the scores and claims_to_verify. Be more confident when content_source is extracted_article_text and extraction_status is ok.

Return strict JSON only with exactly these keys:
{
  "recommendation": "read|skim|watch|ignore",
  "signal_score": 0,
  "fluff_score": 0,
  "technical_depth": 0,
  "novelty": 0,
  "relevance": 0,
  "summary": "concise plain-English summary",
  "why_selected": "one sentence explaining why it made the digest or why it barely did",
  "technically_sound_claims": ["..."],
  "marketing_or_hype": ["..."],
  "claims_to_verify": ["..."],
  "why_it_matters_to_me": ["..."],
  "skeptical_take": "short, direct, opinionated take",
  "suggested_action": "what the reader should do with this",
  "tags": ["..."]
}

Scoring guide:
- signal_score: 85-100 read, 70-84 skim, 55-69 watch/maybe, below 55 ignore.
- fluff_score: 0 is no fluff, 100 is pure marketing/SEO/vendor ad.
- Penalize vendor press releases, generic AI trend articles, no concrete examples, old/stale items, and recycled listicles.

Topic: {topic}
Title: {title}
URL: {url}
Source metadata:
{metadata}

Content source: {content_source}
Extraction status: {extraction_status}

Content:
{content}
"""

PLACEHOLDER_ORDER = ["topic", "title", "url", "metadata", "content_source", "extraction_status", "content"]
