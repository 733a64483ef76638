"""Fixed values that decide results: schema, word lists, domains and patterns."""

from __future__ import annotations

from string import ascii_lowercase

from pyspark.sql import types as T

# The canonical message schema, in column order.
MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("lang", T.StringType()),
    ]
)
CANONICAL = MESSAGE_SCHEMA.fieldNames()

# Label and channel domains.
LEGITIMATE, PHISH = 0, 1
EMAIL, SMS = "email", "sms"

# Source name of rows grown by paraphrasing.
PARAPHRASE_SOURCE = "nz_synth_para"

# What stands around the original text in a prompt.
PROMPT_BEFORE_TEXT = "\n\nORIGINAL:\n"
PROMPT_AFTER_TEXT = '\n\nRespond with valid JSON only: {"paraphrases": ["...", "..."]}'

# Term lists, matched as plain substrings.
GOVERNMENT_TERMS = (
    "inland revenue", "ird", "te tari taake", "nz post", "new zealand post", "nzpost",
    "waka kotahi", "nzta", "new zealand transport agency", "msd", "work and income", "winz",
    "studylink", "acc", "accident compensation", "department of internal affairs", "dia",
    "ministry of health", "te whatu ora", "health new zealand", "immigration new zealand", "inz",
)
BANK_TERMS = (
    "anz", "asb", "westpac", "kiwibank", "bnz", "bank of new zealand", "tsb",
    "co-operative bank", "heartland", "rabobank",
)
TELCO_UTILITY_TERMS = (
    "spark", "one nz", "vodafone nz", "2degrees", "skinny", "contact energy", "mercury",
    "genesis energy", "meridian",
)
SALUTATION_TERMS = (
    "kia ora", "tēnā koe", "tena koe", "tēnā koutou", "tena koutou", "mōrena", "morena",
    "kia kaha", "ngā mihi", "nga mihi", "noho ora mai",
)
LURE_TERMS = (
    "tax refund", "ird refund", "parcel held", "redelivery", "customs fee", "toll fee",
    "unpaid toll", "infringement notice", "fines payment", "covid payment", "winter energy",
    "rates rebate",
)

# Domains that look-alikes imitate.
LEGITIMATE_DOMAINS = (
    "ird.govt.nz", "nzpost.co.nz", "nzta.govt.nz", "msd.govt.nz", "anz.co.nz", "asb.co.nz",
    "westpac.co.nz", "kiwibank.co.nz", "bnz.co.nz",
)

# Default public suffixes. Every two-letter label counts as a country's.
# Pass the whole public list, by ``domains.read_suffixes``, where hosts need more of it.
PUBLIC_SUFFIXES = (
    *(a + b for a in ascii_lowercase for b in ascii_lowercase),
    # generic
    "com", "net", "org", "edu", "gov", "mil", "int", "arpa", "info", "biz", "name", "pro", "mobi",
    "jobs", "travel", "asia", "tel", "post", "aero", "coop", "cat", "museum", "example",
    "app", "bar", "bid", "blog", "bond", "buzz", "cam", "cfd", "click", "cloud", "club", "cyou",
    "date", "dev", "download", "email", "fun", "help", "host", "icu", "life", "link", "live", "loan",
    "lol", "men", "monster", "mov", "news", "online", "page", "party", "press", "quest", "racing",
    "ren", "rest", "review", "sbs", "science", "services", "shop", "site", "space", "store", "stream",
    "support", "tech", "today", "top", "trade", "vip", "web", "website", "win", "work", "world",
    "xyz", "zip", "kiwi",
    # New Zealand
    "ac.nz", "co.nz", "cri.nz", "geek.nz", "gen.nz", "govt.nz", "health.nz", "iwi.nz", "kiwi.nz",
    "maori.nz", "mil.nz", "net.nz", "org.nz", "parliament.nz", "school.nz",
    # other countries' usual second levels
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "asn.au", "id.au",
    "co.uk", "org.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk", "ac.uk", "gov.uk", "nhs.uk",
    "co.za", "org.za", "gov.za", "co.in", "net.in", "org.in", "gov.in", "ac.in",
    "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp", "co.kr", "or.kr", "go.kr", "ac.kr",
    "com.br", "net.br", "org.br", "gov.br", "com.mx", "org.mx", "gob.mx", "com.ar", "gob.ar",
    "com.cn", "net.cn", "org.cn", "gov.cn", "com.hk", "org.hk", "gov.hk", "com.tw", "org.tw",
    "com.sg", "edu.sg", "gov.sg", "com.my", "gov.my", "com.ph", "gov.ph", "co.id", "go.id", "co.th",
    "in.th", "com.vn", "gov.vn", "com.tr", "gov.tr", "co.il", "org.il", "gov.il", "com.sa", "com.eg",
    "com.ng", "gov.ng", "co.ke", "com.gh", "com.pk", "com.bd", "com.fj", "com.ws", "com.ua", "com.pl",
    "com.es", "com.pt", "com.gr", "com.ru", "co.at", "or.at",
    # wildcards and their exceptions
    "*.ck", "!www.ck", "*.bn", "*.kh", "*.mm", "*.np", "*.pg",
)

# What counts as a phone number, an amount, a postcode and a URL.
# Written for Java with (?U), where \s lacks U+001C-001F, hence the added range.
MOBILE_PATTERN = r"(?U)(?:\+?64[\s\x1c-\x1f]?|0)2[0-9](?:[\s\x1c-\x1f\-]?\d){6,8}"
LANDLINE_PATTERN = r"(?U)(?:\+?64[\s\x1c-\x1f]?|0)[34679](?:[\s\x1c-\x1f\-]?\d){7}"
MONEY_PATTERN = (
    r"(?iU)(?:NZ\$|NZD[\s\x1c-\x1f]?\$?|\$NZ)[\s\x1c-\x1f]?\d+(?:[.,]\d+)?"
)
POSTCODE_PATTERN = r"(?<![\p{L}\p{N}_])[0-9]{4}(?![\p{L}\p{N}_])"
URL_PATTERN = r"(?iU)https?://[^\s\x1c-\x1f<>\"']+"

# Cyrillic letters that pass for Latin ones, both cases.
HOMOGLYPHS = "аеіорсухӏ"
HOMOGLYPHS_BOTH_CASES = HOMOGLYPHS + HOMOGLYPHS.upper()

# Cue columns, in the order of the feature vector.
CUE_NAMES = (
    "impersonated_govt", "impersonated_bank", "impersonated_telco_utility",
    "te_reo_salutation", "nz_lure_keyword_count", "nz_mobile_count", "nz_landline_count",
    "nzd_mention_count", "nz_postcode_count", "url_count", "suspicious_govt_lookalike",
    "suspicious_bank_lookalike", "homoglyph_chars", "has_punycode",
)
