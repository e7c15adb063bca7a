"""Fixed values of the page side: word lists, patterns, weights and bars.

They must equal the published behaviour for results to agree, so they are
stated here together, as plain text, in natural order.
"""

KINDS = [
    "admissions", "international_admissions", "tuition", "cost_of_attendance", "financial_aid", "international_financial_aid",
    "scholarships", "testing_policy", "english_requirements", "deadlines", "programs", "common_data_set",
]
TWO_PART_SUFFIXES = ["ac", "edu", "gov", "co", "or", "ne", "com"]
ACADEMIC_SECOND_LEVELS = ["ac", "edu"]
RESERVED_DOMAINS = ["localhost", "local", "internal", "test", "invalid", "example"]
NAME_STOP_WORDS = ["the", "of", "and", "for", "university", "institute", "college", "school", "technology", "national", "state"]
ASSET_SUFFIXES = [
    ".xml", ".xml.gz", ".gz", ".json", ".rss", ".atom", ".txt.gz", ".css", ".js", ".mjs", ".map", ".ics", ".zip", ".csv",
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".mp4", ".mp3",
]
INDEX_MARKERS = ["sitemap", "robots txt", "wp json", "wp content", "wp includes", "feed", "rss", "atom", "oembed", "wp sitemap"]
ROBOTS_REASON = "robots.txt is a discovery source, not a page"
CHALLENGE_MARKERS = [
    "cf-browser-verification", "checking your browser before accessing", "just a moment...",
    "enable javascript and cookies to continue", "__cf_chl",
]
CHALLENGE_CAPTCHA_LENGTH = 6000

# ---- Applicant scope ------------------------------------------------------

SCOPE_MARKERS = [
    ("visiting", ["visiting", "visiting student", "visiting students", "visiting undergraduate", "special student", "special students",
                  "non degree", "nondegree", "non matriculated", "guest student"]),
    ("study_abroad", ["study abroad", "studying abroad", "exchange student", "exchange students", "incoming exchange", "semester abroad",
                      "year abroad", "visiting exchange"]),
    ("continuing_education", ["continuing education", "extension school", "professional education", "executive education",
                              "lifelong learning", "summer school", "part time studies", "adult learners"]),
    ("graduate", ["graduate", "grad", "phd", "doctoral", "masters", "mba", "postgraduate", "postdoctoral", "graduate school", "graduate admissions"]),
    ("transfer", ["transfer", "transfers", "transferring", "transfer applicant", "transfer applicants", "transfer students"]),
    ("first_year", ["first year", "first years", "freshman", "freshmen", "first year applicant", "first year applicants",
                    "first year students", "entering class", "incoming class"]),
    ("general_undergraduate", ["undergraduate", "undergraduates", "undergrad", "college"]),
]
BODY_SCOPES = ["first_year", "general_undergraduate"]
INTERNATIONAL_MARKERS = ["international", "overseas", "non us citizens", "non uk", "eu and international"]
FIRST_YEAR_SCOPES = ["first_year", "international_first_year", "general_undergraduate", "unknown"]
GUARDED_FIELDS = [
    "tuition", "livingCost", "totalCostOfAttendance", "minimumIELTS", "minimumTOEFL", "satPolicy", "applicationDeadline",
    "scholarshipDeadline", "needBasedAidForInternationals", "meetsFullNeedForInternationals", "fullTuitionPossible", "fullRidePossible",
    "aidCertainty",
]
EVIDENCE_FIELDS = [
    "tuition", "livingCost", "totalCostOfAttendance", "minimumIELTS", "minimumTOEFL", "satPolicy", "applicationDeadline",
    "scholarshipDeadline", "applicationPlatform", "needBasedAidForInternationals", "meetsFullNeedForInternationals",
    "fullTuitionPossible", "fullRidePossible",
]

# ---- Ranks and adjustments ------------------------------------------------

STATUS_RANK = {"verified": 3, "derived": 2, "curated": 1, "unverified": 0}
SOURCE_RANK = {"common_data_set": 5, "official_pdf": 4, "official_web": 3, "government": 2, "other_official": 1}
ROLE_RANK = {"canonical": 3, "supporting": 2, "fallback": 1, "historical": 0}
SCOPE_RANK = {"first_year": 2, "international_first_year": 2, "general_undergraduate": 1, "unknown": 1}
AUDIENCE_RANK = {"first_year": 5, "all_undergraduate": 4, "international": 4, "unknown": 3, "transfer": 1, "visiting": 0,
                 "study_abroad": 0, "continuing_education": 0, "graduate": 0}
AUDIENCE_ADJUST = {"first_year": 2, "all_undergraduate": 1, "international": 1, "unknown": 0, "transfer": -4, "visiting": -8,
                   "study_abroad": -8, "continuing_education": -8, "graduate": -7}
TEMPORAL_ADJUST = {"current": 2, "unknown": 0, "dated": -2, "historical": -4}
CANONICAL_SEGMENT, CANONICAL_CAP = 2, 4
ARTICLE_FIRST, ARTICLE_EXTRA, ARTICLE_CAP = -4, -1, -6
BLOG_CONTENT, DATED_PATH = -2, -2
TITLE_WEIGHT, HEADING_WEIGHT, TEXT_WEIGHT, PATH_WEIGHT, SITEMAP_WEIGHT, NEGATIVE_WEIGHT = 3, 2, 1, 1, 0.5, -4
TEXT_HIT_CAP, ACCEPT_BAR, CONTENT_BAR, FALLBACK_BAR = 4, 4, 3, 8
CANDIDATES_PER_KIND, FETCH_BUDGET, STRONG_SCORE, STRONG_NEEDED = 4, 45, 2, 3
ARTICLE_SEGMENTS = [
    "blogs", "blog", "news", "stories", "story", "entry", "entries", "archive", "archives", "posts", "post", "press", "newsroom",
    "announcements", "announcement", "events", "event", "magazine", "podcast", "video", "videos", "author", "authors", "tag", "tags",
    "category", "categories", "comment", "comments",
]
BLOG_MARKERS = [
    "posted on", "posted in", "posted by", "filed under", "read more posts", "leave a comment", "comments are closed", "share this post",
    "related posts", "by the admissions blogger", "this entry was posted", "continue reading",
]
CALCULATOR_MARKERS = [
    "calculator", "calculators", "net price calculator", "estimator", "cost estimator", "estimate your cost", "calculate your", "estimate your aid",
]
ANNOUNCEMENT_MARKERS = [
    "we are reinstating", "we are suspending", "we are extending", "we are pausing", "we have decided", "we will no longer",
    "we are no longer", "starting in", "beginning in", "effective for", "effective from", "we are announcing", "we announced",
    "as of today", "i am writing to share", "we are excited to announce", "today we are",
]
GLOBAL_NEGATIVE = [
    "sitemap", "robots", "privacy policy", "terms of use", "log in", "login", "sign in", "staff directory", "directory", "careers", "jobs",
    "search results", "page not found", "404",
]

# ---- Signals per page kind ------------------------------------------------
# require: every group needs a hit; one_of: one clause needs all its terms; together: both groups in one title, section or nearby text

KIND_SIGNALS = {
    "admissions": dict(
        critical=False, audience=True, require=[["admission", "admissions", "apply", "applying", "application", "applicants"]],
        canonical=["admissions", "admission", "apply", "applying", "undergraduate"],
        path=["admissions", "admission", "apply", "applying", "first year", "freshman"],
        title=["admissions", "admission", "apply", "application"],
        heading=["how to apply", "admissions", "application", "first year applicants"],
        text=["how to apply", "application process", "first year applicants", "apply for admission", "admissions office",
              "application requirements", "submit your application"],
        negative=["graduate admissions", "transfer credit policy"]),
    "international_admissions": dict(
        critical=False, audience=True,
        require=[["international", "overseas"], ["admission", "admissions", "apply", "applying", "applicant", "applicants", "application"]],
        together=[["international", "international students", "international applicants", "overseas"],
                  ["admission", "admissions", "apply", "applying", "application", "applicants", "eligibility", "requirements"]],
        canonical=["international", "admissions", "apply"], path=["international", "international students", "international applicants"],
        title=["international"], heading=["international applicants", "international students"],
        text=["international applicants", "international students", "student visa", "study permit", "if you are an international student"],
        negative=["international news", "global campus news"]),
    "tuition": dict(
        critical=True, audience=False, require=[["tuition", "fees", "fee"]],
        canonical=["tuition", "fees", "cost", "afford", "student financial services", "bursar", "registrar"],
        path=["tuition", "fees", "tuition and fees", "fee schedule"], title=["tuition", "fees"], heading=["tuition", "fees", "tuition and fees"],
        text=["tuition and fees", "annual tuition", "tuition rate", "per academic year", "tuition per year"], negative=[]),
    "cost_of_attendance": dict(
        critical=True, audience=False,
        one_of=[["cost of attendance"], ["estimated cost of attendance"], ["cost of attending"], ["annual cost"], ["total cost"],
                ["total estimated cost"], ["student budget"], ["undergraduate budget"], ["estimated expenses"], ["tuition", "housing"],
                ["tuition", "room and board"], ["tuition", "board"], ["tuition", "food"], ["tuition", "accommodation"]],
        require=[["cost", "costs", "budget", "expenses"]],
        canonical=["cost", "costs", "cost of attendance", "afford", "tuition", "financial aid", "finaid"],
        path=["cost of attendance", "cost", "budget", "student budget", "expenses"], title=["cost of attendance", "cost", "budget"],
        heading=["cost of attendance", "estimated cost", "student budget"],
        text=["cost of attendance", "estimated cost of attendance", "student budget", "total estimated cost"], negative=[]),
    "financial_aid": dict(
        critical=True, audience=False, require=[["aid", "financial", "funding", "affordability", "affording"]],
        canonical=["financial aid", "finaid", "aid", "afford", "student financial services", "funding"],
        path=["financial aid", "finaid", "aid", "funding", "affording", "student financial services"],
        title=["financial aid", "aid", "financial services", "funding"], heading=["financial aid", "types of aid", "applying for aid"],
        text=["financial aid", "need based", "apply for financial aid", "css profile", "fafsa", "demonstrated need", "aid package"],
        negative=["first aid"]),
    "international_financial_aid": dict(
        critical=True, audience=False,
        require=[["international", "overseas", "non citizens"], ["aid", "financial", "funding", "scholarship", "scholarships"]],
        together=[["international", "international students", "international applicants", "international citizens", "overseas", "non citizens"],
                  ["financial aid", "need based aid", "need based", "scholarship", "scholarships", "aid package", "need blind", "need aware",
                   "funding", "demonstrated need", "tuition free"]],
        canonical=["financial aid", "finaid", "aid", "afford", "international", "funding"],
        path=["international", "international aid", "aid for international students"], title=["international"],
        heading=["international students", "aid for international students"],
        text=["international students", "aid for international", "international applicants are eligible", "need blind for international",
              "need aware for international"],
        negative=["history of international students", "international student office news"]),
    "scholarships": dict(
        critical=False, audience=False, require=[["scholarship", "scholarships", "award", "awards", "bursary", "bursaries", "merit"]],
        canonical=["scholarships", "scholarship", "awards", "financial aid", "finaid", "afford"],
        path=["scholarships", "scholarship", "awards", "merit scholarships", "bursaries"], title=["scholarships", "scholarship", "awards"],
        heading=["scholarships", "merit scholarships", "named scholarships"],
        text=["scholarship", "scholarships", "merit based", "award covers", "full tuition scholarship"], negative=[]),
    "testing_policy": dict(
        critical=True, audience=True, require=[["sat", "act", "test", "tests", "testing", "standardized", "standardised"]],
        together=[["sat", "act", "testing", "standardized testing", "standardised testing", "test optional", "test blind", "tests"],
                  ["require", "required", "requirement", "requirements", "policy", "optional", "submit", "scores", "applicants"]],
        canonical=["testing", "tests", "requirements", "apply", "admissions", "standardized testing"],
        path=["testing", "standardized testing", "test optional", "sat act", "tests", "test policy", "requirements"],
        title=["testing", "test", "sat", "act", "test optional"],
        heading=["testing policy", "standardized testing", "test optional", "standardised testing", "tests and scores"],
        text=["test optional", "test blind", "sat or act", "standardized testing", "we require the sat", "testing policy", "act scores"],
        negative=[], hard=["covid testing", "coronavirus testing", "drug testing", "health testing", "testing center hours"]),
    "english_requirements": dict(
        critical=True, audience=True,
        require=[["english", "language"], ["ielts", "toefl", "duolingo", "proficiency", "language requirement", "language requirements"]],
        together=[["english", "english language", "language"],
                  ["proficiency", "ielts", "toefl", "duolingo english test", "duolingo", "language requirement", "language requirements",
                   "minimum score", "minimum overall band", "language test"]],
        canonical=["english", "requirements", "admissions", "apply", "international", "language"],
        path=["english", "english language requirements", "english proficiency", "language requirements"],
        title=["english proficiency", "english language", "english language requirements", "language requirements"],
        heading=["english proficiency", "english language requirement", "english language requirements"],
        text=["ielts", "toefl", "duolingo english test", "english language proficiency", "minimum overall band"], negative=[],
        hard=["old english", "middle english", "english literature", "english department", "english major", "creative writing", "shakespeare"]),
    "deadlines": dict(
        critical=True, audience=True, require=[["deadline", "deadlines", "dates", "timeline", "calendar"]],
        together=[["deadline", "deadlines", "dates", "due"],
                  ["application", "apply", "admissions", "early action", "early decision", "regular decision", "submit"]],
        canonical=["deadlines", "dates", "apply", "admissions", "requirements"],
        path=["deadlines", "dates", "key dates", "important dates", "application deadlines"], title=["deadlines", "dates", "deadline"],
        heading=["deadlines", "important dates", "application dates", "key dates"],
        text=["application deadline", "early action", "early decision", "regular decision", "deadlines", "priority deadline"], negative=[],
        hard=["events calendar", "academic calendar of events"]),
    "programs": dict(
        critical=False, audience=True,
        require=[["program", "programs", "programme", "programmes", "majors", "academics", "degrees", "courses"]],
        canonical=["academics", "programs", "programmes", "majors", "degrees", "fields of study", "courses", "catalog"],
        path=["academics", "programs", "programmes", "majors", "degrees", "fields of study", "courses"],
        title=["academics", "programs", "programmes", "majors", "degrees"],
        heading=["undergraduate programs", "majors", "fields of study", "degree programs"],
        text=["majors", "degree programs", "fields of study", "undergraduate programs", "course catalog"], negative=[]),
    "common_data_set": dict(
        critical=False, audience=False, require=[["common data set", "cds"]],
        canonical=["common data set", "cds", "institutional research", "ir"], path=["common data set", "cds", "institutional research"],
        title=["common data set"], heading=["common data set"], text=["common data set", "first time first year", "cds a", "cds c"], negative=[]),
}

CANDIDATE_PATHS = {
    "admissions": ["/admissions", "/apply", "/undergraduate/admissions", "/admissions/undergraduate"],
    "international_admissions": ["/admissions/international", "/international/admissions", "/international-students", "/international"],
    "tuition": ["/tuition", "/fees", "/admissions/tuition", "/tuition-and-fees", "/student-financial-services/tuition"],
    "cost_of_attendance": ["/cost-of-attendance", "/cost", "/financial-aid/cost-of-attendance", "/admissions/cost"],
    "financial_aid": ["/financial-aid", "/finaid", "/aid", "/student-financial-services"],
    "international_financial_aid": ["/financial-aid/international", "/finaid/international", "/aid/international-students"],
    "scholarships": ["/scholarships", "/financial-aid/scholarships", "/admissions/scholarships"],
    "testing_policy": ["/admissions/testing", "/apply/testing", "/standardized-testing", "/admissions/tests"],
    "english_requirements": ["/admissions/english", "/english-language-requirements", "/admissions/english-proficiency"],
    "deadlines": ["/admissions/deadlines", "/apply/deadlines", "/admissions/dates-and-deadlines"],
    "programs": ["/academics", "/programs", "/undergraduate/programs", "/academics/programs"],
    "common_data_set": ["/common-data-set", "/ir/common-data-set", "/institutional-research/common-data-set"],
}

# ---- Main content ---------------------------------------------------------

CHROME_TAGS = ["nav", "header", "footer", "aside", "script", "style", "noscript", "svg", "form", "iframe", "template", "dialog"]
CONTAINER_TAGS = ["div", "section", "ul", "ol", "aside", "table"]
CHROME_WORDS = [
    "nav", "navbar", "navigation", "menu", "masthead", "header", "footer", "sidebar", "side-bar", "breadcrumb", "cookie", "consent", "banner",
    "related", "related-posts", "share", "sharing", "social", "widget", "promo", "cta", "skip", "skip-link", "site-search", "searchform",
    "subscribe", "newsletter", "comment", "comments", "pagination", "pager", "toolbar", "utility", "global", "offcanvas", "drawer", "megamenu",
    "site-info", "colophon",
]

# ---- Money, scores, dates, aid -------------------------------------------

CURRENCIES = {
    "$": "USD", "US$": "USD", "USD": "USD", "£": "GBP", "GBP": "GBP", "€": "EUR", "EUR": "EUR", "HK$": "HKD", "HKD": "HKD", "S$": "SGD",
    "SGD": "SGD", "¥": "JPY", "JPY": "JPY", "₩": "KRW", "KRW": "KRW", "CHF": "CHF", "CZK": "CZK", "PLN": "PLN", "KZT": "KZT", "AED": "AED",
}
PER_UNIT = [
    (r"(?i)\bper\s+(class|course|module|subject|paper)\b", "per-course"),
    (r"(?i)\bper\s+(credit|credit[- ]hour|unit)\b", "per-credit"),
    (r"(?i)\bper\s+(semester|term|trimester)\b", "per-semester"),
    (r"(?i)\bper\s+(month|monthly)\b", "per-month"),
    (r"(?i)\bper\s+(week|weekly)\b", "per-week"),
    (r"(?i)\bper\s+(quarter)\b", "per-quarter"),
]
ANNUAL = r"(?i)\b(per\s+(year|annum)|annual(ly)?|/\s*year|a year|per academic year)\b"
NOT_A_PRICE = [
    (r"(?i)\b(family|household|parental|annual|combined)\s+income\b", "a family income figure, not a price"),
    (r"(?i)\bincome\s+(below|under|less than|above|over|of|threshold|cap|limit)\b", "an income threshold, not a price"),
    (r"(?i)\bincomes?\s+(are|is)?\s*(below|under|less than)\b", "an income threshold, not a price"),
    (r"(?i)\b(assets?|net worth|savings|investments?)\b", "an assets figure, not a price"),
    (r"(?i)\b(salary|salaries|wages?|earnings?|earns?|median pay|starting pay)\b", "an earnings figure, not a price"),
    (r"(?i)\b(scholarships?|awards?|grants?|bursaries)\b[^.\n]{0,40}\b(up to|maximum|worth|of)\b", "a maximum award value, not a price"),
    (r"(?i)\bup to\b[^.\n]{0,30}\b(scholarship|award|grant|bursary)\b", "a maximum award value, not a price"),
    (r"(?i)\b(eligib\w+|qualif\w+)\b[^.\n]{0,40}\b(if|when|for)\b[^.\n]{0,40}\b(income|earn|below|under)\b", "an aid eligibility threshold, not a price"),
    (r"(?i)\b(endowment|raised|donation|gift|pledge|budget of the (university|institute|college))\b", "an institutional finance figure, not a student cost"),
    (r"(?i)\b(loan|debt)\s+(forgiveness|cap|limit|average)\b", "a borrowing figure, not a price"),
]
OTHER_COMPONENT = "a different cost component is named closer to this figure"
COST_CONCEPTS = [
    "tuition", "fees", "fee", "housing", "room and board", "board", "accommodation", "residence", "living", "food", "meals", "meal plan",
    "books", "supplies", "transportation", "travel", "insurance", "personal expenses", "total", "cost of attendance", "estimated cost", "deposit",
]
AGGREGATE_CONCEPTS = ["total", "total cost", "cost of attendance", "estimated cost", "overall cost"]
MONEY_FIELDS = {
    "tuition": ["tuition"],
    "livingCost": ["housing", "room and board", "living", "accommodation", "residence"],
    "totalCostOfAttendance": ["total", "cost of attendance", "estimated cost"],
}
SECTION_MINIMUM = r"(?i)\b(no (band|sub-?score|component|section)|each (band|component|section|sub-?test)|any (band|component)|minimum of \d(?:\.\d)? in)\b"
OVERALL_SCORE = r"(?i)\b(overall|composite|total|average)\b"
TESTING_PATTERNS = [
    ("optional", r"(?i)\btest[- ]optional\b"),
    ("optional", r"(?i)\bdo(es)? not require (the )?(SAT|ACT|standardi[sz]ed test)"),
    ("not-used", r"(?i)\btest[- ]blind\b|\bwill not (be )?consider (SAT|ACT)"),
    ("required", r"(?i)\b(SAT|ACT)[^.\n]{0,60}\b(is|are) required\b"),
    ("required", r"(?i)\brequire[sd]?\b[^.\n]{0,40}\b(SAT|ACT)\b"),
    ("recommended", r"(?i)\b(SAT|ACT)[^.\n]{0,60}\b(recommended|strongly encouraged)\b"),
]
AID_PATTERNS = {
    "meets_full_need": r"(?i)\bmeets? (100%|the full|full) (of )?(the )?demonstrated (financial )?need\b",
    "need_blind": r"(?i)\bneed[- ]blind\b",
    "need_aware": r"(?i)\bneed[- ]aware\b|\bneed[- ]sensitive\b",
    "full_ride": r"(?i)\bfull[- ]ride\b|\b(covers?|covering) (full )?tuition[^.\n]{0,60}\b(living|housing|accommodation|room and board)\b",
    "full_tuition": r"(?i)\bfull[- ]tuition\b|\bcovers? (the )?(full|entire) (cost of )?tuition\b",
    "merit_exists": r"(?i)\bmerit[- ](based )?(scholarship|award)\b",
    "any_scholarship": r"(?i)\bscholarship(s)?\b",
    "international_eligible": r"(?i)\b(international|non-?(US|U\.S\.|domestic|EU|EEA|local))\s+(students?|applicants?|citizens?)\b[^.\n]{0,120}\b(are )?(eligible|considered|may apply|can apply|qualify)\b",
    "international_excluded": r"(?i)\b(only|restricted to|limited to)\s+(domestic|home|US|U\.S\.|EU|EEA|local|citizens?|permanent residents?)\b|\bnot available to international\b|\binternational students are not eligible\b",
}
COMPETITIVE = r"(?i)\b(competitive|highly competitive|selective|highly selective|limited number|a (small|select|limited) number|limited funds?|limited funding|not guaranteed|subject to availability)\b"
AID_CONTEXT = r"(?i)\b(scholarship|scholarships|award|awards|aid|funding|bursary|bursaries|grant|grants)\b"
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10,
    "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10,
    "nov": 11, "dec": 12,
}
DEADLINE_KINDS = [
    ("scholarship", r"(?i)\bscholarship|financial aid|bursary|funding\b"),
    ("early", r"(?i)\bearly (action|decision)\b"),
    ("application", r"(?i)\b(regular|final|application) (decision|deadline|due)\b|\bdeadline\b|\bdue\b|\bcloses?\b"),
]
CYCLE = ("2026-08-01", "2027-12-31")
COST_CEILING = 120000
STATES_FIGURES = r"[$£€¥₩]\s?\d[\d,]{2,}"

# ---- fixed sentences of aid evidence and review ----------------------------

AID_SILENT = "the page never states whether international students are eligible, so this cannot be concluded from it"
AID_EXCLUDED = "the page states this aid is not open to international students"
AID_FULL_NEED = "the page states that full demonstrated need is met, and that international students are eligible"
AID_NO_FULL_NEED = "the page does not state that full demonstrated need is met; that is not evidence that it is not"
AID_RIDE = "the page states an award covering tuition and living costs"
AID_NO_RIDE = "the page does not describe an award covering living costs as well as tuition"
AID_TUITION = "the page states an award covering full tuition"
AID_NO_TUITION = "the page does not describe an award covering full tuition"
AID_NEED_BASED = "the page states need-based aid and that international students are eligible"
AID_NO_NEED_BASED = "international students are eligible to apply, but the page does not state that the aid is need-based"
AID_CERTAIN = "the page states that full demonstrated need is met and that international students are eligible"
AID_CONTEST = 'the page describes the award as a contest: "'
AID_UNCLEAR = "the page mentions scholarships but does not say whether they are competitive, limited or dependable"
AID_NOTHING = "the page states nothing about how aid is awarded"
AID_ISSUE_SILENT = "the page does not explicitly state that international students are eligible; nothing about international aid can be concluded from it either way"
AID_ISSUE_SIZE = "scholarships are mentioned but neither full tuition nor full cost is claimed; nothing is concluded about their size"
AID_ISSUE_LIVING = "full tuition is claimed but living costs are not; these are different things and are recorded separately"
SCOPE_REFUSAL = "the source is written for {scope} applicants; {field} describes a first-year undergraduate and cannot be taken from it"

# ---- fixed patterns and sentences of extraction, validation and selection ----

# an amount is a symbol with a grouped or plain number, or a number with a currency code; group commas never swallow blanks
MONEY = r"(?:US\$|HK\$|S\$|[$£€¥₩])\s?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?|\b\d[\d,]{2,14}(?:\.\d{1,2})?\s?(?:USD|GBP|EUR|HKD|SGD|JPY|KRW|CHF|CZK|PLN|KZT|AED)\b"
SYMBOL = r"(US\$|HK\$|S\$|[$£€¥₩]|USD|GBP|EUR|HKD|SGD|JPY|KRW|CHF|CZK|PLN|KZT|AED)"
NO_VALUE = "no value extracted"
NO_CURRENCY = "currency could not be determined; a bare number is not usable"
NOT_ANNUAL = "figure is quoted {u}, not annually; annualising it would require a course load or term count this source does not state"
OVER_CEILING = "{v} USD exceeds the plausible annual ceiling; likely a multi-year or programme total"
SEVERAL_YEARS = "the page lists several academic years; cannot attribute this figure to one"
NEEDS_TERMS = "figure is {u}; annualising requires knowing the number of terms, so this needs review"
UNSTATED_UNIT = "the page does not state that this figure is annual; confirm before approving"
TOO_SMALL = "{v} USD is implausibly small for an annual figure"
NO_YEAR = "no academic year attached; cost figures are cycle-specific"
ONLY_SECTIONS = "only per-section minimums found; the overall requirement is what the engine compares against"
CONFLICTING_SCORES = "conflicting overall minimums on the same page; requires review"
NOT_OVERALL = 'the page does not say "overall"; confirm this is not a section minimum'
BARE_DATES = "dates found but none is labelled as a deadline; a bare date is not a deadline"
SEVERAL_DEADLINES = "several in-cycle deadlines found; pick one in review"
CONSISTENCY = [
    ("fullTuitionPossible", "v['fullRidePossible'] = 'true' AND v['fullTuitionPossible'] = 'false'", "a full ride necessarily covers tuition, so full tuition cannot be false"),
    ("needBasedAidForInternationals", "v['meetsFullNeedForInternationals'] = 'true' AND v['needBasedAidForInternationals'] = 'false'", "meeting full demonstrated need is need-based aid"),
    ("aidCertainty", "v['aidCertainty'] = 'meets-full-need' AND coalesce(v['meetsFullNeedForInternationals'], 'x') <> 'true'", "meets-full-need certainty requires an explicit institutional commitment"),
    ("aidCertainty", "v['aidCertainty'] = 'minimal' AND v['fullRidePossible'] = 'true'", "a full ride contradicts minimal published aid"),
    ("totalCostOfAttendance", "try_cast(v['totalCostOfAttendance'] AS double) < try_cast(v['tuition'] AS double)", "total cost is below tuition"),
    ("minimumIELTS", "try_cast(v['minimumIELTS'] AS double) > try_cast(v['recommendedIELTS'] AS double)", "minimum exceeds the recommended threshold"),
    ("satPolicy", "v['satPolicy'] = 'not-used' AND (v['minimumSAT'] IS NOT NULL OR v['recommendedSAT'] IS NOT NULL)", "a test-blind policy should not carry SAT thresholds"),
]
WHY_ALONE = "no other candidate qualified"
WHY_ROLE = "{a} source outranks {b}"
WHY_SCOPE = "written for {a} applicants rather than {b}"
WHY_SCORE = "higher final score ({a} vs {b})"
WHY_STATUS = " ({a} vs {b}, worth {x} vs {y})"
WHY_AUDIENCE = "scores tied; audience {a} is preferred over {b}"
WHY_ORDER = "scores tied ({a}); first by discovery order"
REFUSED_HISTORICAL = "the only source found announces a change in policy rather than stating the current one"
REFUSED_FALLBACK = "only a fallback source was found for a decision-critical field, and {score} is below the {bar} bar for one"

def _meta(name: str):
    return [rf"""(?is)<meta[^>]+(?:property|name)=["']{name}["'][^>]+content=["']([^"']+)["']""",
            rf"""(?is)<meta[^>]+content=["']([^"']+)["'][^>]+(?:property|name)=["']{name}["']"""]


PUBLISHED = [*_meta("article:published_time"), *_meta("datePublished"), *_meta("pubdate"), *_meta("date"), *_meta("DC.date"),
             r'(?i)"datePublished"\s*:\s*"([^"]+)"', r"""(?i)<time[^>]+datetime=["']([^"']+)["']""", "path"]
UPDATED = [*_meta("article:modified_time"), *_meta("og:updated_time"), *_meta("dateModified"), r'(?i)"dateModified"\s*:\s*"([^"]+)"',
           r"(?i)last\s+(?:updated|modified|reviewed)\s*:?\s*([A-Z][a-z]+ \d{1,2},? \d{4}|\d{4}-\d{2}-\d{2})"]

#: What a page must hold in lower case for a date pattern to match at all.
DATE_SIGNS = {p: sign for name, sign in (
    ("article:published_time", "article:published_time"), ("datePublished", "datepublished"), ("pubdate", "pubdate"), ("date", "date"), ("DC.date", "date"),
    ("article:modified_time", "article:modified_time"), ("og:updated_time", "og:updated_time"), ("dateModified", "datemodified"),
) for p in _meta(name)} | {PUBLISHED[-3]: "datepublished", PUBLISHED[-2]: "<time", UPDATED[-2]: "datemodified", UPDATED[-1]: "last"}

UNVERIFIED_VALUE = "status is unverified but a value is present; unverified values must be null"
VERIFIED_BARE = "status is verified but no evidence is attached"
VERIFIED_NULL = "status is verified but the value is null"
DERIVED_BARE = "status is derived but no source fields are recorded"
NOT_PUBLIC_NAME = " is not a public domain name"
NOT_APPROVED = " is not an approved domain for this institution"
ONLY_HTTPS = "only https is permitted, got "
CREDENTIALS = "credentials in URL"
ODD_PORT = "non-standard port "
NOT_READABLE = " is not a readable page"
INDEX_PAGE = '" marks a machine-readable index, not a page'
