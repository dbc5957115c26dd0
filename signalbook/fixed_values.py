"""Word lists, lookup tables, patterns, weights and wording.

Everything in this module is data whose value decides the result, kept plain
and in one place.  All of it can be replaced by passing another table to the
function that uses it.
"""

# --- fixed values: text normalisation --------------------------------------

ABBREVIATIONS = {
    "vpn": "VPN",
    "sla": "SLA",
    "api": "API",
    "ui": "UI",
    "ux": "UX",
    "db": "database",
    "mgr": "manager",
    "dept": "department",
    "corp": "Corporation",
    "ltd": "Limited",
    "inc": "Incorporated",
    "pvt": "Private",
    "llc": "LLC",
}

LEGAL_SUFFIXES = [
    "ltd", "llc", "inc", "corp", "co", "pvt", "limited", "corporation",
    "incorporated", "plc", "sa",
]

NAME_PUNCTUATION = r"[.,/#!$%^&*;:{}=\-_`~()]"

# Spark datetime patterns, tried in order (so day-first wins over month-first).
DATE_FORMATS = [
    "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy",
    "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy/M/d",
]

CURRENCY_SYMBOLS = {"$": "USD", "£": "GBP", "€": "EUR", "₹": "INR"}
CURRENCY_CODES = ["USD", "EUR", "GBP", "INR", "AUD", "CAD"]

SEVERITY_LEVELS = ["critical", "high", "medium", "low"]
SEVERITY_SYNONYMS = {
    "p1": "critical", "priority 1": "critical", "sev1": "critical",
    "p2": "high", "priority 2": "high", "sev2": "high",
    "p3": "medium", "priority 3": "medium", "sev3": "medium",
    "p4": "low", "priority 4": "low", "sev4": "low",
    "urgent": "critical", "blocker": "critical",
    "major": "high", "critical": "critical",
    "moderate": "medium", "normal": "medium",
    "minor": "low", "trivial": "low",
}

# Words a CSV reader treats as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: lexicons --------------------------------------------------

ISSUE_TAXONOMY = {
    "NETWORK": {
        "VPN": ["vpn", "remote access", "tunnel", "unable to connect to vpn", "vpn down"],
        "DNS": ["dns", "name resolution", "domain lookup"],
        "CONNECTIVITY": ["network down", "no internet", "connectivity issue", "packet loss"],
        "FIREWALL": ["firewall", "blocked", "port blocked"],
    },
    "APPLICATION": {
        "AUTHENTICATION": ["login", "password", "sso", "auth", "credentials", "mfa", "2fa"],
        "PERFORMANCE": ["slow", "lag", "timeout", "response time", "latency"],
        "CRASH": ["crash", "blue screen", "bsod", "application crash", "freeze"],
        "AVAILABILITY": ["down", "outage", "unavailable", "not accessible"],
    },
    "HARDWARE": {
        "PRINTER": ["printer", "print", "printing"],
        "DEVICE": ["laptop", "desktop", "workstation", "device"],
        "PERIPHERAL": ["keyboard", "mouse", "monitor", "headset"],
    },
    "DATA": {
        "BACKUP": ["backup", "restore", "recovery"],
        "STORAGE": ["storage", "disk full", "disk space", "quota"],
        "CORRUPTION": ["corrupt", "data loss", "missing data"],
    },
    "BILLING": {
        "INVOICE": ["invoice", "billing", "payment"],
        "REFUND": ["refund", "credit"],
        "SUBSCRIPTION": ["subscription", "renewal", "license"],
    },
    "SECURITY": {
        "BREACH": ["breach", "hack", "unauthorized", "intrusion"],
        "VULNERABILITY": ["vulnerability", "cve", "patch", "exploit"],
        "ACCESS": ["access denied", "permission", "unauthorized access"],
    },
}

POSITIVE_WORDS = [
    "excellent", "great", "good", "happy", "satisfied", "perfect", "awesome",
    "helpful", "fast", "resolved", "thank", "appreciate", "impressed",
    "smooth", "easy",
]
NEGATIVE_WORDS = [
    "terrible", "awful", "bad", "angry", "frustrated", "disappointed",
    "broken", "failed", "worst", "slow", "unacceptable", "outage", "down",
    "useless", "crash", "error", "not working",
]

SEVERITY_KEYWORDS = {
    "critical": ["critical", "urgent", "emergency", "p1", "down", "outage", "breach"],
    "high": ["high", "major", "p2", "severe", "significant"],
    "medium": ["medium", "moderate", "p3", "normal"],
    "low": ["low", "minor", "p4", "informational"],
}

TOPIC_PATTERNS = {
    "vpn": ["vpn", "remote access", "virtual private", "tunnel"],
    "authentication": ["login", "password", "auth", "sso", "credentials", "mfa", "2fa"],
    "performance": ["slow", "latency", "performance", "lag", "timeout", "response time"],
    "availability": ["down", "outage", "unavailable", "offline", "not working", "crash"],
    "billing": ["invoice", "billing", "payment", "charge", "refund", "subscription"],
    "onboarding": ["setup", "install", "onboard", "configuration", "configure"],
    "data_loss": ["lost data", "data loss", "missing data", "deleted"],
    "security": ["hack", "breach", "vulnerability", "unauthorized", "security"],
    "network": ["network", "connectivity", "connection", "internet", "bandwidth"],
    "email": ["email", "mail", "inbox", "outlook", "exchange"],
}

# --- fixed values: extraction patterns and confidences -----------------------

CUSTOMER_PATTERNS = [
    r"(?i)(customer|client|account)[:\s]+([A-Z][a-zA-Z\s&.,'-]+?)(?:\s|,|\.|$)",
    r"(?i)(?:from|by|re:)\s+([A-Z][a-zA-Z\s&.,'-]+?)\s*(?:Ltd|Inc|Corp|LLC|Pvt)?(?:\s|,|\.|$)",
]
TEXT_DATE_PATTERNS = [
    r"(?i)\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    r"(?i)\d{4}[/-]\d{1,2}[/-]\d{1,2}",
    r"(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}",
]
MONEY_PATTERN = (
    r"(?:USD|EUR|GBP|INR|\$|£|€)?\s*[\d,]+(?:\.\d{2})?"
    r"(?:\s*(?:USD|EUR|GBP|INR|million|billion|thousand|k|M|B))?"
)
STRICT_MONEY_PATTERN = (
    r"(?:USD|EUR|GBP|INR|\$|£|€)?\s*\d[\d,]*(?:\.\d{2})?"
    r"(?:\s*(?:USD|EUR|GBP|INR|million|billion|thousand|k|M|B)\b)?"
)
TICKET_PATTERN = r"(?i)(?:ticket|case|ref)[:\s#]+([A-Z0-9\-]+)"
EMAIL_PATTERN = r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}"
INCIDENT_PATTERN = r"(?i)(?:INC|incident|ticket)[:\s#]+([A-Z0-9\-]+)"
DOWNTIME_PATTERN = r"(?i)(\d+)\s*(?:min(?:utes?)?|hours?)\s*(?:of)?\s*(?:down|outage)"
CONTRACT_PATTERN = r"(?i)(?:contract|agreement|ref)[:\s#]+([A-Z0-9\-/]+)"
KEY_PHRASE_PATTERN = r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"

FIELD_CONFIDENCE = {
    "topics": 0.75, "no_topics": 0.3, "ticket_number": 0.95,
    "customer_email": 0.98, "incident_number": 0.95, "downtime_minutes": 0.88,
    "contract_number": 0.93, "customer": 0.81, "date": 0.90,
    "monetary_value": 0.85, "category": 0.78,
    "severity_found": 0.82, "severity_default": 0.55, "reply_default": 0.7,
}

AUTO_ACCEPT_CONFIDENCE = 0.75
REVIEW_CONFIDENCE = 0.65
URGENT_REVIEW_CONFIDENCE = 0.5

# --- fixed values: entity resolution -----------------------------------------

ENTITY_PREFIXES = {
    "customer": "CUST", "company": "COMP", "service": "SVC",
    "product": "PROD", "employee": "EMP", "location": "LOC",
}
EXACT_CONFIDENCE = 1.0
NORMALIZED_CONFIDENCE = 0.95
NEW_ENTITY_CONFIDENCE = 0.5
# (lowest score, confidence, method, needs review)
FUZZY_BANDS = [
    (95, 0.90, "fuzzy", False),
    (85, 0.75, "fuzzy", False),
    (70, 0.60, "fuzzy", True),
    (60, 0.45, "fuzzy_uncertain", True),
]

# --- fixed values: data quality ----------------------------------------------

CRITICAL_FIELDS = {
    "ticket": ["ticket_number", "customer_name", "priority", "status", "created_date"],
    "incident": ["incident_number", "severity", "occurred_at", "service_name"],
    "feedback": ["raw_text", "feedback_date", "sentiment"],
    "contract": ["contract_number", "start_date", "end_date"],
    "customer": ["name", "email"],
}
VALIDITY_RULES = {
    "email": (r"^[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}$", "Invalid email format"),
    "date": (r"^\d{4}-\d{2}-\d{2}", "Invalid date format"),
    "phone": (r"^[+\d\s\-()]{7,15}$", "Invalid phone format"),
    "currency": (r"^\$?[\d,]+\.?\d*$", "Invalid currency format"),
    "priority": (r"^(critical|high|medium|low|p[1-4])$", "Invalid priority value"),
    "sentiment": (r"^(positive|negative|neutral)$", "Invalid sentiment value"),
    "severity": (r"^(critical|high|medium|low|p[1-4])$", "Invalid severity value"),
}
QUALITY_WEIGHTS = {
    "completeness": 0.30, "validity": 0.25, "uniqueness": 0.20,
    "consistency": 0.15, "timeliness": 0.10,
}
STALE_AFTER_DAYS = 730

# --- fixed values: scoring ---------------------------------------------------

HEALTH_WEIGHTS = {
    "ticket": 0.25, "sentiment": 0.25, "sla": 0.20, "resolution": 0.15,
    "incident": 0.10, "rating": 0.05,
}
RISK_BANDS = [(75, "LOW"), (55, "MEDIUM"), (35, "HIGH")]
LOWEST_RISK_BAND = "CRITICAL"
SEVERITY_WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.75, "MEDIUM": 0.5, "LOW": 0.25}
INSIGHT_URGENCY = {
    "risk": 0.9, "anomaly": 0.85, "sla_risk": 0.95, "emerging_issue": 0.85,
    "customer_issue": 0.80, "root_cause": 0.70, "trend": 0.60,
    "data_quality": 0.50, "opportunity": 0.45, "recommendation": 0.40,
}
REVENUE_PER_TRANSACTION = 150.0
TRANSACTIONS_PER_HOUR = 100.0
PENALTY_PER_BREACH = 5000.0
CHURN_SHARE = 0.6
WEEKDAYS = [
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
]

# --- fixed values: wording of insights (printf style) -------------------------

HEALTH_TEXT = {
    "title": "Customer Health Deterioration: %s",
    "description": "%s shows a health score of %s/100 — %s risk.",
    "what_happened": "%s has a health score of %s/100 with a '%s' risk level. The account is %s.",
    "why_start": "Deteriorating customer health indicates increased churn risk. ",
    "why_money": "Estimated $%s in contract value is at risk. ",
    "why_end": "Early intervention is significantly more cost-effective than recovery.",
    "action": (
        "Schedule an urgent account review for %s. Address top factors: %s. "
        "Assign a dedicated customer success manager if not already in place."
    ),
    "no_factors": "review all metrics",
}
# (component, lower than, factor)
HEALTH_FACTORS = [
    ("ticket_frequency", 50, "High ticket volume"),
    ("sentiment", 50, "Negative sentiment trend"),
    ("sla_compliance", 70, "SLA breaches"),
    ("resolution_time", 50, "Slow resolution times"),
    ("incident_frequency", 50, "Elevated incident frequency"),
]
EMERGING_TEXT = {
    "title": "Emerging Issue: %s Complaints Spike",
    "description": "%s complaints have increased by %s%% compared to the previous period.",
    "what_happened": "Reports mentioning '%s' increased from %s to %s records — a %s%% %s.",
    "why_it_matters": (
        "A rapid increase in '%s' complaints may indicate a systemic issue affecting "
        "multiple customers. Left unaddressed, this can escalate to SLA breaches and "
        "customer churn."
    ),
    "action": (
        "Immediately investigate the root cause of %s complaints. Assign an owner and "
        "establish a resolution timeline. Consider proactive customer communication."
    ),
    "factor": "Spike in %s-related reports",
}
SLA_RISK_TEXT = {
    "title": "SLA Breach Risk: Ticket %s",
    "description": "Ticket %s for %s has %s%% probability of SLA breach.",
    "what_happened": (
        "Ticket %s (Priority: %s) has been open for %s hours. SLA target is %s hours, "
        "leaving %s hours."
    ),
    "why_it_matters": (
        "An SLA breach for a %s ticket from %s could trigger contract penalties and "
        "damage the customer relationship."
    ),
    "action": (
        "Immediately escalate ticket %s to a senior engineer. Notify %s proactively and "
        "provide an ETA."
    ),
}
ROOT_CAUSE_TEXT = {
    "title": "Recurring Pattern: %s",
    "description": "%s incidents in category %s with potential root cause: %s",
    "what_happened": "%s incidents have occurred in the '%s' category.",
    "why_it_matters": (
        "Recurring incidents in the same category suggest a systemic issue that simple "
        "reactive fixes cannot resolve."
    ),
    "action_known": (
        "Conduct a root cause analysis session for %s. Potential hypothesis: %s"
    ),
    "action_unknown": (
        "Conduct a root cause analysis session for %s. Insufficient evidence for "
        "hypothesis — gather more data."
    ),
    "undetermined": "Undetermined — insufficient evidence",
    "pattern": "Clustering on %ss",
}
NARRATIVE_TEXT = (
    "%s shows %s. The %s has %s by %s%% based on analysis of available records."
)

# --- fixed values: canned questions (pattern, intent), first match wins -------

QUESTION_INTENTS = [
    (r"(highest|most|top).*(support|risk|churn)", "top_risk_customers"),
    (r"(incident|incidents).*(last|previous).*(month|week)", "recent_incidents"),
    (r"(sentiment|worsening|negative).*(service|product)", "negative_sentiment_services"),
    (r"(service|product).*(sentiment|worsening)", "negative_sentiment_services"),
    (r"(sla|breach|breaches).*(negative|sentiment)", "sla_and_sentiment"),
    (r"(overview|summary|kpi|status)", "overview"),
]
REVIEW_ACTIONS = ["approved", "rejected", "edited", "ignored"]

# --- fixed values: intake ------------------------------------------------------

ALLOWED_EXTENSIONS = ["pdf", "docx", "txt", "csv", "xlsx", "xls", "json"]
MAX_FILE_BYTES = 100 * 1024 * 1024
LINES_PER_PAGE = 100
ROWS_PER_PAGE = 50
