"""Everything in this module must equal the matched services' constants.

Prices, patterns, roles, message texts, model parameters and lookup tables are stated here as
plain data; no logic lives in this module. Where the services write a word boundary before or after ASCII
letters, the patterns say ``(?<!\\w)`` and ``(?!\\w)``, which mean the same in the JVM's dialect.
"""

# Price per million tokens: model -> (input, output).
TOKEN_PRICES = {
    "llama-3.3-70b-versatile": (0.59, 0.79),
    "llama-3.1-8b-instant": (0.05, 0.08),
    "mixtral-8x7b-32768": (0.24, 0.24),
}

# Model chosen per tier.
MODEL_TIERS = {
    "fast": "llama-3.1-8b-instant",
    "balanced": "llama-3.3-70b-versatile",
    "powerful": "llama-3.3-70b-versatile",
}

# Prompt-injection patterns, tried in this order.
INJECTION_PATTERNS = [
    r"(?i)ignore\s+(all\s+)?previous\s+instructions",
    r"(?i)you\s+are\s+now\s+(a\s+)?(?:different|new|another)",
    r"(?i)forget\s+(everything|all|your\s+instructions)",
    r"(?i)system\s*:\s*you\s+are",
    r"\[INST\]|\[\/INST\]|<\|im_start\|>|<\|im_end\|>",
    r"(?i)act\s+as\s+(?:if\s+you\s+are\s+)?(?:a\s+)?(?:jailbr(?:eak|oken)|dan|evil|unrestricted)",
    r"(?i)disregard\s+(?:your\s+)?(?:all\s+)?(?:previous|prior|all)\s+(?:instructions|rules|guidelines)",
]
INJECTION_REASON = "Potential prompt injection detected"
MAX_INPUT_CHARS = 10_000
TOO_LONG_REASON = "Input exceeds maximum length of 10,000 characters"

# Moderation patterns.
BLOCKED_CONTENT = [
    r"(?i)(?<!\w)(bomb|explosive|weapon)\s+(making|instructions|how\s+to)",
    r"(?i)(?<!\w)(hack|exploit|bypass)\s+(the\s+)?(system|database|server)",
]
MODERATION_REASON = "Content policy violation"

# Actions allowed per role.
ROLE_ACTIONS = {
    "admin": ["chat", "ingest", "delete", "admin", "send_email", "write_db_record"],
    "user": ["chat", "ingest", "send_email", "write_db_record"],
    "readonly": ["chat"],
}

# Rate limit and circuit breaker.
REQUESTS_PER_WINDOW = 60
RATE_WINDOW_MS = 60_000
BREAKER_FAILURES = 5
BREAKER_RESET_MS = 30_000

# Text-job service.
JOB_PIPELINES = ["invoice_extraction", "email_classification", "support_ticket_categorization"]
MAX_JOB_BYTES = 102_400
JOB_RETENTION_HOURS = 24

VENDOR_PATTERN = r"(?i)vendor[:\s]+([A-Za-z0-9 &.,'-]+)"
AMOUNT_PATTERN = r"(?i)(?:total|amount)[:\s$€£]*([0-9]+(?:\.[0-9]{1,2})?)"
DATE_PATTERN = r"(?<!\w)(\d{4}-\d{2}-\d{2})(?!\w)"

# Keywords that state the urgency of an e-mail.
URGENCY_HIGH = ["urgent", "asap", "immediately", "critical", "emergency", "blocking"]
URGENCY_MEDIUM = ["soon", "important", "need help"]

# Auto-replies: category -> (subject, body); %s stands for the summary.
AUTO_REPLIES = {
    "complaint": (
        "We've received your complaint — we're on it",
        "Thank you for reaching out. We've received your complaint and a member of our team will "
        'respond within 24 hours.\n\nYour message: "%s"\n\nWe apologise for any inconvenience '
        "caused.\n\nBest regards,\nCustomer Support Team",
    ),
    "support": (
        "Support request received",
        "Thank you for contacting support. We've logged your request and will get back to you "
        'shortly.\n\nYour request: "%s"\n\nExpected response time: 4-8 business hours.\n\nBest '
        "regards,\nSupport Team",
    ),
    "inquiry": (
        "Thanks for your inquiry",
        "Thank you for your inquiry. Our sales team will be in touch within 1 business day.\n\n"
        'Your inquiry: "%s"\n\nBest regards,\nSales Team',
    ),
    "spam": (
        "Unsubscribe confirmed",
        "You have been unsubscribed from our mailing list. No further emails will be sent.\n\n"
        "Best regards,\nEmail Team",
    ),
    "other": (
        "Message received",
        "Thank you for your message. We'll review it and respond if needed.\n\nYour message: "
        '"%s"\n\nBest regards,\nTeam',
    ),
}

# Tool intent of a chat message.
EMAIL_PHRASES = ["send email", "email to", "send a message"]
RECORD_PHRASES = ["write record", "save to database", "store this"]
RECIPIENT_PATTERN = r"(?i)(?:to|email)\s+([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
SUBJECT_PATTERN = r"(?i)(?:about|subject:|re:)\s+([^,.\n]+)"
DEFAULT_SUBJECT = "Message from AI Copilot"
EMAIL_BODY_BEFORE = "Dear recipient,\n\n"
EMAIL_BODY_AFTER = (
    "\n\nThis message was sent via the AI Copilot platform.\n\nBest regards,\nAI Copilot"
)

# Question answering over transcripts.
NOT_FOUND_REPLY = "NOT_FOUND"
NOT_FOUND_ANSWER = "The answer is not available in the video."

# Telemetry constants.
DEFAULT_TELEMETRY_MODEL = "llama-3.3-70b-versatile"
CHURN_TELEMETRY_MODEL = "stacked-ensemble-xgb-lgbm-rf"

# Churn records: required fields in reporting order.
CHURN_FIELDS = [
    "tenure", "MonthlyCharges", "TotalCharges", "SeniorCitizen", "Partner", "Dependents",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup",
    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "Contract",
    "PaperlessBilling", "PaymentMethod",
]

# Levels of the one-hot encoded fields.
CHURN_LEVELS = {
    "Partner": ["No", "Yes"],
    "Dependents": ["No", "Yes"],
    "PhoneService": ["No", "Yes"],
    "MultipleLines": ["No", "No phone service", "Yes"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    "OnlineSecurity": ["No", "No internet service", "Yes"],
    "OnlineBackup": ["No", "No internet service", "Yes"],
    "DeviceProtection": ["No", "No internet service", "Yes"],
    "TechSupport": ["No", "No internet service", "Yes"],
    "StreamingTV": ["No", "No internet service", "Yes"],
    "StreamingMovies": ["No", "No internet service", "Yes"],
    "Contract": ["Month-to-month", "One year", "Two year"],
    "PaperlessBilling": ["No", "Yes"],
    "PaymentMethod": [
        "Bank transfer (automatic)", "Credit card (automatic)", "Electronic check", "Mailed check",
    ],
}

# Numeric churn features, in model order; the one-hot columns follow in CHURN_LEVELS order.
CHURN_NUMERIC = [
    "SeniorCitizen", "log_tenure", "log_monthly", "monthly_to_total", "charges_per_month",
    "tenure_sq", "value_score", "loyalty_score", "contract_risk", "internet_risk", "payment_risk",
    "is_new", "is_loyal", "high_charges", "no_support", "paperless_echeck",
]

# Served logistic model: one entry per feature, in model order.
CHURN_THRESHOLD = 0.54
CHURN_INTERCEPT = -0.569671
CHURN_MAX_MONTHLY = 118.75
CHURN_WEIGHTS = [
    0.051196818103337934, -0.22587876949456043, 0.037059901654654996, 0.227635919859135,
    0.020664888262601096, -0.10239425998438047, -0.06977563665312425, -0.16225609750182213,
    0.21361918677893588, 0.1030058936688787, 0.04466277384003327, 0.0713536526080329,
    -0.014696785466065097, 0.031190448421545593, 0.08827213712762569, 0.06532989653759312,
    0.002278301176592359, -0.002278301176592359, 0.053027664317433554, -0.053027664317433575,
    0.018727249831097584, -0.018727249831097584, -0.0699161302133991, 0.018727249831097584,
    0.0592703252622989, -0.10647585711093217, 0.13169690509273704, -0.03615758896150168,
    0.07700948125171993, -0.03615758896150168, -0.052098594098383987, 0.056384464324520475,
    -0.03615758896150168, -0.027388897995370486, 0.02443094933388513, -0.03615758896150168,
    0.005844401988131125, 0.05978514375489131, -0.03615758896150168, -0.032892387347426805,
    -0.02504990689571757, -0.03615758896150168, 0.05549080785939476, -0.047698934511702075,
    -0.03615758896150168, 0.0782138277405273, 0.19250713946358644, -0.03281326596733115,
    -0.1925453588146133, -0.07741432852002318, 0.07741432852002322, -0.013205715828036781,
    -0.018000080915061684, 0.06058521456590747, -0.037482968450379975,
]
CHURN_MEANS = [
    0.161055, 3.040498, 4.045588, 0.155401, 59.231774, 0.320544, 0.453052, 0.450989, 0.653347,
    0.612475, 0.625963, 0.147667, 0.326775, 0.385396, 0.359229, 0.249493, 0.518864, 0.481136,
    0.702434, 0.297566, 0.100609, 0.899391, 0.476065, 0.100609, 0.423327, 0.341785, 0.441582,
    0.216633, 0.494726, 0.216633, 0.288641, 0.434483, 0.216633, 0.348884, 0.434077, 0.216633,
    0.34929, 0.489047, 0.216633, 0.29432, 0.389655, 0.216633, 0.393712, 0.391684, 0.216633,
    0.391684, 0.548479, 0.209736, 0.241785, 0.407708, 0.592292, 0.220284, 0.21643, 0.335497,
    0.227789,
]
CHURN_STDS = [
    0.367581, 1.153978, 0.58144, 0.275422, 30.647975, 0.347895, 0.254658, 0.342276, 0.417194,
    0.389748, 0.307551, 0.35477, 0.469034, 0.486689, 0.479775, 0.43272, 0.499644, 0.499644,
    0.457188, 0.457188, 0.30081, 0.30081, 0.499427, 0.30081, 0.494086, 0.474308, 0.496576,
    0.41195, 0.499972, 0.41195, 0.453131, 0.495689, 0.41195, 0.476617, 0.495635, 0.41195,
    0.476746, 0.49988, 0.41195, 0.455737, 0.487672, 0.41195, 0.488572, 0.488127, 0.41195,
    0.488127, 0.497644, 0.40712, 0.428165, 0.491408, 0.491408, 0.414438, 0.411811, 0.472164,
    0.419406,
]

# Months until churn: contract, internet, median, lower quartile, upper quartile, churners.
SURVIVAL_ROWS = [
    ("Month-to-month", "Fiber optic", 10.0, 3.0, 25.0, 1162),
    ("Month-to-month", "DSL", 4.0, 1.0, 13.0, 394),
    ("Month-to-month", "No", 1.0, 1.0, 5.0, 99),
    ("One year", "Fiber optic", 54.5, 42.5, 63.2, 104),
    ("One year", "DSL", 38.0, 22.0, 48.0, 53),
    ("One year", "No", 18.0, 8.0, 45.0, 9),
    ("Two year", "Fiber optic", 67.0, 57.0, 70.0, 31),
    ("Two year", "DSL", 66.0, 64.0, 70.2, 12),
    ("Two year", "No", 53.0, 33.0, 56.0, 5),
    ("_overall", "_overall", 10.0, 2.0, 29.0, 1869),
]

# Advice texts for customers predicted to leave.
ADVICE_CONTRACT = "Offer a discounted annual or two-year contract to significantly reduce churn risk."
ADVICE_NEW = "New customer at high risk - assign a dedicated success manager and prioritise onboarding."
ADVICE_EARLY = "Early-stage customer churning - offer a loyalty discount or service upgrade."
ADVICE_LONG = (
    "Unexpected churn for a long-tenure customer - escalate to retention team immediately."
)
ADVICE_PRICE = "High monthly charges are a churn driver - offer a price-lock or bundle discount."
ADVICE_PLAN = "Review pricing plan and offer a tailored discount to improve perceived value."
ADVICE_FIBRE = (
    "Fibre optic customers churn more - offer a speed upgrade, price lock, or premium SLA."
)
ADVICE_PAYMENT = "Encourage automatic payment setup to reduce friction and missed payments."
ADVICE_SUPPORT = (
    "Enrol customer in proactive tech support and security bundle to increase stickiness."
)
ADVICE_DEFAULT = "Consider a personalised retention offer for this customer."

# Advice texts for customers predicted to stay.
KEEP_TWO_YEAR = (
    "Two-year contract in place - customer is well retained. Consider upsell opportunity."
)
KEEP_ONE_YEAR = (
    "Annual contract customer - approaching renewal window, proactively offer renewal incentive."
)
KEEP_LOYAL = "Long-tenured loyal customer - reward with a VIP loyalty benefit or referral programme."
KEEP_ESTABLISHED = "Established customer - eligible for loyalty programme enrolment."
KEEP_NEW = (
    "New customer - focus on onboarding quality and early engagement to build long-term retention."
)
KEEP_VALUE = "Good value customer - candidate for upsell to a higher-tier plan."
KEEP_DEFAULT = "Customer appears stable - continue standard engagement."

# Churn features: risk levels, for training (other levels 0.5) and for serving.
TRAINING_RISK = {
    "Contract": {"Month-to-month": 1.0, "One year": 0.5, "Two year": 0.0},
    "InternetService": {"Fiber optic": 1.0, "DSL": 0.5, "No": 0.0},
    "PaymentMethod": {
        "Electronic check": 1.0,
        "Mailed check": 0.7,
        "Bank transfer (automatic)": 0.3,
        "Credit card (automatic)": 0.3,
    },
}
TRAINING_RISK_OTHER = 0.5
SERVING_RISK = {
    "Contract": {"Month-to-month": 1.0, "One year": 0.5},
    "InternetService": {"Fiber optic": 1.0, "DSL": 0.5},
    "PaymentMethod": {"Electronic check": 1.0, "Mailed check": 0.7},
}
SERVING_RISK_OTHER = {"Contract": 0.0, "InternetService": 0.0, "PaymentMethod": 0.3}
