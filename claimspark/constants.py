"""Word lists, limits, texts and formats that results depend on."""

# Fields an extraction must carry, in report order.
REQUIRED_FIELDS = [
    "claimant_name",
    "policy_number",
    "incident_date",
    "claim_amount",
    "incident_description",
    "claim_type",
]

# Phrases that point to an attempt to instruct the model.
INJECTION_MARKERS = [
    "ignore previous instructions",
    "ignore all prior",
    "system prompt",
    "you are now",
]

# Validation limits and message texts.
MAX_PLAUSIBLE_AMOUNT = 10_000_000
MSG_NOT_JSON = "Model did not return valid JSON: not a JSON object"
MSG_MISSING = "Missing required field: "
MSG_EMPTY = "Field '{field}' is empty/null — document may lack this info"
MSG_NEGATIVE = "claim_amount is negative"
MSG_LARGE = "claim_amount is unusually large — verify manually"
MSG_NOT_NUMERIC = "claim_amount is not numeric: "

# Statuses and failure texts.
STATUS_OK = "success"
STATUS_STORED_OK = "processed"
STATUS_INVALID = "extraction_failed"
STATUS_FAILED = "pipeline_failure"
MSG_FAILED = "An unexpected pipeline execution error occurred"
MSG_NO_KEY = "Missing document key in event"
MSG_NO_TEXT = "The document is an image and has no text"
MSG_AMOUNT_CHANGED = "claim_amount cannot be stored as stated: "

# Fraud points, cap and reason texts.
CLAIMANT_POINTS = 45
POLICY_POINTS = 50
MAX_RISK = 100
MSG_CLAIMANT = "Matching claimant '"
MSG_POLICY = "Matching policy number '"
MSG_FOUND_IN = "' found in file '"

# Retrieval.
TOP_K = 2
QUERY_SUFFIX = " claim coverage limits and exclusions"
CONTEXT_SEPARATOR = "\n---\n"
EMBED_CHARS = 8000

# Policy-number prefix -> line of business.
POLICY_PREFIXES = {"AUTO": "auto", "PROP": "property", "HLTH": "health"}

# Token estimate bases (input, output) and USD per 1000 tokens (input, output).
TOKEN_PRICES = {"small": (0.00025, 0.00125), "large": (0.003, 0.015)}
CHARS_PER_TOKEN = 4

# Flat cost shown per claim.

# Prompt texts.
EXTRACT_SYSTEM = (
    "You are an insurance claims data extraction system. "
    "Extract only what is explicitly stated in the document. "
    "Never infer or fabricate a value. Use null for anything missing."
)
EXTRACT_USER = """Extract the following fields from this insurance claim document
and return ONLY a JSON object, no other text:

- claimant_name (string)
- policy_number (string)
- incident_date (string, ISO format if possible)
- claim_amount (number, no currency symbol)
- incident_description (string, 1-2 sentences)
- claim_type (string: auto | property | health | other)

Document:
{document_text}"""
SUMMARY_SYSTEM = (
    "You are an assistant helping a claims adjuster triage cases quickly. "
    "Be factual and concise. Do not speculate about fault or payout amounts "
    "beyond what the claim data states."
)
SUMMARY_USER = """Extracted claim data:
{extracted_info}

Relevant policy context:
{policy_context}

Write a 3-4 sentence adjuster-facing summary covering: what happened, whether
the claim amount appears within the policy's stated coverage, and any
red flags an adjuster should check manually."""
TEMPLATES = {
    "extract_info": (EXTRACT_SYSTEM, EXTRACT_USER),
    "generate_summary": (SUMMARY_SYSTEM, SUMMARY_USER),
}

# Line of business -> policy title and rule texts.
POLICY_RULES = {
    "auto": (
        "Auto Policy Coverage Summary — Tamil Nadu Standard Motor Plan",
        [
            "Own Damage Limit: Expeditious own damage collision claims settled within IDV "
            "without review if under INR 200,000.",
            "Mandatory Police FIR: Required for third-party collisions exceeding INR 50,000.",
            "Exclusions: Claims filed > 30 days require justification. "
            "Excludes commercial racing/DUI.",
        ],
    ),
    "property": (
        "Property Policy Coverage Summary — Tamil Nadu Homeowner Plan",
        [
            "Water Damage Cap: Covered up to INR 500,000 per incident.",
            "Documentation: Claims > INR 100,000 require independent weather report "
            "confirmation + photo evidence.",
            "Exclusions: Excludes pre-existing structures and gradual seepage > 6 months.",
        ],
    ),
    "health": (
        "Health Policy Coverage Summary — Tamil Nadu Family Health Plan",
        [
            "Hospitalization SLA: Planned cashless-to-reimbursement conversions processed "
            "in 7-10 working days.",
            "Exclusions: Excludes cosmetic or non-prescribed procedures. "
            "Requires discharge summary and bills.",
        ],
    ),
}
UNCATEGORISED = (
    "Uncategorized Policy",
    ["No specific matching rules found in Policy Vector Index."],
)

# Coverage rules as (claim type, code, measure, comparison, bound, adjuster note).
COVERAGE_RULES = [
    ("auto", "AUTO_SCRUTINY", "amount", ">=", 200_000, "own damage needs additional scrutiny"),
    ("auto", "AUTO_POLICE_REPORT", "amount", ">", 50_000, "police report required"),
    ("auto", "AUTO_LATE_FILING", "delay_days", ">", 30, "delay justification note required"),
    ("property", "PROP_OVER_CAP", "amount", ">", 500_000, "above the per-incident cap"),
    ("property", "PROP_VERIFICATION", "amount", ">", 100_000, "independent verification required"),
    ("health", "HLTH_DOCUMENTS", "amount", ">=", 0, "discharge summary and itemized bill required"),
]
