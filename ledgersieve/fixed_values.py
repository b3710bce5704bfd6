"""Texts, weights and cut-offs that results are compared on.

These are data, not logic. They are stated once, plainly, and every operator
takes them from here or from ``ScreenConfig`` (which uses them as defaults).
"""

# --- Columns --------------------------------------------------------------

REQUIRED_ALIASES = {
    "transaction_id": ["transaction_id", "txn_id", "id", "reference", "ref_no"],
    "date": ["date", "txn_date", "transaction_date", "posting_date"],
    "amount": ["amount", "value", "txn_amount", "transaction_amount"],
    "account": ["account", "account_name", "gl_account", "ledger_account"],
    "description": ["description", "narration", "details", "memo"],
}
OPTIONAL_ALIASES = {
    "user": ["user", "posted_by", "officer", "processed_by"],
    "counterparty": ["counterparty", "vendor", "borrower", "customer", "client_name"],
    "loan_id": ["loan_id", "loan_no", "loan_account", "loan_reference"],
}

# Texts that count as missing in a delimited file.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- First-digit test -----------------------------------------------------

BENFORD_REASON = (
    "Benford's Law: leading digit over-represented vs. expected distribution"
)
# Mean absolute deviation below the bound earns the label.
CONFORMITY_BOUNDS = [
    (0.006, "Close conformity"),
    (0.012, "Acceptable conformity"),
    (0.015, "Marginally acceptable conformity"),
]
NONCONFORMITY = "Nonconformity — investigate further"
SAMPLE_SIZE_WARNING = (
    "Sample size (n=%d) is below Nigrini's recommended minimum of %d for the "
    "first-digit test. Treat results as indicative only — deviations may "
    "reflect sampling noise rather than genuine anomalies."
)

# --- Duplicates -----------------------------------------------------------

DUPLICATE_ID_REASON = "Duplicate transaction_id — data integrity issue"
DUPLICATE_PAYMENT_REASON = (
    "Potential duplicate payment: same counterparty, account, and amount "
    "within %s day(s)"
)
DUPLICATE_GROUP_PREFIX = "DUP-GRP-"
MISSING_KEY_TEXT = "nan"

# --- Round amounts: (multiple, label, risk points), highest first -----------

ROUND_TIERS = [
    (1_000_000, "Extremely round (multiple of 1,000,000)", 20),
    (500_000, "Very round (multiple of 500,000)", 15),
    (100_000, "Highly round (multiple of 100,000)", 10),
    (10_000, "Moderately round (multiple of 10,000)", 5),
]
ROUND_REASON_HEAD = "Round-number transaction: "
ROUND_REASON_TAIL = (
    " — atypical for organically-occurring amounts, common in "
    "estimated/fabricated entries"
)

# --- Outliers -------------------------------------------------------------

OUTLIER_METHOD_NAMES = {
    "modified_zscore": "modified z-score",
    "iqr": "IQR method",
    "zscore": "classic z-score",
}
OUTLIER_REASON_HEAD = "Statistical outlier (%s) within '"
OUTLIER_REASON_MIDDLE = "' — "
OUTLIER_REASON_TAIL = " extreme relative to peer transactions"
NORMAL_CONSISTENCY = 0.6745
DEGENERATE_MAD = 1e-9

# --- Posting times --------------------------------------------------------

TIMING_REASON_HEAD = "Journal entry timing: "
WEEKEND_REASON = "posted on a weekend"
AFTER_HOURS_REASON = "posted outside business hours (%d:00-%d:00)"

# --- Related parties: category, reason, risk points -------------------------

SELF_DEALING = "Self-dealing"
STAFF_AS_BORROWER = "Staff as borrower"
RELATED_PARTY_REASONS = {
    SELF_DEALING: (
        "Related party: counterparty matches the SAME officer who posted this "
        "transaction (possible self-dealing / control bypass)"
    ),
    STAFF_AS_BORROWER: (
        "Related party: counterparty name matches a staff member's name "
        "(disclosure required, not necessarily improper)"
    ),
}
RELATED_PARTY_POINTS = {SELF_DEALING: 45, STAFF_AS_BORROWER: 20}
NEAR_MATCH = "Near match"
FUZZY_REASON_HEAD = (
    "Possible related party: counterparty name closely resembles staff member '"
)
FUZZY_REASON_MIDDLE = "' (similarity "
FUZZY_REASON_TAIL = ") — review recommended, not a confirmed match"

# Letters that case folding changes although they are lower case already.
FOLDED_LETTERS = ("ςſ", "σs")
SHARP_S = "ß"

# --- Risk score -----------------------------------------------------------

METHOD_POINTS = {
    "duplicate": 40,
    "journal_entry": 30,
    "outlier": 25,
    "benford": 10,
}
RISK_LABELS = {
    "duplicate": "Duplicate Payment",
    "outlier": "Statistical Outlier",
    "journal_entry": "Journal Entry Timing (User Concentration)",
    "benford": "Benford's Law",
    "round_number": "Round Number (%s)",
    "related_party": "Related Party (%s)",
}
# Score at or above the bound earns the rating.
RATING_BOUNDS = [(60, "Critical"), (35, "High"), (18, "Medium"), (0, "Low")]
RATINGS = ["Critical", "High", "Medium", "Low"]

# Chart names of the methods, in consolidation order.
METHOD_TITLES = {
    "benford": "Benford's Law",
    "duplicate": "Duplicate Payments",
    "round_number": "Round Numbers",
    "outlier": "Statistical Outliers",
    "journal_entry": "Journal Entry Timing",
    "related_party": "Related Party",
}

# --- Reconciliation -------------------------------------------------------

DISBURSEMENT_ACCOUNT = "Loan Disbursement"
REPAYMENT_ACCOUNT = "Loan Repayment"
GHOST_LOAN = "Unsupported schedule entry — no GL support (possible ghost loan)"
UNSUPPORTED_GL = "Unsupported GL balance — missing from schedule"
MATERIAL_VARIANCE = "Material variance — investigate"
TIMING_DIFFERENCE = "Timing difference — monitor"
CLEAN_TIE_OUT = "Clean tie-out"
CLOSED_LOAN = "Closed loan — fully repaid, correctly excluded from schedule"
# Most urgent first.
RECONCILIATION_ORDER = [
    GHOST_LOAN, UNSUPPORTED_GL, MATERIAL_VARIANCE,
    TIMING_DIFFERENCE, CLEAN_TIE_OUT, CLOSED_LOAN,
]
NOT_A_FINDING = [CLEAN_TIE_OUT, CLOSED_LOAN]
