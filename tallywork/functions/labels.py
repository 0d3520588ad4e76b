"""Band edges, labels and orders that results are keyed by."""

REJECT_ORDER = (
    "MISSING_TRANSACTION_ID", "DUPLICATE_TRANSACTION_ID", "INVALID_CUSTOMER_ID", "INVALID_TRANSACTION_DATE",
    "PARTIAL_COVERAGE_PERIOD", "DATE_OUTSIDE_WINDOW", "MISSING_OR_INVALID_AMOUNT", "NEGATIVE_AMOUNT", "ZERO_AMOUNT",
    "AMOUNT_OUT_OF_RANGE",
)

# (exclusive upper edge, label); the last edge is open.
HOUR_BANDS = ((6, "Early morning (00-05)"), (12, "Morning (06-11)"), (17, "Afternoon (12-16)"),
              (21, "Evening (17-20)"), (None, "Night (21-23)"))
AMOUNT_BANDS = ((100, "1. < 100"), (500, "2. 100-499"), (1000, "3. 500-999"), (5000, "4. 1K-4.9K"),
                (25000, "5. 5K-24.9K"), (None, "6. 25K+"))
BALANCE_BANDS = ((1, "1. Zero (< 1)"), (1000, "2. 1-999"), (10000, "3. 1K-9.9K"), (50000, "4. 10K-49.9K"),
                 (100000, "5. 50K-99.9K"), (1000000, "6. 1L-9.9L"), (None, "7. 10L+"))
AGE_BANDS = ((25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"), (65, "55-64"), (None, "65+"))

AGE_ORDER = ("18-24", "25-34", "35-44", "45-54", "55-64", "65+", "Unknown")
GENDER_ORDER = ("F", "M", "Unknown")
TIER_ORDER = ("A", "B", "C", "Watch")
EVIDENCE_ORDER = ("High", "Medium", "Low")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

THEMES = ("investment", "premium", "credit_card", "insurance", "personal_loan", "reengagement")
THEME_LABELS = {
    "investment": "Investment / MF interest",
    "premium": "Premium account interest",
    "credit_card": "Credit card interest",
    "insurance": "Insurance interest",
    "personal_loan": "Personal loan interest (demand signal only)",
    "reengagement": "Re-engagement (service)",
}
THEME_NAMES = {
    "investment": "Investment / MF",
    "premium": "Premium account",
    "credit_card": "Credit card",
    "insurance": "Insurance",
    "personal_loan": "Personal loan (demand)",
    "reengagement": "Re-engagement",
}
NO_THEME = "No rule fully met"
