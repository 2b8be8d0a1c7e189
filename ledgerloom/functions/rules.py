"""Keyword vocabularies and thresholds of the classifiers, and how they become Catalyst expressions.

Names of private persons and employers are placeholders; users pass their own lists.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword vocabularies, in order of priority where the first match decides.
LOAN_SOURCES = [
    "pocketly", "speel finance", "speel fin", "stucred", "stucredpayouts", "mpokket", "mpokket financial", "mpokket financi",
    "branch internat", "branch int", "branch payment", "truecredit", "true credit", "true credits", "lazypay", "snapmint",
    "kreon finnancia", "kreon fin", "instantpay indi", "instantpay india", "cashfree paymen", "cashfree payment", "navi limited",
    "slice small fin", "easebuzz privat", "easebuzz", "brokentusk tech", "setu brokentusk", "apibanking",
]
FAMILY_NAMES = ["family member one", "family member two"]
SELF_PATTERNS = ["self transfer", "own account"]
SALARY = ["salary", "payroll", "sal cr", "wages", "pay credit", "monthly pay", "/salary"]
FREELANCE = ["acme technologies"]
MARKETPLACE = ["meesho", "shiprocket", "meeshofas", "myntra des", "razorpay payments"]
INTEREST = ["interest", "int.pd", "int pd", "int cr", "sbint", "fd interest", "savings interest", "interest credit"]
DIVIDEND = ["dividend", "div cr", "div paid", "dividend credit"]
RENTAL = ["rent received", "rental income", "house rent", "property rent"]
CASH_DEPOSIT = ["cash deposit", "cash deposit at", "cash dep", "cashdep", "cdm deposit", "cash deposit at/"]
REIMBURSEMENT = ["reimbursement", "reimb", "expense claim", "travel claim", "medical reimbursement"]
NON_INCOME = [
    "wallet load", "wallet topup", "wallet transfer", "paytm wallet", "phonepe wallet", "prepaid load", "card load",
    "failed payment return", "neft outward return", "excess amount",
]
REVERSAL = [
    "reversal", "reversed", "refund", "cashback", "cash back", "chargeback", "charge back", "credit reversal", "rev:", "returned",
    "reimburse", "dispute credit", "txn reversal", "failed txn", "auto reversal",
]
BUSINESS = [
    "razorpay settlement", "cashfree settlement", "payu settlement", "instamojo settlement", "ccavenue settlement", "stripe payout",
    "consulting fee", "professional fee", "invoice payment", "project payment", "client payment",
]
EMI = [
    "emi payment", "loan repay", "nach debit", "nach/", "pocketly", "stucred", "mpokket", "speel finance", "speel fin", "lazypay repay",
    "lazypay", "snapmint", "truecredit", "true credits", "branch international", "kreon finnancia", "instantpay", "home loan",
    "car loan emi", "personal loan emi",
]
BOUNCE = ["return unpaid", "bounce", "dishonour", "ecs return", "nach return", "insufficient fund", "si return"]
CASH = ["cash deposit", "cash withdrawal", "atm withdrawal", "cwdr", "cash wdl"]
S80C = [
    "lic premium", "ppf deposit", "nsc ", "elss ", "epf contribution", "provident fund", "life insurance premium", "tax saving fd",
    "sukanya samriddhi", "nps contribution", "tuition fee", "stamp duty",
]
S80C_EXCLUDED = ["safe gold", "safegold", "gold etf", "sovereign gold", "digital gold", "gold bond"]
S80D = [
    "health insurance", "mediclaim", "star health", "bajaj allianz health", "niva bupa", "max bupa", "care health",
    "aditya birla health", "health premium",
]
TDS = ["tds deducted", "tax deducted", "income tax deducted"]
CARD_PAYMENT = ["credit card", "cc payment", "cc bill", "card bill", "hdfc cc", "sbi card", "card dues"]
GAMBLING = [
    "dream11", "my11circle", "rummycircle", "betting", "gambling", "casino", "lottery", "binance", "wazirx", "coinswitch", "coindcx",
    "bitcoin", "ethereum", "exness", "forex trading", "mpl gaming",
]
PENALTY = ["penalty charge", "penal interest", "late payment fee", "overdue charge"]
B2B_SELLERS = ["pvt ltd", "private limited", "limited", " llp", "technologies", "solutions", "enterprises", "trading co"]
B2B_GATEWAYS = ["razorpay settlement", "cashfree settlement", "payu settlement", "instamojo", "acme"]
FOREIGN = ["swift", "foreign inward", "usd ", "eur ", "gbp ", "paypal", "stripe", "wise"]
SPEND = {
    "EMI / Loan Repayment": [
        "pocketly", "stucred", "mpokket", "lazypay", "snapmint", "truecredit", "true credits", "branch international",
        "kreon finnancia", "instantpay", "nach debit", "nach/", "speel finance", "emi payment", "loan repay",
    ],
    "Food & Dining": [
        "swiggy", "zomato", "dominos", "pizza hut", "mcdonalds", "kfc", "subway", "restaurant", "cafe", "burger king", "dunkin",
        "chaayos", "starbucks",
    ],
    "Grocery": [
        "blinkit", "zepto", "bigbasket", "dmart", "big bazaar", "reliance fresh", "more supermarket", "grofers", "jiomart",
        "nature basket", "spencers",
    ],
    "Shopping": [
        "amazon", "flipkart", "myntra", "meesho", "ajio", "snitch", "zudio", "nykaa", "bewakoof", "clovia", "tata cliq",
        "reliance trends",
    ],
    "Fuel": [
        "petrol", "fuel", "diesel", "hp petrol", "iocl", "bpcl", "indian oil", "hindustan petroleum", "bharat petroleum", "shell",
        "fastag",
    ],
    "Healthcare": [
        "apollo pharmacy", "one stop pharma", "tata one mg", "medplus", "pharmeasy", "hospital", "clinic", "doctor", "medicine",
        "pharmacy", "netmeds",
    ],
    "Education": [
        "school fee", "college fee", "tuition", "udemy", "coursera", "byju", "unacademy", "vedantu", "exam fee", "books",
    ],
    "Utilities": [
        "electricity", "water bill", "gas bill", "bses", "tata power", "adani electricity", "mahanagar gas", "igl", "piped gas",
        "bescom", "mseb",
    ],
    "Entertainment": [
        "netflix", "spotify", "bookmyshow", "pvr ", "inox", "zee5", "jiohotstar", "amazon prime", "disney", "youtube premium",
        "gaana", "apple music",
    ],
    "Travel": [
        "irctc", "makemytrip", "redbus", "goibibo", "indigo", "spicejet", "airbnb", "oyo ", "uber", "olacabs", "ola cabs",
        "ola ride", "rapido",
    ],
    "Telecom": [
        "airtel", "jio recharge", "vodafone", "vi ", "bsnl", "mobile recharge", "broadband", "internet", "dth recharge", "tata sky",
        "dish tv",
    ],
    "Investment": [
        "mutual fund", "sip ", "nse", "bse", "zerodha", "groww", "upstox", "icicidirect", "hdfc securities", "ppf deposit", "nps ",
        "elss ", "fd ", "fixed deposit",
    ],
    "Subscriptions": [
        "linkedin premium", "canva pro", "microsoft 365", "adobe", "scribd", "google one", "icloud", "higgsfield",
    ],
    "ATM / Cash Withdrawal": ["atm withdrawal", "cash wdl", "cwdr", "atm cash"],
    "Insurance": [
        "lic premium", "life insurance", "health insurance", "mediclaim", "star health", "niva bupa", "bajaj allianz", "hdfc life",
        "icici prudential", "max life",
    ],
    "Rent": ["house rent", "pg rent", "flat rent", "lease rent", "rental payment", "room rent"],
}
PAYMENT_WORDS = ["upi", "neft", "imps", "rtgs", "transfer", "payment", "charges", "other", "unknown", "misc", "debit"]
MODES = {
    "IMPS": ["imps"],
    "NEFT": ["neft"],
    "RTGS": ["rtgs"],
    "ATM": ["atm withdrawal", "atm wdr", "cash wdl", "cwdr"],
    "Cash Deposit": ["cash deposit", "cash dep", "cdm deposit"],
    "Card": ["pos/", " pos ", "pci/", "card swipe"],
    "International": ["swift", "foreign inward", "usd ", "eur ", "paypal", "stripe", "wise"],
    "Cheque": ["chq", "cheque", "clearing", "cts/"],
    "NACH/ECS": ["nach", "ecs/", "mandate", "auto debit"],
}
UPI_PATTERN = r"(upi[/\-\s]|@ok|@ybl|@ibl|@axl|@okhdfcbank|@oksbi|@paytm|gpay|phonepe|bhim)"

# Thresholds of the engine and the reports (money in rupees).
FOIR_HEALTHY, FOIR_MODERATE, FOIR_CAP = 35.0, 50.0, 50.0
INTEREST_RATE, TENURE_MONTHS = 0.10, 60
HIGH_VALUE, DAILY_CASH, ANNUAL_CASH, STR_DAY = 200_000, 50_000, 1_000_000, 500_000
STRUCTURING = (180_000, 200_000)
CAP_80C, CAP_80D, GST_RATE, GST_THRESHOLD = 150_000, 25_000, 0.18, 2_000_000

TAXABLE = ["salary", "business", "interest", "dividend", "rental"]


def pattern(keywords: list[str]) -> str:
    """One alternation: keywords of up to five characters stand between non-alphanumerics, longer ones anywhere."""
    short = sorted({k.strip() for k in keywords if len(k.strip()) <= 5})
    long = sorted({k for k in keywords if len(k.strip()) > 5})
    parts = [re.escape(k) for k in long]
    if short:
        parts.append(r"(?<![a-zA-Z0-9])(?:" + "|".join(re.escape(k) for k in short) + r")(?![a-zA-Z0-9])")
    return "|".join(parts)


def mentions(lowered: Column, keywords: list[str]) -> Column:
    return lowered.rlike(pattern(keywords))


def contains_any(lowered: Column, keywords: list[str]) -> Column:
    return lowered.rlike("|".join(re.escape(k) for k in keywords))


def first_match(rules: list[tuple[Column, str]], otherwise: Column) -> Column:
    """The label of the first rule that holds: one CASE, evaluated in order."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, label in rules[1:]:
        out = out.when(condition, F.lit(label))
    return out.otherwise(otherwise)
