"""Keyword lists, patterns, tolerances and tax tables.

These decide results, so they are kept here as plain data; operators turn them
into expressions or small frames.
"""

from __future__ import annotations

from decimal import Decimal

# --- Nature of a ledger entry. Fixed values; matched as substrings of upper-case text.
REFUND = ("REFUND", "REVERSAL", "REV", "REVERSED", "CASHBACK", "REWARD")
INTEREST = ("INTEREST", "INT CR", "FD INT", "SAVINGS INTEREST")
DIVIDEND = ("DIVIDEND",)
SALARY = ("SALARY", "PAYROLL", "WAGES")
TAX = ("TAX", "TDS", "ADVANCE TAX", "CHALLAN", "GST")
INVESTMENT = ("MUTUAL FUND", "SIP", "NPS", "PPF", "DEMAT", "ZERODHA", "GROWW", "ICICI DIRECT")
CARD_PAYMENT = (
    "CREDIT CARD PAYMENT", "CARD PAYMENT", "CC PAYMENT", "CCPMT", "CARD PMT", "PAYMENT RECEIVED", "PAYMENT-THANK YOU",
    "PAYMENT THANK YOU", "AUTOPAY", "BILLDESK", "TELE TRANSFER", "TELE TRANSFER CREDIT", "TELE TRANSFER CR",
    "CARD PAYMENT RECEIVED", "CC BILL PAYMENT",
)
TELE_CREDIT = ("TELE TRANSFER CREDIT", "TELE TRANSFER CR")
EXPLICIT_BILL = (
    "CREDIT CARD PAYMENT", "CC PAYMENT", "CCPMT", "CARD PMT", "CC BILL PAYMENT", "PAYMENT RECEIVED", "PAYMENT THANK YOU",
    "PAYMENT-THANK YOU", "CARD PAYMENT RECEIVED", "TELE TRANSFER CREDIT", "TELE TRANSFER CR",
)
BANK_TOKENS = ("HDFC", "ICICI", "SBI", "AXIS", "KOTAK", "AMEX", "INDUSIND", "YES BANK")
CHANNEL = ("UPI", "IMPS", "NEFT", "RTGS", "TRANSFER")
SELF = ("SELF", "OWN", "TO A/C", "FROM A/C", "ACCOUNT TRANSFER")
TRANSFERISH = ("TRANSFER", "TELE TRANSFER", "CREDIT CARD PAYMENT", "CC PAYMENT", "CARD PAYMENT", "BILLDESK", "IMPS", "NEFT", "RTGS", "UPI", "AUTOPAY")
UPI = ("UPI", "VPA", "PAYTM", "PHONEPE", "GPAY", "BHIM")
REVERSAL = ("REVERSAL", "REV", "REFUND", "FAILED", "FAILURE", "REVERSED")
NATURES = ("expense", "income", "transfer_internal", "refund", "investment", "tax", "interest_income", "dividend_income")

# --- Category guesses. Fixed values; first group with a match wins.
CATEGORY_RULES = (
    (("ATM WDL", "ATM WITHDRAW", "CASH WITHDRAW"), "ATM Withdrawal"),
    (("CREDIT CARD PAYMENT", "CC PAYMENT", "CARD PAYMENT", "BILLDESK", "AUTOPAY"), "Credit Card Payment"),
    (("SALARY", "PAYROLL", "WAGES"), "Salary"),
    (("INTEREST", "FD INT", "SAVINGS INTEREST"), "Interest"),
    (("DIVIDEND",), "Dividend"),
    (("MUTUAL FUND", "SIP", "NPS", "PPF", "ZERODHA", "GROWW", "ICICI DIRECT"), "Investment"),
    (("INCOME TAX", "ADVANCE TAX", "SELF ASSESSMENT TAX", "TDS", "CHALLAN", "GST"), "Tax"),
    (("SWIGGY", "ZOMATO"), "Food Delivery"),
    (("UBER", "OLA", "RAPIDO"), "Cab & Auto"),
    (("NETFLIX", "HOTSTAR", "PRIME VIDEO", "SPOTIFY"), "OTT Subscriptions"),
    (("RENT", "HOUSE RENT"), "Rent"),
    (("ELECTRICITY", "BESCOM", "MSEB", "TNEB"), "Electricity"),
    (("AIRTEL", "JIO", "VODAFONE", "BSNL", "ACT FIBERNET"), "Mobile & Internet"),
    (("INSURANCE", "LIC"), "Insurance"),
)
WEB_RULES = (
    (("E-COMMERCE", "ONLINE RETAIL", "MARKETPLACE"), "Online Shopping"),
    (("FOOD DELIVERY", "RESTAURANT CHAIN", "QUICK SERVICE RESTAURANT"), "Food Delivery"),
    (("RIDE-HAILING", "CAB", "TAXI SERVICE"), "Cab & Auto"),
    (("BROKERAGE", "MUTUAL FUND PLATFORM", "STOCK BROKER"), "Investment"),
    (("INSURANCE",), "Insurance"),
    (("SUBSCRIPTION VIDEO", "MUSIC STREAMING", "STREAMING SERVICE"), "OTT Subscriptions"),
)

# --- Buckets of recurring payments. Fixed values; word-boundary patterns without regard to case, in order.
RECURRING_RULES = (
    ("rent", r"\b(rent|landlord|property\s*rent|flat\s*rent)\b"),
    ("utility", r"\b(electricity|bescom|tata\s*power|adani\s*electric|reliance\s*energy|water\s*bill|bwssb|gas\s*bill|broadband|jio\s*fiber|airtel\s*xstream|act\s*fibernet|hathway|tata\s*sky|d2h|prepaid|postpaid|mobile\s*bill|recharge|utilit(?:y|ies))\b"),
    ("emi", r"\b(emi|installment|loan\s*repayment|home\s*loan|car\s*loan|personal\s*loan|two\s*wheeler\s*loan|education\s*loan)\b"),
    ("insurance", r"\b(insurance|policy\s*premium|mediclaim|lic|hdfc\s*life|max\s*life|icici\s*pru|term\s*plan|car\s*insurance|two\s*wheeler\s*insurance)\b"),
    ("subscription", r"\b(netflix|prime\s*video|hotstar|disney|spotify|apple\s*music|youtube\s*premium|youtube\s*music|sony\s*liv|zee5|swiggy\s*one|zomato\s*gold|gym|cult[\s._-]?fit|fitness|google\s*one|icloud|dropbox|microsoft\s*365|office\s*365|github|notion|substack)\b"),
    ("salary", r"\b(salary|sal\s*credit|payroll|stipend|wages|consultancy\s*fee)\b"),
    ("investment", r"\b(sip\b|mutual\s*fund|ppf\s*contribution|nps\s*contribution|recurring\s*deposit|rd\b|elss|kuvera|groww|coin|zerodha|paytm\s*money)\b"),
)

# --- Deduction sections: name, pattern without regard to case, cap (0: none), whether credits count. Fixed values.
SECTION_RULES = (
    ("80C", r"\b(ppf|elss|nps\b|nps tier 1|life insurance|sukanya|epf|vpf|home loan principal|5-?year tax saving fd|tax saver fd|nsc)\b", 150000, False),
    ("80D", r"\b(health insurance|medical insurance|mediclaim|preventive health)\b", 25000, False),
    ("80D-parents", r"\b(parents?\s*(health|medical)\s*insurance|parents?\s*mediclaim)\b", 50000, False),
    ("80E", r"\b(education loan interest|student loan interest)\b", 0, False),
    ("80G", r"\b(donation|charity|relief fund)\b", 0, False),
    ("24b", r"\b(home loan interest|housing loan interest)\b", 200000, False),
    ("80TTA", r"\b(savings interest|interest credit|interest paid)\b", 10000, True),
)

# --- Display labels. Fixed values.
ACCOUNT_SUFFIX = {"credit_card": "CC", "savings": "Saving", "current": "Current", "salary": "Salary", "loan": "Loan", "demat": "Demat", "wallet": "Wallet", "upi": "UPI"}
BANK_LABEL = {"HDFC": "HDFC", "ICICI": "ICICI", "SBI": "SBI", "AXIS": "Axis", "KOTAK": "Kotak", "IDFC": "IDFC", "YES": "YES", "RBL": "RBL", "HSBC": "HSBC", "AMEX": "Amex"}

# --- SMS senders and patterns. Fixed values; all without regard to case unless a pattern says otherwise.
SENDERS = (
    ("HDFCBK", "HDFC", "savings"), ("HDFCBN", "HDFC", "savings"), ("HDFCCC", "HDFC", "credit_card"), ("HDFCRD", "HDFC", "savings"),
    ("ICICIB", "ICICI", "savings"), ("ICICIS", "ICICI", "savings"), ("ICICIP", "ICICI", "savings"),
    ("AXISBK", "AXIS", "savings"), ("AXISBN", "AXIS", "savings"),
    ("SBIINB", "SBI", "savings"), ("SBIPSG", "SBI", "savings"), ("SBICRD", "SBI", "credit_card"), ("SABORB", "SBI", "savings"),
    ("KOTAKB", "KOTAK", "savings"), ("KOTKBK", "KOTAK", "savings"), ("YESBKL", "YES", "savings"), ("INDBNK", "INDUSIND", "savings"),
    ("RBLBNK", "RBL", "savings"), ("IDFCFB", "IDFC_FIRST", "savings"), ("PNBSMS", "PNB", "savings"), ("CANBNK", "CANARA", "savings"),
    ("BOIIND", "BOI", "savings"), ("UCOBNK", "UCO", "savings"), ("JIOBNK", "JIO_PAYMENTS", "wallet"), ("PAYTMB", "PAYTM", "wallet"),
)
SMS_AMOUNT = (
    r"(?i)(?:Rs\.?|INR|₹)\s?([\d,]+\.?\d*)",
    r"(?i)(?:debited|credited|spent|received|paid|withdrawn)\s+(?:Rs\.?|INR|₹)?\s?([\d,]+\.?\d*)",
    r"(?i)([\d,]+\.?\d*)\s*(?:has been|was)\s*(?:debited|credited)",
)
SMS_ACCOUNT = (
    r"(?i)(?:a/c|account|acct|ac)\s*(?:no\.?\s*)?(?:XX|xx|X{2,}|\*{2,})(\d{3,6})",
    r"(?i)(?:card)\s*(?:ending|no\.?|xx)\s*(\d{4})",
    r"(?:XX|xx|\*{2,})(\d{4,6})",
)
SMS_BALANCE = (r"(?i)(?:bal|balance|avl\.?\s*bal\.?|available)\s*(?:is|:)?\s*(?:Rs\.?|INR|₹)?\s?([\d,]+\.?\d*)",)
SMS_REFERENCE = (
    r"(?i)(?:UPI|Ref)\s*(?:No\.?|Ref\.?|ID)?\s*[:.]?\s*(\d{12,})",
    r"(?i)(?:NEFT|RTGS|IMPS)\s*(?:Ref\.?)?\s*[:.]?\s*([A-Z0-9]{8,})",
)
SMS_VPA = (r"(?i)(?:to|from|VPA)\s*[:.]?\s*([a-zA-Z0-9._-]+@[a-zA-Z]+)",)
SMS_OTP = (
    r"(?i)\bOTP\b", r"(?i)\bone[\s-]time[\s-]password\b", r"(?i)\bverification\s*code\b", r"(?i)\b\d{4,8}\b.*(?:is your|use this)",
    r"(?i)(?:do not share|never share).*(?:OTP|password|PIN)",
)
SMS_DEBIT = (r"(?i)(?:debited|deducted|spent|paid|purchase|withdrawn|transferred|sent)\b", r"(?i)\bdr\b")
SMS_CREDIT = (r"(?i)(?:credited|received|deposited|refund|cashback|reversed)\b", r"(?i)\bcr\b")
SMS_PROMO = (
    r"(?i)\b(?:offer|discount|cashback|reward|apply\s*now|limited\s*time|exclusive|pre-?approved)\b",
    r"(?i)\b(?:EMI\s*available|instant\s*loan|credit\s*limit.*increased)\b",
    r"(?i)\b(?:congratulations|eligible|selected|lucky)\b",
)
SMS_HAS_ACCOUNT = r"(?i)(?:a/c|account|acct|ac)\s*(?:no\.?\s*)?(?:XX|xx|X{2,}|\*{2,})\d"
SPAM_URGENT = (
    r"(?i)account\s*(?:will\s*be\s*)?(?:blocked|suspended|closed|frozen)", r"(?i)immediate(?:ly)?\s*(?:action|attention|verification)",
    r"(?i)(?:verify|update)\s*(?:your\s*)?(?:KYC|PAN|Aadhaar)", r"(?i)(?:will\s*be\s*)?(?:blocked|suspended)\s*(?:in|within)\s*\d+",
)
SPAM_SENSITIVE = (
    r"(?i)(?:share|send|provide|enter)\s*(?:your\s*)?(?:OTP|PIN|CVV|password|card\s*number)",
    r"(?i)(?:click|tap)\s*(?:here|link|below)\s*to\s*(?:verify|update|confirm)",
    r"(?i)call\s*(?:this|the)?\s*(?:number|helpline)\s*(?:immediately|urgently)",
)
SPAM_TEMPLATE = (
    r"(?i)if\s*not\s*(?:done|authorized)\s*by\s*you.*?call\s*\d{10}", r"(?i)KYC\s*(?:expired?|expir(?:ing|es)|not\s*updated).*?(?:click|link|update)",
    r"(?i)(?:won|winner|prize|lottery|jackpot).*?(?:claim|collect|click)", r"(?i)(?:earn|income)\s*(?:Rs\.?|INR)\s*[\d,]+\s*(?:per|daily|weekly)",
)

# --- Tolerances and thresholds. Fixed values.
WALK_TOLERANCE = Decimal("1.00")
CONFIDENCE_FLOOR, LEAST_YIELD, YIELD_ROWS, LARGE_AMOUNT = 0.75, 0.55, 5, 100000
#: Recurring gaps in days: name, least, most, months to the next one.
RECURRING_GAPS = (("monthly", 25, 35, 1), ("quarterly", 80, 100, 3), ("yearly", 340, 390, 12))
RECURRING_SPREAD = 0.20
TRANSFER_AMOUNT, TRANSFER_DAYS = Decimal("0.50"), 5
UPI_AMOUNT, UPI_DAYS, UPI_CONFIDENCE = Decimal("0.01"), 3, 0.88
SMS_AMOUNT_GAP, SMS_DAYS = Decimal("1.00"), 3
SPIKE_LEAST, NEW_MERCHANT_AMOUNT = 5, Decimal("5000")

# --- Income tax by financial year. Fixed values: (upper bound or None, per cent) brackets.
NEW_SLABS = {
    "2023-24": ((300000, 0), (600000, 5), (900000, 10), (1200000, 15), (1500000, 20), (None, 30)),
    "2024-25": ((300000, 0), (700000, 5), (1000000, 10), (1200000, 15), (1500000, 20), (None, 30)),
    "2025-26": ((400000, 0), (800000, 5), (1200000, 10), (1600000, 15), (2000000, 20), (2400000, 25), (None, 30)),
}
OLD_SLABS = {
    "below_60": ((250000, 0), (500000, 5), (1000000, 20), (None, 30)),
    "senior": ((300000, 0), (500000, 5), (1000000, 20), (None, 30)),
    "super_senior": ((500000, 0), (1000000, 20), (None, 30)),
}
#: Highest income with a rebate, and the most that is rebated.
NEW_REBATE = {"2023-24": (700000, 25000), "2024-25": (700000, 25000), "2025-26": (1200000, 60000)}
OLD_REBATE = (500000, 12500)
STANDARD_DEDUCTION = {"2023-24": (50000, 50000), "2024-25": (50000, 75000), "2025-26": (50000, 75000)}  # old, new
#: Surcharge in per cent of the tax where income is above the first number.
OLD_SURCHARGE = ((5000000, 10), (10000000, 15), (20000000, 25), (50000000, 37))
NEW_SURCHARGE = ((5000000, 10), (10000000, 15), (20000000, 25))
CESS = 4
#: Equity gains: short-term per cent, long-term per cent, long-term exemption.
EQUITY = {"2023-24": (Decimal("15"), Decimal("10"), 100000), "2024-25": (Decimal("20"), Decimal("12.5"), 125000), "2025-26": (Decimal("20"), Decimal("12.5"), 125000)}
EQUITY_BEFORE = (Decimal("15"), Decimal("10"), 100000)
EQUITY_CUT = "2024-07-23"
SECTION_CAPS = {"80C": 150000, "80CCD1B": 50000, "80D_self": 25000, "80D_senior": 50000, "80TTA": 10000, "80TTB": 50000, "24b": 200000}
HRA_METROS = ("mumbai", "delhi", "kolkata", "chennai")

# --- Words that say nothing about a statement or a merchant. Fixed values.
STATEMENT_STOPWORDS = (
    "the", "and", "for", "with", "from", "this", "that", "your", "bank", "statement", "account", "page", "date", "amount",
    "balance", "total", "credit", "debit", "transaction", "transactions", "description",
)
GENERIC_WORDS = ("UPI", "IMPS", "NEFT", "RTGS", "TRANSFER", "PAYMENT", "DEBIT", "CREDIT", "PURCHASE", "POS", "INR", "TRF", "TXN", "REF", "ID", "NO")

# --- Banks and kinds of account in statement text. Fixed values.
BANK_ALIASES = {
    "SBI": ("SBI", "STATE BANK OF INDIA", "STATE_BANK_OF_INDIA"), "HDFC": ("HDFC", "HDFC BANK"), "ICICI": ("ICICI", "ICICI BANK"), "AXIS": ("AXIS", "AXIS BANK"),
    "KOTAK": ("KOTAK", "KOTAK MAHINDRA BANK"), "PNB": ("PNB", "PUNJAB NATIONAL BANK"), "BOB": ("BANK OF BARODA", "BARODA", "BOB"), "CANARA": ("CANARA", "CANARA BANK"),
    "UNION": ("UNION", "UNION BANK", "UNION BANK OF INDIA"), "INDIAN": ("INDIAN", "INDIAN BANK"), "BOI": ("BOI", "BANK OF INDIA"), "IDBI": ("IDBI", "IDBI BANK"),
    "INDUSIND": ("INDUSIND", "INDUSIND BANK"), "YES": ("YES", "YES BANK"), "FEDERAL": ("FEDERAL", "FEDERAL BANK"),
}
BANK_WORDS = {
    "SBI": ("state bank of india", "sbi"), "HDFC": ("hdfc bank", "hdfc"), "ICICI": ("icici bank", "icici"), "AXIS": ("axis bank", "axis"),
    "KOTAK": ("kotak mahindra bank", "kotak"), "PNB": ("punjab national bank", "pnb"), "BOB": ("bank of baroda", "bob", "baroda"), "CANARA": ("canara bank", "canara"),
    "UNION": ("union bank of india", "union bank", "union"), "INDIAN": ("indian bank", "indian bank ltd"), "BOI": ("bank of india", "boi"), "IDBI": ("idbi bank", "idbi"),
    "INDUSIND": ("indusind bank", "indusind"), "YES": ("yes bank", "yesbank", "yes bank ltd"), "FEDERAL": ("federal bank", "federal"),
}
ACCOUNT_TYPE_ALIASES = {
    "auto": ("AUTO", "AUTO_DETECT"), "bank_account": ("BANK_ACCOUNT", "BANK STATEMENT", "BANK_STATEMENT", "SAVING", "SAVINGS", "CURRENT"),
    "credit_card": ("CREDIT_CARD", "CREDIT CARD", "CC"),
}
HEAD_RULES = (
    (("public provident fund", "ppf account"), "ppf"), (("challan", "self assessment tax receipt"), "tax_challan"), (("form no. 16", "form 16", "form no 16"), "tax_form"),
    (("fixed deposit advice", "fixed deposit receipt"), "fixed_deposit"), (("interest certificate",), "interest_certificate"), (("dividend",), "dividend_report"),
    (("consolidated account statement", "mutual fund statement"), "investment"),
)
CARD_CUES = ("credit card", "card statement", "total amount due", "minimum amount due", "payment due date", "credit limit", "available limit", "card no")
BANK_CUES = ("account statement", "savings account", "current account", "available balance", "closing balance", "opening balance", "withdrawal", "deposit", "cheque", "passbook")

# --- What stands around numbers in text that is masked. Fixed values.
REFERENCE_CONTEXT = r"(?i)\b(?:upi|utr|rrn|imps|neft|rtgs|txn|txnid|ref|reference|trace|order|vpa)\b"
ACCOUNT_CONTEXT = r"(?i)\b(?:account|a/c|acct|acc(?:ount)?\s*no|card|card\s*no|ending|masked)\b"
#: How far these may stand from a number, also where short references are kept.
CONTEXT, WIDE_CONTEXT = 18, 40
LONG_NUMBER = r"\b(?:\d[\s-]?){9,19}\b"
MASKS_BEFORE = ((r"(?im)^.*\bOTP\b.*$", "[OTP_LINE_REMOVED]"), (r"\b\d{4}[\s-]\d{4}[\s-]\d{4}\b", "XXXX XXXX XXXX"), (r"\b[A-Z]{5}\d{4}[A-Z]\b", "XXXX_PAN"))
#: An address begins where its run of characters does, or where the address before it ended, so that a long run is read once.
MASKS_AFTER = ((r"(?:(?<![a-zA-Z0-9_.+-])|\G)[a-zA-Z0-9_.+-]++@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "XXXX@XXXX.XXX"), (r"(?<!\d)(?:\+91[\s-]?|0)?[6-9]\d{9}\b", "XXXX_PHONE"))
CARD_MASK, ACCOUNT_MASK, NAME_MASK = "XXXX-XXXX-XXXX-XXXX", "XXXX_ACCT", "XXXX_NAME"
COUNT_UP, COUNT_DOWN = "01234567890123456789", "98765432109876543210"

# --- Tax documents. Words before an amount, by category; heads of a salary form; marks of other rows.
AIS_WORDS = {
    "salary": ("salary received", "salary income", "salary"),
    "interest": ("interest from savings bank", "interest from deposit", "interest from fd", "savings interest", "deposit interest", "fd interest", "interest"),
    "dividend": ("dividend received", "dividend"),
    "securities_sold": ("sale of securities", "sale of shares", "sale of mutual fund", "securities sold"),
    "rental": ("rent received", "rental income"),
    "tds": ("tds on", "tax deducted at source"),
}
AIS_SOURCES = (r"HDFC\s*BANK", r"ICICI\s*BANK", r"AXIS\s*BANK", "SBI", "KOTAK", r"YES\s*BANK", "PNB", "CDSL", "NSDL")
FORM16_HEADS = {
    "gross_salary": r"(?i)(?:Gross\s*Salary|Salary\s*as\s*per\s*provisions|Total\s*Income\s*from\s*Salary)\s*[:\-]?\s*([0-9][0-9,]*(?:\.\d{1,2})?)",
    "tds": r"(?i)(?:Total\s*Tax\s*Deducted|TDS|Tax\s*Deducted\s*at\s*Source)\s*[:\-]?\s*([0-9][0-9,]*(?:\.\d{1,2})?)",
    "deduction_80c": r"(?i)80C[^0-9]{0,20}([0-9][0-9,]*(?:\.\d{1,2})?)",
    "deduction_80d": r"(?i)80D[^0-9]{0,20}([0-9][0-9,]*(?:\.\d{1,2})?)",
    "deduction_80ccd_1b": r"(?i)80CCD\(?1B\)?[^0-9]{0,20}([0-9][0-9,]*(?:\.\d{1,2})?)",
    "house_rent_allowance": r"(?i)HRA[^0-9]{0,20}([0-9][0-9,]*(?:\.\d{1,2})?)",
    "standard_deduction": r"(?i)Standard\s*Deduction[^0-9]{0,20}([0-9][0-9,]*(?:\.\d{1,2})?)",
}
#: Characters: from a word to its amount, kept before and behind both, and that tell two rows apart.
AIS_REACH, AIS_BEFORE, AIS_BEHIND, AIS_SAME = 40, 80, 40, 60
#: Characters before and behind a deductor's number, and of a challan's row; digits of a number without decimals there; least amount of a challan.
TAN_BEFORE, TAN_BEHIND, CHALLAN_ROW = 50, 200, 200
TAN_DIGITS, CHALLAN_DIGITS, CHALLAN_LEAST = 3, 4, 100
PLAIN_AMOUNT = r"[0-9][0-9,]*(?:\.\d{1,2})?"
TAN, SECTION, CHALLAN = r"\b([A-Z]{4}\d{5}[A-Z])\b", r"\b(192[A-Z]?|193|194[A-Z]?|195|196[A-Z]?|206[A-Z]{2})\b", r"(?i)(?:challan|bsr)\s*[:#]?\s*(\d{7,})"

# --- Directions of a statement whose rows carry balances. Fixed values.
CREDIT_NARRATIONS = ("INT.PD", "INTEREST", "CLOSURE PROCEEDS", "SALARY", "GIFT", "REFUND")
DELTA_TOLERANCE = 0.02
REFERENCE_TOKEN = r"(?i)\b([A-Z0-9][A-Z0-9/\-:]{5,})\b"

# --- Documents that a return needs. Fixed values.
TAX_DOCUMENTS = ("tax_form", "tax_challan", "interest_certificate", "demat_tax_report", "dividend_report", "fd_report", "ppf_statement")
FORM16A_SECTIONS = ("194", "194A", "194K")
FORM16A_SECTIONS = ("194", "194A", "194K")
LEAST_LEDGER_ROWS = 10

# --- Names of document types, as hints give them. The type, and the names that stand for it.
DOCUMENT_TYPES = {
    "auto": ("auto",),
    "bank_statement": ("bank_statement", "bank_account_statement", "saving_statement", "savings_statement"),
    "credit_card_statement": ("credit_card_statement",),
    "interest_certificate": ("interest_certificate",),
    "fd_report": ("fd_report", "fixed_deposit"),
    "tax_challan": ("tax_challan", "direct_tax_ack", "direct_tax_payment_acknowledgement"),
    "ppf_statement": ("ppf_statement",),
    "tax_form": ("tax_form",),
    "dividend_report": ("dividend_report",),
    "demat_tax_report": ("demat_tax_report", "capital_gains_statement", "pnl_statement", "p_and_l_statement"),
    "demat_trade_report": ("demat_trade_report", "contract_note_report"),
    "demat_holdings": ("demat_holdings", "stock_holdings", "mutual_fund_holdings", "balance_statement"),
}
STATEMENT_TYPES = ("bank_statement", "credit_card_statement")
NO_PARSER, NO_FORMAT, LOCKED = "no parser configured", "could not identify the bank/statement type", "password-protected"

# --- Rows that an extractor gave. Days around a period, characters that tell two rows apart.
DAYS_BEFORE_PERIOD, DAYS_AFTER_PERIOD, EXTRACTED_SAME, CHUNK_SAME = 120, 31, 120, 90
LINE_CHUNK, LINE_OVERLAP, MOST_LINE_CHUNKS = 5200, 6, 12
ROW_CHUNK, ROW_OVERLAP = 120, 8

# --- Corrections and routing. Fixed values.
SETTABLE_NATURES = ("expense", "income", "transfer_internal", "refund", "investment", "tax")
SMALL_MODEL_TASKS = ("statement_classification", "transfer_classification", "document_classification", "integrity_review", "correction_chat")

# --- Fields of tax documents by type. Patterns without regard to case, in order. An amount follows what leads to it.
NEAR_AMOUNT = rf"[^0-9]{{0,25}}({PLAIN_AMOUNT})"
AMOUNT_FIELDS = {
    "interest_certificate": {
        "interest_amount": (r"total\s+interest" + NEAR_AMOUNT, r"interest\s+(?:paid|credited|accrued|income|amount)" + NEAR_AMOUNT, r"interest[^0-9]{0,10}(" + PLAIN_AMOUNT + ")"),
        "tds_amount": (r"total\s+tds" + NEAR_AMOUNT, r"tds\s+(?:deducted|amount|u/s)?" + NEAR_AMOUNT),
    },
    "tax_challan": {
        "tax_paid_amount": (r"(?:challan|tax)\s+(?:amount|paid|payment)" + NEAR_AMOUNT, r"total\s+(?:amount\s+paid|tax\s+paid)" + NEAR_AMOUNT, r"amount\s+paid" + NEAR_AMOUNT),
    },
    "ppf_statement": {
        "opening_balance": (r"opening\s+balance" + NEAR_AMOUNT,),
        "closing_balance": (r"closing\s+balance" + NEAR_AMOUNT, r"balance\s+as\s+on" + NEAR_AMOUNT),
        "interest_amount": (r"interest\s+(?:credited|deposited|amount)" + NEAR_AMOUNT, r"interest[^0-9]{0,12}(" + PLAIN_AMOUNT + ")"),
        "contribution_amount": (r"(?:subscription|deposit|contribution)" + NEAR_AMOUNT, r"total\s+deposits?" + NEAR_AMOUNT),
    },
    "tax_form": {
        "gross_salary": (r"gross\s+salary" + NEAR_AMOUNT, r"salary" + NEAR_AMOUNT),
        "tds_amount": (r"tax\s+deducted\s+at\s+source" + NEAR_AMOUNT, r"tds" + NEAR_AMOUNT),
    },
}
#: Words before amounts that are added up.
SUM_FIELDS = {
    "fd_report": {
        "principal_total": ("principal amount", "deposit amount", "amount invested", "face value"),
        "interest_total": ("interest amount", "interest accrued", "interest payable"),
        "maturity_total": ("maturity amount", "maturity value"),
    },
}
COUNT_FIELDS = {"fd_report": {"fd_count": (r"\b(?:fd|fixed deposit)\b", r"\b(?:fd\s*no|deposit\s*no)\b")}}
TEXT_FIELDS = {
    "tax_challan": {
        "cin": (r"\bCIN(?:\s*No\.?|:)?\s*([A-Z0-9/-]{8,})", r"\bChallan\s+Identification\s+Number(?:\s*:?)*\s*([A-Z0-9/-]{8,})"),
        "bsr_code": (r"\bBSR\s*Code(?:\s*:?)*\s*([0-9]{7})",),
        "challan_serial_no": (r"\bChallan\s*(?:No\.?|Serial\s*No\.?)(?:\s*:?)*\s*([A-Z0-9-]{3,})", r"\bSerial\s*No\.?(?:\s*:?)*\s*([A-Z0-9-]{3,})"),
    },
    "ppf_statement": {
        "ppf_account_masked": (r"\bPPF\s*(?:A/C|Account)?\s*(?:No\.?|Number|#)?\s*[:\-]?\s*([0-9Xx*]{6,20})", r"\bAccount\s*(?:No\.?|Number|#)\s*[:\-]?\s*([0-9Xx*]{6,20})"),
    },
}
CHALLAN_DATES = ("challan date", "date of deposit", "payment date", "date")
NEAR_DATE = r"[^0-9A-Za-z]{0,8}([0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4}|[0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{2,4})"
FINANCIAL_YEAR = r"\b(?:FY|F\.Y\.|Financial Year)\s*[:\-]?\s*([0-9]{4}\s*[-/]\s*[0-9]{2,4})\b"

# --- Kinds of documents by what their heading says. Phrases of lower-case text in which _ - / \\ are spaces; the first rule that holds counts.
HEADING_ENDS = ("txn date", "transaction details", "value date", "debit credit balance", "date narration", "date particulars", "date description")
HEADING_LINES, HEADING_CHARS = 40, 2500
PPF_PHRASES = ("ppf statement", "public provident fund", "ppf account", " ppf ")
CHALLAN_PHRASES = (
    "direct tax payment acknowledgement", "income tax challan", "challan receipt", "challanreceipt", "challan no", "cin no", "bsr code", "tax paid", "e-pay tax", "tax payment receipt",
)
FORM16_PHRASES = ("form16", "form-16", "form no. 16", "parta", "part a", "partb", "part b")
FORM12BB_PHRASES = ("form12bb", "12bb")
CERTIFICATE_PHRASES = ("tds certificate", "interest certificate")
CERTIFICATE_WORDS = ("total interest", "interest credited", "interest paid", "interest amount", "interest accrued", "tds deducted", "tds amount")
INVESTMENT_PHRASES = (
    "mutual fund", "cams", "kfin", "groww", "zerodha", "demat", "portfolio", "holdings", "consolidated account statement", "capital gains", "dividend", "statement of holdings",
)
INVESTMENT_WORDS = r"\b(?:cas|coin|nse|bse)\b"
HOLDING_PHRASES = (
    "investment portfolio", "consolidated investment portfolio", "valuation report", "mutual fund summary", "demat holdings", "statement of holdings", "current amount", "holdings as on", "asset composition",
)
GAIN_PHRASES = ("capital gains", "stcgt", "ltcgt", "gain/loss", "tax report")
TRADE_PHRASES = ("trade", "contract note", "order history", "f&o", "fno", "p&l", "pnl")
BARE_GAIN_PHRASES = ("capital gains", "stcgt", "ltcgt", "p&l", "pnl")
BARE_HOLDING_PHRASES = ("holdings", "balance statement")
CARD_PHRASES = (
    "credit card statement", "credit card no", "card number", "minimum amount due", "total amount due", "payment due date", "credit limit", "available limit", "card statement", "cc statement", "cc stmt",
    "card account", "cash limit", "cash advance", "card ending",
)
BANK_PHRASES = (
    "savings account", "current account", "account statement", "passbook", "opening balance", "closing balance", "available balance", "ifsc", "branch", "account number", "a/c no", "a/c number", "upi/",
    "neft", "rtgs", "imps", "debit", "credit", "withdrawal", "deposit",
)
CARD_NAMES = ("credit card statement", "card statement", "cc statement", "cc stmt")
BANK_NAMES = ("account statement", "savings account", "current account", "passbook")
SHEET_TRADES = (
    "global transaction statement", "charges account head amount", "buy quantity", "sell quantity", "buy value", "sell value", "tradebook", "trade book", "order history", "f&o", "fno",
    "equity from", "mutual funds from", "commodity from", "currency from", "segment",
)
SHEET_GAINS = ("capital gains", "stcgt", "ltcgt", "tax report", "gain/loss")
SHEET_HOLDINGS = ("holdings", "holding", "valuation report", "mutual fund summary", "current amount", "invested amount", "portfolio", "stocks", "mutual funds")
