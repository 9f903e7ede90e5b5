"""Grammars of statements: how a bank's statements are told, where their sections begin and end, and what their rows look like.

Fixed values: these patterns must be what they are for the rows of real statements to be found.
"""

from __future__ import annotations

from typing import NamedTuple

DAY = r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"
AMOUNT = r"([\d,]+\.\d{2})"
#: Row shapes, tried in order: name, pattern, and the groups of date, posting date, description, debit, credit, balance, mark (0: none).
THREE_AMOUNTS = ("three", rf"^\s*{DAY}\s+(.+?)\s+{AMOUNT}\s+{AMOUNT}\s+{AMOUNT}\s*$", (1, 0, 2, 3, 4, 5, 0))
TWO_AMOUNTS = ("two", rf"^\s*{DAY}\s+(.+?)\s+{AMOUNT}\s+{AMOUNT}\s*$", (1, 0, 2, 3, 0, 4, 0))
MARKED = ("marked", rf"^\s*{DAY}\s+(.+?)\s+{AMOUNT}\s*(Cr|Dr|CR|DR|C|D)\s*$", (1, 0, 2, 3, 0, 0, 4))
TWO_DATES = ("two_dates", rf"^\s*{DAY}\s+{DAY}\s+(.+?)\s+{AMOUNT}\s+{AMOUNT}\s+{AMOUNT}\s*$", (1, 2, 3, 4, 5, 6, 0))

ENDS = (r"(?i)Closing\s*Balance", r"(?i)Statement\s*Summary", r"(?i)Terms\s*(?:and|&)\s*Condition", r"(?i)This\s+is\s+a\s+(?:computer|system)\s+generated", r"^\s*\*{3,}")
RULERS = (r"(?i)^\s*Page\s*\d+", r"^\s*-{3,}\s*$", r"^\s*={3,}\s*$", r"(?i)^\s*Withdrawal\s+Deposit\s+Balance", r"(?i)^\s*Debit\s+Credit\s+Balance", r"(?i)^\s*Opening\s*Balance")
SAVINGS = r"(?i)Savings\s*Account|Current\s*Account|Account\s*Statement|Statement\s*of\s*Account|Transaction\s*Statement"
CREDIT_WORDS = ("SALARY", "NEFT CR", "RTGS CR", "IMPS CR", "CREDIT", "REFUND", "CASHBACK", "INTEREST", "INT.CREDIT", "BY TRANSFER", "RECEIVED")


class Grammar(NamedTuple):
    bank: str
    #: All of these are in the text, and none of those.
    has: tuple[str, ...]
    lacks: tuple[str, ...]
    starts: tuple[str, ...]
    ends: tuple[str, ...]
    skips: tuple[str, ...]
    shapes: tuple[tuple, ...]
    credit_words: tuple[str, ...] = CREDIT_WORDS
    #: Of a row with both amounts: whether an unchanged balance tells a credit, and whether it counts where no balance is known before it.
    equal_is_credit: bool = False
    both_without_balance: bool = False
    #: Whether a row whose date or amount can't be read counts towards the end of a section.
    bad_rows_count: bool = False


HDFC_SAVINGS = Grammar(
    "HDFC", (r"(?i)HDFC\s*Bank", SAVINGS), (r"(?i)Credit\s*Card\s*Statement|Card\s*Statement|Domestic\s*Transactions",),
    (r"(?i)Date\s+(?:Narration|Description|Particulars?|Transaction)", r"(?i)Transaction\s+Details?", r"(?i)Txn\s*Date"), ENDS,
    (r"(?i)^\s*Date\s+(?:Narration|Description|Particulars)", r"(?i)^\s*Txn\s*Date", r"(?i)HDFC\s*Bank", *RULERS), (THREE_AMOUNTS, TWO_AMOUNTS, MARKED),
    equal_is_credit=True, both_without_balance=True, bad_rows_count=True,
)
SBI_SAVINGS = Grammar(
    "SBI", (r"(?i)State\s*Bank\s*of\s*India|SBI\b", SAVINGS + r"|Passbook"), (r"(?i)SBI\s*Card|Credit\s*Card\s*Statement",),
    (r"(?i)(?:Txn|Tran(?:saction)?)\s*Date", r"(?i)Date\s+(?:Narration|Description|Particulars?)", r"(?i)Transaction\s+Details?"), ENDS,
    (r"(?i)^\s*(?:Txn|Tran)\s*Date", r"(?i)^\s*Date\s+(?:Narration|Description|Particulars|Value)", r"(?i)State\s*Bank", *RULERS), (TWO_DATES, THREE_AMOUNTS, TWO_AMOUNTS, MARKED),
)
AXIS_SAVINGS = Grammar(
    "Axis", (r"(?i)Axis\s*Bank", SAVINGS), (r"(?i)Credit\s*Card\s*Statement|Card\s*Statement",),
    (r"(?i)(?:Tran|Txn)\s*Date", r"(?i)Date\s+(?:Narration|Description|Particulars?|Chq)", r"(?i)Transaction\s+Details?"), ENDS,
    (r"(?i)^\s*(?:Tran|Txn)\s*Date", r"(?i)^\s*Date\s+(?:Narration|Description|Particulars|Chq)", r"(?i)Axis\s*Bank", *RULERS), (THREE_AMOUNTS, TWO_AMOUNTS, MARKED),
    tuple(w for w in CREDIT_WORDS if w != "INT.CREDIT"),
)
GRAMMARS = (HDFC_SAVINGS, SBI_SAVINGS, AXIS_SAVINGS)

ACCOUNT = r"(?i)(?:Account|A/c)\s*(?:No\.?|Number|#)\s*[:\-]?\s*(\d[\d\s]{8,18}\d)"
PERIODS = (
    r"(?i)(?:Statement|Period|From)\s*[:\-]?\s*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})\s*(?:to|-)\s*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
)
BALANCE = r"(?i){}\s*Balance\s*[:\-]?\s*(?:Rs\.?\s*|INR\s*|₹\s*)?([\d,]+\.?\d*)"


class Card(NamedTuple):
    """A card's statement. ``course`` names how lines follow each other: ``gaps`` (sections that end after gaps), ``blocks`` (a blank line ends a
    section that has rows) or ``open`` (no sections)."""

    bank: str
    has: tuple[str, ...]
    lacks: tuple[str, ...]
    starts: tuple[str, ...]
    ends: tuple[str, ...]
    skips: tuple[str, ...]
    #: Row shapes, tried in order: pattern, and the groups of date, description, plus sign, amount, mark (0: none).
    shapes: tuple[tuple, ...]
    course: str
    #: Metadata: patterns tried in order; the last group is taken.
    card: tuple[str, ...]
    periods: tuple[str, ...]
    amounts: dict[str, tuple[str, ...]]
    due: tuple[str, ...]
    credit_marks: tuple[str, ...] = ("CR",)
    #: Whether runs of white space in a description become one space.
    tight: bool = True


CARD = r"Card\s*(?:Number|No\.?|#)\s*[:\-]?\s*([\dXx\*\s]{12,19})"
CARD_MARK = r"(Cr|Dr|CR|DR)"
CARD_SAVINGS = r"(?i)Savings\s*Account|Current\s*Account"
RUPEES = r"(?:Rs\.?\s*|INR\s*|₹\s*)?([\d,]+\.?\d*)"
RUPEES_C = r"(?:Rs\.?\s*|INR\s*|₹\s*|C\s*)?([\d,]+\.?\d*)"
WORD_DAY = r"(\d{1,2}\s+\w{3,9},?\s+\d{4})"
NAMED_DAY = r"(\d{1,2}[\s/\-]\w{3,9}[\s/\-]\d{2,4})"

HDFC_CARD = Card(
    "HDFC", (r"(?i)\bHDFC\s+Bank\b", r"(?i)Credit\s*Card|Card\s*Statement|Domestic\s*Transactions"), (CARD_SAVINGS,),
    (
        r"(?i)Domestic\s*Transactions?", r"(?i)International\s*Transactions?", r"(?i)Transaction\s*Details?", r"(?i)Date\s+Transaction\s+(?:Description|Details?|Particulars?)",
        r"(?i)Date\s+Particulars?\s+Amount", r"(?i)Date\s+Description\s+Amount", r"(?i)DATE\s*&\s*TIME\s+TRANSACTION\s+DESCRIPTION",
    ),
    (
        r"(?i)TOTAL\s*AMOUNT", r"(?i)Total\s*(?:Domestic|International)?\s*(?:Transaction|Amount)", r"(?i)Eligible\s+for\s+(?:EMI|FlexiPay)", r"(?i)CONVERT\s+TO\s+EMI", r"(?i)Past\s*Dues?",
        r"(?i)GST\s*Summary", r"(?i)Rewards?\s*(?:Program|Point|Summary)", r"(?i)Offers?\s+on\s+your\s+card", r"(?i)Cash\s*Back\s*Summary", r"(?i)Benefits\s+on\s+your\s+card",
        r"(?i)Purchase\s+Indicator", r"(?i)Terms\s*(?:and|&)\s*Condition", r"(?i)Important\s*(?:Notice|Information)", r"(?i)\*\s*Transaction\s+time", r"(?i)^\s*TRANSACTIONS\s*$",
    ),
    (
        r"(?i)^\s*Page\s*\d+", r"(?i)^\s*HDFC\s*Bank", r"^\s*-{3,}\s*$", r"^\s*={3,}\s*$", r"(?i)^\s*Date\s+Transaction", r"(?i)^\s*Date\s+Particulars?", r"(?i)^\s*Date\s+Description",
        r"(?i)^\s*Sr\.?\s*No", r"(?i)HSN\s*Code", r"(?i)GSTIN", r"(?i)Credit\s*Card\s*Statement", r"(?i)^\s*Infinia\s+Credit\s+Card", r"(?i)^\s*Regalia\s+", r"(?i)^\s*Millennia\s+",
        r"(?i)^\s*Diners\s+", r"(?i)^\s*Amount\s*\(.*?\)\s*$", r"(?i)^\s*Swiggy\s+HDFC", r"(?i)^\s*DATE\s*&\s*TIME\s+TRANSACTION", r"(?i)^\s*[A-Z]+\s+Credit\s+Card\s*$",
    ),
    ((rf"^\s*{DAY}(?:\s*\|?\s*\d{{1,2}}:\d{{2}}(?::\d{{2}})?)?\s+(.+?)\s+(\+)?\s*(?:C\s?)?([\d,]+\.\d{{2}})\s*{CARD_MARK}?\s*(?:l)?\s*$", (1, 2, 3, 4, 5)),),
    "gaps",
    (rf"(?i){CARD}", r"(\d{4}\s*[Xx\*]{4}\s*[Xx\*]{4}\s*\d{4})"),
    (
        rf"(?i)Billing\s*Period\s*[:\-]?\s*{WORD_DAY}\s*[\-–]\s*{WORD_DAY}",
        rf"(?i)Statement\s+for\s+(?:the\s+)?period\s*[:\-]?\s*{WORD_DAY}\s*(?:to|-|–)\s*{WORD_DAY}",
        rf"(?i)Statement\s*Period\s*[:\-]?\s*{DAY}\s*(?:to|-)\s*{DAY}",
        r"(?i)(?:Statement|Billing)\s*Period\s*[:\-]?\s*(\d{1,2}[\s/\-]\w{3,9}[\s,/\-]+\d{2,4})\s*(?:to|-|–)\s*(\d{1,2}[\s/\-]\w{3,9}[\s,/\-]+\d{2,4})",
        rf"(?i)(?:From|Period)\s*[:\-]?\s*{DAY}\s*(?:to|-)\s*{DAY}",
    ),
    {
        "total_due": (rf"(?i)Total\s*(?:Amount\s*)?Due[s]?\s*[:\-]?\s*{RUPEES_C}", rf"(?i)Total\s*Dues?\s*(?:Amount)?\s*[:\-]?\s*{RUPEES_C}", rf"(?i)TOTAL\s*AMOUNT\s*DUE\s*[\n\r]*\s*{RUPEES_C}"),
        "minimum_due": (rf"(?i)Min(?:imum)?\s*(?:Amount\s*)?Due\s*[:\-]?\s*{RUPEES_C}",),
        "credit_limit": (rf"(?i)(?:Total\s*)?Credit\s*Limit\s*[:\-]?\s*{RUPEES_C}",),
        "available_limit": (rf"(?i)Available\s*(?:Credit\s*)?Limit\s*[:\-]?\s*{RUPEES_C}",),
        "previous_balance": (rf"(?i)(?:Previous|Opening|Last\s*Statement)\s*(?:.*?)Balance\s*[:\-]?\s*{RUPEES}",),
        "payments_received": (rf"(?i)Payment[s]?\s*(?:Received|Credited|/Credits|/\s*Credits)\s*[:\-]?\s*{RUPEES}",),
    },
    (
        r"(?i)DUE\s*DATE\s*[\n\r]+\s*(?:C\s*)?(?:[\d,]+\.?\d*)\s+(\d{1,2}\s+\w{3,9},?\s+\d{4})", rf"(?i)(?:Payment\s*)?Due\s*Date\s*[:\-]?\s*{WORD_DAY}",
        r"(?i)(?:Payment\s*)?Due\s*Date\s*[:\-]?\s*(\d{1,2}[/\-.\s]\w{3,9}[/\-.\s]\d{2,4})", rf"(?i)(?:Payment\s*)?Due\s*Date\s*[:\-]?\s*{DAY}",
    ),
)
SBI_CARD = Card(
    "SBI", (r"(?i)SBI\s*Card|State\s*Bank.*?Credit\s*Card", r"(?i)Statement|Card\s*Statement|Account\s*Summary"), (CARD_SAVINGS + r"|Passbook",),
    (r"(?i)Transaction\s*Detail", r"(?i)Date\s+(?:Transaction|Particular|Description|Narration)", r"(?i)Domestic\s*Transaction", r"(?i)New\s*Transaction"),
    (r"(?i)Total\s*(?:Due|Amount|New\s*Transaction)", r"(?i)Reward\s*(?:Point|Summary)", r"(?i)Terms\s*(?:and|&)\s*Condition", r"(?i)(?:Note|Disclaimer)\s*:", r"(?i)Account\s*Summary"),
    (r"(?i)^Date\s+", r"(?i)Page\s*\d+", r"^-{3,}$", r"(?i)SBI\s*Card"),
    ((r"^(\d{1,2}[\s/\-]\w{3,9}[\s/\-]\d{2,4}|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})\s+(.+?)\s+([\d,]+\.?\d{2})(?:\s*(Cr|Dr|CR|DR|C|D))?\s*$", (1, 2, 0, 3, 4)),),
    "blocks",
    (rf"(?i){CARD}",),
    (rf"(?i)Statement\s*(?:Period|Date)\s*[:\-]?\s*{NAMED_DAY}\s*(?:to|-)\s*{NAMED_DAY}", rf"(?i)(?:Period|From)\s*[:\-]?\s*{DAY}\s*(?:to|-)\s*{DAY}"),
    {
        "total_due": (rf"(?i)Total\s*(?:Amount\s*)?(?:Due|Payable|Outstanding)\s*[:\-]?\s*{RUPEES}",),
        "minimum_due": (rf"(?i)Min(?:imum)?\s*(?:Amount\s*)?Due\s*[:\-]?\s*{RUPEES}",),
        "credit_limit": (rf"(?i)(?:Total\s*)?Credit\s*Limit\s*[:\-]?\s*{RUPEES}",),
        "previous_balance": (rf"(?i)(?:Previous|Opening)\s*Balance\s*[:\-]?\s*{RUPEES}",),
    },
    (r"(?i)(?:Payment\s*)?Due\s*Date\s*[:\-]?\s*(\d{1,2}[/\-.\s]\w{3,9}[/\-.\s]\d{2,4}|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",),
    ("CR", "C"), False,
)
AXIS_DAY = r"\d{1,2}(?:[/\-]\d{1,2}[/\-]\d{2,4}|[/\-]\w{3}[/\-]\d{2,4})"
AXIS_AMOUNT = r"([0-9][0-9,]*\.\d{2})"
AXIS_CARD = Card(
    "AXIS", (r"(?i)Axis\s*Bank", r"(?i)Credit\s*Card|Card\s*Statement|Card\s*Number"), (CARD_SAVINGS,), (), (r"(?i)END OF STATEMENT",), (),
    # The first shape has a cashback column.
    (
        (rf"^({AXIS_DAY})\s+(.+?)\s+{AXIS_AMOUNT}\s+{CARD_MARK}\s+[0-9][0-9,]*\.\d{{2}}\s+(?:Cr|Dr|CR|DR)\s*$", (1, 2, 0, 3, 4)),
        (rf"^({AXIS_DAY})\s+(.+?)\s+{AXIS_AMOUNT}\s+{CARD_MARK}\s*$", (1, 2, 0, 3, 4)),
    ),
    "open", (rf"(?i){CARD}", r"\b(\d{6}\*{2,}\d{4})\b"), (), {}, (),
)
CARDS = (HDFC_CARD, SBI_CARD, AXIS_CARD)
#: Summaries whose values stand some lines below their labels: field, labels that the line has, lines to look at, words that a line must not have, which amount of the line.
BELOW = (
    ("total_due", ("TOTAL AMOUNT DUE",), 5, "RECEIVED", 1), ("minimum_due", ("MINIMUM DUE", "DUE DATE"), 5, None, 1),
    ("credit_limit", ("TOTAL CREDIT LIMIT",), 6, None, 1), ("available_limit", ("TOTAL CREDIT LIMIT",), 6, None, 2),
)
BELOW_LINES = 140
BELOW_AMOUNT = r"(?i)(?:₹|INR|Rs\.?|C)\s*([0-9][0-9,]*(?:\.\d{1,2})?)"
BELOW_DAY = r"(\d{1,2}\s+\w{3,9},?\s+\d{4}|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"
#: The other bank's summary: labels of a line, and what one of the next three lines holds; the first line with the labels counts alone.
AXIS_LINES = 150
AXIS_DUES = (("TOTAL PAYMENT DUE", "MINIMUM PAYMENT DUE"), rf"(?i){AXIS_AMOUNT}\s*(?:Cr|Dr|CR|DR)?\s+{AXIS_AMOUNT}\s*(?:Cr|Dr|CR|DR)?\s+(\d{{1,2}}/\d{{1,2}}/\d{{2,4}})\s*[-–]\s*(\d{{1,2}}/\d{{1,2}}/\d{{2,4}})\s+(\d{{1,2}}/\d{{1,2}}/\d{{2,4}})")
AXIS_LIMITS = (("CREDIT CARD NUMBER", "CREDIT LIMIT"), rf"(\d{{6}}\*{{2,}}\d{{4}})\s+{AXIS_AMOUNT}\s+{AXIS_AMOUNT}")


class Passbook(NamedTuple):
    """A statement whose rows end in an amount and a balance, of which only the balance tells the direction."""

    bank: str
    has: tuple[str, ...]
    lacks: tuple[str, ...]
    starts: tuple[str, ...]
    skips: tuple[str, ...]
    amount: str
    balance: str
    reference: str
    account: str
    period: str
    credit_words: tuple[str, ...]


BOB_SAVINGS = Passbook(
    "BOB", (r"(?i)Bank\s*of\s*Baroda|\bBOB\b|BARB0", r"(?i)TRAN\s+DATE\s+VALUE\s+DATE\s+NARRATION.*WITHDRAWAL\(DR\).*DEPOSIT\(CR\).*BALANCE\(INR\)|Statement\s+of\s+transactions\s+in\s+Savings\s+Account"),
    (r"(?i)Credit\s*Card\s*Statement|Minimum\s*Amount\s*Due",), (r"(?i)TRAN\s+DATE\s+VALUE\s+DATE\s+NARRATION.*WITHDRAWAL\(DR\).*DEPOSIT\(CR\).*BALANCE\(INR\)",),
    (r"(?i)^[-=\s]+$|^Main Account Holder|^Address\s*:|^Customer Id|^Branch Name|^IFSC Code|^Your Account Statement|^Statement of transactions|^Page\s+\d+|computer-generated statement|Contact-Us@",),
    r"(?i)^(?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d{1,2})?(?:Cr|Dr)?$", r"(?i)^(?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d{1,2})?(?:Cr|Dr)$", r"(?i)\b([A-Z0-9][A-Z0-9/\-:]{5,})\b",
    r"(?i)Account\s*(?:Number|No\.?)\s*[:\-]?\s*([\dXx*\s\-]{8,})", rf"(?i)(?:Statement\s+Period\s+from|Statement\s+Period|Period|for\s+the\s+period)\s*[:\-]?\s*{DAY}\s*(?:to|-)\s*{DAY}",
    ("INT.PD", "INTEREST", "CLOSURE PROCEEDS", "SALARY", "GIFT", "REFUND"),
)
