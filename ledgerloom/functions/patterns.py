"""Pattern tables. Labels, their order and keyword lists are fixed values of the billing vocabulary."""

from __future__ import annotations

#: Ordered patterns per field, whatever the case; the first that matches anywhere in the text gives the value. Fixed
#: values of the billing vocabulary: labels, their order, and what may stand between a label and its value.
SUMMARY: dict[str, list[str]] = {
    "invoice_number": [
        r"Invoice\s*Number\s*:\s*(\S+)",
        r"Invoice\s*#\s*:?\s*(\S+)",
        r"Invoice\s*No\.?\s*:?\s*(\S+)",
        r"Invoice\s*:\s*(\S+)",
        r"Bill\s*Number\s*:\s*(\S+)",
        r"Invoice\s+Number\s+(\S+)",
    ],
    "invoice_date": [
        r"Invoice\s*Date\s*:\s*([\d/\-]+)",
        r"Issue\s*Date\s*:\s*([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"Bill\s*Date\s*:\s*([\d/\-]+)",
        r"Statement\s*Date\s*:\s*([\d/\-]+)",
        r"Bill\s*Date\s*:?\s*([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"Invoice\s+Date\s+([\d/\-]+)",
        r"INVOICE\s+DATE\s*\n\s*(\d{1,2}/\d{1,2}/\d{2,4})",
        r"BILL\s+DATE\s*:\s*([\d/\-]+)",
        r"Bill\s+At\s+A\s+Glance\s+([\d/\-]+)",
        r"Bill\s+Date\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
    ],
    "invoice_due_dtm": [
        r"Due\s*Date\s*:\s*(\d{1,2}/\d{1,2}/\d{2,4})",
        r"Payment\s*Due\s*:\s*(\d{1,2}/\d{1,2}/\d{2,4})",
        r"Due\s*Date\s*:\s*(\d{1,2}-\d{1,2}-\d{2,4})",
        r"Due\s*Date\s*:\s*([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"Payment\s*Due\s*Date\s*:\s*([\d/\-]+)",
        r"Pay\s*by\s*:\s*([\d/\-]+)",
        r"Due\s+on\s+(\d{1,2}/\d{1,2}/\d{2,4})",
        r"Due\s+by\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"Due\s+by\s+(\d{1,2}/\d{1,2}/\d{2,4})",
        r"Total\s+Amount\s+Due\s+by\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"Payment\s+Due\s*\n\s*(\d{1,2}/\d{1,2}/\d{2,4})",
        r"Payment\s+Due.*?\n\s*(\d{1,2}/\d{1,2}/\d{2,4})",
        r"Due\s+date:\s*(\d{1,2}/\d{1,2}/\d{2,4})",
        r"DUE\s+DATE\s*\n\s*(\d{1,2}/\d{1,2}/\d{2,4})",
        r"DUE\s+DATE\s+(\d{1,2}/\d{1,2}/\d{2,4})",
    ],
    "invoice_st_dtm": [
        r"(?:activity|period|service)\s+from\s+(\d{1,2}/\d{1,2}/\d{2,4})",
        r"(?:Billing|Statement)\s*Period\s*:\s*([\d/\-]+)",
        r"Service\s*From\s*:\s*([\d/\-]+)",
        r"(?:activity|period|service)\s+from\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"(?:Billing|Statement)\s*Period\s*:\s*([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"Bill\s+period\s*\n\s*([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
    ],
    "invoice_end_dtm": [
        r"(?:through|thru|to)\s+(\d{1,2}/\d{1,2}/\d{2,4})",
        r"Service\s*(?:To|Through)\s*:\s*([\d/\-]+)",
        r"(?:through|thru|to)\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"Bill\s+period\s*\n\s*[A-Za-z]+\s+\d{1,2},?\s+\d{4}\s*-\s*([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"Billing\s+period:\s+[A-Za-z]+\s+\d{1,2}\s*-\s*([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
    ],
    "beg_bal": [
        r"Previous\s+Statement\s+Balance\s+\$?(-?[\d,]+\.\d{2})",
        r"Previous\s+Balance\s+\$?(-?[\d,]+\.\d{2})",
        r"Prior\s+Balance\s+\$?(-?[\d,]+\.\d{2})",
        r"Beginning\s+Balance\s+\$?(-?[\d,]+\.\d{2})",
        r"Your\s+last\s+bill\s+\$?(-?[\d,]+\.\d{2})",
        r"Previous\s+bill\s+\$?(-?[\d,]+\.\d{2})",
        r"Last\s+Statement\s+Balance\s+\$?(-?[\d,]+\.\d{2})",
        r"BALANCE\s+FROM\s+LAST\s+BILLING\s+\$?(-?[\d,]+\.\d{2})",
        r"PREVIOUS\s+BALANCE\s+DUE\s+\$?(-?[\d,]+\.\d{2})",
        r"last\s+bill\s+of\s+\$?(-?[\d,]+\.\d{2})",
        r"Previous\s+Bill\s+Payment/Adj.*?\n\s*\$?(-?[\d,]+\.\d{2})\s",
        r"Balance\s+from\s+last\s+bill\s+\$?(-?[\d,]+\.\d{2})",
    ],
    "payment": [
        r"Previous\s+Bill\s+Payment/Adj.*?\n\s*\$?[\d,]+\.\d{2}\s+\$?([\d,]+\.\d{2})(?:CR)?",
        r"Payment/Adj\s+Current.*?\n.*?\$?([\d,]+\.\d{2})(?:CR)?",
        r"PAYMENT\(S\)\s+RECEIVED[\s\S]*?\$?([\d,]+\.\d{2})(?:CR)?",
        r"Payment/Adj\s*\n\s*\$?([\d,]+\.\d{2})(?:CR)?",
        r"Payments?\s+\$?-?([\d,]+\.\d{2})",
        r"Payment\s+Received\s+\$?-?([\d,]+\.\d{2})",
        r"Payment,.*?-?\$?([\d,]+\.\d{2})",
        r"Payments?\s+Received.*?\$?-?([\d,]+\.\d{2})",
        r"Payments?\s+Applied\s+\$?-?([\d,]+\.\d{2})",
        r"paying\s+your\s+last\s+bill\s+of\s+\$?([\d,]+\.\d{2})",
        r"Payments?\s*-\s*Thank\s+You\s+-?\$?([\d,]+\.\d{2})",
        r"Total\s+Payments?\s+-?\$?([\d,]+\.\d{2})",
    ],
    "prev_adj": [
        r"Adjustments?\s+\$?(-?[\d,]+\.\d{2})",
        r"Credits?\s+\$?(-?[\d,]+\.\d{2})",
    ],
    "curr_adj": [
        r"Current\s+Adjustments?\s+\$?(-?[\d,]+\.\d{2})",
    ],
    "curr_chg": [
        r"Subtotal[ \t]+\$?(-?[\d,]+\.\d{2})",
        r"Sub\s*-?\s*total[ \t]+\$?(-?[\d,]+\.\d{2})",
        r"Current\s+Charges?\s+Subtotal\s+\$?(-?[\d,]+\.\d{2})",
        r"Total\s+Current\s+Charges?\s+\$?(-?[\d,]+\.\d{2})",
        r"This\s+month'?s\s+charges\s+.*?\$?(-?[\d,]+\.\d{2})",
        r"Total\s+Current\s+charges?\s+due\s+by\s+[\d/]+\s+\$?(-?[\d,]+\.\d{2})",
        r"New\s+Charges?\s+\$?(-?[\d,]+\.\d{2})",
        r"Monthly\s+Charges?\s+\$?(-?[\d,]+\.\d{2})",
        r"Total\s+Charges\s+\$?(-?[\d,]+\.\d{2})",
        r"CURRENT\s+BILLING(?:\s+AMOUNT)?[ \t]+\$?(-?[\d,]+\.\d{2})",
        r"Current\s+Charges\s+-\s+Due\s+on\s+[\d/]+\s+\$?(-?[\d,]+\.\d{2})",
        r"Current\s+Billing\s+Total\s+Due\s*\n\s*\$?[\d,]+\.\d{2}\s+\$?[\d,]+\.\d{2}(?:CR)?\s+\$?(-?[\d,]+\.\d{2})",
    ],
    "curr_tax": [
        r"Taxes,?\s*Fees\s*(?:&|and)\s*Surcharges?\s+\$?(-?[\d,]+\.\d{2})",
        r"Total\s+Taxes?\s+\$?(-?[\d,]+\.\d{2})",
        r"Taxes?\s+and\s+(?:Fees|Surcharges)\s+\$?(-?[\d,]+\.\d{2})",
        r"Government\s+(?:Taxes|Fees).*?\$?(-?[\d,]+\.\d{2})",
        r"Taxes?\s+&\s+Surcharges?\s+\$?(-?[\d,]+\.\d{2})",
    ],
}

#: Labels of an account in order, and what an account may hold (fixed values).
ACCOUNT = [
    r"Account\s*Number\s*:\s*([\d\-\s\.\(\)]+)",
    r"Account\s*#\s*:?\s*([\d\-\s\.\(\)]+)",
    r"Account\s*No\.?\s*:?\s*([\d\-\s\.\(\)]+)",
    r"ACCOUNT\s+NUMBER\s+([\d\-\s\.\(\)]+)",
    r"Account\s*:\s*([\d\-\s\.\(\)]+)",
    r"ACCOUNT\s+NO\s*:\s*([\d\-\s\.\(\)]+)",
    r"Account\s*\n\s*([\d\-\s\.\(\)]+)",
    r"Account\s*Number\s*:\s*(\d+)",
]

#: Labels of the amount due in order of priority (fixed values).
END_BAL = [
    r"TOTAL\s+DUE\s*:?\s*(-?\$?\s*\(?[\d,]+\.\d{2}\)?\s*(?:CR)?)",
    r"AMOUNT\s+DUE\s*:?\s*(-?\$?\s*\(?[\d,]+\.\d{2}\)?\s*(?:CR)?)",
    r"CURRENT\s+CHARGES\s*:?\s*(-?\$?\s*\(?[\d,]+\.\d{2}\)?\s*(?:CR)?)",
    r"REMAINING\s+BALANCE\s*:?\s*(-?\$?\s*\(?[\d,]+\.\d{2}\)?\s*(?:CR)?)",
    r"(?<!PREVIOUS\s{1,9})BALANCE\s+DUE\s+\$?\s*(-?\$?\s*\(?[\d,]+\.\d{2}\)?\s*(?:CR)?)",
    r"Total\s+(?:Amount\s+)?Due[ \t]+\$?\s*(-?\$?\s*\(?[\d,]+\.\d{2}\)?\s*(?:CR)?)",
    r"Amount\s+Due[ \t]+\$?\s*(-?\$?\s*\(?[\d,]+\.\d{2}\)?\s*(?:CR)?)",
    r"Total\s+due\s*:?[ \t]+\$?\s*(-?\$?\s*\(?[\d,]+\.\d{2}\)?\s*(?:CR)?)",
    r"(?:Please\s+)?Pay\s+(?:this\s+amount|Total)\s+\$?\s*(-?\$?\s*\(?[\d,]+\.\d{2}\)?\s*(?:CR)?)",
    r"TOTAL\s+DUE\s*\n\s*\$?\s*(-?\$?\s*\(?[\d,]+\.\d{2}\)?\s*(?:CR)?)",
    r"Total\s+Due:.*?\$?\s*(-?\$?\s*\(?[\d,]+\.\d{2}\)?\s*(?:CR)?)",
]

# ---------------------------------------------------------------------------------------------- charges
#: Fixed values of charge lines: the form of a line, section titles, and beginnings that are no charge.
CHARGE = r"(?i)^(.+?)\s+\$?\s*(-?\(?[\d,]*\.\d{2}\)?)\s*(CR)?\s*$"
SECTIONS = (
    "Recurring Charges", "One Time Charges", "Prorated Charges", "Usage Charges", "BASIC TELEPHONE", "NON-BASIC TELEPHONE", "OTHER", "Monthly Service",
    "Equipment Charges", "Internet Service", "Voice Service", "Data Service", "MONTHLY USAGE FOR TELEPHONE", "Product/Service",
)
TAX_SECTION = r"(?i)^Taxes,?\s*Fees"
SKIP_PREFIXES = (
    "Previous Statement", "Current Charges Subtotal", "Current Charges $", "BALANCE DUE", "Payments", "Subtotal", "Page ", "Page:", "Invoice Number",
    "Account Number", "Invoice Date", "Due Date", "Security Code", "Late Fee", "Summary Account", "Pay Online", "Make payments", "Checks",
    "Charter Communications", "Contact Us", "details on following", "AMOUNT PAID", "PREVIOUS BALANCE", "CURRENT CHARGES", "ACCOUNT NO", "TELEPHONE NO",
    "BILL DATE", "Surcharges and Other", "Taxes, Governmental Surcharges", "Monthly Charges", "Usage and Purchase Charges", "Total Current Charges",
    "Total Voice", "Total Data", "Total Messaging", "Description Date", "CURRENT BILLING AMOUNT", "SUB-TOTAL", "PAYMENT(S)", "BALANCE FROM",
    "SUMMARY BY SERVICE", "Total Due", "MESSAGE CENTER", "Frequently Asked", "The carrier you have chosen",
)
EXCLUDED = r"(?i)PAYMENT|THANK YOU|ADJUSTMENT"
SUMMARY_TOTAL = r"(?i)^\s*(Subtotal|Total)\s*:?\s*\$?\s*-?[\d,]*\.\d{2}\s*$"
UNIT_PRICE = r"\s+\d+\s*@\s*[\d,.]+\s*$"
NOISE = r"(?i)^(?:Subtotal|Total)\b"
PHONE = r"\(\d{3}\)\d{3}-\d{4}"
PHONE_TOTAL = r"(?i)^\(\d{3}\)\d{3}-\d{4}\s+TOTAL\b"
CIRCUIT_LINE = r"(?i)^Circuit\s*ID\s*:"
CIRCUIT = r"(?i)Circuit\s*ID\s*:\s*([\w.]+)"

#: Fixed values that tell what is no charge, and what may be none.
URL = r"(?i)\.com|\.net|\.org|\.gov|www\.|https?://"
INFORMATIONAL = r"(?i)^(?:See\s|Visit\s|Go\s+to\s|Learn\s+more|For\s+(?:more|details|info)|Contact\s|Call\s+\d|Terms\s+and|©|\*{1,3}\s|Page\s+\d|continued\s+on)"
DISCLAIMER = r"(?i)subject\s+to\s+change|not\s+responsible|all\s+rights\s+reserved|privacy\s+policy|terms\s+of\s+(?:service|use)"
FOOTER = r"(?i)printed\s+on|generated\s+on|confidential|do\s+not\s+(?:pay|discard)"
MARKS = r"[.!?]{2,}"
SOFT = r"(?i)\b(?:please|thank|sorry|note:|important)\b"
BILLING = r"(?i)\$|charge|plan|fee|service|access|line|device|data|voice|text|roaming|discount|promo|credit"

# ---------------------------------------------------------------------------------------------- feedback
#: What introduces a corrected value, for numbers, dates and text (fixed values).
CORRECT_NUMBER = r"(?i)(?:should\s+be|correct\s+(?:value|amount|number)\s+is|actual(?:ly)?\s+is|it\s+is|is\s+actually|change\s+(?:it\s+)?to|update\s+(?:it\s+)?to|set\s+(?:it\s+)?to)\s+\$?([\d,]+\.?\d*)"
CORRECT_DATE = r"(?i)(?:should\s+be|correct\s+(?:value|date)\s+is|actual(?:ly)?\s+is|it\s+is|is\s+actually|change\s+(?:it\s+)?to|update\s+(?:it\s+)?to|set\s+(?:it\s+)?to)\s+(\d{1,2}/\d{1,2}/\d{2,4})"
CORRECT_TEXT = r"(?i)(?:should\s+be|correct\s+(?:value|number)\s+is|actual(?:ly)?\s+is|it\s+is|is\s+actually|change\s+(?:it\s+)?to|update\s+(?:it\s+)?to|set\s+(?:it\s+)?to)\s+[\"']?(\S+)[\"']?"
NOISE_PHRASE = r"(?i)(?:has\s+extra\s+text|extra\s+(?:word|text|value)|remove|strip|delete)\s+[\"']?(.+?)[\"']?\s*(?:\.|$|,)"
#: Aliases in the order in which they are tried (fixed values).
ALIASES = (
    ("invoice number", "invoice_number"), ("invoice no", "invoice_number"), ("invoice #", "invoice_number"), ("bill number", "invoice_number"),
    ("account number", "carrier_account"), ("account no", "carrier_account"), ("account #", "carrier_account"), ("account", "carrier_account"),
    ("invoice date", "invoice_date"), ("bill date", "invoice_date"), ("statement date", "invoice_date"),
    ("start date", "invoice_st_dtm"), ("statement start", "invoice_st_dtm"), ("period start", "invoice_st_dtm"), ("service from", "invoice_st_dtm"),
    ("billing period start", "invoice_st_dtm"), ("end date", "invoice_end_dtm"), ("statement end", "invoice_end_dtm"), ("period end", "invoice_end_dtm"),
    ("service to", "invoice_end_dtm"), ("billing period end", "invoice_end_dtm"), ("due date", "invoice_due_dtm"), ("payment due", "invoice_due_dtm"),
    ("pay by", "invoice_due_dtm"), ("previous balance", "beg_bal"), ("beginning balance", "beg_bal"), ("prior balance", "beg_bal"), ("last bill", "beg_bal"),
    ("previous bill", "beg_bal"), ("payment", "payment"), ("amount paid", "payment"), ("previous adjustment", "prev_adj"),
    ("prior adjustment", "prev_adj"), ("adjustment", "prev_adj"), ("current adjustment", "curr_adj"), ("current charge", "curr_chg"),
    ("new charge", "curr_chg"), ("monthly charge", "curr_chg"), ("tax", "curr_tax"), ("fees", "curr_tax"), ("surcharge", "curr_tax"),
    ("balance due", "end_bal"), ("total due", "end_bal"), ("amount due", "end_bal"), ("ending balance", "end_bal"), ("total amount", "end_bal"),
)

#: What a learned rule captures, by field (fixed values).
CAPTURE = {
    "invoice_number": r"(\S+)",
    "carrier_account": r"(\d+)",
    "invoice_date": r"([\d/-]+)",
    "invoice_due_dtm": r"([\d/-]+)",
    "invoice_st_dtm": r"(\d{1,2}/\d{1,2}/\d{2,4})",
    "invoice_end_dtm": r"(\d{1,2}/\d{1,2}/\d{2,4})",
}
CAPTURE_MONEY = r"(-?[\d,]+\.\d{2})"

# ---------------------------------------------------------------------------------------------- short rules (four fields)
#: Patterns of the short rule set in order (fixed values).
BASIC_NUMBER = [
    r"(?i)Invoice\s*#\s*:?\s*([A-Za-z0-9\-/]+)",
    r"(?i)Invoice\s*Number\s*:?\s*([A-Za-z0-9\-/]+)",
    r"(?i)Invoice\s+No\.?\s*:?\s*([A-Za-z0-9\-/]+)",
    r"(?i)Bill\s*Number\s*:?\s*([A-Za-z0-9\-/]+)",
]
BASIC_DATE = [
    r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b",
    r"\b(\d{4}-\d{1,2}-\d{1,2})\b",
    r"(?i)\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b",
]
BASIC_TOTAL = [
    r"(?i)(?:Total\s+Amount\s+Due|Amount\s+Due|Total\s+Due|Balance\s+Due)\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    r"(?i)(?:^|\b)Total\b\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    r"(?i)Grand\s+Total\s*:?\s*\$?\s*([\d,]+\.?\d*)",
]
NO_VENDOR = r"(?i)^(?:invoice|bill|statement|page|tel:|fax|www\.|http)"
