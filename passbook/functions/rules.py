"""Fixed values that results depend on: names, keywords, patterns and limits, in the order in which they apply."""

# Payment modes by the start of a description (first match), and by its first word.
MODE_PREFIXES = {"UPI": r"^UPI[-/]", "NEFT": r"^NEFT", "IMPS": r"^IMPS", "ATM": r"^ATM", "POS": r"^POS", "RTGS": r"^RTGS"}
MODE_WORDS = {"UPI": r"^\s*UPI\b", "IMPS": r"^\s*IMPS\b", "NEFT": r"^\s*NEFT\b", "RTGS": r"^\s*RTGS\b", "ACH": r"^\s*(ACH|NACH|ECS)\b", "POS": r"^\s*POS\b", "ATM": r"^\s*ATM\b"}

# What is taken out of a description before its merchant is looked for.
HANDLES = ["@ok[a-z]+", "@paytm", "@ybl", "@axl", "@ibl", "@apl", "@[a-z0-9.-]+"]
NOISE_WORDS = ["UPI", "IMPS", "NEFT", "RTGS", "ACH", "NACH", "ECS", "POS", "ATM", "DR", "CR", "PAYMENT", "TXN", "REF", "RRN", "ORDER", "INDIA", "PVT", "LTD", "LIMITED"]
LONG_NUMBER = r"\d{6,}"
TOKEN_BREAKS = r"[\\/*|:;,>_@#-]+"
ROUTING = ["HDFC", "SBIN", "SBI", "ICIC", "ICICI", "AXIS", "KKBK", "KOTAK", "PUNB", "PNB", "YESB", "IDFB", "PYTM", "RAZORPAY", "RAZP", "BILLDESK", "CCAVENUE", "PAYU"]

# Merchants and other names for them.
MERCHANTS = [
    "Amazon", "Flipkart", "Zepto", "Blinkit", "Swiggy", "Zomato", "Netflix", "Spotify", "BigBasket", "Uber", "Ola", "Myntra", "Jio", "Airtel",
    "PhonePe", "Paytm", "Google Pay", "Apple", "Microsoft", "IRCTC", "MakeMyTrip", "Dominos", "McDonalds", "Starbucks", "Reliance", "DMart", "HDFC Bank", "LIC",
]
ALIASES = {
    "AMZN": "Amazon", "AMAZON PAY": "Amazon", "AMAZONPAY": "Amazon", "AMAZON IN": "Amazon", "FKRT": "Flipkart", "FLIPKART INTERNET": "Flipkart",
    "SWIGGYUPI": "Swiggy", "ZOMATO ONLINE": "Zomato", "NETFLIX COM": "Netflix", "GPAY": "Google Pay", "GOOGLEPAY": "Google Pay", "MMT": "MakeMyTrip", "BOOKMYSHOW": "BookMyShow",
}

# The 22 categories, their keywords and merchant category codes.
CATEGORY_KEYWORDS = {
    "Food": ["swiggy", "zomato", "restaurant", "dominos", "mcdonalds", "kfc", "starbucks", "cafe", "food"],
    "Groceries": ["bigbasket", "blinkit", "zepto", "dmart", "grofers", "grocery", "supermarket", "instamart"],
    "Fuel": ["petrol", "diesel", "fuel", "hpcl", "iocl", "bpcl", "indianoil", "shell"],
    "Healthcare": ["hospital", "pharmacy", "apollo", "medplus", "clinic", "diagnostic", "medical", "pharmeasy"],
    "Travel": ["irctc", "makemytrip", "goibibo", "uber", "ola", "flight", "airline", "indigo", "redbus", "mmt"],
    "Entertainment": ["netflix", "spotify", "hotstar", "bookmyshow", "pvr", "inox", "prime video", "cinema"],
    "Utilities": ["electricity", "water bill", "gas bill", "bescom", "utility", "power", "adani electricity"],
    "Investments": ["zerodha", "groww", "upstox", "mutual fund", "sip", "nps", "stock", "demat", "coin"],
    "Salary": ["salary", "payroll", "sal credit", "wages", "stipend"],
    "Rent": ["rent", "nobroker", "rentpay", "house rent", "landlord"],
    "Education": ["school", "college", "university", "tuition", "byjus", "unacademy", "coursera", "udemy", "fees"],
    "Insurance": ["insurance", "lic", "premium", "policybazaar", "hdfc life", "term plan"],
    "Shopping": ["amazon", "flipkart", "myntra", "ajio", "nykaa", "shopping", "mall", "reliance trends"],
    "Transfers": ["transfer", "upi transfer", "neft", "imps", "rtgs", "sent to", "received from", "self"],
    "ATM": ["atm", "cash withdrawal", "atw", "cash wdl"],
    "Loan": ["loan", "disbursement", "personal loan", "home loan", "lending"],
    "EMI": ["emi", "installment", "instalment", "bajaj finserv", "nach emi"],
    "Government": ["government", "govt", "municipal", "passport", "challan", "gst payment"],
    "Tax": ["tax", "income tax", "tds", "advance tax", "gst", "cbdt"],
    "Subscription": ["subscription", "membership", "renewal", "prime", "recurring"],
    "Telecom": ["jio", "airtel", "vodafone", "vi", "bsnl", "recharge", "mobile bill", "broadband", "dth"],
    "Others": ["misc", "other", "sundry"],
}
CATEGORY_CODES = {
    "Food": ["5812", "5814"], "Groceries": ["5411"], "Fuel": ["5541", "5542"], "Healthcare": ["8011", "5912", "8062"], "Travel": ["4511", "4111", "4121", "7011"],
    "Entertainment": ["7832", "7841"], "Utilities": ["4900"], "Investments": ["6211"], "Rent": ["6513"], "Education": ["8220", "8299"], "Insurance": ["6300"],
    "Shopping": ["5311", "5651", "5999"], "ATM": ["6011"], "Government": ["9399"], "Tax": ["9311"], "Subscription": ["5968"], "Telecom": ["4814", "4899"],
}
MERCHANT_CATEGORIES = {
    "Amazon": "Shopping", "Flipkart": "Shopping", "Myntra": "Shopping", "Zepto": "Groceries", "Blinkit": "Groceries", "BigBasket": "Groceries", "DMart": "Groceries",
    "Swiggy": "Food", "Zomato": "Food", "Dominos": "Food", "McDonalds": "Food", "Starbucks": "Food", "Netflix": "Entertainment", "Spotify": "Entertainment",
    "Uber": "Travel", "Ola": "Travel", "IRCTC": "Travel", "MakeMyTrip": "Travel", "Jio": "Telecom", "Airtel": "Telecom", "LIC": "Insurance",
}

# Phrases that the second tier learns from beside keywords and merchants, with their categories.
TRAINING_PHRASES = {
    "swiggy order food delivery": "Food", "zomato dinner": "Food", "amazon shopping order": "Shopping", "flipkart purchase": "Shopping",
    "netflix monthly subscription": "Entertainment", "spotify premium": "Entertainment", "uber ride trip": "Travel", "irctc train ticket": "Travel",
    "hpcl petrol pump fuel": "Fuel", "bigbasket grocery order": "Groceries", "zepto instant grocery": "Groceries", "salary credit from employer": "Salary",
    "monthly house rent payment": "Rent", "lic insurance premium": "Insurance", "atm cash withdrawal": "ATM", "jio mobile recharge": "Telecom",
    "airtel broadband bill": "Telecom", "electricity utility bill": "Utilities", "zerodha stock investment": "Investments", "income tax payment": "Tax",
}

# Other names of the canonical columns.
COLUMN_NAMES = {
    "date": ["date", "txn date", "transaction date", "value date", "posting date", "entry date", "trans date"],
    "description": ["description", "narration", "particulars", "details", "transaction details", "remarks"],
    "debit": ["withdrawal", "dr", "debit", "debit amount", "amount withdrawn", "withdraw", "paid out", "outflow"],
    "credit": ["deposit", "cr", "credit", "credit amount", "amount deposited", "paid in", "inflow"],
    "balance": ["balance", "closing balance", "running balance", "available balance", "current balance", "closing bal"],
    "reference_number": ["reference", "ref no", "reference number", "cheque no", "chq no", "utr", "transaction id", "txn id"],
    "amount": ["amount", "txn amount", "transaction amount", "signed amount"],
}

# Confidences and limits.
CONFIDENCE = {"alias": 0.95, "word": 0.90, "fallback": 0.4, "merchant": 0.95, "code": 0.85, "keyword": 0.80, "default": 0.1}
FUZZY_MERCHANT, FUZZY_COLUMN = 88, 85
KNOWN_SHARES = ["UPI", "ATM", "POS", "NEFT", "IMPS"]


def keywords_by_length() -> list[tuple[str, str]]:
    """(keyword, category): the longest first, then in the order above."""
    pairs = [(k, c) for c, ks in CATEGORY_KEYWORDS.items() for k in ks]
    return sorted(pairs, key=lambda p: -len(p[0]))
