"""Fixed values that results depend on, kept together as plain lists."""

# Words without content in financial text.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into",
    "through", "during", "before", "after", "above", "below", "between", "among", "within", "without", "under", "over",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "must", "shall", "this", "that", "these", "those", "i", "you", "he", "she", "it",
    "we", "they", "me", "him", "her", "us", "them",
]

# Terms that a vocabulary takes first.
FINANCIAL_TERMS = [
    "revenue", "income", "profit", "loss", "assets", "liabilities", "equity", "cash", "debt", "expenses", "costs", "earnings",
    "dividend", "stock", "shares", "securities", "investment", "capital", "financing", "operations", "margin", "ratio",
    "growth", "performance", "risk", "compliance", "regulatory", "market", "competition", "strategy", "acquisition", "merger",
    "segment", "product", "service", "customer", "technology",
]

# Categories of concepts by keyword in the lower-cased name; the first match counts.
CONCEPT_CATEGORIES = {
    "revenue": ["revenues", "revenue", "netsales", "operatingrevenues", "totalrevenues", "salesrevenuenet", "revenuefromcontractwithcustomerexcludingassessedtax"],
    "expenses": ["operatingexpenses", "costofrevenue", "costofgoodssold", "researchanddevelopmentexpense", "sellingandmarketingexpense", "generalandadministrativeexpense"],
    "income": ["netincome", "netincomeloss", "profitloss", "incomelossfromcontinuingoperations", "comprehensiveincomeloss", "earningsper", "dilutedearningsper"],
    "assets": ["assets", "totalassets", "currentassets", "noncurrentassets", "cashandcashequivalents", "shortterminvestments", "accountsreceivable", "inventory", "propertyplantandequipment", "intangibleassets", "goodwill"],
    "liabilities": ["liabilities", "totalliabilities", "currentliabilities", "noncurrentliabilities", "accountspayable", "accruedliabilities", "debt", "longtermldebt", "shorttermldebt"],
    "equity": ["stockholdersequity", "shareholdersequity", "totalequity", "retainedearnings", "commonstock", "preferredstock", "treasurystock", "paidincapital"],
    "cashflow": ["cashflowfromoperatingactivities", "cashflowfrominvestingactivities", "cashflowfromfinancingactivities", "netcashflow", "freecashflow"],
    "ratios": ["returnonassets", "returnonequity", "grossmargin", "operatingmargin", "netmargin", "debttoequity", "currentratio", "quickratio"],
}

# Transaction codes of ownership forms.
TRANSACTION_CODES = {
    "P": "Purchase", "S": "Sale", "A": "Award/Grant", "G": "Gift", "F": "Payment of Exercise Price", "M": "Exercise of Derivative",
    "X": "Exercise of Derivative", "D": "Disposition", "B": "Purchase (Beneficial)", "C": "Conversion", "E": "Exercise", "H": "Holding",
    "I": "Inheritance", "J": "Other Acquisition", "K": "Other Disposition", "L": "Loan", "O": "Other", "U": "Transfer",
    "V": "Transaction Voluntarily Reported", "W": "Will or Bequest", "Z": "Deposit",
}

# Titles, first by the whole lower-cased title, then by the first one it contains.
TITLES = {
    "ceo": "Chief Executive Officer", "cfo": "Chief Financial Officer", "coo": "Chief Operating Officer", "cto": "Chief Technology Officer",
    "president": "President", "chairman": "Chairman", "director": "Director", "vp": "Vice President", "svp": "Senior Vice President", "evp": "Executive Vice President",
}

# Groups of words that a text query is widened by.
SYNONYMS = {
    "revenue": ["revenue", "sales", "income", "earnings"],
    "profit": ["profit", "earnings", "income", "margin"],
    "debt": ["debt", "liabilities", "borrowings", "obligations"],
    "cash": ["cash", "liquidity", "funds"],
    "growth": ["growth", "increase", "expansion", "improvement"],
    "risk": ["risk", "threat", "challenge", "concern"],
}

# How many filings of a type are processed for a company, and how many of its sections are kept.
FILING_CAPS = {"10-K": 3, "10-Q": 3, "8-K": 3, "DEF 14A": 3, "3": 5, "4": 5, "5": 5}
SECTION_CAPS = {"10-K": 8, "10-Q": 6, "8-K": 4, "DEF 14A": 3}
