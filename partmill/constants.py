"""Status codes and fixed values shared by all operators."""

# ---- fixed values: contract headers of the intake file -------------------
INTAKE_COLUMNS = {
    "mpn": "Mfg_Part_Num",
    "description": "Part_Desc",
    "brand_1": "E1_Brand",
    "brand_2": "Unilog_Brand",
    "brand_3": "DIB_Brand",
    "manufacturer": "Part_Manuf",
}
JSON_KEY_ALIASES = {
    "mpn": ["mpn", "mfg_part_num"],
    "description": ["description", "part_desc"],
    "brand_1": ["e1_brand"],
    "brand_2": ["unilog_brand"],
    "brand_3": ["dib_brand"],
    "manufacturer": ["manufacturer", "part_manuf"],
}

# ---- fixed values: placeholders -------------------------------------------
BRAND_PLACEHOLDERS = ["-- unbranded --", "-- no unilog brand --", "-- no dib brand --"]
ENTITY_PLACEHOLDERS = ["-", "--", "n/a", "na", "none", "unknown", "null"]

# ---- fixed values: legal suffix folding -----------------------------------
LEGAL_SUFFIXES = [
    ("incorporated", "inc"),
    ("corporation", "corp"),
    ("limited", "ltd"),
    ("company", "co"),
    ("l\\.l\\.c", "llc"),
]

# ---- fixed values: units of measure ---------------------------------------
UNITS = {
    "in": ["in", "in.", "inch", "inches", '"', "”", "″"],
    "ft": ["ft", "ft.", "foot", "feet", "'"],
    "mm": ["mm", "millimeter", "millimeters"],
    "cm": ["cm", "centimeter", "centimeters"],
    "V": ["v", "volt", "volts", "vac"],
    "A": ["a", "amp", "amps", "ampere", "amperes"],
    "dBA": ["dba", "db(a)"],
    "EA": ["ea", "each", "pc", "pcs", "piece", "pieces"],
    "PK": ["pk", "pack", "packs"],
}
UNIT_FAMILIES = {
    "length": ["in", "ft", "mm", "cm"],
    "electrical_potential": ["V"],
    "electrical_current": ["A"],
    "sound": ["dBA"],
    "count": ["EA", "PK"],
}
FRACTION_BASE = 64
FRACTION_TOLERANCE = 0.0005

# ---- fixed values: host classes and authority scales ----------------------
MARKETPLACE_HOSTS = [
    "amazon.com", "amazon.ca", "ebay.com", "walmart.com", "alibaba.com",
    "aliexpress.com", "etsy.com", "facebook.com", "craigslist.org", "temu.com",
]
RETAILER_HOSTS = [
    "homedepot.com", "lowes.com", "acehardware.com", "northerntool.com",
    "toolbarn.com", "build.com", "mclendons.com", "mccoys.com",
]
DISTRIBUTOR_HOSTS = [
    "zoro.com", "grainger.com", "mscdirect.com", "supplyhouse.com",
    "acwholesalers.com", "fastenal.com", "globalindustrial.com",
]
HOST_KIND_ORDER = ["manufacturer", "marketplace", "distributor", "retailer"]
SOURCE_CLASS = {
    "manufacturer": "MANUFACTURER",
    "distributor": "AUTHORIZED_DISTRIBUTOR",
    "retailer": "RETAILER",
    "marketplace": "MARKETPLACE",
}
MANUFACTURER_AUTHORITY = {
    "PRODUCT_PAGE": 1.0,
    "SPECIFICATION": 0.95,
    "TECHNICAL_DOCUMENT": 0.90,
    "INSTALLATION_MANUAL": 0.90,
    "CATALOG": 0.85,
    "OTHER": 0.80,
}
HOST_AUTHORITY = {"distributor": 0.50, "retailer": 0.45, "marketplace": 0.20}
UNKNOWN_HOST_AUTHORITY = 0.10
EVIDENCE_AUTHORITY = {
    "INPUT": 1.0,
    "MANUFACTURER": 1.0,
    "AUTHORIZED_DISTRIBUTOR": 0.7,
    "RETAILER": 0.4,
    "MARKETPLACE": 0.2,
    "OTHER": 0.1,
}
MAX_SOURCES = 5

# ---- fixed values: thresholds ----------------------------------------------
ENTITY_STRONG = 92.0
ENTITY_POSSIBLE = 80.0
CLASSIFY_HIGH = 0.90
CLASSIFY_REVIEW = 0.70
CHUNK_SIZE = 2400
CHUNK_OVERLAP = 300
VECTOR_DIM = 384
EVIDENCE_TOP_K = 5
MIN_SEARCH_K = 8

# ---- fixed values: stages and statuses ---------------------------------------
STAGES = [
    "understanding", "entity_resolution", "classification", "research",
    "rag", "extraction", "normalization", "validation",
]
# Product status -> index of the stage that sets it; used by monotone advance.
STATUS_STAGE = {
    "INGESTED": 0, "DUPLICATE_CANDIDATE": 0, "INVALID": 0,
    "UNDERSTOOD": 1,
    "RESOLVED": 2, "REVIEW_REQUIRED": 2,
    "CLASSIFIED": 3,
    "RESEARCHED": 4, "NO_AUTHORITATIVE_SOURCE": 4,
    "INDEXED": 5,
    "EXTRACTED": 6, "INSUFFICIENT_EVIDENCE": 6,
    "NORMALIZED": 7,
    "VALIDATED": 8, "PARTIAL": 8, "FAIL": 8, "APPROVED": 8,
}
OPEN_REVIEW = ["PENDING", "IN_REVIEW"]
CLOSED_REVIEW = ["APPROVED", "REJECTED", "UNKNOWN"]
TERMINAL_ITEMS = ["APPROVED", "PARTIAL", "REVIEW_REQUIRED", "FAILED", "SKIPPED"]
DECISION_ALIASES = {
    "APPROVE": "APPROVE_CURRENT",
    "SELECT": "SELECT_CANDIDATE",
    "REJECT": "REJECT_ATTRIBUTE",
    "UNKNOWN": "MARK_UNKNOWN",
    "MARK_AS_UNKNOWN": "MARK_UNKNOWN",
}
INPUT_STRONG_LABELS = ["Width", "Length", "Quantity", "Grit", "Diameter", "Size"]

# ---- fixed values: sentences of the output contract --------------------------
# %s stands for a value of the row.
SENTENCES = {
    "MISSING_REQUIRED": "Required attribute %s is missing.",
    "SOURCE_CONFLICT": "Input and manufacturer values disagree.",
    "SECONDARY_SOURCE_ONLY": "Only low-authority source evidence was found.",
    "MISSING_EVIDENCE": "%s is populated without source evidence.",
    "UOM_INVALID": "UOM '%s' is not an approved unit for %s.",
    "UOM_MISSING": "%s is populated but has no approved UOM.",
    "LOV_INVALID": "Normalized value '%s' does not match approved LOV for %s.",
    "MISSING_IDENTITY": "Product classification is missing.",
    "BRAND_CONFLICT": "Input brand and manufacturer/description brand disagree.",
    "LOW_CLASSIFICATION_CONFIDENCE": "Classification confidence %s is below the review threshold.",
    "NO_AUTHORITATIVE_SOURCE": "Manufacturer source was not found.",
    "SOURCE_FETCH_FAILED": "The manufacturer source could not be fetched.",
    "LLM_QUOTA_EXHAUSTED": "Daily token quota exhausted. Understanding was not generated.",
    "SELECTION_MISSING": "SELECT_CANDIDATE requires selected_value or selected_source",
    "FIELD_EMPTY": "Required field %s is empty",
    "MPN_REPEATED": "Duplicate output row for MPN %s",
    "SLOT_UNLABELLED": "ATTRIBUTE_VALUE %s is populated without a label",
    "SLOT_VALUE": "%s value '%s' is not an allowed LOV value",
    "SLOT_UNIT": "%s UOM '%s' is not an approved unit",
    "SLOT_FAMILY": "%s UOM '%s' is not valid for its unit family",
    "CLASSIFIED": "Matched allowed taxonomy '%s' from product type '%s' using %s.",
    "UNCLASSIFIED": "No allowed taxonomy node was close enough to the product understanding.",
    "CSV_COLUMNS": "CSV is missing required columns: ",
}

# ---- fixed values: delivery contract ----------------------------------------
SLOT_COUNT = 50
REQUIRED_DELIVERY = ["Mfg_Part_Num", "Part_Desc"]
NAMED_DIMENSIONS = {
    "Width": ("WIDTH", "WIDTH_UOM"),
    "Length": ("LENGTH", "LENGTH_UOM"),
    "Height": ("HEIGHT", "HEIGHT_UOM"),
    "Weight": ("WEIGHT", "WEIGHT_UOM"),
    "Volume": ("VOLUME", "VOLUME_UOM"),
}
DOCUMENT_COLUMNS = {
    "SPECIFICATION": "Specification Sheet",
    "INSTALLATION_MANUAL": "Instruction/Installation Manual",
    "CATALOG": "Catalog",
    "TECHNICAL_DOCUMENT": "Technical Bulletin",
}


def slot_columns(n: int) -> tuple[str, str, str]:
    return f"ATTRIBUTE_LABEL {n}", f"ATTRIBUTE_VALUE {n}", f"ATTRIBUTE_UOM {n}"


def delivery_columns() -> list[str]:
    """The delivery header in contract order; repeated groups come from a rule."""
    identity = [
        "PART_NUMBER", "Dept", "Class", "Fine", "SKU - MY_PART_NUMBER",
        "Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand",
        "Part_Manuf", "MANUFACTURER_NAME", "BRAND_NAME", "TRADE_NAME",
        "MANUFACTURER_PART_NUMBER", "ALTERNATE_PART_NUMBER", "Classpath",
        "MOBILE_DESC", "INVOICE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC",
        "MARKETING_DESCRIPTION",
    ]
    after_features = [
        "With", "Standard/Approvals", "Prop 65", "Application", "Includes", "Product Name",
    ]
    commerce = [
        "UPC", "EAN", "GTIN", "UNSPSC", "Warranty", "List Price", "Selling Qty",
        "Selling UOM", "Standard Packaging Information",
    ]
    dimensions = ["LENGTH", "HEIGHT", "WIDTH", "WEIGHT", "VOLUME"]
    media = ["Product Image"] + [f"Alternate Image {i}" for i in range(1, 5)]
    documents = [
        "SDS", "SDS_1", "Warranty Information", "Catalog", "Specification Sheet",
        "Instruction/Installation Manual", "Service Manual", "Owners/User Manual",
        "Line Drawing", "MTR", "RoHS", "Full Engineering Drawing", "Energy Star Guide",
        "Technical Bulletin", "Submittal", "Compatibility Chart", "Size Chart",
        "Product Label/Insert", "Video Link", "Video Link 1", "Country Of Origin",
        "Discontinued", "Actual Image (Yes/No)",
    ]
    columns = ["MFR URL"] + [f"Ref URL {i}" for i in range(1, 6)] + identity
    columns += [f"ITEM_FEATURES_{i}" for i in range(1, 21)] + after_features
    for i in range(1, SLOT_COUNT + 1):
        columns += slot_columns(i)
    columns += commerce
    for name in dimensions:
        columns += [name, f"{name}_UOM"]
    return columns + media + documents
