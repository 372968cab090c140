"""Fixed values that results depend on: word lists, weights and labels. Plain data, no logic."""

# Brands recognized in product names.
KNOWN_BRANDS = [
    "AMD", "Intel", "NVIDIA", "Gigabyte", "ASUS", "MSI", "EVGA", "Zotac",
    "Sapphire", "PowerColor", "XFX", "ASRock", "Corsair", "G.Skill",
    "Kingston", "Crucial", "Samsung", "Seagate", "Western Digital", "WD",
    "Noctua", "be quiet!", "Cooler Master", "Lian Li", "Fractal Design",
    "Phanteks", "NZXT", "Seasonic", "Super Flower", "Antec", "Thermaltake",
    "Logitech", "Razer", "SteelSeries", "HyperX", "BenQ", "LG", "Dell",
    "Acer", "ViewSonic", "AOC",
]

# Words removed by the strict model normalization.
STRICT_WORDS = [
    "OC", "Edition", "Gaming", "Pro", "Founders", "Strix", "TUF", "ROG",
    "Aorus", "Windforce", "Eagle", "Vision", "Ventus", "Suprim", "Trio",
    "Graphics Card", "CPU", "Processor", "Cooler", "Black", "White", "RGB",
    "ARGB", "DDR4", "DDR5", "GDDR6X", "GDDR7", "PCIe", "Gen4", "Gen5",
    "with Cooler", "(No Cooler)", "WOF",
]

# Further words removed by the loose model normalization.
LOOSE_EXTRA_WORDS = ["threads", "ghz", "matx", "atx", "itx", "wifi", "core"]

# Attribute keys that enter a fingerprint, per lower-case category name, in order.
FINGERPRINT_KEYS = {
    "graphics cards": ("series", "vram_gb"),
    "cpus": ("socket", "intel_series", "amd_series"),
    "motherboards": ("socket", "intel_chipset", "amd_chipset", "form_factor"),
    "memory (ram)": ("type", "capacity_gb", "speed_mhz", "form_factor", "ecc"),
    "storage (ssd/hdd)": ("type", "capacity_gb", "form_factor"),
    "power supplies": ("wattage", "rating", "modularity"),
    "pc cases": ("size",),
    "monitors": ("screen_size_inch", "resolution", "panel_type", "refresh_rate_hz"),
    "cooling": ("type",),
}

# Attributes that hold numbers; all others hold text.
NUMERIC_KEYS = ("vram_gb", "capacity_gb", "speed_mhz", "wattage", "refresh_rate_hz", "screen_size_inch")

# Candidate score weights, bonus and thresholds.
MODEL_WEIGHT = 0.45
NAME_WEIGHT = 0.30
BRAND_WEIGHT = 0.15
ATTRIBUTE_WEIGHT = 0.10
FINGERPRINT_BONUS = 18.0
BRAND_EQUAL, BRAND_UNEQUAL, BRAND_UNKNOWN = 100.0, 15.0, 55.0
ATTRIBUTES_UNKNOWN = 50.0
AUTO_MATCH_SCORE = 96.0
REVIEW_SCORE = 75.0
SIMILARITY_REASON_MIN = 70
BULK_MIN_SCORE = 95.0

# Texts written by matching.
REASON_FINGERPRINT = "Exact deterministic fingerprint match"
REASON_BRAND = "Brand match: "
REASON_ATTRIBUTES = "Matched attributes: "
REASON_MODEL = "Model similarity "
REASON_NAME = "Name similarity "
REASON_FALLBACK = "Weak fallback candidate based on title similarity"
RATIONALE_KEPT_MATCH = "Preserved manual canonical assignment during ingestion"
RATIONALE_KEPT_REJECT = "Preserved manual rejection during ingestion"
RATIONALE_PENDING = "Awaiting manual review"
RATIONALE_EXACT = "Matched during native v2 ingestion using deterministic fingerprint grouping"
RATIONALE_AUTO = "Automatically matched using ranked candidate score "
RATIONALE_QUEUED = "Queued for manual review after candidate score "
RATIONALE_NEW = "Created a new canonical product because no sufficiently similar candidate existed"
RATIONALE_BULK = "Bulk accepted top candidate "

# Reference dimension rows (name, url, logo) and category names.
SEED_RETAILERS = [
    ("PC Case Gear", "https://www.pccasegear.com", "assets/logos/pccg.png"),
    ("Scorptec", "https://www.scorptec.com.au", "assets/logos/scorptec.png"),
    ("Centre Com", "https://www.centrecom.com.au", None),
    ("MSY Technology", "https://www.msy.com.au", "assets/logos/msy.png"),
    ("Umart", "https://www.umart.com.au", "assets/logos/umart.png"),
    ("Computer Alliance", "https://www.computeralliance.com.au", "assets/logos/computeralliance.png"),
    ("JW Computers", "https://www.jw.com.au", "assets/logos/jw.png"),
    ("Shopping Express", "https://www.shoppingexpress.com.au", "assets/logos/shoppingexpress.png"),
]
SEED_CATEGORIES = [
    "Graphics Cards", "CPUs", "Motherboards", "Memory (RAM)", "Storage (SSD/HDD)",
    "Power Supplies", "PC Cases", "Monitors", "Cooling", "Fans & Accessories",
]
