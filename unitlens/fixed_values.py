"""Fixed values.

Word lists, lookup tables, constants and patterns which decide results and so have to hold exactly these
values. They are data: the logic that uses them is in the other modules.
"""

# --- numbers written as words ------------------------------------------------------------------
WORD_NUMBERS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "eighteen": 18, "twentyfour": 24, "twenty four": 24,
}

# --- number patterns ----------------------------------------------------------------------------
PRICE_PATTERN = r"\$?\s*(\d[\d,]*(?:\.\d+)?)"
NUMBER_PATTERN = r"(\d+(?:\.\d+)?)"
BED_WORD_PATTERN = r"\b(one|two|three|four|five|six)\b"
HALF_BATH_PATTERN = r"(\d+)\s*half"
YEAR_PATTERN = r"(1[89]\d{2}|20\d{2})"
SQFT_RANGE = (200, 25000)
YEAR_RANGE = (1880, 2100)

# --- lease windows (months), in order of preference within each list -----------------------------
LEASE_RANGE_PATTERNS = (
    r"\b(\d{1,2})\s*(?:-|to|thru|through|/)\s*(\d{1,2})\s*(?:\+)?\s*(?:mo|mos|month|months)\b",
    r"\bmin(?:imum)?\.?\s*(\d{1,2})\s*(?:mo|mos|month|months)\b.{0,40}?"
    r"\bmax(?:imum)?\.?\s*(\d{1,2})\s*(?:mo|mos|month|months)\b",
)
LEASE_MIN_PATTERNS = (
    r"\bmin(?:imum)?\.?\s*(?:of\s*)?(\d{1,2})\s*(?:mo|mos|month|months)\b",
    r"\b(\d{1,2})\s*(?:mo|mos|month|months)\s*(?:min(?:imum)?|or (?:more|longer)|\+)\b",
    r"\bat least\s*(\d{1,2})\s*(?:mo|mos|month|months)\b",
)
LEASE_MAX_PATTERNS = (
    r"\bmax(?:imum)?\.?\s*(?:of\s*)?(\d{1,2})\s*(?:mo|mos|month|months)\b",
    r"\bup to\s*(\d{1,2})\s*(?:mo|mos|month|months)\b",
    r"\bno more than\s*(\d{1,2})\s*(?:mo|mos|month|months)\b",
)
LEASE_YEAR_PATTERNS = (
    r"\b(\d{1,2})\s*(?:yr|yrs|year|years)\s*(?:lease|term|minimum|min)?\b",
)
LEASE_EXACT_PATTERNS = (
    r"\b(\d{1,2})\s*(?:mo|mos|month|months)\s*(?:lease|term|rental|only)\b",
    r"\blease\s*(?:term|length|of|:)?\s*(\d{1,2})\s*(?:mo|mos|month|months)\b",
    r"\b(\d{1,2})\s*(?:mo|mos|month|months)\b",
)
ANNUAL_PHRASES = (
    "annual lease", "annual rental", "annual only", "yearly lease",
    "one year lease", "1 year lease", "12 month lease", "12-month lease",
    "long term lease", "long-term lease", "unfurnished annual",
)
LEASE_MAX_MONTHS = 60
LEASE_MAX_YEARS = 5

# --- negation around keywords --------------------------------------------------------------------
NEGATORS_BEFORE = (
    "no", "not", "non", "never", "without", "excluding", "excludes", "exclude",
    "prohibited", "prohibits", "prohibit", "unavailable", "sorry", "cannot",
    "cant", "wont", "declined", "denies", "deny", "absolutely", "strictly",
)
NEGATORS_AFTER = (
    "not available", "not allowed", "not permitted", "not accepted", "prohibited",
    "unavailable", "excluded", "will not be considered", "need not apply",
    "not an option", "no", "not",
)
NEGATION_WINDOW = 4

# --- addresses -----------------------------------------------------------------------------------
STREET_SUFFIXES = {
    "avenue": "ave", "av": "ave", "ave": "ave", "aven": "ave", "avenu": "ave",
    "boulevard": "blvd", "blvd": "blvd", "boul": "blvd", "boulv": "blvd",
    "causeway": "cswy", "cswy": "cswy",
    "circle": "cir", "cir": "cir", "circl": "cir",
    "court": "ct", "ct": "ct",
    "drive": "dr", "dr": "dr", "driv": "dr", "drv": "dr",
    "expressway": "expy", "expy": "expy",
    "highway": "hwy", "hwy": "hwy", "hiway": "hwy",
    "island": "is", "is": "is",
    "lane": "ln", "ln": "ln",
    "parkway": "pkwy", "pkwy": "pkwy", "pky": "pkwy",
    "place": "pl", "pl": "pl",
    "plaza": "plz", "plz": "plz",
    "point": "pt", "pt": "pt",
    "road": "rd", "rd": "rd",
    "square": "sq", "sq": "sq",
    "street": "st", "st": "st", "str": "st", "strt": "st",
    "terrace": "ter", "ter": "ter", "terr": "ter",
    "trail": "trl", "trl": "trl",
    "walk": "walk",
    "way": "way", "wy": "way",
}
DIRECTIONALS = {
    "north": "n", "n": "n", "south": "s", "s": "s",
    "east": "e", "e": "e", "west": "w", "w": "w",
    "northeast": "ne", "ne": "ne", "northwest": "nw", "nw": "nw",
    "southeast": "se", "se": "se", "southwest": "sw", "sw": "sw",
}
ORDINAL_WORDS = {
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th",
    "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th",
    "ninth": "9th", "tenth": "10th",
}
UNIT_MARKERS = (
    "apt", "apartment", "unit", "ste", "suite", "no", "num", "number",
    "ph", "penthouse", "th", "townhouse", "lot", "res", "residence", "villa",
)
UNIT_LABEL_MARKERS = ("ph", "penthouse", "th", "townhouse")
UNIT_NOISE_MARKERS = (
    "apartment", "apt", "unit", "suite", "ste", "number", "num", "no", "residence", "res",
)
UNIT_EMPTY_WORDS = ("na", "none", "null")
UNIT_VALUE_PATTERN = r"([A-Za-z0-9][A-Za-z0-9\-]*(?:\s+[A-Za-z0-9]{1,3})?)"
BARE_UNIT_PATTERN = r"(?i)^(?:(?:ph|th)?-?\d{1,5}[a-z]?|[a-z]-?\d{1,5}[a-z]?)$"
HOUSE_NUMBER_PATTERN = r"^\d+[a-z]?(?:-\d+)?$"
TRAILING_ZIP_PATTERN = r"\b(\d{5})(?:-\d{4})?\s*$"
TRAILING_STATE_PATTERN = r"(?i)[\s,]+(florida|fla|[A-Za-z]{2})\s*$"
CITY_ALIASES = {
    "miami beach": "Miami Beach",
    "miamibeach": "Miami Beach",
    "south beach": "Miami Beach",
    "mid beach": "Miami Beach",
    "north beach": "Miami Beach",
    "surfside": "Surfside",
    "bal harbour": "Bal Harbour",
    "bal harbor": "Bal Harbour",
    "balharbour": "Bal Harbour",
    "bay harbor islands": "Bay Harbor Islands",
    "bay harbour islands": "Bay Harbor Islands",
    "sunny isles beach": "Sunny Isles Beach",
    "sunny isles": "Sunny Isles Beach",
    "sunnyisles": "Sunny Isles Beach",
}
STATE_ALIASES = {"florida": "FL", "fl": "FL", "fla": "FL"}
DEFAULT_STATE = "FL"

# --- geometry: (latitude, longitude) of the reference line, south to north -------------------------
SHORELINE = (
    (25.7650, -80.1300),
    (25.7700, -80.1295),
    (25.7800, -80.1280),
    (25.7900, -80.1265),
    (25.8000, -80.1245),
    (25.8130, -80.1215),
    (25.8250, -80.1205),
    (25.8385, -80.1200),
    (25.8480, -80.1195),
    (25.8600, -80.1198),
    (25.8700, -80.1200),
    (25.8790, -80.1200),
    (25.8890, -80.1210),
    (25.9000, -80.1225),
    (25.9130, -80.1210),
    (25.9200, -80.1203),
    (25.9280, -80.1200),
    (25.9390, -80.1190),
    (25.9500, -80.1195),
    (25.9640, -80.1200),
)
COASTAL_BOX = (25.750, 25.975, -80.160, -80.110)  # lat_min, lat_max, lon_min, lon_max
EARTH_RADIUS_MILES = 3958.7613
NEAR_MILES = 0.1
AT_LINE_MILES = 0.06

# --- constraints -----------------------------------------------------------------------------------
DENIED_TYPES = (
    "single family", "single_family", "singlefamily", "townhouse", "town house",
    "multi family", "multi_family", "duplex", "triplex", "lot", "land",
    "manufactured", "mobile", "commercial", "office", "retail", "warehouse",
)
PROSE_MIN_CHARS = 40
PREFILTER_DISTANCE_SLACK = 1.5
NEW_BUILD_YEAR = 2015

DEFAULT_CITIES = ("Miami Beach", "Surfside", "Bal Harbour", "Bay Harbor Islands", "Sunny Isles Beach")
DEFAULT_ZIP_CODES = ("33139", "33140", "33141", "33154", "33160")
DEFAULT_PROPERTY_TYPES = ("condo", "condominium", "apartment", "co-op")
DEFAULT_EXCLUDED_KEYWORDS = (
    "short term", "short-term", "shortterm", "vacation", "vacation rental", "seasonal", "season only",
    "daily", "per day", "nightly", "per night", "weekly", "per week", "month to month", "month-to-month",
    "monthly rental", "airbnb", "air bnb", "vrbo", "transient", "snowbird", "furnished short",
    "flexible terms", "1-3 months", "3 month minimum", "30 day minimum", "90 days",
)
DEFAULT_POSITIVE_KEYWORDS = (
    "annual", "annual lease", "yearly", "year lease", "12 month", "12-month", "one year", "1 year",
    "long term", "long-term", "unfurnished annual",
)
DEFAULT_RENOVATION_KEYWORDS = (
    "renovated", "fully renovated", "completely renovated", "remodeled", "gut renovated",
    "new construction", "newly built", "just completed", "brand new", "turnkey", "restored",
)
DEFAULT_AMENITIES = {
    "valet": ("valet", "valet parking"),
    "concierge": ("concierge", "front desk", "24-hour desk", "24/7 concierge"),
    "doorman": ("doorman", "door man"),
    "pool": ("pool", "infinity pool", "rooftop pool", "lap pool"),
    "gym": ("gym", "fitness center", "fitness centre", "health club", "wellness center"),
    "spa": ("spa", "sauna", "steam room", "hammam"),
    "beach_service": ("beach service", "beach club", "private beach", "beach access"),
    "security": ("24-hour security", "24/7 security", "security guard", "gated"),
    "balcony": ("balcony", "terrace", "wraparound balcony", "private terrace"),
    "ocean_view": (
        "ocean view", "ocean views", "oceanfront", "ocean front", "direct ocean",
        "sea view", "sea views", "water view", "water views", "panoramic ocean",
        "unobstructed ocean", "beach view", "atlantic view", "ocean facing",
        "oceanview", "sunrise view",
    ),
    "parking": ("garage parking", "assigned parking", "covered parking", "self parking"),
    "tennis": ("tennis court", "pickleball", "padel"),
    "business": ("business center", "conference room", "co-working"),
    "pet": ("pet friendly", "dog park", "pet spa"),
    "smart": ("smart home", "private elevator", "semi-private elevator"),
}
DEFAULT_REQUIRED_AMENITIES = ("ocean_view",)

# --- register and valuation ------------------------------------------------------------------------
SQFT_CONFLICT_RATIO = 0.15
YEAR_CONFLICT_YEARS = 2
VALUATION_TYPES = {
    "condo": "Condo",
    "condominium": "Condo",
    "co-op": "Condo",
    "coop": "Condo",
    "apartment": "Apartment",
    "townhouse": "Townhouse",
    "single family": "Single Family",
}

# --- snapshot --------------------------------------------------------------------------------------
INACTIVE_AFTER_HOURS = 72
KEEP_WHEN_BLANK = (
    "beds", "baths", "sqft", "year_built", "latitude", "longitude",
    "available_date", "days_on_market", "broker", "photos", "amenities",
    "description", "title", "lease_min_months", "lease_max_months",
    "property_type", "unit", "city", "zip_code", "url", "amenity_matches",
    "enrichment", "lease_term_text", "miles_from_ocean",
)

# --- coverage --------------------------------------------------------------------------------------
COVERAGE_CONSEQUENCES = {
    "price": "budget filter cannot run -- listing is dropped",
    "beds": "bedroom minimum degrades to a warning",
    "baths": "bathroom minimum degrades to a warning",
    "sqft": "1,200 sqft floor degrades to a warning (county lookup may recover it)",
    "description": "LEASE TERM and OCEAN VIEW cannot be judged -- both become advisory",
    "latitude": "ocean distance cannot be measured",
    "url": "alerts carry no link to the listing",
}

# --- payload shapes --------------------------------------------------------------------------------
LISTING_SIGNALS = (
    "price", "list_price", "rent", "rentzestimate", "zpid", "property_id",
    "propertyid", "listingid", "listing_id", "mlsid", "address", "streetaddress",
    "bedrooms", "beds", "baths", "bathrooms", "livingarea", "sqft",
)
SEARCH_DEPTH = 8
LIST_DESCENT = 200
TEXT_LIST_DESCENT = 100
TEXT_LIMIT = 4000
LABEL_KEYS = ("href", "url", "name", "label", "text", "value", "description")
ENVELOPE_KEYS = ("listings", "results", "properties", "data", "items", "records")
NESTED_ENVELOPE_KEYS = ("listings", "results", "properties", "items")
STATE_PATTERNS = (
    r'(?is)<script[^>]+id="__NEXT_DATA__"[^>]*>(.*?)</script>',
    r"(?s)window\.__INITIAL_STATE__\s*=\s*(\{.*?\})\s*(?:;.*?)?</script>",
    r"(?s)window\.__reactServerState\s*=\s*(\{.*?\})\s*(?:;.*?)?</script>",
    r"(?s)root\.__STATE__\s*=\s*(\{.*?\})\s*(?:;.*?)?</script>",
    r'(?s)<!--\s*(\{"queryState".*?\})\s*-->',
)
JSON_LD_PATTERN = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
FEED_TITLE_PATTERN = (
    r"(?i)^\s*(\$[\d,]+)?\s*/?\s*(?:(\d+)\s*br)?\s*-?\s*(?:([\d,]+)\s*ft2?)?\s*-?\s*(.*)$"
)
FEED_AREA_PATTERN = r"\(([^()]{2,60})\)\s*$"
POSTING_ID_PATTERN = r"/(\d{6,})\.html"
CARD_BEDS_PATTERN = r"(?i)(\d+(?:\.\d+)?)\s*(?:bd|bds|bed|beds|br)\b"
CARD_BATHS_PATTERN = r"(?i)(\d+(?:\.\d+)?)\s*(?:ba|bath|baths|br)\b"
CARD_SQFT_PATTERN = r"(?i)([\d,]+)\s*(?:sqft|sq\s?ft|square feet)\b"
SITE_URLS = {
    "zillow": "https://www.zillow.com",
    "redfin": "https://www.redfin.com",
    "realtor": "https://www.realtor.com",
}
