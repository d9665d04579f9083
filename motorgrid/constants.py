"""Names, word lists, tables and patterns that results depend on."""

# ---- fixed values: closed vocabularies ----
LISTING_SOURCES = (
    "cars_com", "autotrader", "craigslist", "bat", "hemmings", "carsandbids",
    "stanford_cars", "vmmrdb", "compcars", "wikimedia_commons",
)
QUEUE_SOURCES = ("cars_com", "autotrader", "craigslist", "bat", "hemmings", "carsandbids")
QUEUE_KINDS = ("search", "listing", "image")
QUEUE_STATUSES = ("pending", "in_progress", "done", "failed", "dead")
SPLITS = ("train", "val", "test")
EXTERIOR_VIEWS = ("front", "rear", "side", "three-quarter-front", "three-quarter-rear")
NON_EXTERIOR_VIEWS = ("interior", "detail", "non-car")
ALL_VIEWS = EXTERIOR_VIEWS + NON_EXTERIOR_VIEWS
NON_EXTERIOR = "non-exterior"
UNKNOWN = "unknown"

# ---- fixed values: make spellings and their canonical form ----
MAKE_ALIASES = {
    "benz": "Mercedes-Benz",
    "mercedes benz": "Mercedes-Benz",
    "mercedes-benz": "Mercedes-Benz",
    "bwm": "BMW",
    "bmw": "BMW",
    "chevy": "Chevrolet",
    "chevrolet": "Chevrolet",
    "kia": "Kia",
    "mazda": "Mazda",
    "buck": "Buick",
    "buick": "Buick",
    "chrey": "Chery",
    "lamorghini": "Lamborghini",
    "lamborghini": "Lamborghini",
    "land-rover": "Land Rover",
    "land rover": "Land Rover",
    "landrover": "Land Rover",
    "tesla": "Tesla",
    "saab": "Saab",
    "fiat": "FIAT",
    "vw": "Volkswagen",
    "vauxhall": "Vauxhall",
    "mini": "MINI",
    "smart": "smart",
    "rolls-royce": "Rolls-Royce",
    "rolls royce": "Rolls-Royce",
    "alfa romeo": "Alfa Romeo",
    "aston martin": "Aston Martin",
    "am general": "AM General",
    "ds": "DS",
    "byd": "BYD",
    "gmc": "GMC",
    "mg": "MG",
    "abt": "ABT",
}

# ---- fixed values: further makes recognised in category names ----
CATEGORY_MAKES = (
    "acura", "audi", "bentley", "bugatti", "cadillac", "chrysler", "citroen", "citroën",
    "daewoo", "daihatsu", "datsun", "dodge", "ferrari", "fisker", "ford", "genesis", "honda",
    "hummer", "hyundai", "infiniti", "isuzu", "jaguar", "jeep", "lancia", "lexus", "lincoln",
    "lotus", "maserati", "maybach", "mclaren", "mercury", "mitsubishi", "morgan", "nissan",
    "oldsmobile", "opel", "packard", "peugeot", "plymouth", "pontiac", "porsche", "ram",
    "renault", "saturn", "scion", "seat", "skoda", "studebaker", "subaru", "suzuki", "toyota",
    "triumph", "volkswagen", "volvo",
)

# ---- fixed values: popularity weight per catalog make spelling ----
MAKE_POPULARITY = {
    "Ford": 1.0, "Toyota": 1.0, "Chevrolet": 1.0, "Honda": 1.0, "Nissan": 0.95, "Ram": 0.9,
    "Jeep": 0.9, "Gmc": 0.9, "Hyundai": 0.9, "Kia": 0.85, "Subaru": 0.85, "Mazda": 0.8,
    "Volkswagen": 0.8, "Bmw": 0.8, "Mercedes-Benz": 0.8, "Audi": 0.75, "Tesla": 0.75,
    "Lexus": 0.7, "Acura": 0.65, "Buick": 0.65, "Cadillac": 0.65, "Volvo": 0.6,
    "Infiniti": 0.55, "Lincoln": 0.55, "Chrysler": 0.55, "Dodge": 0.7, "Mitsubishi": 0.5,
    "Mini": 0.5, "Porsche": 0.55, "Land Rover": 0.5, "Jaguar": 0.45, "Genesis": 0.5,
    "Fiat": 0.4, "Alfa Romeo": 0.4, "Mclaren": 0.35, "Maserati": 0.35,
}
DEFAULT_MAKE_WEIGHT = 0.3
KNOWN_TITLE_MAKES = tuple(name.lower() for name in MAKE_POPULARITY)

# ---- fixed values: recency curve, generation grid, retry policy ----
RECENCY_TAU = 15.0
RECENCY_FLOOR_AGE = 40
RECENCY_FLOOR = 0.02
GENERATION_ANCHOR = 1980
GENERATION_YEARS = 4
BACKOFF_CAP_SECONDS = 3600
DEAD_AFTER_ATTEMPTS = 5
POSITION_LAST = 2**30

# ---- fixed values: class-string body styles ----
BODY_STYLES = (
    "Sedan", "Coupe", "Hatchback", "Wagon", "Convertible", "SUV", "Van", "Minivan", "Truck",
    "Pickup", "Roadster", "Cabriolet", "GranCoupe", "GranTurismo",
)
CAB_STYLES = (
    "Crew Cab", "Extended Cab", "Regular Cab", "Super Cab", "Quad Cab", "Club Cab",
    "Standard Cab",
)

# ---- fixed values: category name patterns ----
CATEGORY_YEAR_PATTERN = (
    r"(?i)^(?:(?:cars|vehicles|automobiles) introduced in (\d{4})"
    r"|(\d{4}) (?:automobiles|cars|vehicles))$"
)
CATEGORY_DECADE_PATTERN = r"(?i)^(\d{4})s (?:automobiles|cars|vehicles)$"
CATEGORY_MAKE_SUFFIX = (
    r"(?i)\s*(?:\(.*?\)|vehicles|automobiles|cars|motor company|motors)$"
)

# ---- fixed values: media types and image trees ----
MEDIA_EXTENSIONS = {
    "image/jpeg": ".jpg",
    "image/jpg": ".jpg",
    "image/png": ".png",
    "image/webp": ".webp",
    "image/gif": ".gif",
}
CATEGORY_MEDIA_TYPES = ("image/jpeg", "image/jpg", "image/png", "image/webp")
TREE_EXTENSIONS = (".jpg", ".jpeg", ".png")
TREE_PREFIXES = ("VMMRdb/", "VMMRdb_master/")

# ---- fixed values: sites ----
HOST_SOURCES = {
    "cars.com": "cars_com",
    "www.cars.com": "cars_com",
    "autotrader.com": "autotrader",
    "www.autotrader.com": "autotrader",
    "bringatrailer.com": "bat",
    "www.bringatrailer.com": "bat",
    "hemmings.com": "hemmings",
    "www.hemmings.com": "hemmings",
    "carsandbids.com": "carsandbids",
    "www.carsandbids.com": "carsandbids",
}
CRAIGSLIST_DOMAIN = "craigslist.org"
CRAIGSLIST_CITIES = (
    "newyork", "losangeles", "sfbay", "chicago", "houston", "atlanta", "miami", "seattle",
    "boston", "dallas",
)
LISTING_HREF_PATTERNS = {
    "cars_com": r"^(?:https?://(?:www\.)?cars\.com)?/vehicledetail/[^/?#]+"
                r"(?:/(?:overview|photos|features))?/?(?:\?[^#]*)?$",
    "autotrader": r"^(?:https?://(?:www\.)?autotrader\.com)?"
                  r"/cars-for-sale/(?:vehicledetails|vehicle)/[^/?#]+/?$",
    "craigslist": r"^https?://[a-z0-9-]+\.craigslist\.org/[^/]+/ct[od]/d/[^/]+/\d{6,}\.html$",
    "bat": r"^(?:https?://(?:www\.)?bringatrailer\.com)?/listing/[a-z0-9-]+/?$",
    "hemmings": r"^(?:https?://(?:www\.)?hemmings\.com)?"
                r"/(?:classifieds|auctions|listing)/[^?#]*?\d{6,}/?$",
    "carsandbids": r"^(?:https?://(?:www\.)?carsandbids\.com)?/auctions/[a-z0-9-]+/?$",
}
# Group 1 is the native id; matched against the URL path, or the whole URL for cars_com.
NATIVE_ID_PATTERNS = {
    "cars_com": r"/vehicledetail/([^/?#]+)",
    "autotrader": r"(\d{6,})/?$",
    "craigslist": r"/(\d{6,})\.html$",
    "bat": r"^/listing/([a-z0-9-]+)/?$",
    "hemmings": r"(\d{6,})/?$",
    "carsandbids": r"^/auctions/([a-z0-9-]+)/?$",
}
SOURCE_MAX_ITEMS = {
    "bat": 15, "craigslist": 15, "cars_com": 15, "hemmings": 10, "autotrader": 5,
    "carsandbids": 5,
}
VEHICLE_TYPES = ("vehicle", "car", "product")
STATE_SCRIPT_ID = "CarsWeb.VehicleDetailController.show"
GALLERY_HOST = "platform.cstatic-images.com"

# ---- fixed values: page block tags ----
CHALLENGE_MARKERS = (
    "Just a moment",
    "__cf_chl_jschl_tk__",
    "cf-error-details",
    "Attention Required! | Cloudflare",
    "__cf_chl_opt",
    "cf_chl_managed",
    "Enable JavaScript and cookies to continue",
)
CONTENT_MARKERS = {
    "cars_com": ("vehicle-card", "listing-card", "/vehicledetail/", "spark-vehicle-card",
                 "data-listing-id"),
    "autotrader": ("inventory-listing", "/cars-for-sale/vehicledetails/",
                   'data-cmp="inventoryListing"', "vehicle-card"),
    "hemmings": ("/classifieds/dealer/", "/classifieds/private/", "listing-card", "ad-tile"),
    "carsandbids": ("/auctions/", "auction-item", "auctions-list", "__NEXT_DATA__"),
}
SHELL_BYTES = 8000
SMALL_PAGE_BYTES = 1000

# ---- fixed values: evaluation and parity ----
TOP_KS = (1, 3, 5, 10)
CONFUSION_LIMIT = 50
PER_MAKE_MIN_ROWS = 50
PER_MAKE_LIMIT = 3
COSINE_MEAN_MIN = 0.998
COSINE_MIN_MIN = 0.99
TOP1_IDENTITY_MIN = 0.95
TOP5_IDENTITY_MIN = 0.98
COSINE_EPSILON = 1e-12

# ---- fixed values: live detection ----
DETECTED_VEHICLES = ("car", "truck", "bus", "motorcycle")
DETECTION_MIN_CONFIDENCE = 0.15
SMOOTHING_WINDOW = 8
