"""Word lists, lookup tables and patterns whose contents decide results."""

# Legal suffixes of company names.
COMPANY_SUFFIXES = ("inc", "incorporated", "llc", "ltd", "limited", "pvt", "private", "llp", "plc", "corp", "corporation", "co", "company")

# Abbreviations spelt out when titles are compared.
TITLE_ABBREVIATIONS = {"sr": "senior", "jr": "junior"}

# Query parameters that do not identify a posting.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "gh_src", "lever-source")

# Location words that do not name a place.
GENERIC_LOCATION_TOKENS = ("india", "remote", "hybrid", "onsite", "office", "hq")

# Older names of cities.
LOCATION_ALIASES = {"bangalore": "bengaluru", "bombay": "mumbai", "gurgaon": "gurugram"}

# States and union territories.
STATES = (
    "andaman and nicobar islands", "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chandigarh", "chhattisgarh",
    "dadra and nagar haveli and daman and diu", "delhi", "goa", "gujarat", "haryana", "himachal pradesh", "jammu and kashmir",
    "jharkhand", "karnataka", "kerala", "ladakh", "lakshadweep", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram",
    "nagaland", "odisha", "orissa", "puducherry", "pondicherry", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana", "tripura",
    "uttar pradesh", "uttarakhand", "west bengal",
)

# Cities.
CITIES = (
    "agartala", "agra", "ahmedabad", "aizawl", "ajmer", "allahabad", "aligarh", "amritsar", "aurangabad", "bareilly", "belagavi",
    "bengaluru", "bhopal", "bhubaneswar", "bikaner", "calcutta", "chandigarh", "chennai", "coimbatore", "cochin", "cuttack", "dehradun",
    "dhanbad", "durgapur", "faridabad", "gandhinagar", "ghaziabad", "greater noida", "gurugram", "guwahati", "gwalior", "hubballi",
    "hyderabad", "imphal", "indore", "itanagar", "jabalpur", "jaipur", "jalandhar", "jammu", "jamshedpur", "jodhpur", "kanpur", "kochi",
    "kohima", "kolkata", "kota", "kozhikode", "lucknow", "ludhiana", "madurai", "mangaluru", "mangalore", "madras", "meerut", "mumbai",
    "mysuru", "mysore", "nagpur", "nashik", "navi mumbai", "new delhi", "noida", "panaji", "patna", "prayagraj", "pune", "raipur", "rajkot",
    "ranchi", "shimla", "shillong", "siliguri", "srinagar", "surat", "thiruvananthapuram", "trivandrum", "thane", "thanjavur",
    "tiruchirappalli", "udaipur", "vadodara", "varanasi", "vijayawada", "visakhapatnam", "warangal",
)

# Phrases that tie a remote role to India.
REMOTE_INDIA_PHRASES = (
    "india only", "only in india", "candidates in india", "candidate in india", "based in india", "located in india", "residing in india",
    "residents of india", "within india", "anywhere in india", "open to india", "must be in india", "working from india", "remote india",
    "remote, india", "remote - india",
)

# Phrases that rule India out.
INDIA_EXCLUSIONS = (
    "except india", "excluding india", "outside india", "outside of india", "not in india", "not available in india", "not open to india",
    "no candidates in india", "ineligible in india",
)

# Phrases that keep a role in the United States.
US_ONLY_PHRASES = ("us only", "usa only", "u.s. only", "u.s.a. only", "united states only", "us-only", "usa-only")

# Signs of remote work.
REMOTE_SIGNALS = (
    "remote", "worldwide", "work from anywhere", "work from home", "anywhere", "fully remote", "remote role", "remote position", "distributed",
)

# Other countries.
FOREIGN_COUNTRIES = (
    "united states of america", "united states", "united kingdom", "united arab emirates", "south africa", "south korea", "new zealand",
    "sri lanka", "hong kong", "saudi arabia", "usa", "u.s.a.", "u.s.", "uk", "england", "scotland", "wales", "canada", "australia", "germany",
    "france", "singapore", "netherlands", "ireland", "japan", "china", "uae", "dubai", "abu dhabi", "brazil", "mexico", "spain", "italy",
    "sweden", "norway", "denmark", "finland", "poland", "portugal", "switzerland", "austria", "belgium", "nigeria", "kenya", "indonesia",
    "philippines", "vietnam", "thailand", "malaysia", "korea", "taiwan", "israel", "romania", "ukraine", "turkey", "argentina", "chile",
    "colombia", "egypt", "qatar", "pakistan", "bangladesh", "nepal", "bhutan", "greece",
)

# Cities abroad.
FOREIGN_CITIES = (
    "san francisco", "new york", "los angeles", "seattle", "austin", "boston", "chicago", "denver", "atlanta", "dallas", "houston", "miami",
    "indianapolis", "london", "berlin", "munich", "paris", "amsterdam", "dublin", "toronto", "vancouver", "sydney", "melbourne", "singapore",
    "dubai", "tokyo", "athens", "heraklion",
)

# States of the United States.
US_STATES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho",
    "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota",
    "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina",
    "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas",
    "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming", "district of columbia",
)

# Three-letter and other country codes.
COUNTRY_CODES = {"IND": "IN", "USA": "US", "GBR": "GB", "UK": "GB"}

# Names of states by code.
STATE_CODES = {
    "ap": "Andhra Pradesh", "ar": "Arunachal Pradesh", "as": "Assam", "br": "Bihar", "cg": "Chhattisgarh", "ga": "Goa", "gj": "Gujarat",
    "hr": "Haryana", "hp": "Himachal Pradesh", "jh": "Jharkhand", "jk": "Jammu and Kashmir", "ka": "Karnataka", "kl": "Kerala",
    "la": "Ladakh", "mh": "Maharashtra", "ml": "Meghalaya", "mn": "Manipur", "mp": "Madhya Pradesh", "mz": "Mizoram", "nl": "Nagaland",
    "od": "Odisha", "or": "Odisha", "pb": "Punjab", "py": "Puducherry", "rj": "Rajasthan", "sk": "Sikkim", "tg": "Telangana",
    "tn": "Tamil Nadu", "tr": "Tripura", "ts": "Telangana", "uk": "Uttarakhand", "up": "Uttar Pradesh", "wb": "West Bengal", "dl": "Delhi",
    "ch": "Chandigarh",
}

# States by city.
CITY_STATES = {
    "ahmedabad": "Gujarat", "bangalore": "Karnataka", "bengaluru": "Karnataka", "bhopal": "Madhya Pradesh", "bhubaneswar": "Odisha",
    "chandigarh": "Chandigarh", "chennai": "Tamil Nadu", "coimbatore": "Tamil Nadu", "delhi": "Delhi", "faridabad": "Haryana",
    "ghaziabad": "Uttar Pradesh", "goa": "Goa", "gurugram": "Haryana", "gurgaon": "Haryana", "hyderabad": "Telangana",
    "indore": "Madhya Pradesh", "jaipur": "Rajasthan", "kochi": "Kerala", "kolkata": "West Bengal", "lucknow": "Uttar Pradesh",
    "mohali": "Punjab", "mumbai": "Maharashtra", "mysore": "Karnataka", "mysuru": "Karnataka", "nagpur": "Maharashtra",
    "nashik": "Maharashtra", "new delhi": "Delhi", "noida": "Uttar Pradesh", "pune": "Maharashtra", "surat": "Gujarat",
    "thiruvananthapuram": "Kerala", "trivandrum": "Kerala", "vadodara": "Gujarat", "visakhapatnam": "Andhra Pradesh",
}

# Employment words and the types they stand for.
EMPLOYMENT = {
    "fulltime": "full_time", "permanent": "full_time", "parttime": "part_time", "contract": "contract", "contractor": "contract",
    "freelance": "contract", "intern": "internship", "internship": "internship", "temporary": "temporary", "temp": "temporary",
}
EMPLOYMENT_TYPES = ("full_time", "part_time", "contract", "internship", "temporary")
WORK_MODES = ("remote", "hybrid", "onsite")

# How an employment type may be written in a posting.
EMPLOYMENT_WRITTEN = {
    "full_time": ("full time", "full-time", "fulltime", "permanent"),
    "part_time": ("part time", "part-time", "parttime"),
    "contract": ("contract", "contractor", "freelance"),
    "internship": ("intern",),
    "temporary": ("temporary", "temp role", "temp position"),
}
ONSITE_WRITTEN = ("on-site", "onsite", "on site", "in-office", "in office")

# Patterns of amounts in rupees.
LPA_RANGE = r"(?i)(?:₹|rs\.?|inr)?\s*(\d+(?:\.\d+)?)\s*(?:-|–|to)\s*(?:₹|rs\.?|inr)?\s*(\d+(?:\.\d+)?)\s*(?:lpa|lacs?|lakhs?)(?:\s*(?:per|/)\s*(?:annum|year|pa|p\.a\.))?"
LPA_SINGLE = r"(?i)(?:₹|rs\.?|inr)?\s*(\d+(?:\.\d+)?)\s*(?:lpa|lacs?|lakhs?)(?:\s*(?:per|/)\s*(?:annum|year|pa|p\.a\.))?"
RUPEE_RANGE = r"(?i)(?:₹|rs\.?|inr)\s*([\d,]{4,})\s*(?:-|–|to)\s*(?:₹|rs\.?|inr)?\s*([\d,]{4,})(?:\s*(?:per|/)\s*(month|year|annum))?"
RUPEE_SINGLE = r"(?i)(?:₹|rs\.?|inr)\s*([\d,]{4,})(?:\s*(?:per|/)\s*(month|year|annum))?"

# Relevance labels, thresholds, versions and limits.
PUBLISHED = ("india", "remote_india")
TITLE_THRESHOLD, DESCRIPTION_THRESHOLD = 92.0, 88.0
EMPLOYER_SOURCES = ("greenhouse", "lever", "ashby", "workable")
AGGREGATORS = ("adzuna",)
SOURCE_TYPES = ("greenhouse", "lever", "ashby", "workable", "generic-jsonld")
STRUCTURE_VERSION = "v1"
DESCRIPTION_LIMIT = 14000
MISSES_TO_EXPIRE = 2
DEFAULT_INTERVAL, SLOW_INTERVAL = 360, 720
SLOW_TYPES = ("adzuna", "generic")
BATCH_ROWS = 40
