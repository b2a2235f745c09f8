"""Vocabularies, lookup tables, patterns and weights.

FIXED VALUES: everything in this file has to equal the published vocabulary of the
analysis for results to agree, so it is stated as plain text. Every operator that
uses one of these takes it as a parameter, the lists here are only the defaults.
"""

# ---------------------------------------------------------------- transport modes
MARITIME = ["port", "shipping", "ship", "vessel", "maritime", "harbour", "harbor", "canal", "strait", "freight", "container", "dock", "tanker"]
AVIATION = ["airport", "airspace", "aircraft", "aviation", "airline", "flight", "runway", "airfreight", "drone", "missile", "no-fly"]
SURFACE = ["airport", "airspace", "aircraft", "aviation", "airline", "flight", "runway", "airfreight", "truck", "road", "bridge", "rail", "railway", "border", "customs"]
LITERAL_TRANSPORT = list(dict.fromkeys(MARITIME + SURFACE))

# ---------------------------------------------------------------- event language
DISRUPTION = ["strike", "closure", "close", "closed", "blocked", "delay", "delayed", "disruption", "disrupted", "shortage", "sanction", "attack", "attacks", "war", "conflict", "flood", "earthquake", "wildfire", "storm", "cyclone", "outage", "blackout", "protest", "halt", "halted", "halting", "suspended", "damaged", "rerouted", "cancelled", "canceled"]
CRITICAL = ["war", "attack", "attacks", "missile", "close", "closed", "closure", "blocked", "earthquake", "cyclone", "sanction", "outage", "halted", "halting", "suspended", "damaged"]
CONSEQUENCE = [
    "closure", "close", "closes", "closed", "blocked", "delay", "delayed", "disruption", "disrupted", "shortage",
    "suspension", "suspended", "cancelled", "canceled", "cancellation", "reroute", "rerouted",
    "rerouting", "diverted", "diversion", "congestion", "backlog", "damage", "damaged", "outage",
    "blackout", "grounded", "halted", "stopped", "shutdown", "strike", "sanction", "restricted",
    "restriction", "embargo", "seized",
]
ARMED_THREAT = ["war", "attack", "attacks", "missile", "drone", "conflict", "hostilities", "houthi", "seized"]
NATURAL_HAZARD = [
    "earthquake", "aftershock", "tsunami", "flood", "flooding", "wildfire", "bushfire",
    "cyclone", "hurricane", "typhoon", "storm", "volcano", "volcanic", "eruption",
    "drought", "landslide", "mudslide",
]
HAZARD_EXPOSURE = [
    "road", "bridge", "rail", "port", "airport", "terminal", "warehouse", "factory",
    "plant", "supplier", "cargo", "logistics", "power", "electricity", "utility", "telecoms",
]
TRADE_EXPOSURE = [
    "trade", "import", "imports", "export", "exports", "customs", "tariff", "tariffs",
    "embargo", "sanction", "sanctions", "border", "aid", "supplies", "fuel", "commodity",
    "commodities", "production", "supplier", "suppliers", "inventory",
]
UTILITY_EXPOSURE = ["power", "electricity", "grid", "transmission", "pipeline", "refinery", "utility", "utilities"]

ASSET = [
    "port", "harbour", "harbor", "airport", "airspace", "terminal", "runway", "canal",
    "strait", "border", "crossing", "bridge", "road", "railway", "rail", "warehouse",
    "factory", "plant", "refinery", "pipeline", "power", "grid", "customs", "depot",
]
RESOLUTION = ["reopened", "reopens", "resumed", "resumes", "restored", "resolved", "recovery", "cleared"]
ACTIVE_STATUS = ["ongoing", "continues", "continuing", "current", "active", "until", "indefinite", "indefinitely"]
DEVELOPING_STATUS = ["warning", "threat", "threatens", "risk", "expected", "forecast", "possible"]

# ---------------------------------------------------------------- figurative / indirect wording (regular expressions)
METAPHOR_PATTERNS = [
    r"\bwar on [‘'\"]?(?:drip pricing|prices?|pricing|poverty|drugs?|waste|inflation|disease|crime)\b",
    r"\bfinancial closure\b",
    r"\btsunami of (?:emigration|migration|applications|criticism|debt)\b",
    r"\bflood of (?:applications|messages|complaints|people|money)\b",
]
STATEMENT_PATTERNS = [r"\b(?:condemns?|comments?|discusses?|urges?|calls for|backs?|supports?)\b"]
SUPPORT_PATTERNS = [
    r"\b(?:fight|fighting|campaign|programme|program|plan|response) against\b",
    r"\b(?:backs?|supports?|funds?|assists?|helps?)\b.{0,45}\b(?:fight|response|recovery|resilience)\b",
]
ACTIVE_HAZARD_PATTERNS = [
    r"\b(?:strikes?|hits?|damages?|disrupts?|closes?|blocks?|destroys?|forces?|threatens?)\b",
    r"\b(?:warning|alert|high risk|severe|major|widespread|ongoing)\b",
]
NAMED_ASSET_PATTERN = r"\b(?:[A-Z][\w'’-]+\s+){1,4}(?:Port|Harbou?r|Airport|Terminal|Canal|Strait|Bridge|Refinery|Pipeline|Railway)\b"
METAPHORICAL_HAZARDS = ["economic tsunami", "political earthquake", "electoral earthquake", "storm of criticism"]
DECISION_HAZARDS = ["earthquake", "tsunami", "flood", "wildfire", "cyclone", "hurricane", "typhoon", "volcano", "eruption", "drought", "landslide"]

# ---------------------------------------------------------------- gazetteers
ASSET_COUNTRY = {
    "ben gurion airport": "Israel", "heathrow airport": "United Kingdom",
    "port of rotterdam": "Netherlands", "lagos port complex": "Nigeria",
    "apapa port": "Nigeria", "suez canal": "Egypt", "gridco": "Ghana",
}
FOREIGN_PLACE_COUNTRY = {
    "kyiv": "Ukraine", "ukraine": "Ukraine", "kurdistan": "Iraq",
    "gaza": "Palestine", "taiwan": "Taiwan", "maine": "United States",
    "iran": "Iran", "somalia": "Somalia", "somali": "Somalia",
}
STRATEGIC_ROUTES = [
    "bab el-mandeb", "bab-el-mandeb", "red sea", "suez", "hormuz", "persian gulf", "gulf of aden",
    "black sea", "malacca", "panama canal", "english channel", "bosporus", "bosphorus",
]
AMBIGUOUS_BRANDS = {"Poland": "poland spring"}
COUNTRY_ALIASES = {
    "United Kingdom": ["United Kingdom", "Britain", "British", "England", "Scotland", "Wales", "Northern Ireland", "UK", "U.K."],
    "United States": ["United States", "United States of America", "America", "USA", "U.S.A.", "US", "U.S."],
    "United States of America": ["United States", "United States of America", "America", "USA", "U.S.A.", "US", "U.S."],
    "Netherlands": ["Netherlands", "The Netherlands", "Holland", "Dutch"],
    "United Arab Emirates": ["United Arab Emirates", "Emirati", "UAE", "U.A.E."],
    "Iran": ["Iran", "Iranian"],
    "Russia": ["Russia", "Russian Federation", "Russian"],
    "Democratic Republic of the Congo": ["Democratic Republic of the Congo", "DR Congo", "DRC", "Congolese"],
    "Congo": ["Congo", "Republic of the Congo", "Congo-Brazzaville"],
    "Côte d'Ivoire": ["Côte d'Ivoire", "Cote d'Ivoire", "Ivory Coast", "Ivorian"],
    "Czechia": ["Czechia", "Czech Republic"],
    "Türkiye": ["Türkiye", "Turkiye", "Turkey"],
    "Myanmar": ["Myanmar", "Burma"],
    "Eswatini": ["Eswatini", "Swaziland"],
    "Cabo Verde": ["Cabo Verde", "Cape Verde"],
    "Timor-Leste": ["Timor-Leste", "East Timor"],
    "North Macedonia": ["North Macedonia", "Republic of North Macedonia"],
    "Vietnam": ["Vietnam", "Viet Nam"],
    "Laos": ["Laos", "Lao PDR", "Lao People's Democratic Republic"],
    "South Korea": ["South Korea", "Republic of Korea", "ROK", "R.O.K."],
    "North Korea": ["North Korea", "DPRK", "D.P.R.K.", "Democratic People's Republic of Korea"],
    "Taiwan": ["Taiwan", "Chinese Taipei"],
    "Moldova": ["Moldova", "Republic of Moldova"],
    "Tanzania": ["Tanzania", "United Republic of Tanzania"],
    "Bolivia": ["Bolivia", "Plurinational State of Bolivia"],
    "Venezuela": ["Venezuela", "Bolivarian Republic of Venezuela"],
    "Brunei": ["Brunei", "Brunei Darussalam"],
    "Syria": ["Syria", "Syrian Arab Republic"],
    "Palestine": ["Palestine", "State of Palestine", "Palestinian territories"],
}
CASE_SENSITIVE_ALIASES = ["Turkey", "Congo"]

# ---------------------------------------------------------------- tone
POSITIVE_TONE = ["reopens", "reopened", "resume", "resumes", "recovery", "restored", "agreement", "deal", "growth", "improves", "improved", "boost", "expands", "investment", "surplus", "eases"]
NEGATIVE_TONE = DISRUPTION + ["crisis", "risk", "threat", "fatalities", "killed", "loss", "decline", "collapse", "escalates", "impasse", "volatile", "warning"]
SENTIMENT_POSITIVE = {
    "agreement": 2, "boost": 2, "expansion": 2, "growth": 2, "improved": 2,
    "investment": 2, "recovery": 3, "reopened": 3, "restored": 3, "resumed": 2,
    "stable": 1, "surplus": 2, "upgrade": 2,
}
SENTIMENT_NEGATIVE = {
    "attack": 3, "attacks": 3, "blackout": 3, "blocked": 3, "cancelled": 2,
    "closure": 3, "collapse": 3, "conflict": 3, "crisis": 3, "damage": 2,
    "damaged": 3, "delay": 2, "delayed": 2, "disruption": 3, "drought": 2,
    "earthquake": 3, "fatalities": 4, "flood": 3, "halted": 3, "outage": 3,
    "risk": 1, "sanction": 2, "shortage": 3, "strike": 2, "threat": 2,
    "war": 4, "wildfire": 3,
}
NEGATIONS = ["no", "not", "never", "without", "avoids", "avoided", "prevented"]
SIGNAL_STOPWORDS = [
    "a", "an", "the", "and", "or", "in", "on", "at", "to", "for", "of", "from", "with", "by",
    "signal", "near", "general", "reports", "reported", "event", "alert", "country", "identified",
    "referenced", "mentions", "articles", "sources", "gdelt",
]

# ---------------------------------------------------------------- story keys and event anchors
STORY_STOPWORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "from", "with", "as", "at", "by", "after", "over", "says", "new", "latest"]
ROUTE_MARKERS = {
    "Suez Canal": ["suez"], "Panama Canal": ["panama canal"], "Red Sea": ["red sea"],
    "Strait of Hormuz": ["hormuz"], "Strait of Malacca": ["malacca"],
    "Black Sea": ["black sea"], "English Channel": ["english channel"],
    "Bosporus": ["bosporus", "bosphorus"], "Baltic Sea": ["baltic sea"],
}
MODE_MARKERS = {
    "Maritime": ["port", "shipping", "ship", "vessel", "canal", "strait", "tanker", "container", "harbour", "harbor"],
    "Aviation": ["airport", "airspace", "airline", "flight", "air cargo", "airfreight", "runway"],
    "Road": ["road", "motorway", "highway", "truck", "border crossing"],
    "Rail": ["rail", "railway", "train", "freight line"],
    "Energy": ["pipeline", "refinery", "oil field", "gas terminal", "power grid"],
}
OPERATIONAL_TERMS = [
    "closure", "closed", "blocked", "strike", "delay", "disruption", "shortage", "sanction",
    "attack", "war", "conflict", "flood", "earthquake", "wildfire", "storm", "outage", "protest",
    "evacuation", "embargo", "congestion", "diversion",
]
EVENT_ACTORS = ["houthi", "houthis", "iran", "israel", "russia", "ukraine", "hezbollah", "hamas"]
EVENT_ACTIONS = ["attack", "attacks", "attacked", "strike", "strikes", "struck", "closure", "closed", "blockade", "blocked", "collision", "fire", "explosion", "seized"]
EVENT_TARGETS = ["ship", "shipping", "vessel", "tanker", "port", "airport", "airspace", "flight", "cargo", "freight"]
EVENT_ROUTES = ["mandeb", "hormuz", "suez", "red", "gulf", "aden", "black", "malacca", "panama"]
EVENT_EQUIVALENTS = {
    "attacks": "attack", "attacked": "attack", "strikes": "strike", "struck": "strike",
    "shipping": "ship", "vessels": "vessel", "flights": "flight",
}
GENERIC_EVENT_WORDS = STORY_STOPWORDS + [
    "libya", "country", "security", "energy", "operations", "infrastructure", "crisis",
    "risk", "risks", "threat", "threaten", "deepens", "worsening", "faces", "means",
]
THREAT_TERMS = ["drone", "missile", "earthquake", "flood", "wildfire", "cyclone", "explosion", "fire", "strike", "attack", "closure", "outage", "protest"]
ENTITY_PATTERN = r"\b(?:[A-Z][\w’-]+(?:\s+|$)){1,4}"
PUBLISHER_SUFFIX = r"\s+[\-–—]\s+[^\-–—]{2,80}$"

# ---------------------------------------------------------------- headline synthesis
LEAD_IN_PATTERN = r"(?i)^(?:live\s+updates?|latest\s+(?:news|updates?)|breaking(?:\s+news)?)\s*[:\-–—]\s*"
ACTOR_LABELS = {
    "houthis": "Houthi forces", "houthi": "Houthi forces", "iran": "Iran",
    "israel": "Israel", "russia": "Russia", "ukraine": "Ukraine",
    "hezbollah": "Hezbollah", "hamas": "Hamas",
}
SYNTHESIS_ROUTES = {
    "bab el-mandeb": ["bab el-mandeb", "bab al-mandab", "bab el mandeb"],
    "Strait of Hormuz": ["hormuz"], "Red Sea": ["red sea"], "Suez Canal": ["suez"],
    "Gulf of Aden": ["gulf of aden"], "Black Sea": ["black sea"],
}
ASSET_LABELS = {
    "container terminal operations": ["container terminal", "container operations"],
    "commercial vessel": ["commercial vessel", "merchant vessel", "cargo ship"],
    "oil tanker": ["oil tanker", "crude tanker", "fuel tanker"],
    "container ship": ["container ship"],
    "airport cargo operations": ["airport cargo", "air cargo", "airport freight"],
    "port operations": ["port operations", "port closure", "port closed", "port"],
    "commercial shipping": ["shipping", "ship", "vessel"],
    "airspace and flight operations": ["airspace", "flight", "airline"],
    "road-freight operations": ["cargo convoy", "freight truck", "trucking", "highway", "road freight"],
    "rail-freight operations": ["freight train", "rail freight", "railway", "rail line"],
    "border and customs operations": ["border crossing", "customs", "land border"],
    "warehouse and distribution operations": ["warehouse", "distribution centre", "distribution center"],
    "energy-supply infrastructure": ["pipeline", "refinery", "fuel terminal", "power grid"],
    "freight operations": ["cargo", "freight"],
}
# (markers, template); {actor} is the actor label with a trailing blank or nothing
EVENT_TEMPLATES = [
    (["missile attack", "missile strike"], "{actor}missile attack targets {asset}"),
    (["drone attack", "drone strike"], "{actor}drone attack targets {asset}"),
    (["walkout", "industrial action", "workers strike", "worker strike"], "Industrial action disrupts {asset}"),
    (["attack", "attacked", "strike", "struck"], "{actor}attack targets {asset}"),
    (["closure", "closed", "shutdown", "shut down"], "Closure of {asset} disrupts transport activity"),
    (["blockade", "blocked"], "Blockage disrupts {asset}"),
    (["collision"], "Collision disrupts {asset}"),
    (["seized", "seizure"], "Seizure interrupts {asset}"),
]
CONSEQUENCE_PHRASES = [
    (["killed", "fatalities", "dead", "deaths"], "fatalities reported"),
    (["reroute", "rerouting", "divert", "diversion"], "route diversions"),
    (["delay", "delays", "delayed", "congestion", "backlog"], "cargo delays"),
    (["suspend", "suspended", "cancelled", "canceled", "halt", "halted"], "services suspended"),
    (["damage", "damaged", "fire", "explosion"], "physical damage reported"),
]

# ---------------------------------------------------------------- general-news taxonomy
TAXONOMY = {
    "Politics and governance": [
        "election", "government", "minister", "president", "parliament", "policy", "law",
        "regulation", "diplomatic", "diplomacy", "sanction", "cabinet", "vote", "court",
    ],
    "Economy and finance": [
        "economy", "economic", "inflation", "interest", "rate", "bank", "banking", "finance",
        "financial", "market", "stocks", "currency", "investment", "recession", "gdp", "budget",
    ],
    "Trade and supply chains": [
        "trade", "tariff", "customs", "import", "export", "supplier", "supply", "chain",
        "logistics", "freight", "cargo", "warehouse", "inventory", "shipment", "shipping",
    ],
    "Transport and infrastructure": [
        "port", "airport", "rail", "railway", "road", "bridge", "transport", "transit",
        "aviation", "airline", "flight", "vessel", "ship", "terminal", "infrastructure",
    ],
    "Energy and commodities": [
        "energy", "oil", "gas", "lng", "power", "electricity", "fuel", "petrol", "diesel",
        "commodity", "commodities", "mining", "copper", "grain", "wheat", "pipeline",
    ],
    "Environment and climate": [
        "climate", "environment", "environmental", "emission", "pollution", "renewable",
        "carbon", "biodiversity", "conservation", "drought", "water", "weather",
    ],
    "Natural disasters": [
        "earthquake", "tsunami", "flood", "flooding", "wildfire", "cyclone", "hurricane",
        "typhoon", "volcano", "eruption", "landslide", "storm", "disaster", "aftershock",
    ],
    "Technology and cyber": [
        "technology", "digital", "software", "semiconductor", "chip", "cyber", "cyberattack",
        "ransomware", "artificial", "intelligence", "ai", "data", "telecom", "satellite",
    ],
    "Conflict and security": [
        "war", "conflict", "attack", "missile", "drone", "military", "defence", "defense",
        "security", "terrorism", "ceasefire", "armed", "troops", "weapon", "hostilities",
    ],
    "Health": [
        "health", "hospital", "disease", "virus", "outbreak", "pandemic", "medicine",
        "medical", "vaccine", "pharmaceutical", "patient", "public-health",
    ],
    "Society and labour": [
        "strike", "worker", "workers", "labour", "labor", "employment", "unemployment",
        "wage", "protest", "education", "migration", "housing", "community", "inequality",
    ],
}
TAXONOMY_PHRASES = {
    "Politics and governance": ["prime minister", "foreign policy", "general election"],
    "Economy and finance": ["central bank", "interest rate", "stock market", "cost of living"],
    "Trade and supply chains": ["supply chain", "trade route", "customs clearance"],
    "Transport and infrastructure": ["air traffic", "public transport", "port authority"],
    "Energy and commodities": ["natural gas", "crude oil", "power grid"],
    "Environment and climate": ["climate change", "green energy"],
    "Natural disasters": ["natural disaster", "extreme weather"],
    "Technology and cyber": ["artificial intelligence", "data centre", "data center"],
    "Conflict and security": ["armed conflict", "national security"],
    "Health": ["public health", "health care", "healthcare system"],
    "Society and labour": ["industrial action", "labour union", "labor union"],
}
TAXONOMY_FALLBACK = "General affairs"

# ---------------------------------------------------------------- hazards
HAZARD_MARKERS = {
    "earthquake": ["earthquake", "seismic", "tremor", "aftershock"], "tsunami": ["tsunami"],
    "flood": ["flood", "flooding"], "wildfire": ["wildfire", "forest fire", "bushfire"],
    "cyclone": ["cyclone", "hurricane", "typhoon", "tropical storm"],
    "volcano": ["volcano", "volcanic", "eruption"], "drought": ["drought"],
    "landslide": ["landslide", "mudslide"],
}
HAZARD_LABELS = {"EQ": "Earthquake", "TC": "Tropical cyclone", "FL": "Flood", "VO": "Volcano", "DR": "Drought", "WF": "Wildfire"}
HAZARD_CODES = {"Earthquake": "EQ", "Tropical cyclone": "TC", "Flood": "FL", "Volcano": "VO", "Drought": "DR", "Wildfire": "WF"}
ALERT_SCORES = {"green": 0.6, "orange": 1.8, "red": 3.0}
SEVERITY_ALERTS = {"Critical": "red", "High": "orange", "Watch": "green"}
SEVERITY_SCORES = {"Critical": 85, "High": 62, "Watch": 34}
CONFLICT_ROOTS = {"12": "Rejection", "13": "Threat", "14": "Protest", "15": "Force posture", "16": "Reduced relations", "17": "Coercion", "18": "Assault", "19": "Armed conflict", "20": "Mass violence"}
OFFICIAL_DETECTORS = ["USGS", "GDACS"]

# ---------------------------------------------------------------- publishers
WIRE_FAMILIES = {
    "reuters": "reuters", "associated press": "associated-press", "ap news": "associated-press",
    "agence france-presse": "afp", "afp": "afp", "bloomberg": "bloomberg",
}
PUBLISHER_COUNTRY = {
    "reuters": "United Kingdom", "associated press": "United States", "ap news": "United States",
    "bbc": "United Kingdom", "the guardian": "United Kingdom", "financial times": "United Kingdom",
    "sky news": "United Kingdom", "the telegraph": "United Kingdom", "cnn": "United States",
    "fox news": "United States", "new york times": "United States", "washington post": "United States",
    "bloomberg": "United States", "cnbc": "United States", "nbc news": "United States",
    "abc news": "United States", "cbs news": "United States", "al jazeera": "Qatar",
    "france 24": "France", "afp": "France", "le monde": "France", "deutsche welle": "Germany",
    "der spiegel": "Germany", "euronews": "France", "xinhua": "China", "china daily": "China",
    "cgtn": "China", "times of india": "India", "the hindu": "India", "ndtv": "India",
    "japan times": "Japan", "nhk": "Japan", "tass": "Russia", "kyiv independent": "Ukraine",
    "ukrinform": "Ukraine", "haaretz": "Israel", "times of israel": "Israel",
    "tehran times": "Iran", "irna": "Iran", "daily maverick": "South Africa",
    "news24": "South Africa", "vanguard": "Nigeria", "premium times": "Nigeria",
}
GENERIC_DOMAINS = ["ai", "co", "fm", "io", "me", "tv", "ws"]
PRIMARY_SOURCE_TYPES = ["Port authority", "Carrier advisory", "Maritime authority", "Aviation authority", "Government notice"]
CATEGORIES = ["Conflicts and war", "Politics and governance", "Economy and markets", "Environment and hazards", "Infrastructure and supply chains"]

# ---------------------------------------------------------------- transport monitor
COMMERCIAL_VESSEL_TYPES = ["cargo", "tanker", "passenger", "container", "bulk carrier", "vehicle carrier", "chemical tanker", "lng tanker", "lpg tanker", "ro-ro", "ferry"]
CARGO_PREFIXES = {
    "ABW": "AirBridgeCargo", "AHK": "Air Hong Kong", "ATN": "Air Transport International",
    "BOX": "AeroLogic", "CAO": "Air China Cargo", "CLX": "Cargolux",
    "CKS": "Kalitta Air", "FDX": "FedEx Express", "GTI": "Atlas Air",
    "LCF": "Boeing Dreamlifter", "LCO": "LATAM Cargo",
    "MNB": "MNG Airlines Cargo", "NCR": "National Airlines Cargo", "PAC": "Polar Air Cargo",
    "SOO": "Southern Air", "SRR": "Star Air",
    "SQC": "Singapore Airlines Cargo", "TPA": "Transcarga", "UPS": "UPS Airlines",
}
CARGO_MARKERS = ["cargo", "freight", "express", "logistics", "air transport international", "atlas air", "cargolux", "kalitta", "polar air", "aerologic"]
AIS_TYPES = {
    30: "Fishing", 31: "Towing", 32: "Towing", 33: "Dredging or underwater operations",
    34: "Diving operations", 35: "Military operations", 36: "Sailing", 37: "Pleasure craft",
    50: "Pilot vessel", 51: "Search and rescue", 52: "Tug", 53: "Port tender",
    55: "Law enforcement", 58: "Medical transport", 59: "Non-combatant ship",
}
MONITORING_ZONES = [  # south, west, north, east
    (-5, 95, 10, 110), (20, 50, 32, 62), (10, 38, 18, 48), (28, 30, 33, 34), (7, -82, 11, -77),
    (20, 116, 27, 124), (49, -6, 52, 3), (35, 25, 43, 31), (-37, 15, -31, 22), (32, -121, 35, -117),
]
ROUTE_COUNTRY_ALIASES = {
    "united states of america": "united states", "russian federation": "russia",
    "viet nam": "vietnam", "iran, islamic republic of": "iran",
}

# ---------------------------------------------------------------- semantic model and ranking
SEED_GROUPS = {
    "disruption": ["closure", "delay", "blocked", "shortage", "shutdown", "damage", "rerouting", "outage"],
    "severity": ["war", "attack", "explosion", "earthquake", "cyclone", "fatalities", "emergency"],
    "transport": ["shipping", "port", "cargo", "freight", "airport", "airspace", "rail", "logistics"],
}
RANKING_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is",
    "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with",
    "latest", "news", "reported", "reports", "update",
]
EXPOSURE_WEIGHTS = {
    "supplier_concentration": .25, "goods_value": .20, "route_dependency": .20,
    "inventory_vulnerability": .15, "customer_exposure": .10, "substitution_difficulty": .10,
}

# ---------------------------------------------------------------- fixed wording of results
EFFECT_MARITIME = "possible port, ocean-freight, routing or lead-time disruption"
EFFECT_AVIATION = "possible air-cargo, airport, airspace or urgent-freight disruption"
EFFECT_SANCTION = "supplier, payment, customs or trade-compliance exposure"
EFFECT_HAZARD = "possible facility, utility and inland-transport interruption"
EFFECT_SECURITY = "possible workforce, security and cross-border movement constraints"
EFFECT_NONE = "monitor for indirect supplier, inventory and transport effects"
EFFECT_HAZARD_TERMS = ["earthquake", "flood", "storm", "cyclone", "wildfire"]
EFFECT_SECURITY_TERMS = ["war", "conflict", "attack", "protest", "strike"]
REASON_COUNTRY = "selected country or a controlled alias is explicitly identified"
REASON_ASSET = "country inferred from recognised infrastructure: "
REASON_OPERATIONAL = "an operational threat or consequence is described"
REASON_TRANSPORT = "transport or logistics exposure is identified"
REASON_BROADER = "trade, utility or humanitarian-logistics exposure is identified"
REASON_PRIMARY = "reported by a primary operational source"
REASON_NONE = "no direct operational connection identified"
ACTION_CRITICAL = "Escalate immediately: contact affected suppliers and logistics partners, verify routes and lead times, and activate contingency options."
ACTION_MODERATE = "Review exposure today: confirm supplier status, transport bookings, buffer stock and alternative routing options."
ACTION_LOW = "Monitor the issue and confirm whether the named locations, suppliers or transport routes intersect with current operations."
ALERT_ACTION_CRITICAL = "Escalate now: contact affected suppliers and logistics partners, verify routes and lead times, and activate the relevant contingency plan."
ALERT_ACTION_ELEVATED = "Review exposure today: validate supplier status, transport bookings, buffer stock and alternative routing options."
ALERT_ACTION_WATCH = "Monitor closely: confirm whether named locations, suppliers or routes intersect with current operations."
