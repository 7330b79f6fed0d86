"""Default rule pack: food-quality roles in Australia.

Everything here is data. The compilers in ``postlens.functions.rules`` turn it into
column expressions; swapping this module for another retargets the whole engine.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Vocabularies, patterns, point tables and texts that results depend on.
# ---------------------------------------------------------------------------

SOURCE_PREFERENCE = ["official_ats", "linkedin", "seek", "indeed", "jora"]
AGGREGATORS = ["seek", "jora", "linkedin", "indeed"]

COMPANY_STOP_TOKENS = [
    "pty", "ltd", "limited", "inc", "co", "group", "holdings", "australia", "australian", "aust",
    "anz", "oceania", "pacific", "nz", "the",
]

TITLE_NOISE_TOKENS = [
    "full", "time", "part", "casual", "permanent", "ongoing", "contract", "fixed", "term", "temp",
    "temporary", "month", "months", "day", "night", "afternoon", "morning", "weekend", "shift",
    "ref", "fte", "snr",
]

UNDISCLOSED_SALARY = [
    r"\bcompetitive\b", r"\bnegotiable\b", r"\bnot\s+disclosed\b", r"\bundisclosed\b", r"\btbc\b",
    r"\btba\b", r"\bdoe\b", r"\bdepends?\s+on\s+experience\b", r"\battractive\s+package\b",
    r"\bmarket\s+rate\b",
]
SALARY_FIGURE = r"\$?\s*(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*([kK])?"
PERIOD_HOUR = [r"\bp\.?h\.?\b", r"\bper\s*hour\b", r"\bhour\b", r"\bhourly\b", r"\b/\s*hr\b", r"\b/\s*hour\b"]
PERIOD_DAY = [r"\bper\s*day\b", r"\bdaily\b", r"\b/\s*day\b", r"\bday\s*rate\b"]
CURRENCY = "AUD"

# Seniority: strict first match. A clause holds when every word of "all" is a token of the
# title, each list of "any" has a token in it, no word of "none" is a token and "phrase"
# occurs as a substring. Several clauses under a label are alternatives.
SENIORITY_RULES = [
    ("national_group_head", [
        {"all": ["quality"], "any": [["national", "group"]]},
        {"phrase": "head of quality"},
    ]),
    ("site_quality_manager", [{"all": ["site", "quality", "manager"], "none": ["technical"]}]),
    ("senior_quality_manager", [
        {"all": ["senior", "quality"], "any": [["food", "safety", "supplier", "specialist"]],
         "none": ["manager", "officer", "coordinator"], "flag": "promote_senior_specialist"},
        {"all": ["senior", "quality", "manager"]},
    ]),
    ("food_safety_quality_manager", [{"all": ["food", "safety", "quality", "manager"]}]),
    ("supplier_quality_manager", [
        {"all": ["manager"], "any": [["supplier", "vendor"], ["quality", "assurance"]]},
    ]),
    ("regulatory_affairs_manager_food", [
        {"all": ["regulatory", "manager"], "any": [["affairs", "compliance"]]},
    ]),
    ("site_technical_manager", [{"all": ["technical", "manager"]}, {"phrase": "site technical"}]),
    ("qa_manager", [
        {"all": ["manager"], "any": [["qa", "quality"]]},
        {"all": ["manager"], "phrase": "quality assurance"},
    ]),
    ("senior_specialist_quality_lead", [
        {"all": ["senior", "specialist"]},
        {"phrase": "quality lead"},
        {"phrase": "quality systems lead"},
    ]),
    ("qa_officer_coordinator", [{"any": [["qa", "quality"], ["officer", "coordinator"]]}]),
]

SENIORITY_POINTS = {
    "national_group_head": 30,
    "site_quality_manager": 28,
    "senior_quality_manager": 25,
    "food_safety_quality_manager": 25,
    "supplier_quality_manager": 22,
    "regulatory_affairs_manager_food": 20,
    "site_technical_manager": 20,
    "qa_manager": 15,
    "senior_specialist_quality_lead": 10,
    "qa_officer_coordinator": 3,
    "other": 0,
}

QUALITY_TITLE = [
    r"\bquality\b", r"\bqa\b", r"q\.a", r"quality assurance", r"quality control", r"\bqc\b",
    r"food safety", r"\bhaccp\b", r"\bbrcgs\b", r"\bbrc\b", r"\bsqf\b", r"\bfssc\b", r"\bgmp\b",
    r"food technolog", r"quality systems", r"product integrity", r"technical manager",
    r"regulatory affairs", r"vendor assurance", r"supplier quality", r"quality and compliance",
    r"quality & compliance",
]
TITLE_EXCLUDE = [r"\btechnician\b"]

SIGNALS = {
    "multi_site_national": [
        r"multi[\s-]?site", r"\bnational\b", r"\bgroup[\s-]?wide\b",
        r"across (?:multiple|several|all) (?:sites|plants|facilities)",
        r"\b\d+\s+(?:sites|plants|factories|facilities)\b",
        r"network of (?:sites|plants|facilities)",
    ],
    "manages_quality_team": [
        r"manage[s]? (?:a|the)? ?(?:quality|qa) team", r"lead[s]? (?:a|the)? ?(?:quality|qa) team",
        r"(?:quality|qa) team", r"team of (?:quality|qa)", r"direct reports",
        r"manage[s]? (?:a team of|staff)", r"people management",
    ],
    "laboratory": [
        r"\blaborator(?:y|ies)\b", r"\blab\b", r"\bqfs\b", r"micro(?:biolog\w*)? testing",
        r"laboratory management", r"nata",
    ],
    "site_leadership": [
        r"site leadership", r"site lead", r"plant (?:manager|leadership|lead)",
        r"operations leadership", r"factory (?:manager|leadership)", r"leadership team",
        r"senior leadership",
    ],
    "supplier_vendor_assurance": [
        r"supplier (?:quality|assurance|approval|management|audit)",
        r"vendor (?:quality|assurance|approval|management|audit)",
        r"raw material (?:approval|quality)", r"supplier development",
        r"incoming (?:goods|materials) (?:inspection|quality)",
    ],
    "co_packer": [
        r"co[\s-]?pack\w*", r"contract manufactur\w*", r"3rd party manufactur\w*",
        r"third[\s-]?party manufactur\w*", r"toll manufactur\w*", r"external manufactur\w*",
    ],
    "customer_retailer_audit": [
        r"customer audit", r"retailer audit", r"second[\s-]?party audit", r"\baudit readiness\b",
        r"\baudits?\b", r"woolworths|coles|aldi|metcash", r"customer complaint",
    ],
    "food_safety_cert": [
        r"\bhaccp\b", r"\bgmp\b", r"fssc\s?22000", r"\bsqf\b", r"\bbrc(?:gs)?\b", r"\bgfsi\b",
        r"\bfsms\b", r"food safety (?:management|system|standard|cert\w*|program)?",
        r"\bfood safety\b", r"iso\s?22000",
    ],
    "regulatory_compliance": [
        r"regulatory (?:compliance|affairs|requirements)", r"\bcompliance\b", r"food standards",
        r"\blabel(?:l?ing)?\b", r"legislativ\w*", r"\bfsanz\b",
    ],
    "capa_nc_traceability": [
        r"\bcapa\b", r"corrective (?:and|&)? ?preventive action", r"non[\s-]?conformanc\w*",
        r"\bnc(?:r)?\b", r"traceab\w*", r"\brecall\b", r"risk (?:assessment|management|analysis)",
        r"root cause",
    ],
    "alert_quality_systems_ownership": [
        r"technical (?:leadership|lead|manager|director)",
        r"quality systems? (?:ownership|owner|lead|management)",
        r"own(?:s|ership of)? the quality (?:system|management system)",
        r"head of (?:technical|quality)", r"quality manager",
    ],
    "ex_software_qa": [
        r"software (?:qa|quality|test\w*)", r"\bsdet\b", r"test automation", r"automated test\w*",
        r"\bselenium\b", r"\bcypress\b", r"\bci/cd\b", r"qa engineer", r"test analyst",
        r"saas (?:platform|product)",
    ],
    "ex_construction": [
        r"\bconstruction\b", r"\bcivil\b", r"\bbuilding\b", r"\binfrastructure\b",
        r"\bengineering project\b", r"\bitp\b", r"\bcommissioning\b",
    ],
    "ex_ndis": [r"\bndis\b", r"disability (?:services|support)", r"support coordinat\w*"],
    "ex_health_aged_edu": [
        r"\baged care\b", r"\bhealthcare\b", r"\bhospital\b", r"\bclinical\b", r"\bnursing\b",
        r"\bpatient\b", r"\bschool\b", r"\buniversit\w*\b", r"\beducation\b", r"\bchildcare\b",
    ],
    "ex_call_centre": [
        r"call cent(?:re|er)", r"contact cent(?:re|er)",
        r"customer service (?:representative|agent)", r"\bbpo\b",
    ],
    "ex_lab_tech": [
        r"laboratory technician", r"lab technician", r"lab assistant", r"laboratory assistant",
        r"sample preparation",
    ],
    "ex_junior": [
        r"\bjunior\b", r"\bgraduate\b", r"\bentry[\s-]?level\b", r"\bintern(?:ship)?\b",
        r"\btrainee\b", r"\bcadet\b",
    ],
    "ex_operator": [
        r"machine operator", r"production operator", r"line operator", r"process worker",
        r"\bforklift\b", r"production worker",
    ],
    "ex_food_service_role": [
        r"\bchef\b", r"\bcook\b", r"\bbarista\b", r"\bwait(?:er|ress|staff)\b", r"kitchen hand",
        r"\bhospitality\b", r"front of house",
    ],
}

RESPONSIBILITY_POINTS = {
    "multi_site_national": 20,
    "manages_quality_team": 15,
    "laboratory": 10,
    "site_leadership": 15,
    "supplier_vendor_assurance": 15,
    "co_packer": 15,
    "customer_retailer_audit": 10,
    "food_safety_cert": 15,
    "regulatory_compliance": 10,
    "capa_nc_traceability": 10,
}
# Firing both of these counts the second one's points only once.
AUDIT_OVERLAP = ("supplier_vendor_assurance", "customer_retailer_audit")

OUT_OF_DOMAIN = [
    r"\bsoftware\b", r"\bsaas\b", r"\bsdet\b", r"test automation", r"\bconstruction\b", r"\bcivil\b",
    r"\bndis\b", r"disability (?:services|support)", r"\bhealthcare\b", r"\bhospital\b",
    r"\bclinical\b", r"\baged care\b", r"\bnursing\b", r"education quality", r"\bchildcare\b",
]
FOOD_SUBSECTOR = [
    r"\bdairy\b", r"\bmeat\b", r"\bpoultry\b", r"\bbaker\w*", r"\bbeverage\b", r"\bgrain\b",
    r"\bsnack\b", r"\bconfection\w*", r"\bbrew\w*", r"\bwiner\w*", r"\bseafood\b", r"\bsmallgoods\b",
]
FOOD_MANUFACTURING = [
    r"\bfood (?:manufactur\w*|production|processing|factory)\b", r"\bfmcg\b",
    r"\bfood manufactur\w*", r"\bfood (?:and|&) beverage\b", r"\bfood production\b",
]
FOOD_SECTOR = [r"\bfood\b", r"\bfmcg\b"]
RETAILER_SUPPLIER = [
    r"\bretail\w*", r"\bsupermarket\b", r"\bgrocer\w*", r"woolworths", r"coles", r"aldi", r"metcash",
    r"\bprivate label\b", r"own brand", r"supplier quality",
]
FOODSERVICE = [
    r"\bfoodservice\b", r"\bfood service\b", r"meal kit", r"central kitchen", r"\bcatering\b",
    r"\bqsr\b", r"\brestaurant\b",
]
PHARMA = [r"\bpharma\w*", r"\bmedical device\b", r"\bmeddevice\b", r"\bnutraceutical\b", r"\btga\b"]

# Ordered (label, subject, patterns); subject "sector" is the sector alone, "text" is
# sector plus title plus description.
INDUSTRY_RULES = [
    ("out_of_domain", "text", OUT_OF_DOMAIN),
    ("food_subsector", "text", FOOD_SUBSECTOR),
    ("retailer_supplier_quality", "sector", RETAILER_SUPPLIER),
    ("foodservice", "sector", FOODSERVICE),
    ("pharma_meddevice", "sector", PHARMA),
    ("food_manufacturing_fmcg", "sector", FOOD_MANUFACTURING + FOOD_SECTOR),
    ("food_manufacturing_fmcg", "text", FOOD_MANUFACTURING),
    ("retailer_supplier_quality", "text", RETAILER_SUPPLIER),
    ("foodservice", "text", FOODSERVICE),
    ("pharma_meddevice", "text", PHARMA),
]

INDUSTRY_POINTS = {
    "food_manufacturing_fmcg": 25,
    "food_subsector": 25,
    "retailer_supplier_quality": 22,
    "foodservice": 15,
    "pharma_meddevice": 5,
    "out_of_domain": -50,
    "unclear": 0,
}

TIER1_FOOD_GROUP = [
    r"\bnestl", r"\bpepsico\b", r"\bmars\b", r"mondelez", r"cadbury", r"kellanova", r"kellogg",
    r"\bbega\b", r"saputo", r"fonterra", r"lactalis", r"\blion\b", r"\basahi\b", r"coca[\s-]?cola",
    r"\bccep\b", r"amatil", r"suntory", r"\bjbs\b", r"\bteys\b", r"ingham", r"goodman fielder",
    r"george weston", r"tip[\s-]?top", r"arnott", r"graincorp", r"sunrice", r"cargill", r"\bkerry\b",
    r"hellofresh", r"treasury wine",
]
TIER1_RETAIL = [r"woolworths", r"\bcoles\b", r"\baldi\b", r"metcash", r"costco"]
RECRUITER_NAMES = [
    r"michael page", r"\bhays\b", r"six degrees", r"peoplefusion", r"blackbook", r"randstad",
    r"hudson", r"\bmpau\b", r"robert walters", r"robert half", r"adecco", r"\bhello recruitment\b",
    r"recruit\w*", r"\bagency\b", r"talent\b", r"staffing",
]
LARGE_GROUP_SECTOR = [
    r"food (?:manufactur\w*|group)", r"\bfmcg\b", r"multinational", r"global (?:food|fmcg)",
    r"large (?:food )?group",
]
LARGE_GROUP_TEXT = [r"large (?:food )?group", r"food group", r"multinational", r"global (?:food|fmcg)"]
LARGE_RETAIL = [r"\bretail\w*", r"supermarket", r"grocer\w*", r"major retailer"]
MID_MAKER_SECTOR = [r"\bfood\b", r"\bbeverage\b", r"\bmanufactur\w*"]
MID_MAKER_TEXT = [r"\bfood\b", r"\bbeverage\b", r"\bmanufactur\w*", r"\bfmcg\b"]

# Ordered like INDUSTRY_RULES; subject "name" is the employer name, "flag" the recruiter flag.
COMPANY_RULES = [
    ("large_food_group", "name", TIER1_FOOD_GROUP),
    ("large_retail_food", "name", TIER1_RETAIL),
    ("recruiter_anonymous_food", "name", RECRUITER_NAMES),
    ("large_food_group", "sector", LARGE_GROUP_SECTOR),
    ("large_retail_food", "sector", LARGE_RETAIL),
    ("mid_food_manufacturer", "sector", MID_MAKER_SECTOR),
    ("large_food_group", "text", LARGE_GROUP_TEXT),
    ("large_retail_food", "text", LARGE_RETAIL),
    ("recruiter_anonymous_food", "flag", None),
    ("mid_food_manufacturer", "text", MID_MAKER_TEXT),
]

COMPANY_POINTS = {
    "large_food_group": 15,
    "large_retail_food": 12,
    "mid_food_manufacturer": 8,
    "recruiter_anonymous_food": 5,
    "unclear": 0,
}
COMPANY_ANCHOR = "large_food_group"

# -- places ---------------------------------------------------------------
REMOTE_MARKERS = ["remote", "work from home", "work-from-home", "wfh", "anywhere", "hybrid"]
BUCKET_REMOTE_MARKERS = [
    "remote", "work from home", "work-from-home", "wfh", "anywhere", "australia wide",
    "australia-wide", "fully remote",
]
HOME_COUNTRY = [r"australia", r"australian", r"\baus\b"]
STATE_NAMES = [
    "new south wales", "victoria", "queensland", "western australia", "south australia", "tasmania",
    "northern territory", "australian capital territory",
]
STATE_CODES = [r"\bnsw\b", r"\bvic\b", r"\bqld\b", r"\bwa\b", r"\bsa\b", r"\btas\b", r"\bnt\b", r"\bact\b"]
HOME_STATE = [r"\bnsw\b", r"new south wales"]
SYDNEY_SUBURBS = [
    "sydney", "parramatta", "chatswood", "north sydney", "macquarie park", "north ryde",
    "ryde", "rhodes", "epping", "eastwood", "hornsby", "st leonards", "lane cove", "artarmon",
    "crows nest", "mascot", "alexandria", "rosebery", "waterloo", "surry hills", "redfern",
    "pyrmont", "ultimo", "homebush", "lidcombe", "auburn", "silverwater", "rydalmere", "granville",
    "merrylands", "smithfield", "wetherill park", "fairfield", "liverpool", "prestons", "moorebank",
    "ingleburn", "minto", "campbelltown", "penrith", "st marys", "blacktown", "seven hills",
    "eastern creek", "rooty hill", "mount druitt", "castle hill", "baulkham hills", "bella vista",
    "norwest", "kellyville", "rouse hill", "frenchs forest", "brookvale", "dee why", "bankstown",
    "padstow", "revesby", "kingsgrove", "rockdale", "kogarah", "hurstville", "miranda", "caringbah",
    "taren point", "marrickville", "leichhardt", "gladesville", "hunters hill", "wentworthville",
    "greystanes", "erskine park", "kemps creek", "marsden park", "smeaton grange", "gregory hills",
    "edmondson park", "chipping norton", "villawood", "chullora", "olympic park", "western sydney",
    "greater sydney", "northern beaches", "sutherland",
]
NSW_REGIONAL = [
    "newcastle", "wollongong", "gosford", "central coast", "wyong", "tuggerah", "maitland",
    "cessnock", "port macquarie", "coffs harbour", "tamworth", "orange", "bathurst", "dubbo",
    "wagga", "albury", "lismore", "ballina", "byron", "nowra", "goulburn", "queanbeyan", "griffith",
    "leeton", "armidale", "taree", "kempsey", "grafton", "broken hill", "mudgee", "parkes", "forbes",
    "moree", "narrabri", "gunnedah", "singleton", "muswellbrook", "scone", "raymond terrace",
    "nelson bay", "batemans bay", "ulladulla", "bega", "eden", "cooma", "regional nsw",
    "nsw regional",
]
OTHER_STATE_CITIES = [
    "melbourne", "brisbane", "perth", "adelaide", "canberra", "hobart", "darwin", "gold coast",
    "sunshine coast", "geelong", "ballarat", "bendigo", "toowoomba", "townsville", "cairns",
    "mackay", "rockhampton", "launceston", "bunbury", "tatura", "shepparton", "dandenong",
    "yatala", "carole park", "tingalpa", "moorabbin", "clayton", "mulgrave", "scoresby",
    "notting hill", "truganina", "derrimut", "laverton", "altona", "rowville", "keysborough",
    "braeside", "eagle farm", "acacia ridge", "richlands", "wacol", "hemmant", "murarrie",
    "rocklea", "darra", "kewdale", "canning vale", "welshpool", "malaga", "osborne park",
    "wingfield", "regency park", "edinburgh",
]
OTHER_STATE_MARKS = [
    r"\bvic\b", r"victoria", r"\bqld\b", r"queensland", r"\bwa\b", r"western australia", r"\bsa\b",
    r"south australia", r"\btas\b", r"tasmania", r"\bnt\b", r"northern territory", r"\bact\b",
    r"australian capital territory",
]
NON_LOCALITY = [
    "australia", "australian", "aus", "remote", "wfh", "anywhere", "hybrid", "various", "multiple",
    "location", "locations", "all", "work from home", "work[- ]from[- ]home", "nationwide",
    "flexible", "onsite", "on[- ]site", "aunz", "anz", "oceania",
]
LOCATION_POINTS = {
    "sydney_greater": 15,
    "nsw_regional": 10,
    "melbourne_brisbane": 8,
    "other_au": 5,
    "overseas": -20,
}
HOME_REGION = ["sydney_greater", "nsw_regional"]

# -- bands and weights ----------------------------------------------------
SALARY_BANDS = [(170000, 15), (150000, 12), (130000, 10), (110000, 5), (0, -10)]
SALARY_NEUTRAL_GAP = (100000, 110000)
TIER_BANDS = [(80, "A+"), (65, "A"), (50, "B"), (38, "C"), (0, "D")]
TIER_RANK = {"A+": 0, "A": 1, "B": 2, "C": 3, "D": 4}
WEIGHTS = {
    "seniority": 0.30,
    "semantic": 0.25,
    "industry": 0.20,
    "company": 0.15,
    "location_salary": 0.10,
}
SEMANTIC_CEILING = 0.8

ALERT_SENIORITY = [
    "national_group_head", "site_quality_manager", "senior_quality_manager",
    "food_safety_quality_manager",
]
REASONS = {
    "seniority": "High-fit seniority: ",
    "tier1": "Tier-1 target company",
    "region": "Located in Sydney / NSW (preferred region)",
    "salary": "Salary >= $130k",
    "multi_site": "Multi-site / national quality scope",
    "supplier": "Supplier / co-packer quality scope",
    "leadership": "Site leadership / quality systems ownership",
    "food_safety": "Food-safety certification scope (HACCP/FSSC/BRC/SQF)",
    "fresh": "Freshly posted (< 7 days)",
}
# (signals, categories, text): shown when any of the signals fired or the category is listed.
TIPS = [
    (["multi_site_national"], [], "Emphasize national quality scope across several sites"),
    (["supplier_vendor_assurance", "co_packer"], [],
     "Highlight co-packer and supplier quality work"),
    (["food_safety_cert"], [], "Lead with FSSC 22000, HACCP, audit readiness"),
    (["laboratory"], [], "Highlight laboratory management"),
    (["manages_quality_team", "site_leadership"], [],
     "Foreground team leadership and site-level QA ownership"),
    (["regulatory_compliance"], ["regulatory_affairs_manager_food"],
     "Surface regulatory/compliance and labelling experience"),
    (["capa_nc_traceability"], [],
     "Detail CAPA, non-conformance, traceability and recall readiness"),
]
DEFAULT_TIP = "Tailor the summary to senior food-quality leadership outcomes"
MAX_TIPS = 5

# -- presentation texts ---------------------------------------------------
UNDISCLOSED_LABEL = "Not disclosed / 未披露"
RECRUITER_LABEL = "🕵 Recruiter — employer undisclosed / 招聘中介 (雇主未披露)"
SECTIONS = [
    "优选公司 / Preferred Companies",
    "综合推荐 / NSW & Remote Picks",
    "其他地区 / Other Regions",
]
EMAIL_TOP_N = 10
HIDDEN_ADVERTISERS = ["private advertiser", "private advertisor"]

# -- company ratings ------------------------------------------------------
DEFAULT_STARS = 3
STAR_BOOST = 2.5
RATINGS = {
    "Nestle": 5, "PepsiCo": 5, "Mars": 5, "Mondelez": 5, "Cadbury": 5, "Kellanova": 5,
    "Kellogg's": 5, "Kerry Group": 5, "Cargill": 5, "ADM": 5,
    "Bega Group": 4, "Saputo": 4, "Goodman Fielder": 4, "George Weston Foods": 4, "Tip Top": 4,
    "The Arnott's Group": 4, "JBS Australia": 4, "Teys Australia": 4, "Ingham's": 4,
    "GrainCorp": 4, "Fonterra": 4, "Lactalis": 4, "SunRice": 4, "Primo Foods": 4,
    "Andrews Meat": 3, "Norco": 3, "Baiada": 3,
    "Coca-Cola Europacific Partners": 4, "Lion": 4, "Asahi Beverages": 4, "Suntory Oceania": 4,
    "Treasury Wine Estates": 4,
    "Woolworths Group": 4, "Coles Group": 4, "ALDI Australia": 4, "Metcash": 4,
    "Costco Australia": 3, "Harris Farm Markets": 3,
    "HelloFresh": 3, "Youfoodz": 3, "Marley Spoon": 3, "Compass Group": 3, "PFD Food Services": 3,
    "Bidfood": 3, "dnata Catering": 3, "Gate Gourmet": 3,
}

# -- companies: (company_id, name, sector, priority_tier, adapter, active) --
COMPANIES = [
    ("bega", "Bega Group", "Dairy / Food Manufacturing", "P1", "workday", True),
    ("saputo", "Saputo Dairy Australia", "Dairy", "P1", "workday", True),
    ("mondelez_au", "Mondelez Australia (Cadbury)", "Confectionery / Snacks / FMCG", "P1", "workday", True),
    ("pepsico_au", "PepsiCo Australia", "Snacks / Beverages / FMCG", "P1", "phenom", True),
    ("mars_au", "Mars Australia", "Confectionery / Petcare / Food", "P1", "phenom", True),
    ("kerry_au", "Kerry Group Australia", "Food ingredients / Taste & Nutrition", "P2", "phenom", True),
    ("lion", "Lion", "Beverages (beer / dairy)", "P1", "phenom", True),
    ("hellofresh_au", "HelloFresh Australia (incl. Youfoodz)", "Meal Kit / Food Manufacturing", "P1", "phenom", True),
    ("aldi_au", "ALDI Australia", "Retail / Grocery", "P2", "smartrecruiters", True),
    ("nestle_au", "Nestlé Australia", "FMCG / Food Manufacturing", "P1", "generic_html", False),
    ("nestle_linkedin", "Nestlé Australia — via LinkedIn", "FMCG / Food Manufacturing", "P1", "linkedin", True),
    ("nestle_seek", "Nestlé Australia — via SEEK", "FMCG / Food Manufacturing", "P1", "seek", True),
    ("kellanova", "Kellanova (Kellogg's) Australia", "Snacks / Cereal / FMCG", "P1", "successfactors", True),
    ("suntory_oceania", "Suntory Oceania", "Beverages", "P1", "successfactors", True),
    ("metcash", "Metcash", "Wholesale / Grocery Distribution", "P1", "successfactors", True),
    ("jbs_au", "JBS Australia (incl. Primo Foods)", "Meat", "P1", "successfactors", True),
    ("arnotts", "The Arnott's Group", "Snack / Bakery", "P1", "successfactors", True),
    ("graincorp", "GrainCorp", "Grain / Agribusiness", "P1", "successfactors", True),
    ("teys", "Teys Australia", "Meat", "P1", "successfactors", True),
    ("gwf", "George Weston Foods / Tip Top", "Bakery / Food Manufacturing", "P1", "generic_html", True),
    ("goodman_fielder", "Goodman Fielder", "Food Manufacturing / FMCG", "P1", "generic_html", True),
    ("inghams", "Ingham's", "Poultry / Food Manufacturing", "P1", "generic_html", True),
    ("norco", "Norco Co-operative", "Dairy", "P2", "generic_html", True),
    ("costco_au", "Costco Australia", "Retail / Warehouse", "P2", "generic_html", True),
    ("marley_spoon", "Marley Spoon", "Meal Kit / Food Manufacturing", "P2", "generic_html", True),
    ("woolworths", "Woolworths Group (incl. Primary Connect)", "Retail / Grocery / Supply Chain", "P1", "generic_html", True),
    ("coles", "Coles Group", "Retail / Private Label", "P2", "generic_html", True),
    ("compass_au", "Compass Group Australia", "Foodservice / Catering", "P2", "generic_html", True),
    ("pfd_foods", "PFD Food Services", "Foodservice Distribution", "P2", "generic_html", True),
    ("cargill", "Cargill", "Grain / Agribusiness", "P1", "generic_html", True),
    ("ccep", "Coca-Cola Europacific Partners", "Beverages", "P1", "generic_html", True),
    ("adm", "ADM (Archer Daniels Midland)", "Grain / Oilseed / Agribusiness", "P2", "generic_html", True),
    ("sunrice", "SunRice", "Grain / Rice / Food Manufacturing", "P1", "successfactors", False),
    ("treasury_wine", "Treasury Wine Estates", "Wine / Beverages", "P2", "generic_html", False),
    ("harris_farm", "Harris Farm Markets", "Retail / Grocery", "P3", "generic_html", False),
    ("dnata_catering", "dnata Catering Australia", "Inflight Catering / Food Manufacturing", "P2", "generic_html", False),
    ("fonterra", "Fonterra Australia", "Dairy", "P2", "generic_html", False),
    ("li_food_safety_quality", "LinkedIn — Food Safety & Quality Manager (Sydney)", "aggregator", "P1", "linkedin", True),
    ("li_senior_quality", "LinkedIn — Senior/Site/National Quality Manager (Australia)", "aggregator", "P1", "linkedin", True),
    ("li_supplier_quality", "LinkedIn — Supplier Quality / Vendor Assurance (Australia)", "aggregator", "P1", "linkedin", True),
    ("li_regulatory_food", "LinkedIn — Regulatory Affairs / Compliance Manager Food (Australia)", "aggregator", "P2", "linkedin", True),
    ("seek_senior_quality", "SEEK — Senior/Site/National Quality Manager (Sydney)", "aggregator", "P1", "seek", True),
    ("seek_qa_food_mfg", "SEEK — QA Manager Food Manufacturing (NSW)", "aggregator", "P1", "seek", True),
    ("seek_supplier_quality", "SEEK — Supplier Quality / Vendor Assurance (Australia)", "aggregator", "P1", "seek", True),
    ("seek_regulatory", "SEEK — Regulatory / Compliance Manager Food (Australia)", "aggregator", "P2", "seek", True),
    ("jora_quality_manager", "Jora — Quality Manager food (Sydney)", "aggregator", "P2", "jora", True),
    ("jora_food_safety", "Jora — Food Safety Quality Manager (Australia)", "aggregator", "P2", "jora", True),
]
