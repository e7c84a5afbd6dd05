"""Default dictionaries. Every operator takes its dictionary as an argument; these are the shipped values."""

from __future__ import annotations

# Word lists, patterns and constants that results depend on.

MAJORS = [
    (
        "Software Engineering",
        ["coding", "software", "programming", "python", "java", "api", "web", "cloud", "devops", "intern", "engineer"],
    )
]

SENIORITY = [
    ("Intern", ["intern", "internship", "co-op", "coop", " co op ", "student", "placement", "apprentice"]),
    (
        "New grad",
        [
            "new grad", "new graduate", "recent graduate", "campus", "early career", "early talent",
            "graduate program", "rotational program", "entry level", "entry-level",
        ],
    ),
    ("Junior", ["junior", " jr ", " jr.", " i ", " associate "]),
    ("Lead", ["director", "vp ", "vice president", "head of", "chief", "principal", "distinguished", "fellow"]),
    ("Senior", ["senior", " sr ", " sr.", "staff ", "lead ", "manager", "architect", " iii", " iv"]),
]

ADJACENT_LEVELS = {
    "Intern": ["New grad"],
    "New grad": ["Intern", "Junior"],
    "Junior": ["New grad"],
    "Senior": ["Lead"],
    "Lead": ["Senior"],
}

TECHNICAL_TITLE = [
    "software", "developer", "engineer", "programmer", "devops", "sre", "site reliability", "machine learning",
    " ml ", " ai ", "data ", "analytics", "analyst", "cloud", "backend", "back-end", "back end", "frontend",
    "front-end", "front end", "full stack", "full-stack", "fullstack", "mobile", " ios ", "android", " qa ",
    "sdet", "security", "cyber", "infrastructure", "platform", "architect", "scientist", "researcher", "technolog",
    " it ", "network", "database", " dba ", "embedded", "firmware", "robotics", "systems", "computing", "digital",
]

MODALITIES = [("Remote", ["remote"]), ("Hybrid", ["hybrid"])]

CITIES = [
    ("Toronto", ["toronto"]),
    ("Vancouver", ["vancouver"]),
    ("Waterloo", ["waterloo", "kitchener"]),
    (
        "San Francisco",
        ["san francisco", "bay area", "mountain view", "palo alto", "sunnyvale", "san jose", "menlo park", "cupertino"],
    ),
    ("New York", ["new york", "nyc", "brooklyn", "manhattan"]),
    ("Seattle", ["seattle", "bellevue", "redmond"]),
    ("London", ["london"]),
]

CANADA = [
    "canada", "toronto", "vancouver", "waterloo", "kitchener", "montreal", "ottawa", "calgary", "edmonton", ", on",
    ", bc", ", qc", ", ab", "ontario", "british columbia", "quebec", "alberta",
]

USA = [
    "usa", "united states", "u.s.", "san francisco", "bay area", "new york", "nyc", "seattle", "austin", "boston",
    "chicago", "mountain view", "palo alto", "sunnyvale", "san jose", "redmond", "bellevue", ", ca", ", ny", ", wa",
    ", tx", ", ma", ", il", ", ga", ", nc", ", va", ", pa", ", co", ", ut", ", az", ", fl",
]

COMPANY_SUFFIXES = [
    "inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gmbh", "sa", "nv",
    "ag", "pbc", "lp", "llp", "group", "holdings", "technologies", "technology", "labs", "software", "systems",
]

TIER_VALUE = {1: 1.0, 2: 0.7, 3: 0.4, 4: 0.2}

MONEY_WORDS = ["salary", "compensation", "pay range", "wage", "per hour", "hourly", "annually", "per year"]

CURRENCY_CODES = ["CAD", "USD", "EUR", "GBP", "AUD", "INR", "CHF", "SGD"]

SPECIALTIES = {
    "Frontend": r"\b(front[- ]?end|ui engineer|web developer|react|angular|vue)\b",
    "Backend": r"\b(back[- ]?end|server[- ]side|api engineer|platform engineer)\b",
    "Full-Stack": r"\b(full[- ]?stack)\b",
    "DevOps": r"\b(dev[- ]?ops|site reliability|sre|infrastructure|cloud engineer|platform engineer)\b",
    "AI/ML": r"\b(ai|ml|a\.i\.|machine learning|deep learning|artificial intelligence|llms?|computer vision|nlp|data scien\w*)\b",
    "Embedded": r"\b(embedded|firmware|fpga|rtos|hardware engineer|microcontroller\w*)\b",
    "Data": r"\b(data (engineer\w*|scien\w*|analy\w*|platform|infrastructure)|analytics|business intelligence|etl)\b",
    "Product": r"\b(product (manag\w*|design\w*|owner|analyst|engineer\w*)|pm intern|apm)\b",
    "Security": r"\b(security|cyber\w*|infosec|appsec|penetration|soc analyst)\b",
}

LEARN_CUES = [
    "you will learn", "you'll learn", "you’ll learn", "opportunity to learn", "chance to learn", "will be trained",
    "we will train", "we'll train", "we will teach", "we'll teach", "training provided", "training will be provided",
    "no prior experience", "no previous experience", "no experience with", "no experience in", "not required to have",
    "willingness to learn", "eagerness to learn", "eager to learn", "interest in learning", "excited to learn",
    "introduction to", "get exposure to", "you will be introduced",
]

NICE_CUES = [
    "nice to have", "nice-to-have", "preferred", "preferable", "preference will", "a plus", "big plus", "plus if",
    "bonus", "an asset", "is an asset", "considered an asset", "desirable", "advantageous", "would be great",
    "we'd love", "we’d love", "ideally", "optional", "not required", "familiarity with", "exposure to",
    "some experience", "any experience", "helpful but", "good to have",
]

MUST_CUES = [
    "must have", "must-have", "must be able", "you must", "is required", "are required", "required:", "requirement",
    "minimum qualification", "basic qualification", "essential", "proficien", "expertise", "expert in", "strong ",
    "solid ", "deep ", "extensive", "advanced knowledge", "in-depth", "hands-on experience", "demonstrated",
    "track record",
]

#: field -> (weight, emphasis of a plain line: 0 must, 1 nice, 2 mentioned)
FIELDS = {"requirements": (3.0, 0), "title": (2.0, 0), "scraped": (2.0, 0), "responsibilities": (1.6, 2), "description": (1.0, 2)}

TONE_FACTOR = {"must": 1.5, "plain": 1.0, "nice": 0.45, "learn": 0.1}

SECTION_PHRASES = [
    (
        "responsibilities",
        [
            "responsibilit", "what you'll do", "what you will do", "what you'll be doing", "what you would be doing",
            "what you’ll do", "what you’ll be doing", "your day", "day-to-day", "day to day", "your impact",
            "the impact you", "key accountab", "essential function", "essential duties", "duties", "job duties",
            "the role", "in this role", "about the role", "role overview", "what to expect", "tasks",
        ],
    ),
    (
        "perks",
        [
            "benefit", "perk", "what we offer", "what you'll get", "what you’ll get", "what's in it for you",
            "what’s in it for you", "why join", "why you'll love", "we offer", "total reward", "compensation",
            "salary", "pay range", "pay transparency", "remuneration",
        ],
    ),
    (
        "requirements",
        [
            "requirement", "qualification", "what you'll need", "what you will need", "what you’ll need",
            "what we require", "what we look for", "what we're looking for", "what we are looking for",
            "what we’re looking for", "who you are", "about you", "you have", "you bring", "must have",
            "nice to have", "preferred", "minimum", "basic", "eligibility", "education", "competenc", "skill",
            "experience and specialization", "required experience", "experience required", "years of experience",
            "relevant experience", "professional experience", "your experience",
        ],
    ),
]
SECTION_EXACT = {"experience": "requirements"}
