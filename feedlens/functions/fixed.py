"""Tables that results must share, in their natural order. Larger ones (a skill catalog) are arguments."""

# fmt: off
#: Interests and their keywords, substrings of the padded lower-cased text.
INTERESTS = [
    ("AI/ML", [
        "machine learning", "deep learning", "neural network", "llm", "language model", "pytorch", "tensorflow", "computer vision", "generative ai",
        " ai ", "ai/ml", "transformer", "inference",
    ]),
    ("Frontend", [
        "frontend", "front-end", "react", "vue.js", "svelte", "next.js", "tailwind", "css", "typescript", "web ui", "user interface", "browser",
    ]),
    ("Backend", [
        "backend", "back-end", "microservice", "rest api", "graphql", "postgres", "database", "server-side", "distributed system", "golang",
        "django", "node.js",
    ]),
    ("Systems", [
        "kernel", "compiler", "operating system", "embedded", "firmware", "low-level", "rust", "c++", "assembly", "linux", "memory safety",
        "concurrency",
    ]),
    ("Security", [
        "security", "vulnerability", "exploit", "cryptography", "penetration test", "malware", "infosec", "authentication", "zero-day", "cve-",
    ]),
    ("Data", [
        "data engineer", "data scien", "analytics", "apache spark", "etl", "data warehouse", "data pipeline", "sql", "bigquery", "snowflake",
    ]),
    ("DevOps/Cloud", [
        "devops", "kubernetes", "docker", "terraform", "aws", "azure", "gcp", "ci/cd", "site reliability", "observability", "infrastructure",
    ]),
    ("Mobile", [
        "ios", "android", "swift", "kotlin", "react native", "flutter", "mobile app", "app store",
    ]),
    ("Hardware", [
        "semiconductor", "fpga", "chip design", "verilog", "robotics", "circuit", "silicon", "processor", "gpu",
    ]),
    ("Product/Design", [
        "product manager", "product management", "ux ", "user experience", "product design", "figma", "design system",
    ]),
    ("Game Dev", [
        "game dev", "unity", "unreal engine", "shader", "rendering", "graphics engine", "gamedev",
    ]),
    ("Startups", [
        "startup", "founder", "seed round", "series a", "y combinator", "venture capital", "bootstrapped",
    ]),
]
#: Tighter keywords of skills whose names are common words, for long texts.
TIGHT_SKILLS = [
    ("Go", ["golang", " go/", "go programming"]),
    ("C", [" c/", "c99", "c11", "c programming"]),
    ("R", ["rstudio", "tidyverse", " r/", "r programming"]),
    ("RAG", ["retrieval-augmented", "vector database", "embeddings"]),
]
#: Employers by tier, 1 the strongest.
TIERS = {
    1: [
        "Google", "Apple", "Microsoft", "Amazon", "Meta", "Netflix", "NVIDIA", "OpenAI", "Anthropic", "DeepMind", "Stripe", "Databricks", "Palantir",
        "SpaceX", "Waymo", "Jane Street", "Citadel", "Citadel Securities", "Two Sigma", "Hudson River Trading", "Jump Trading", "DRW", "Optiver",
        "IMC Trading", "Radix Trading", "Tower Research Capital", "Point72", "D. E. Shaw", "Goldman Sachs",
    ],
    2: [
        "Shopify", "Salesforce", "Adobe", "Cisco", "Intel", "AMD", "Qualcomm", "Broadcom", "Arm", "Texas Instruments", "Oracle", "SAP", "VMware",
        "Dell", "HP", "IBM", "Uber", "Lyft", "Airbnb", "DoorDash", "Instacart", "Pinterest", "Reddit", "Snap", "Spotify", "Roblox", "Unity",
        "Electronic Arts", "Ubisoft", "Riot Games", "Epic Games", "Coinbase", "Robinhood", "Block", "PayPal", "Visa", "Mastercard",
        "American Express", "Capital One", "Morgan Stanley", "JPMorgan Chase", "BlackRock", "Snowflake", "Datadog", "Cloudflare", "MongoDB",
        "Elastic", "Confluent", "HashiCorp", "GitLab", "GitHub", "Atlassian", "LinkedIn", "Twilio", "Figma", "Notion", "Ramp", "Plaid", "Brex",
        "Affirm", "Discord", "Anduril", "Scale AI", "Perplexity", "Cohere", "Mistral AI", "Hugging Face", "Applied Intuition", "Rivian", "Tesla",
        "Lockheed Martin", "Boeing", "Raytheon", "RBC", "TD", "CIBC", "BMO", "Scotiabank", "Wealthsimple", "Thomson Reuters", "Telus", "Rogers",
        "Bell", "Deloitte", "PwC", "KPMG", "EY", "Accenture", "Workday", "Autodesk", "ServiceNow", "Intuit", "Zoom", "Dropbox", "Slack",
        "Squarespace", "Asana",
    ],
    3: [
        "Sun Life", "Manulife", "Great-West Life", "OMERS", "CPP Investments", "OTPP", "Canadian Tire", "Loblaw", "Air Canada", "WestJet",
        "Hydro One", "Ontario Power Generation", "1Password", "Faire", "Vercel", "Supabase", "Replit", "Linear", "Sentry", "Sierra", "Mercury",
        "Retool", "Rippling", "Deel", "Gusto", "Chime", "Samsara", "Verkada", "Nuro", "Zipline", "Benchling", "Airtable", "Grammarly", "Axon",
        "Tenstorrent", "Xanadu", "D-Wave", "Untether AI", "Clio", "Jobber", "Hootsuite", "Later", "Benevity", "Neo Financial", "Float", "Wattpad",
        "Ritual", "Ada", "Coveo", "Kinaxis", "Lightspeed", "Nuvei", "Vidyard", "Ecobee", "Top Hat", "Wave", "Dialogue", "Konrad", "Index Exchange",
        "StackAdapt",
    ],
    4: [
        "Cohere Health",
    ],
}
#: Other names of employers.
ALIASES = [
    ("alphabet", "Google"), ("google llc", "Google"), ("facebook", "Meta"), ("meta platforms", "Meta"), ("apple inc", "Apple"),
    ("amazon web services", "Amazon"), ("aws", "Amazon"), ("microsoft corporation", "Microsoft"), ("nvidia corporation", "NVIDIA"),
    ("x corp", "Twitter"), ("square", "Block"), ("block inc", "Block"), ("royal bank of canada", "RBC"), ("rbc royal bank", "RBC"),
    ("toronto dominion bank", "TD"), ("td bank", "TD"), ("td bank group", "TD"), ("canadian imperial bank of commerce", "CIBC"),
    ("bank of montreal", "BMO"), ("bmo financial group", "BMO"), ("bank of nova scotia", "Scotiabank"), ("sun life financial", "Sun Life"),
    ("manulife financial", "Manulife"), ("cppib", "CPP Investments"), ("canada pension plan investment board", "CPP Investments"),
    ("ontario teachers pension plan", "OTPP"), ("pricewaterhousecoopers", "PwC"), ("ernst young", "EY"), ("ernst and young", "EY"),
    ("jpmorgan", "JPMorgan Chase"), ("jp morgan", "JPMorgan Chase"), ("chase", "JPMorgan Chase"), ("american express company", "American Express"),
    ("amex", "American Express"), ("space exploration technologies", "SpaceX"), ("advanced micro devices", "AMD"), ("hewlett packard", "HP"),
    ("hp inc", "HP"), ("international business machines", "IBM"), ("ea", "Electronic Arts"), ("de shaw", "D. E. Shaw"), ("d e shaw", "D. E. Shaw"),
    ("hrt", "Hudson River Trading"), ("imc", "IMC Trading"), ("imc financial markets", "IMC Trading"), ("scale", "Scale AI"),
    ("openai inc", "OpenAI"), ("anthropic pbc", "Anthropic"), ("thomson reuters corporation", "Thomson Reuters"), ("telus communications", "Telus"),
    ("bell canada", "Bell"), ("bce", "Bell"), ("rogers communications", "Rogers"), ("shopify inc", "Shopify"), ("1password agilebits", "1Password"),
    ("agilebits", "1Password"),
]
# fmt: on
