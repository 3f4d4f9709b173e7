"""Fixed values that must equal the reference's for identical results.

Everything here is plain data, listed in the reference's own order (order is
meaningful where a first match wins). Parameters of the operators default to
these lists and can be replaced by the caller.
"""

# Keep-list of the link-listing source (substring test).
LISTING_KEEP = [
    "kubernetes", "cloud", "devops", "serverless", "ai", "agent", "agentic",
    "infrastructure", "platform", "developer", "open source", "linux",
    "security", "confidential", "virtualization", "container", "wasm",
    "machine learning", "mlops", "llm", "inference", "gpu", "faas",
    "data", "api", "microservices", "sre", "devsecops", "ebpf",
]

# Skip-list of the link-listing source (checked first).
LISTING_SKIP = [
    "gaming", "blockchain", "crypto", "nft", "fintech", "fashion",
    "sports", "travel", "real estate", "marketing", "advertising",
    "vidcon", "siggraph", "blizzcon", "twitchcon", "rare evo",
    "cannes", "burning man",
]

# Keep-list of the card source.
CARD_KEEP = [
    "kubernetes", "cloud native", "cloud-native", "devops", "platform engineering",
    "serverless", "wasm", "webassembly", "ebpf", "container", "docker",
    "agentic", "agent", "llm", "ai infra", "ai infrastructure", "mlops",
    "unikernel", "virtualization", "confidential computing", "tee",
    "firecracker", "microvm", "faas", "function", "infrastructure",
    "hackathon", "demo night", "tech meetup", "startup",
]

# Keep-list of the group-page source (card list plus six terms).
GROUP_KEEP = CARD_KEEP + [
    "developer", "build", "engineering", "open source", "sre", "site reliability",
]

# Navigation paths skipped by the card source.
CARD_NAV_SKIP = ["/discover", "/signin", "/pricing", "/help", "/app"]

# CFP page phrases. An "open" phrase is checked first, then the
# first closed list; without an open phrase the second closed list applies.
CFP_OPEN = [
    "cfp is open", "call for proposals", "call for papers",
    "submit a talk", "submit your proposal", "submit now",
    "apply to speak", "sessionize",
]
CFP_CLOSED_WHEN_OPEN = ["cfp is closed", "submissions are closed", "cfp closed"]
CFP_CLOSED = ["cfp is closed", "submissions closed", "cfp has closed"]

# Focus cities in priority order with their location needles.
FOCUS_CITIES = [
    ("San Francisco", [
        "san francisco", "sf,", "s.f.", "bay area",
        "palo alto", "menlo park", "mountain view", "san jose",
        "redwood city", "santa clara", "oakland", "berkeley",
        "sunnyvale", "cupertino", "fremont", "san mateo",
        ", ca ", ", ca,", "california", "94",
    ]),
    ("Munich", ["munich", "münchen", "muenchen"]),
    ("Berlin", ["berlin"]),
    ("Bucharest", ["bucharest", "bucurești", "bucuresti"]),
    ("London", ["london"]),
    ("Dublin", ["dublin"]),
]
DEMO_CITY = "San Francisco"
MIN_FIT_SCORE = 0

# CFP statuses that are re-checked by the refresh step.
REFRESH_STATUSES = ["", "check site", "not yet announced", "unknown"]

# The nine event categories of the classifier.
CATEGORIES = [
    "Cloud-Native / Kubernetes", "Agentic AI", "DevOps", "Serverless / FaaS",
    "Confidential Computing", "AI Infra", "Security", "Community / Networking",
    "Startup / General Tech",
]

# Discovery targets.
MIN_NEW_EVENTS_PER_RUN = 5
MIN_NEW_MEETUPS_PER_RUN = 15
MEETUP_CITIES = ["San Francisco", "Munich", "Berlin", "Bucharest", "London", "Dublin"]
KNOWN_NAMES_SHOWN = 60
DIGEST_CONFERENCES = 6
DIGEST_MEETUPS = 6
DIGEST_DEMOS = 4
CARD_TEXT_CHARS = 500
PARTY_TEXT_CHARS = 400
GROUP_NAME_CHARS = 120
SUMMARY_CARD_CHARS = 400
MIN_GROUP_NAME_LEN = 5

# Seed events (name, url, location, start, end, category, status).
SEED_EVENTS = [
    ("KubeCon + CloudNativeCon Japan 2026",
     "https://events.linuxfoundation.org/kubecon-cloudnativecon-japan/",
     "Yokohama, Japan", "Jul 28, 2026", "Jul 30, 2026", "Cloud-Native / Kubernetes", None),
    ("KubeCon + CloudNativeCon China 2026",
     "https://www.lfopensource.cn/kubecon-cloudnativecon-openinfra-summit-pytorch-conference-china/",
     "Shanghai, China", "Sep 7, 2026", "Sep 9, 2026", "Cloud-Native / Kubernetes / AI", None),
    ("KubeCon + CloudNativeCon North America 2026",
     "https://events.linuxfoundation.org/kubecon-cloudnativecon-north-america/",
     "Salt Lake City, USA", "Nov 9, 2026", "Nov 12, 2026", "Cloud-Native / Kubernetes", None),
    ("AGNTCon + MCPCon Europe 2026",
     "https://events.linuxfoundation.org/agntcon-mcpcon-europe/",
     "Amsterdam, Netherlands", "Sep 17, 2026", "Sep 18, 2026", "Agentic AI", None),
    ("MCP Dev Summit Seoul 2026",
     "https://events.linuxfoundation.org/mcp-dev-summit-seoul/",
     "Seoul, South Korea", "Aug 13, 2026", "Aug 14, 2026", "Agentic AI", None),
    ("Confidential Computing Summit 2026",
     "https://events.linuxfoundation.org/confidential-computing-summit/",
     "San Francisco, USA", "Jun 23, 2026", "Jun 24, 2026", "Confidential Computing / Security", None),
    ("KCD UK — Edinburgh 2026",
     "https://community2.cncf.io/events/details/cncf-kcd-uk-presents-kubernetes-community-days-uk-edinburgh-2026/",
     "Edinburgh, UK", "Oct 19, 2026", "Oct 20, 2026", "Cloud-Native / Kubernetes", "Open"),
    ("KCD Sofia 2026",
     "https://community2.cncf.io/events/details/cncf-kcd-sofia-presents-kubernetes-community-days-sofia-2026/",
     "Sofia, Bulgaria", "TBC", "TBC", "Cloud-Native / Kubernetes", "Check site"),
]
SEED_SOURCES = ["Linux Foundation"] * 6 + ["CNCF"] * 2
