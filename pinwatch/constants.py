"""Fixed values the domain prescribes."""

# Severity by CVSS base score, lower bounds.
SEVERITY_FLOORS = (("CRITICAL", 9.0), ("HIGH", 7.0), ("MEDIUM", 4.0))
SEVERITY_DEFAULT = "LOW"

# Ecosystem by prefix of the update branch.
BRANCH_ECOSYSTEMS = {
    "dependabot/pip/": "pypi",
    "dependabot/npm_and_yarn/": "npm",
    "dependabot/go_modules/": "go",
    "dependabot/maven/": "maven",
    "dependabot/cargo/": "cargo",
    "dependabot/bundler/": "rubygems",
    "dependabot/uv/": "pypi",
    "renovate/pip/": "pypi",
    "renovate/npm/": "npm",
    "renovate/go/": "go",
    "renovate/maven/": "maven",
    "renovate/cargo/": "cargo",
    "renovate/rubygems/": "rubygems",
}

# Manifest file by ecosystem.
MANIFESTS = {
    "pypi": "requirements.txt",
    "npm": "package.json",
    "go": "go.mod",
    "maven": "pom.xml",
    "cargo": "Cargo.toml",
    "rubygems": "Gemfile",
}
MANIFEST_DEFAULT = "unknown"

# Ecosystem names of the advisory feed.
FEED_ECOSYSTEMS = {
    "PyPI": "pypi",
    "npm": "npm",
    "Maven": "maven",
    "Go": "go",
    "crates.io": "cargo",
    "RubyGems": "rubygems",
}

# Output topics.
TIER_TOPICS = {
    "CRITICAL": "vuln.matches.critical",
    "HIGH": "vuln.matches.high",
    "MEDIUM": "vuln.matches.medium",
    "LOW": "vuln.matches.low",
}
TOPIC_DEFAULT = "vuln.matches.low"
PR_RISK_TOPIC = "deps.risk.prs"
SNAPSHOT_TOPIC = "vuln.graph.snapshots"
INPUT_TOPICS = ("vulns.nvd.raw", "vulns.osv.raw", "deps.changes")

# Remediation time in hours by tier.
SLA_HOURS = {"CRITICAL": 4, "HIGH": 24, "MEDIUM": 168, "LOW": 720}

# Score weights and lower bounds of the tiers.
WEIGHT_CVSS = 0.40
WEIGHT_CUSTOMER_FACING = 0.25
WEIGHT_COMPLIANCE = 0.20
WEIGHT_PII = 0.15
TIER_FLOORS = (("CRITICAL", 0.75), ("HIGH", 0.50), ("MEDIUM", 0.25))
TIER_DEFAULT = "LOW"
TIERS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

# Sources of vulnerability records, first useful archive day, update bots.
VULN_SOURCES = ("nvd", "osv")
ARCHIVE_FLOOR = "2024-01-01"
UPDATE_BOTS = ("dependabot", "renovate")

# Title patterns of dependency updates.
BUMP_TITLE = r"(?i)bump ([\w\-\.\/]+) from ([\d\.]+) to ([\d\.]+)"
CHORE_TITLE = r"(?i)chore\(deps\).*bump ([\w\-\.]+) from ([\d\.]+) to ([\d\.]+)"
REQUIREMENT_TITLE = r"(?i)update ([\w\-\.]+) requirement from .* to .*?([\d\.]+)\s*$"

# How long an accepted vulnerability record suppresses its copies.
DEDUP_HOURS = 24

# Compliance framework, registry flag (None: no flag exists) and controls.
FRAMEWORK_CONTROLS = (
    ("pci_dss", "pci_scope", "6.3"),
    ("pci_dss", "pci_scope", "12.3.2"),
    ("hipaa", "hipaa_scope", "164.306"),
    ("hipaa", "hipaa_scope", "164.312"),
    ("soc2", "soc2_scope", "CC7.1"),
    ("soc2", "soc2_scope", "CC7.2"),
    ("iso27001", None, "A.12.6"),
    ("nist_csf", None, "DE.CM-8"),
    ("nist_csf", None, "RS.AN-5"),
)

# Text chunks in tokens.
CHUNK_TOKENS = 512
CHUNK_OVERLAP = 64

# Weakness ids by category.
WEAKNESS_CATEGORIES = (
    ("CWE-284", "access_control"),
    ("CWE-285", "access_control"),
    ("CWE-862", "access_control"),
)

# Spread of open findings over a period, in days.
TREND_DAYS = (7, 30, 90)
