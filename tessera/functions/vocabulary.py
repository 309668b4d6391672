"""Keyword lists, alias tables and patterns that decide results. All are defaults of parameters."""

REQUIRE_WORDS = ("requires", "required", "must")
UNSUPPORTED_WORDS = ("not supported", "unsupported", "incompatible")
MINIMUM_WORDS = ("minimum", "or later", "at least")
FIX_WORDS = ("fixed", "corrected an issue", "added support", "back-flashing")
FIX_PHRASES = ("fixed an issue", "corrected an issue", "added support", "back-flashing")
COMPONENT_WORDS = ("bios", "firmware", "driver", "os", "cpu", "processor", "hba", "raid", "agent", "windows", "vmware", "esxi", "linux")
RULE_KEYWORDS = (
    "requires", "required", "minimum", "at least", "or later", "must", "must not", "should not", "not supported", "unsupported", "incompatible", "only supported", "certified with",
    "depends on", "before upgrading", "after upgrading", "corrected an issue", "fixed an issue", "added support", "back-flashing", "downgrade", "firmware", "bios", "driver", "os", "agent",
)
BODY_SIGNALS = ("requires", "not supported", "bios", "firmware", "driver", "back-flashing", "processor")
METADATA_LABELS = ("document id", "release version", "release date", "document type", "applies to", "vendor", "product family", "platform", "version", "published date")
SECTION_TITLES = (
    "overview", "supported components", "compatibility requirements", "certified configurations", "unsupported configurations", "known issues", "fixed issues",
    "upgrade requirements", "firmware requirements", "driver requirements", "security updates", "remediation guidance",
)
#: Cells that tell a table's header.
HEADER_WORDS = ("component", "version", "minimum version", "current release", "condition", "action required", "cve / id", "description", "fixed in")
TABLE_WORDS = ("compatibility matrix", "supported versions", "minimum version", "table", "required bios")
RULE_LANGUAGE = ("must", "required", "requires", "not supported", "not allowed", "earlier than", "do not", "before upgrading", "limitation", "restriction")
LANES = ("deterministic_support_matrix", "deterministic_table_rule", "llm_prose_rule", "context_only", "evidence_only", "ignore")
COMPONENT_ALIASES = (
    ("bios", "bios"), ("system bios", "bios"), ("dell bios", "bios"), ("os", "os"), ("operating system", "os"), ("firmware", "firmware"), ("driver", "driver"), ("cpu", "cpu"),
    ("processor", "cpu"), ("hba", "hba"), ("host bus adapter", "hba"), ("raid", "raid_controller"), ("perc", "raid_controller"), ("raid controller", "raid_controller"), ("agent", "agent"),
    ("endpoint agent", "agent"), ("security agent", "agent"), ("management tool", "management_tool"), ("model", "device_model"), ("switch model", "device_model"),
    ("hardware model", "device_model"), ("device model", "device_model"), ("switch", "device"), ("device_type", "device_family"), ("network module", "network_module"),
    ("module", "network_module"), ("cisco ios xe", "network_os"), ("ios xe", "network_os"), ("switch software", "network_os"), ("software image", "software_image"), ("rommon", "bootloader"),
    ("bootloader", "bootloader"), ("license", "license"), ("license level", "license"), ("feature", "feature"), ("unsupported feature", "feature"), ("virtualization_feature", "feature"),
    ("transceiver", "transceiver"), ("optic", "transceiver"),
)
OPERATOR_ALIASES = (
    ("or later", ">="), ("minimum", ">="), ("at least", ">="), ("not earlier than", ">="), ("earlier than", "<"), ("below", "<"), ("older than", "<"), ("equal to", "=="),
    ("not supported", "not_supported"), ("incompatible", "not_in"), ("incompatible_with", "not_in"), ("must not", "must_not"), ("do not", "must_not"), (">=", ">="), ("<=", "<="),
    (">", ">"), ("<", "<"), ("==", "=="), ("installed", "installed"), ("requires", ">="),
)
RULE_TYPE_ALIASES = (
    ("requires_minimum_version", "min_version_constraint"), ("minimum_version", "min_version_constraint"), ("min_version_constraint", "min_version_constraint"),
    ("feature_support_added", "feature_support_added"), ("added_support", "feature_support_added"), ("known_issue_fixed", "known_issue_fixed"), ("fixed_issue", "known_issue_fixed"),
    ("incompatible_with", "incompatible_combination"), ("incompatible_combination", "incompatible_combination"), ("unsupported_combination", "incompatible_combination"),
    ("update_order_constraint", "update_order_constraint"), ("upgrade_order_constraint", "upgrade_order_constraint"), ("readiness_requirement", "readiness_requirement"),
    ("model_support_min_version", "model_support_min_version"), ("network_module_support_min_version", "network_module_support_min_version"),
    ("license_support_fact", "license_support_fact"), ("software_image_fact", "software_image_fact"), ("rommon_version_fact", "rommon_version_fact"), ("unsupported_feature", "unsupported_feature"),
    ("configuration_requirement", "configuration_requirement"), ("operational_warning", "operational_warning"), ("known_limitation", "known_limitation"), ("not_a_rule", "not_a_rule"),
)
SEVERITY_ALIASES = (("critical", "critical"), ("high", "critical"), ("blocker", "blocker"), ("warning", "warning"), ("medium", "warning"), ("low", "info"), ("info", "info"), ("unknown", "info"))
CANDIDATE_KINDS = ("support_matrix_fact", "compliance_rule", "unsupported_feature", "known_limitation", "operational_warning", "informational_note", "not_a_rule")
IOS_XE_TRAINS = ("amsterdam", "cupertino", "dublin", "fuji", "gibraltar")
#: Patterns. VERSION is looked for in lower-cased text, the others in any case.
VERSION = r"(^|[^0-9a-z_])v?[0-9]+(\.[0-9]+)+(\.x)?($|[^0-9a-z_])"
SWITCH_MODEL = r"^C(9200|9200L|9200CX|9300|9400|9500|9600)[A-Z0-9-]*$"
NETWORK_MODULE = r"^C(9200|9300|9500|9600)-NM-[A-Z0-9-]+(\s+[0-9]+)?$"
TABLE_HEADER = r"([A-Z][A-Za-z0-9 /()+-]{2,40}):"
#: Evidence types and the base of their priority.
EVIDENCE_BASE = (
    ("ViolationEvidence", 100), ("RiskEvidence", 100), ("InventoryEvidence", 85), ("CompatibilityEvidence", 70), ("VersionEvidence", 70), ("DependencyEvidence", 70),
    ("RecommendationEvidence", 70), ("LifecycleEvidence", 50), ("DomainEvidence", 50),
)
RISKS = ("Informational", "Low", "Medium", "High", "Critical")
#: Keyword in a report's text, root cause, violation, risk; the order decides which of several with one outcome counts.
VIOLATION_PATTERNS = (
    ("version mismatch", "RC-VERSION-MISMATCH", "VIOL-VERSION", "High"), ("not supported", "RC-UNSUPPORTED-CONFIGURATION", "VIOL-COMPATIBILITY", "High"),
    ("incompatible", "RC-CONFLICT-VIOLATION", "VIOL-CONFLICT", "High"), ("conflicts", "RC-CONFLICT-VIOLATION", "VIOL-CONFLICT", "High"),
    ("missing", "RC-MISSING-DEPENDENCY", "VIOL-DEPENDENCY", "High"), ("dependency", "RC-MISSING-DEPENDENCY", "VIOL-DEPENDENCY", "Medium"),
    ("upgrade", "RC-INVALID-UPGRADE-PATH", "VIOL-UPGRADE", "High"), ("end-of-support", "RC-DEPRECATED-COMPONENT", "VIOL-LIFECYCLE", "High"),
    ("end of support", "RC-DEPRECATED-COMPONENT", "VIOL-LIFECYCLE", "High"), ("deprecated", "RC-DEPRECATED-COMPONENT", "VIOL-LIFECYCLE", "Medium"),
    ("security", "RC-SECURITY-VIOLATION", "VIOL-SECURITY", "Critical"), ("vulnerability", "RC-SECURITY-VIOLATION", "VIOL-SECURITY", "Critical"),
    ("cve", "RC-SECURITY-VIOLATION", "VIOL-SECURITY", "Critical"), ("privilege escalation", "RC-SECURITY-VIOLATION", "VIOL-SECURITY", "Critical"),
    ("token exposure", "RC-SECURITY-VIOLATION", "VIOL-SECURITY", "Critical"), ("policy", "RC-POLICY-VIOLATION", "VIOL-POLICY", "Medium"),
    ("drift", "RC-CONFIGURATION-DRIFT", "VIOL-COMPLIANCE", "Medium"), ("compliance", "RC-POLICY-VIOLATION", "VIOL-COMPLIANCE", "Medium"),
    ("non-compliant", "RC-POLICY-VIOLATION", "VIOL-COMPLIANCE", "High"), ("noncompliant", "RC-POLICY-VIOLATION", "VIOL-COMPLIANCE", "High"),
    ("readiness", "RC-INVALID-UPGRADE-PATH", "VIOL-UPGRADE", "High"), ("sequence", "RC-INVALID-UPGRADE-PATH", "VIOL-UPGRADE", "High"),
    ("order", "RC-INVALID-UPGRADE-PATH", "VIOL-UPGRADE", "High"), ("unknown", "RC-UNKNOWN-STATE", "VIOL-COMPLIANCE", "Medium"),
    ("failing", "RC-VERSION-MISMATCH", "VIOL-COMPATIBILITY", "High"), ("fail", "RC-VERSION-MISMATCH", "VIOL-COMPATIBILITY", "High"),
    ("lifecycle", "RC-LIFECYCLE-MISMATCH", "VIOL-LIFECYCLE", "Medium"), ("outdated", "RC-VERSION-MISMATCH", "VIOL-VERSION", "High"),
    ("boot delay", "RC-UNSUPPORTED-CONFIGURATION", "VIOL-CONFLICT", "High"), ("boot failure", "RC-UNSUPPORTED-CONFIGURATION", "VIOL-CONFLICT", "Critical"),
    ("instability", "RC-CONFLICT-VIOLATION", "VIOL-CONFLICT", "High"), ("network adapter", "RC-CONFLICT-VIOLATION", "VIOL-CONFLICT", "High"),
    ("telemetry", "RC-CONFIGURATION-DRIFT", "VIOL-COMPLIANCE", "Medium"), ("authentication", "RC-SECURITY-VIOLATION", "VIOL-SECURITY", "Critical"),
)
#: Labels of the violations that the patterns tell, in the same order; severity words and their levels, the first that is found counts; rows of evidence.
VIOLATION_LABELS = (
    "VersionMismatch", "UnsupportedConfig", "Conflict", "Conflict", "MissingDependency", "Dependency", "UpgradePath", "EndOfSupport", "EndOfSupport", "Deprecated", "SecurityViolation", "SecurityViolation",
    "SecurityViolation", "SecurityViolation", "SecurityViolation", "PolicyViolation", "ConfigDrift", "Compliance", "NonCompliant", "NonCompliant", "Readiness", "Sequence", "UpdateOrder", "UnknownState",
    "VersionMismatch", "VersionMismatch", "LifecycleMismatch", "Outdated", "BootDelay", "BootFailure", "Instability", "NetworkAdapter", "Telemetry", "Authentication",
)
SEVERITY_WORDS = (("critical", "Critical"), ("warning", "High"), ("info", "Medium"), ("informational", "Informational"))
EVIDENCE_ROWS = "array<struct<evidence_type: string, entity: string, target: string, confidence: double, source_excerpt: string, description: string, rule_type: string, relationship: string>>"
#: Component types in questions and their names.
QUESTION_COMPONENTS = (
    ("bios", ("bios", "uefi", "system bios")), ("firmware", ("firmware", "system firmware", "device firmware")), ("operating_system", ("operating system", "windows", "linux", "ubuntu", "os")),
    ("driver", ("driver", "drivers", "driver pack")), ("security_component", ("security agent", "antivirus", "endpoint protection", "secure boot", "tpm")),
    ("management_tool", ("management agent", "management tool", "mdm", "monitoring agent")),
)
IN_SCOPE = (
    "compatibility", "compatible", "incompatible", "compliance", "compliant", "rule", "rules", "candidate", "candidates", "document", "documents", "release note", "release notes", "evidence", "source",
    "chunk", "chunks", "page", "excerpt", "firmware", "bios", "driver", "drivers", "os", "operating system", "windows server", "windows", "tpm", "secure boot", "secureboot", "uefi", "crowdstrike", "intune",
    "nvidia", "vgpu", "nic", "ethernet", "remediation", "upgrade", "rollout", "configuration", "configure", "unsupported", "supported", "certified", "baseline", "known issue", "approval", "approve", "review",
    "reject", "reviewed", "rule extraction", "normalize", "normalization", "validated", "pending review", "approved candidate", "rule candidate", "inventory", "device", "server", "host", "scan", "violation",
    "version", "version constraint", "min version", "minimum version", "dependency", "requirement", "handoff", "export", "comp-", "unsup-", "rec-", "rcand-", "doc-", "perc", "storecli", "openmanage", "dell",
    "idrac", "esxi", "vmware", "hyper-v", "linux", "ubuntu", "rhel", "centos", "poweredge", "proliant", "thinkserver", "kb", "knowledge base", "kg", "knowledge graph", "graph", "llm", "ai", "extraction", "extracted",
)
OUT_OF_SCOPE = (
    "cricket", "football", "soccer", "basketball", "baseball", "tennis", "sports", "match", "tournament", "championship", "league", "nfl", "ipl", "movie", "movies", "film", "actor", "actress", "celebrity", "recipe",
    "cook", "bake", "ingredient", "restaurant", "weather", "forecast", "rain", "temperature", "politics", "election", "vote", "president", "prime minister", "love letter", "poem", "poetry", "story",
    "creative writing", "photosynthesis", "biology", "chemistry", "physics", "algebra", "homework", "essay", "school", "university", "college", "joke", "funny", "humor", "comedy", "stocks", "bitcoin", "crypto",
    "nft", "investment", "medical advice", "diagnosis", "symptom", "medicine", "lawyer", "legal advice",
)
INJECTIONS = (
    r"ignore\s+(your\s+)?(previous|prior|all|above)\s+instructions?", r"forget\s+(your\s+)?(previous|prior|all)?\s*(rules?|instructions?)", r"you\s+are\s+now\s+a\s+(general|different|new)",
    r"reveal\s+(your\s+)?(system\s+)?prompt", r"show\s+(me\s+)?(your\s+)?(hidden|internal|system)\s*(prompt|instructions?)", r"bypass\s+(the\s+)?(guardrail|filter|safety|restriction)",
    r"pretend\s+you\s+(are|have\s+no)\s+restrictions?", r"act\s+as\s+(if\s+you\s+are\s+)?a\s+general", r"jailbreak", r"dan\s+(mode|prompt)",
)
