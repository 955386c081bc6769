"""Table schemas and the fixed vocabulary of the code graph."""

from __future__ import annotations


# ---- fixed values: names and constants that results depend on -------------------------------------------------------

EDGE_TYPES = ("FLOWS_TO", "SANITIZED_BY", "CALLS", "CALLED_BY", "DEFINED_BY", "USED_BY", "CONTAINS")
PATH_FILL_TYPES = ("FLOWS_TO", "SANITIZED_BY", "CALLS", "CALLED_BY", "DEFINED_BY", "USED_BY")
TAINT_TYPES = ("FLOWS_TO", "DEFINED_BY")
#: Edge types that count as evidence of a role.
ROLE_OF_EDGE = {"SANITIZED_BY": "sanitizer", "FLOWS_TO": "propagation", "CALLS": "caller", "CALLED_BY": "callee", "DEFINED_BY": "definition"}

SINK_HINTS = ("subprocess", "os.system", "popen", "eval", "exec", "pickle.loads", "yaml.load", "render_template", "execute")
SOURCE_HINTS = ("request", "argv", "sys.argv", "getenv", "environ", "input", "headers", "cookies", "body")
GUARD_HINTS = ("validate", "sanitize", "escape", "normalize", "check", "authorize", "allow", "deny", "guard", "safe")
GENERATED_SUFFIX = "_pb2.py"
GENERATED_SEGMENTS = ("generated", "autogen", "auto_generated")
GENERATED_HEADERS = ("generated", "auto-generated", "do not edit")
HIGH_RISK_CWES = (22, 77, 78, 79, 89, 94, 95, 98, 113, 185, 200, 209, 215, 259, 327, 338, 502, 611, 703, 918)

ROLE_PRIORS = {
    "root": 1.00,
    "sink": 0.95,
    "source": 0.90,
    "sanitizer": 0.85,
    "guard": 0.85,
    "propagation": 0.75,
    "definition": 0.65,
    "import": 0.60,
    "callee": 0.55,
    "caller": 0.55,
    "entrypoint": 0.55,
    "enclosing_context": 0.50,
    "boilerplate": 0.15,
}
TAINT_BY_HOP = {1: 1.0, 2: 0.70, 3: 0.50, 4: 0.35}
TAINT_FAR = 0.20
DEFAULT_KIND_SCORE = 0.20
UNKNOWN_SEVERITY = 0.50
UNKNOWN_CONFIDENCE = 0.40
#: First issue number of each tier of the second analyzer, and where the last tier ends.
ISSUE_TIERS = ((100, 106, "HIGH"), (106, 131, "MEDIUM"), (131, 138, "LOW"))
SEVERITY_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
EXCLUDED_DIRS = ("__pycache__", ".git", ".venv", "venv", ".mypy_cache", ".pytest_cache", "tests", "test")

# ---- schemas, as DDL ---------------------------------------------------------------------------------------------------------

NODES = (
    "identifier string, kind string, name string, file_path string, line_start int, line_end int, token_count int, type_hint string, "
    "caller_id string, callee_id string, finding_evidence_score double, security_path_score double, ord bigint"
)
EDGES = ("src string, dst string, type string, operation string, ord bigint")
FINDINGS = ("id string, tool string, file string, line_number int, cwe_id int, severity string, issue_id int, message string")
SPANS = ("context_id string, file_path string, start_line int, end_line int")
