"""What directories and file names say about an architecture."""

# Parts of top-level directory names per style.
DIRECTORY_INDICATORS = {
    "mvc": ["controllers", "models", "views", "templates"],
    "clean_architecture": ["domain", "usecases", "adapters", "frameworks", "entities"],
    "layered": ["presentation", "business", "data", "persistence"],
    "microservices": ["services", "api", "gateway", "discovery"],
    "component_based": ["components", "modules", "widgets"],
    "event_driven": ["events", "handlers", "subscribers", "publishers"],
}

# Path expressions (any case) per style and kind of file, and how many kinds are needed.
FILE_PATTERNS = {
    "mvc": (2, {
        "controllers": [r".*[Cc]ontroller\..*", r".*[Cc]trl\..*"],
        "models": [r".*[Mm]odel\..*", r".*[Ee]ntity\..*"],
        "views": [r".*[Vv]iew\..*", r".*[Tt]emplate\..*", r".*\.html$", r".*\.jsx$", r".*\.vue$"],
    }),
    "clean_architecture": (3, {
        "entities": [r".*[Ee]ntit(y|ies).*", r".*[Dd]omain.*"],
        "use_cases": [r".*[Uu]se[Cc]ase.*", r".*[Ss]ervice.*", r".*[Ii]nteractor.*"],
        "adapters": [r".*[Aa]dapter.*", r".*[Gg]ateway.*", r".*[Rr]epository.*"],
        "frameworks": [r".*[Cc]ontroller.*", r".*[Pp]resenter.*"],
    }),
    "microservices": (2, {
        "services": [r".*[Ss]ervice.*", r".*[Aa]pi.*"],
        "docker": [r"[Dd]ockerfile.*", r"docker-compose\..*"],
        "config": [r".*config.*", r".*\.env.*", r"k8s/.*", r"kubernetes/.*"],
    }),
}

LAYERS = {
    "presentation": ["view", "ui", "frontend", "web", "controller"],
    "business": ["service", "business", "domain", "logic", "usecase"],
    "data": ["data", "repository", "dao", "persistence", "model"],
    "infrastructure": ["config", "util", "common", "shared", "infrastructure"],
}

IMPORT_LINE = r"(?m)^(import|from|#include|require\()"
PYTHON_LOCAL = r"from\s+\..*?\s+import|import\s+\..*"
SCRIPT_LOCAL = r"import.*?from\s+['\"]\..*?['\"]"
