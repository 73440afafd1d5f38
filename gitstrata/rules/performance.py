"""Performance rules, matched over whole texts in any case.

Expressions are Python ``re`` text with a literal brace escaped; ``MULTILINE``
applies to all and ``IGNORECASE`` to all but those bound to a language.
"""

from __future__ import annotations

# name, severity, category, expressions; confidence depends on the line
PERFORMANCE = [
    ("n_plus_one_queries", "high", "database", [
        r"for\s+\w+\s+in\s+\w+:\s*\n\s*\w+\.query\(",
        r"forEach\s*\(\s*\w+\s*=>\s*\{[\s\S]*?query\(",
        r"for\s*\(\s*\w+[\s\S]*?\)\s*\{[\s\S]*?query\(",
        r"while\s*\([\s\S]*?\)\s*\{[\s\S]*?SELECT",
    ]),
    ("inefficient_loops", "medium", "algorithmic", [
        r"for\s+\w+\s+in\s+range\s*\(\s*len\s*\(\s*\w+\s*\)\s*\):",
        r"for\s*\(\s*let\s+\w+\s*=\s*0;\s*\w+\s*<\s*\w+\.length",
        r"for\s+\w+\s+in\s+\w+:\s*\n\s*for\s+\w+\s+in\s+\w+:",
        r"while\s+\w+\s*<\s*len\s*\(\s*\w+\s*\):",
    ]),
    ("string_concatenation", "medium", "memory", [
        r"(\w+\s*\+=\s*[\"'].*[\"']|\w+\s*=\s*\w+\s*\+\s*[\"'])",
        r"for\s+\w+\s+in\s+\w+:\s*\n\s*\w+\s*\+=",
        r"while\s+.*:\s*\n\s*\w+\s*\+=\s*[\"']",
        r"String\.concat\s*\(",
    ]),
    ("synchronous_io", "high", "io", [
        r"open\s*\(\s*['\"][^'\"]*['\"].*?\)\.read\s*\(\s*\)",
        r"fs\.readFileSync\s*\(",
        r"requests\.get\s*\(",
        r"urllib\.request\.urlopen\s*\(",
        r"fetch\s*\([^)]*\)\.then",
    ]),
    ("inefficient_data_structures", "medium", "algorithmic", [
        r"list\s*\(\s*set\s*\(\s*\w+\s*\)\s*\)",
        r"for\s+\w+\s+in\s+\w+:\s*\n\s*if\s+\w+\s+in\s+\w+:",
        r"\.index\s*\(\s*\w+\s*\)",
        r"\.count\s*\(\s*\w+\s*\)",
        r"Array\.prototype\.indexOf\.call",
    ]),
    ("memory_leaks", "high", "memory", [
        r"addEventListener\s*\([^)]*\)(?![\s\S]*removeEventListener)",
        r"setInterval\s*\([^)]*\)(?![\s\S]*clearInterval)",
        r"setTimeout\s*\([^)]*\)(?![\s\S]*clearTimeout)",
        r"new\s+\w+\s*\([^)]*\)(?![\s\S]*\.close\(\))",
        r"open\s*\([^)]*\)(?![\s\S]*\.close\(\))",
    ]),
    ("inefficient_regex", "medium", "algorithmic", [
        r"re\.compile\s*\([^)]*\).*?re\.compile\s*\(",
        r"new\s+RegExp\s*\([^)]*\).*?new\s+RegExp\s*\(",
        r"re\.search\s*\(['\"][^'\"]*\*[^'\"]*['\"]",
        r"Pattern\.compile\s*\([^)]*\).*?Pattern\.compile\s*\(",
    ]),
    ("blocking_ui_operations", "high", "rendering", [
        r"document\.write\s*\(",
        r"alert\s*\(",
        r"confirm\s*\(",
        r"prompt\s*\(",
        r"while\s*\(\s*true\s*\)",
        r"for\s*\(\s*;\s*;\s*\)",
    ]),
    ("inefficient_dom_operations", "medium", "rendering", [
        r"for\s*\([^)]*\)\s*\{\s*document\.",
        r"while\s*\([^)]*\)\s*\{\s*\w+\.appendChild",
        r"getElementsBy.*\s*\([^)]*\).*getElementsBy",
        r"querySelector.*\([^)]*\).*querySelector",
    ]),
    ("poor_error_handling", "low", "anti_pattern", [
        r"try:\s*\n[\s\S]*?\nexcept:\s*\n\s*pass",
        r"try\s*\{\s*[\s\S]*?\s*\}\s*catch\s*\([^)]*\)\s*\{\s*\}",
        r"@silenced",
        r"error_reporting\s*\(\s*0\s*\)",
    ]),
]

# name, severity, expressions, complexity; category algorithmic, confidence 0.8
COMPLEXITY = [
    ("nested_loops", "medium", [
        r"for\s+\w+.*:\s*\n.*for\s+\w+.*:",
        r"for\s*\([^)]*\)\s*\{\s*[^}]*for\s*\(",
        r"while\s*\([^)]*\)\s*\{\s*[^}]*while\s*\(",
    ], "O(n²)"),
    ("triple_nested_loops", "high", [
        r"for\s+\w+.*:\s*\n.*for\s+\w+.*:\s*\n.*for\s+\w+.*:",
        r"for\s*\([^)]*\)\s*\{\s*[^}]*for\s*\([^)]*\)\s*\{\s*[^}]*for\s*\(",
    ], "O(n³)"),
    ("recursive_without_memoization", "high", [
        r"def\s+(\w+)\s*\([^)]*\):\s*[^{]*return.*\1\s*\(",
        r"function\s+(\w+)\s*\([^)]*\)\s*\{\s*[^}]*return.*\1\s*\(",
    ], "Exponential"),
]

# name, severity, expressions; category memory, confidence 0.7
MEMORY = [
    ("large_objects_in_loops", "medium", [
        r"for\s+\w+.*:\s*\n.*\[\s*\]",
        r"for\s+\w+.*:\s*\n.*\{\s*\}",
        r"while\s*\([^)]*\)\s*\{\s*[^}]*new\s+Array",
        r"for\s*\([^)]*\)\s*\{\s*[^}]*new\s+Object",
    ]),
    ("unnecessary_copying", "low", [
        r"list\s*\(\s*\w+\s*\)",
        r"dict\s*\(\s*\w+\s*\)",
        r"Array\.from\s*\(\s*\w+\s*\)",
        r"Object\.assign\s*\(\s*\{\s*\}\s*,\s*\w+\s*\)",
    ]),
]

# name, severity, expressions; category concurrency, confidence 0.6
CONCURRENCY = [
    ("race_conditions", "high", [
        r"threading\.Thread.*shared_var",
        r"asyncio\.create_task.*global\s+\w+",
        r"new\s+Worker.*postMessage",
    ]),
    ("blocking_in_async", "high", [
        r"async\s+def\s+\w+.*:\s*[^{}]*time\.sleep",
        r"async\s+function\s+\w+.*\{\s*[^}]*Thread\.sleep",
        r"await.*requests\.get",
    ]),
]

# name, languages, severity, category, confidence, auto-fixable, expressions (case counts)
BY_LANGUAGE = [
    ("python_list_comp", "python", "low", "algorithmic", 0.8, True, [
        r"for\s+\w+\s+in\s+\w+:\s*\n\s*\w+\.append\s*\(",
    ]),
    ("js_array", "javascript typescript", "low", "algorithmic", 0.7, False, [
        r"for\s*\(\s*let\s+\w+\s*=\s*0;\s*\w+\s*<\s*\w+\.length;\s*\w+\+\+\s*\)",
        r"\.map\s*\([^)]*\)\.filter\s*\([^)]*\)",
        r"\.filter\s*\([^)]*\)\.map\s*\([^)]*\)",
    ]),
    ("java_string", "java", "medium", "memory", 0.9, True, [
        r"for\s*\([^)]*\)\s*\{\s*[^}]*\+\s*=.*String",
    ]),
]

CATEGORIES = [
    "algorithmic", "memory", "io", "database", "network", "concurrency", "caching", "rendering", "resource_management", "anti_pattern",
]
AUTO_FIXABLE = ["inefficient_loops", "string_concatenation"]
IMPACT = {"critical": "high", "high": "high", "medium": "medium", "low": "low", "info": "low"}
