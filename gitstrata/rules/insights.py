"""Thresholds and word families behind the insights. Titles are ours."""

# metric, at least, above, below, at most, kind, title, category, priority, confidence, impact
THRESHOLDS = [
    ("quality_score", 90, None, None, None, "achievement", "quality is excellent", "code_quality", "low", 0.9, 0.3),
    ("quality_score", 70, None, 90, None, "recommendation", "quality is good and can improve", "code_quality", "medium", 0.8, 0.6),
    ("quality_score", None, None, 70, None, "improvement", "quality needs attention", "code_quality", "high", 0.9, 0.9),
    ("advanced_minus_simple", None, 0, None, None, "recommendation", "complexity is high", "complexity", "medium", 0.7, 0.7),
    ("maintainability_index", 80, None, None, None, "achievement", "easy to maintain", "maintainability", "low", 0.8, 0.3),
    ("maintainability_index", None, None, 60, None, "improvement", "hard to maintain", "maintainability", "high", 0.85, 0.8),
    ("technical_debt_score", None, 60, None, None, "warning", "debt is high", "debt", "critical", 0.9, 1.0),
    ("technical_debt_score", None, 30, None, 60, "recommendation", "debt is manageable", "debt", "medium", 0.8, 0.7),
    ("testability_score", 80, None, None, None, "achievement", "easy to test", "testability", "low", 0.75, 0.3),
    ("testability_score", None, None, 60, None, "recommendation", "hard to test", "testability", "medium", 0.8, 0.6),
    ("documentation_coverage", 80, None, None, None, "achievement", "well documented", "documentation", "low", 0.7, 0.3),
    ("documentation_coverage", None, None, 50, None, "recommendation", "little documentation", "documentation", "medium", 0.8, 0.5),
    ("style_consistency", None, None, 70, None, "recommendation", "style is uneven", "style", "low", 0.75, 0.4),
    ("technology_count", None, 10, None, None, "trend", "many technologies", "technology", "low", 0.8, 0.4),
    ("technology_count", None, None, 3, None, "recommendation", "few technologies", "technology", "medium", 0.7, 0.6),
    ("modern_technologies", 1, None, None, None, "achievement", "modern technologies", "technology", "low", 0.8, 0.3),
    ("outdated_technologies", 1, None, None, None, "recommendation", "outdated technologies", "technology", "medium", 0.8, 0.7),
    ("design_names", 3, None, None, None, "achievement", "well structured", "architecture", "low", 0.8, 0.3),
    ("smell_names", 1, None, None, None, "improvement", "architectural debt", "architecture", "high", 0.8, 0.8),
    ("performance_names", 1, None, None, None, "achievement", "performance is looked after", "performance", "low", 0.8, 0.3),
    ("slow_names", 1, None, None, None, "recommendation", "performance can improve", "performance", "high", 0.8, 0.8),
    ("secure_names", 1, None, None, None, "achievement", "security is looked after", "security", "low", 0.8, 0.3),
    ("insecure_names", 1, None, None, None, "warning", "security weaknesses", "security", "critical", 0.9, 1.0),
    ("modern_names", 1, None, None, None, "trend", "modern patterns", "trends", "low", 0.8, 0.4),
    ("commit_rate", None, 10, None, None, "achievement", "active development", "evolution", "low", 0.8, 0.3),
    ("commit_rate", None, 0, 2, None, "recommendation", "little activity", "evolution", "medium", 0.7, 0.6),
]

# Words in pattern names per counted family.
NAME_FAMILIES = {
    "design_names": ["singleton", "factory", "observer", "strategy"],
    "smell_names": ["antipattern", "smell"],
    "performance_names": ["lazy", "memo", "cache", "optimization"],
    "slow_names": ["n_plus_one", "inefficient", "bottleneck"],
    "secure_names": ["validation", "authentication", "encryption", "secure"],
    "insecure_names": ["injection", "xss", "hardcoded", "vulnerability"],
    "modern_names": ["react", "vue", "async", "functional", "microservice"],
}

# The rule-based view: same columns, priority and weights are not used there.
PATTERN_THRESHOLDS = [
    ("advanced_patterns", 1, None, None, None, "achievement", "advanced patterns", "patterns", None, None, None),
    ("antipatterns", 1, None, None, None, "warning", "antipatterns present", "patterns", None, None, None),
    ("pattern_count", None, 15, None, None, "trend", "many patterns", "patterns", None, None, None),
    ("technology_count", None, 10, None, None, "trend", "many technologies", "technology", None, None, None),
    ("technology_count", None, 5, None, 10, "recommendation", "balanced technologies", "technology", None, None, None),
    ("technology_count", None, 0, None, 5, "recommendation", "focused technologies", "technology", None, None, None),
    ("pattern_quality", 80, None, None, None, "achievement", "high quality", "quality", None, None, None),
    ("pattern_quality", 60, None, 80, None, "recommendation", "good quality", "quality", None, None, None),
    ("pattern_quality", None, None, 60, None, "warning", "quality needs attention", "quality", None, None, None),
    ("architecture_patterns", 1, None, None, None, "achievement", "sound architecture", "architecture", None, None, None),
    ("technology_count", None, 8, None, None, "recommendation", "review the architecture", "architecture", None, None, None),
    ("patterns_per_commit", None, 0.5, None, None, "trend", "patterns change fast", "evolution", None, None, None),
    ("patterns_per_commit", None, 0.2, None, 0.5, "trend", "patterns grow steadily", "evolution", None, None, None),
]
ARCHITECTURE_NAMES = ["mvc", "mvp", "mvvm", "facade", "adapter", "strategy"]

PRIORITY = {"critical": 5, "high": 4, "medium": 3, "low": 2}

TECHNOLOGY_ERA = {
    "modern": [
        "React", "Vue.js", "Angular", "Svelte", "Next.js", "Nuxt.js", "FastAPI", "Express.js", "Spring Boot", "Django", "NestJS",
        "React Native", "Flutter", "Ionic", "Vite", "Webpack", "TypeScript", "ESLint", "Prettier",
    ],
    "outdated": [
        "jQuery", "AngularJS", "Backbone.js", "Knockout.js", "PHP 5", "ASP.NET Web Forms", "Struts", "EJB 2.x", "Grunt", "Gulp", "Bower", "RequireJS",
    ],
    "emerging": ["SolidJS", "Qwik", "SvelteKit", "Astro", "Deno", "Bun", "Cloudflare Workers", "Turborepo", "Nx", "Rome", "SWC"],
}

# Heuristic scores from pattern names.
SECURITY_WORDS = ["sql", "injection", "xss", "csrf", "auth"]
FAST_WORDS = ["cache", "pool", "lazy", "singleton"]
SLOW_WORDS = ["god_object", "spaghetti", "lava_flow"]
STRUCTURE_WORDS = ["mvc", "mvp", "adapter", "facade", "strategy", "observer"]
CRITICAL_WORDS = ["sql_injection", "command_injection"]
HIGH_WORDS = ["auth", "session", "crypto"]

# Pattern families by words in the name, and design patterns with their confidence.
SECURITY_FAMILY = ["auth", "security", "validation", "crypto", "hash"]
PERFORMANCE_FAMILY = ["cache", "pool", "lazy", "singleton", "flyweight"]
PERFORMANCE_NEGATIVE = ["god_object", "spaghetti"]
DESIGN_CONFIDENCE = {
    "singleton": 0.9, "factory": 0.85, "adapter": 0.8, "facade": 0.85, "strategy": 0.8, "observer": 0.75, "decorator": 0.8, "mvc": 0.9, "mvp": 0.85,
}

# Complexity regrouping by words in the name and by use.
EXPERT_WORDS = ["async", "concurrent", "reactive", "decorator", "observer", "strategy"]
ADVANCED_WORDS = ["factory", "builder", "adapter", "facade"]
INTERMEDIATE_WORDS = ["function", "class", "method"]
