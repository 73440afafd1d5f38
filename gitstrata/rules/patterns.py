"""Line patterns, design evidence and technology evidence.

Line patterns are tried on single lines in any case, so expressions that need a
line break can never match and are not listed.
"""

from __future__ import annotations

# family, group, confidence
LINE_FAMILIES = {
    "design_patterns": 0.8, "quality_patterns": 0.7, "performance_patterns": 0.8,
    "security_patterns": 0.9, "modern_patterns": 0.8, "antipatterns": 0.8,
}

# family, group, name, level or severity, expressions
LINE_PATTERNS = [
    ("design_patterns", "creational", "singleton", "intermediate", [
        r"private\s+static\s+\w+\s+instance\s*=\s*null",
        r"getInstance\s*\(\s*\)\s*\{[\s\S]*?if\s*\(\s*instance\s*==\s*null\s*\)",
        r"export\s+default\s+new\s+\w+\s*\(\s*\)",
    ]),
    ("design_patterns", "creational", "factory", "intermediate", [
        r"interface\s+\w+Factory\s*\{[\s\S]*?create\w+\s*\(",
        r"static\s+\w+\s+create\w+\s*\(",
        r"export\s+const\s+create\w+\s*=\s*\(",
    ]),
    ("design_patterns", "creational", "builder", "intermediate", [
        r"\.with\w+\s*\([^)]*\)\s*\.with\w+\s*\(",
        r"return\s+this\s*;",
        r"chain\s*=\s*true",
    ]),
    ("design_patterns", "structural", "adapter", "intermediate", [
        r"implements\s+\w+Target\s*\{[\s\S]*?adapt\w*\s*\(",
        r"\.adapt\w*\s*\(",
        r"wrapper.*class",
    ]),
    ("design_patterns", "structural", "decorator", "advanced", [
        r"decorator\s*\(\s*\w+\s*\)",
        r"\.decorate\s*\(",
    ]),
    ("design_patterns", "structural", "facade", "intermediate", [
        r"interface\s+\w+Facade\s*\{[\s\S]*?simplify\w*\s*\(",
        r"\.facade\s*\(",
        r"unified\s+interface",
    ]),
    ("design_patterns", "behavioral", "observer", "intermediate", [
        r"interface\s+\w+Observer\s*\{[\s\S]*?update\s*\(",
        r"\.notify\w*\s*\(",
        r"\.subscribe\s*\(",
        r"\.addEventListener\s*\(",
    ]),
    ("design_patterns", "behavioral", "strategy", "intermediate", [
        r"interface\s+\w+Strategy\s*\{[\s\S]*?execute\s*\(",
        r"\.strategy\s*\.execute\s*\(",
        r"\.setStrategy\s*\(",
    ]),
    ("design_patterns", "behavioral", "command", "intermediate", [
        r"interface\s+\w+Command\s*\{[\s\S]*?execute\s*\(",
        r"\.execute\s*\(",
        r"\.undo\s*\(",
    ]),
    ("quality_patterns", "positive", "clean_code", "info", [
        r"const\s+\w+\s*=\s*\([^)]*\)\s*=>\s*\{",
        r"async\s+function\s+\w+\s*\(",
    ]),
    ("quality_patterns", "positive", "solid_principles", "info", [
        r"interface\s+\w+\s*\{",
        r"abstract\s+class\s+\w+\s*\{",
        r"class\s+\w+\s+implements\s+\w+",
        r"private\s+\w+\s+",
        r"final\s+class\s+\w+\s*\{",
    ]),
    ("quality_patterns", "positive", "functional_programming", "info", [
        r"\.map\s*\([^)]*\)",
        r"\.filter\s*\([^)]*\)",
        r"\.reduce\s*\([^)]*\)",
        r"const\s+\w+\s*=\s*\([^)]*\)\s*=>",
        r"immutable",
        r"\.pipe\s*\(",
    ]),
    ("quality_patterns", "negative", "code_smells", "warning", [
        r"if\s+.*\s+and\s+.*\s+and\s+.*\s+and\s+",
        r"function\s+\w+\s*\([^)]{100,}\)",
        r"for\s*\([^)]*\)\s*\{[\s\S]{500,}\}",
        r"var\s+\w+\s*=\s*\w+\s*;\s*var\s+\w+\s*=\s*\w+\s*;",
        r"TODO\s*:|FIXME\s*:|HACK\s*:",
    ]),
    ("quality_patterns", "negative", "duplicate_code", "warning", [
        r"class\s+\w+\s*\{[\s\S]{100,}\}\s*class\s+\w+\s*\{[\s\S]{100,}\}",
    ]),
    ("performance_patterns", "optimizations", "lazy_loading", "info", [
        r"lazy\s*\(\s*\(\)\s*=>\s*import\s*\(",
        r"React\.lazy\s*\(",
        r"\.lazy\s*\(",
        r"dynamic\s+import\s*\(",
        r"require\.ensure\s*\(",
    ]),
    ("performance_patterns", "optimizations", "memoization", "info", [
        r"React\.memo\s*\(",
        r"useMemo\s*\(",
        r"useCallback\s*\(",
        r"@memoize",
        r"\.memoize\s*\(",
        r"functools\.lru_cache",
    ]),
    ("performance_patterns", "optimizations", "pagination", "info", [
        r"\.skip\s*\(\s*\d+\s*\)\s*\.limit\s*\(",
        r"OFFSET\s+\d+\s+LIMIT\s+\d+",
        r"\.slice\s*\(\s*\d+\s*,\s*\d+\s*\)",
        r"page\s*=\s*\d+",
        r"cursor\s*=",
    ]),
    ("performance_patterns", "bottlenecks", "n_plus_one", "error", [
        r"forEach\s*\([^)]*\)\s*\{[\s\S]*?\.query\s*\(",
        r"while\s*\([^)]*\)\s*\{[\s\S]*?SELECT",
        r"\.map\s*\([^)]*\)\s*\.query\s*\(",
    ]),
    ("performance_patterns", "bottlenecks", "inefficient_loops", "warning", [
        r"for\s*\([^)]*\)\s*\{[\s\S]*?for\s*\([^)]*\)\s*\{[\s\S]*?for\s*\([^)]*\)\s*\{",
        r"\.indexOf\s*\([^)]*\)\s*!=\s*-1",
        r"\.split\s*\([^)]*\)\[0\]",
        r"JSON\.parse\s*\([^)]*\)\s*in\s+loop",
    ]),
    ("security_patterns", "vulnerabilities", "sql_injection", "error", [
        r"SELECT\s+.*\+.*['\"]",
        r"INSERT\s+.*\+.*['\"]",
        r"UPDATE\s+.*\+.*['\"]",
        r"DELETE\s+.*\+.*['\"]",
        r"cursor\.execute\s*\(\s*['\"][^'\"]*['\"].+\+.+\)",
        r"Statement.*executeQuery\s*\([^?]*\+",
    ]),
    ("security_patterns", "vulnerabilities", "xss", "error", [
        r"innerHTML\s*=\s*[^;]*\+",
        r"document\.write\s*\([^)]*\+",
        r"\.html\s*\([^)]*\+",
        r"dangerouslySetInnerHTML",
        r"eval\s*\(",
    ]),
    ("security_patterns", "vulnerabilities", "hardcoded_secrets", "error", [
        r"password\s*=\s*['\"][^'\"]{8,}['\"]",
        r"api_key\s*=\s*['\"][^'\"]{20,}['\"]",
        r"secret\s*=\s*['\"][^'\"]{10,}['\"]",
        r"token\s*=\s*['\"][^'\"]{20,}['\"]",
        r"AWS_SECRET_ACCESS_KEY\s*=",
        r"PRIVATE_KEY\s*=",
    ]),
    ("security_patterns", "best_practices", "input_validation", "info", [
        r"validate\s*\([^)]*\)",
        r"sanitize\s*\([^)]*\)",
        r"\.isEmail\s*\(",
        r"\.isLength\s*\(",
        r"\.matches\s*\(",
        r"validator\.",
    ]),
    ("security_patterns", "best_practices", "authentication", "info", [
        r"bcrypt\.",
        r"jwt\.",
        r"passport\.",
        r"oauth\.",
        r"session\.",
        r"middleware.*auth",
    ]),
    ("modern_patterns", "", "microservices", "advanced", [
        r"@RestController", r"@Service", r"@Repository", r"@Component", r"@Microservice", r"@EnableEurekaClient", r"docker-compose", r"kubernetes",
    ]),
    ("modern_patterns", "", "reactive", "advanced", [
        r"Observable\.", r"\.subscribe\s*\(", r"\.map\s*\([^)]*\)\s*\.filter\s*\(", r"@Reactive", r"Flux\.", r"Mono\.", r"\.flatMap\s*\(",
    ]),
    ("modern_patterns", "", "serverless", "intermediate", [
        r"@Function", r"exports\.handler\s*=", r"lambda\s+function", r"serverless\.", r"@aws_lambda", r"vercel\.", r"netlify\.",
    ]),
    ("antipatterns", "", "god_object", "warning", [
        r"class\s+\w+\s*\{[\s\S]{1000,}\}",
        r"class\s+\w+\s*\{[\s\S]*?def\s+\w+[\s\S]*?def\s+\w+[\s\S]*?def\s+\w+[\s\S]*?def\s+\w+[\s\S]*?def\s+\w+",
    ]),
    ("antipatterns", "", "spaghetti_code", "warning", [r"goto\s+\w+"]),
    ("antipatterns", "", "copy_paste", "warning", [
        r"class\s+\w+\s*\{[\s\S]{100,}\}\s*class\s+\w+\s*\{[\s\S]{100,}\}",
    ]),
]

# Design evidence: pattern, language, expressions; confidence is the matched share.
DESIGN_EVIDENCE = [
    ("singleton", "python", [r"class\s+\w+.*:\s*\n.*_instance\s*=\s*None", r"def\s+__new__\s*\(cls.*\):", r"if\s+cls\._instance\s+is\s+None:"]),
    ("singleton", "javascript", [r"var\s+\w+\s*=\s*\(\s*function\s*\(\s*\)\s*\{", r"return\s*\{\s*getInstance\s*:", r"if\s*\(\s*instance\s*===?\s*(undefined|null)\s*\)"]),
    ("singleton", "java", [r"private\s+static\s+\w+\s+instance", r"public\s+static\s+\w+\s+getInstance\s*\(\s*\)", r"private\s+\w+\s*\(\s*\)\s*\{"]),
    ("factory", "python", [r"def\s+create_\w+\s*\(", r"class\s+\w*Factory\w*:", r"def\s+make_\w+\s*\("]),
    ("factory", "javascript", [r"function\s+create\w+\s*\(", r"class\s+\w*Factory\w*", r"\w+Factory\s*=\s*\{"]),
    ("factory", "java", [r"class\s+\w*Factory\w*", r"public\s+\w+\s+create\w+\s*\(", r"static\s+\w+\s+create\s*\("]),
    ("observer", "python", [r"class\s+\w*Observer\w*:", r"def\s+notify\s*\(", r"def\s+update\s*\(", r"def\s+subscribe\s*\(", r"observers\s*=\s*\[\]"]),
    ("observer", "javascript", [r"class\s+\w*Observer\w*", r"addEventListener\s*\(", r"on\s*\(\s*['\"].*['\"]", r"observers\s*=\s*\[\]"]),
    ("observer", "java", [r"class\s+\w*Observer\w*", r"interface\s+\w*Observer\w*", r"void\s+update\s*\(", r"addObserver\s*\("]),
    ("strategy", "python", [r"class\s+\w*Strategy\w*:", r"def\s+execute\s*\(", r"strategy\s*=\s*\w+Strategy"]),
    ("strategy", "javascript", [r"class\s+\w*Strategy\w*", r"strategy\s*:\s*\w+Strategy", r"execute\s*:\s*function"]),
    ("strategy", "java", [r"interface\s+\w*Strategy\w*", r"class\s+\w*Strategy\w*", r"void\s+execute\s*\("]),
    ("decorator", "python", [r"@\w+", r"def\s+\w*decorator\w*\s*\(", r"def\s+wrapper\s*\(", r"functools\.wraps"]),
    ("decorator", "javascript", [r"function\s+\w*decorator\w*\s*\(", r"class\s+\w*Decorator\w*", r"wrapper\s*=\s*function"]),
    ("decorator", "java", [r"@\w+", r"class\s+\w*Decorator\w*", r"extends\s+\w*Decorator\w*"]),
    ("repository", "python", [r"class\s+\w*Repository\w*:", r"def\s+find_by_\w+\s*\(", r"def\s+save\s*\(", r"def\s+delete\s*\("]),
    ("repository", "javascript", [r"class\s+\w*Repository\w*", r"findBy\w+\s*\(", r"save\s*\(", r"delete\s*\("]),
    ("repository", "java", [r"interface\s+\w*Repository\w*", r"class\s+\w*Repository\w*", r"findBy\w+\s*\(", r"@Repository"]),
    ("dependency_injection", "python", [r"def\s+__init__\s*\(self.*:\s*\w+", r"@inject", r"container\.register", r"dependency\s*=\s*\w+\(\)"]),
    ("dependency_injection", "javascript", [r"constructor\s*\(\s*\w+\s*:\s*\w+", r"@Injectable", r"container\.register", r"inject\s*\("]),
    ("dependency_injection", "java", [r"@Autowired", r"@Inject", r"@Component", r"@Service"]),
]

# Technology evidence: category, technology, expressions; 0.3 per matched one, at most 1.
TECHNOLOGY_EVIDENCE = [
    ("frontend_frameworks", "react", [r"import\s+React\s+from\s+['\"]react['\"]", r"from\s+['\"]react['\"]", r"React\.(Component|useState|useEffect)", r"\.jsx?$", r"\.tsx?$"]),
    ("frontend_frameworks", "vue", [r"import\s+.*\s+from\s+['\"]vue['\"]", r"Vue\.(component|directive|mixin)", r"\.vue$", r"<template>", r"vue-cli|@vue/cli"]),
    ("frontend_frameworks", "angular", [r"import\s+.*\s+from\s+['\"]@angular/", r"@Component\s*\(", r"@Injectable\s*\(", r"@NgModule\s*\(", r"\.module\.ts$"]),
    ("frontend_frameworks", "svelte", [r"<script\s+context=['\"]module['\"]>", r"svelte:", r"\.svelte$", r"import.*from\s+['\"]svelte['\"]"]),
    ("backend_frameworks", "express", [r"const\s+express\s*=\s*require\s*\(\s*['\"]express['\"]\s*\)", r"import\s+express\s+from\s+['\"]express['\"]", r"app\.(get|post|put|delete)\s*\(", r"express\.Router\s*\("]),
    ("backend_frameworks", "fastapi", [r"from\s+fastapi\s+import", r"@app\.(get|post|put|delete)\s*\(", r"FastAPI\s*\(", r"from\s+pydantic\s+import"]),
    ("backend_frameworks", "django", [r"from\s+django\s+import", r"Django\s+version", r"INSTALLED_APPS\s*=", r"urlpatterns\s*="]),
    ("backend_frameworks", "spring_boot", [r"@SpringBootApplication", r"@RestController", r"@Service", r"@Repository", r"org\.springframework"]),
    ("mobile_frameworks", "react_native", [r"import\s+.*\s+from\s+['\"]react-native['\"]", r"View|Text|Image.*from\s+['\"]react-native['\"]", r"\.android\.js$", r"\.ios\.js$"]),
    ("mobile_frameworks", "flutter", [r"import\s+'package:flutter/", r"Widget\s+", r"StatelessWidget|StatefulWidget", r"\.dart$"]),
    ("mobile_frameworks", "ionic", [r"@ionic/", r"ion-", r"ionic-angular", r"@ionic/react"]),
    ("build_tools", "webpack", [r"webpack\.config\.", r"require\s*\(\s*['\"]webpack['\"]\s*\)", r"module\.exports\s*=\s*\{", r"entry:\s*"]),
    ("build_tools", "vite", [r"vite\.config\.", r"import\s+.*\s+from\s+['\"]vite['\"]", r"defineConfig\s*\("]),
    ("build_tools", "rollup", [r"rollup\.config\.", r"import\s+.*\s+from\s+['\"]rollup['\"]"]),
    ("testing_frameworks", "jest", [r"describe\s*\(", r"it\s*\(", r"test\s*\(", r"expect\s*\(", r"\.test\.js$", r"\.spec\.js$"]),
    ("testing_frameworks", "cypress", [r"cy\.(get|visit|click)", r"describe\s*\(", r"it\s*\(", r"cypress\.json"]),
    ("testing_frameworks", "playwright", [r"from\s+playwright\s+import", r"page\.(click|fill|get)", r"test\s*\(", r"playwright\.config\."]),
]

# File names of tools, and deployment files (a name, or a part of a path in a subdirectory).
CONFIG_FILES = [
    ("webpack.config.js", "Webpack", "build_tools"), ("vite.config.js", "Vite", "build_tools"), ("rollup.config.js", "Rollup", "build_tools"),
    ("next.config.js", "Next.js", "frontend_frameworks"), ("nuxt.config.js", "Nuxt.js", "frontend_frameworks"), ("gatsby-config.js", "Gatsby", "frontend_frameworks"),
    ("tailwind.config.js", "Tailwind CSS", "css_frameworks"), ("postcss.config.js", "PostCSS", "css_tools"), ("eslint.config.js", "ESLint", "development_tools"),
    ("prettier.config.js", "Prettier", "development_tools"), ("jest.config.js", "Jest", "testing_frameworks"), ("cypress.json", "Cypress", "testing_frameworks"),
    ("playwright.config.js", "Playwright", "testing_frameworks"), ("tsconfig.json", "TypeScript", "development_tools"), ("babel.config.js", "Babel", "development_tools"),
]
DEPLOYMENT_FILES = [
    ("dockerfile", "Docker", "containerization"), ("docker-compose.yml", "Docker Compose", "containerization"), ("docker-compose.yaml", "Docker Compose", "containerization"),
    ("vercel.json", "Vercel", "cloud_platforms"), ("netlify.toml", "Netlify", "cloud_platforms"), ("railway.json", "Railway", "cloud_platforms"),
    ("heroku.yml", "Heroku", "cloud_platforms"), ("procfile", "Heroku", "cloud_platforms"), ("k8s.yml", "Kubernetes", "container_orchestration"),
    ("kubernetes.yml", "Kubernetes", "container_orchestration"), (".github/workflows/", "GitHub Actions", "ci_cd"), (".gitlab-ci.yml", "GitLab CI", "ci_cd"),
    ("jenkinsfile", "Jenkins", "ci_cd"), ("travis.yml", "Travis CI", "ci_cd"), ("circle.yml", "CircleCI", "ci_cd"),
]
