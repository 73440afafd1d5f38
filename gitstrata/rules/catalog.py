"""Packages and the technology each one stands for.

The list of npm packages is long and open-ended; it is a parameter
(``identify(..., catalog=...)``), and only the names that have a rule of their
own are kept here.
"""

from __future__ import annotations

# ecosystem -> kind -> package: technology. These match the whole package name.
EXACT = {
    "python": {
        "framework": {
            "django": "Django", "flask": "Flask", "fastapi": "FastAPI", "tornado": "Tornado", "pyramid": "Pyramid", "bottle": "Bottle",
            "aiohttp": "aiohttp", "starlette": "Starlette", "sanic": "Sanic",
        },
        "library": {
            "numpy": "NumPy", "pandas": "Pandas", "scipy": "SciPy", "matplotlib": "Matplotlib", "seaborn": "Seaborn", "plotly": "Plotly",
            "scikit-learn": "scikit-learn", "tensorflow": "TensorFlow", "torch": "PyTorch", "keras": "Keras", "opencv-python": "OpenCV",
            "pillow": "Pillow", "requests": "Requests", "beautifulsoup4": "BeautifulSoup", "scrapy": "Scrapy", "sqlalchemy": "SQLAlchemy",
            "psycopg2": "psycopg2", "pymongo": "PyMongo", "redis": "Redis-py", "celery": "Celery",
        },
        "tool": {
            "pytest": "pytest", "black": "Black", "flake8": "flake8", "mypy": "mypy", "pylint": "Pylint", "jupyterlab": "JupyterLab",
            "notebook": "Jupyter Notebook",
        },
    },
    "rust": {
        "framework": {
            "actix-web": "Actix Web", "warp": "Warp", "rocket": "Rocket", "axum": "Axum", "tide": "Tide", "tokio": "Tokio",
            "async-std": "async-std", "hyper": "Hyper", "tauri": "Tauri", "egui": "egui", "iced": "Iced", "druid": "Druid", "slint": "Slint",
            "gtk4": "GTK4", "fltk": "FLTK", "bevy": "Bevy", "amethyst": "Amethyst", "ggez": "ggez", "yew": "Yew", "leptos": "Leptos",
            "dioxus": "Dioxus",
        },
        "library": {
            "serde": "Serde", "serde_json": "Serde JSON", "toml": "TOML", "reqwest": "Reqwest", "surf": "Surf", "clap": "Clap",
            "structopt": "StructOpt", "diesel": "Diesel", "sqlx": "SQLx", "rusqlite": "rusqlite", "mongodb": "MongoDB", "chrono": "Chrono",
            "time": "Time", "uuid": "UUID", "regex": "Regex", "thiserror": "thiserror", "anyhow": "anyhow", "log": "log",
            "env_logger": "env_logger", "tracing": "Tracing", "ring": "Ring", "rustls": "rustls", "proptest": "proptest",
            "quickcheck": "quickcheck",
        },
    },
    "ruby": {
        "framework": {"rails": "Ruby on Rails", "sinatra": "Sinatra", "hanami": "Hanami", "roda": "Roda", "grape": "Grape"},
        "library": {
            "devise": "Devise", "rspec": "RSpec", "factory_bot": "Factory Bot", "sidekiq": "Sidekiq", "redis": "Redis", "pg": "PostgreSQL",
        },
    },
    "php": {
        "framework": {
            "laravel/framework": "Laravel", "symfony/symfony": "Symfony", "cakephp/cakephp": "CakePHP",
            "codeigniter4/framework": "CodeIgniter", "slim/slim": "Slim",
        },
        "library": {
            "doctrine/orm": "Doctrine ORM", "monolog/monolog": "Monolog", "guzzlehttp/guzzle": "Guzzle", "phpunit/phpunit": "PHPUnit",
            "predis/predis": "Predis",
        },
    },
    "dart": {
        "framework": {"flutter": "Flutter", "angular": "AngularDart", "shelf": "Shelf"},
        "library": {"http": "HTTP", "dio": "Dio", "provider": "Provider", "bloc": "BLoC", "riverpod": "Riverpod"},
    },
    "javascript": {
        "frontend_frameworks": {
            "react": "React", "@types/react": "React", "vue": "Vue.js", "@vue/cli-service": "Vue.js", "next": "Next", "nuxt": "Nuxt",
            "gatsby": "Gatsby",
        },
        "backend_frameworks": {"express": "Express.js"},
        "testing_frameworks": {
            "jest": "Jest", "vitest": "Vitest", "mocha": "Mocha", "jasmine": "Jasmine", "cypress": "Cypress", "playwright": "Playwright",
            "@playwright/test": "Playwright/Test",
        },
        "build_tools": {"webpack": "Webpack", "vite": "Vite", "rollup": "Rollup", "parcel": "Parcel"},
        "development_tools": {"eslint": "Eslint", "prettier": "Prettier", "typescript": "Typescript"},
        "databases": {"mongoose": "MongoDB", "sequelize": "Sequelize", "prisma": "Prisma", "@prisma/client": "Prisma"},
        "cloud_services": {"aws-sdk": "AWS SDK"},
    },
    "python-build": {
        "tool": {"poetry": "Poetry", "setuptools": "Setuptools", "flit": "Flit", "hatch": "Hatch"},
    },
}

# ecosystem, kind, start of the package name, technology
PREFIXES = [
    ("javascript", "frontend_frameworks", "@angular/", "Angular"),
    ("javascript", "cloud_services", "aws-", "AWS SDK"),
    ("javascript", "cloud_services", "@azure/", "Azure SDK"),
]

# ecosystem -> kind -> part of the package name: technology
PARTS = {
    "go": {
        "framework": {
            "github.com/gin-gonic/gin": "Gin", "github.com/gorilla/mux": "Gorilla Mux", "github.com/labstack/echo": "Echo",
            "github.com/gofiber/fiber": "Fiber", "github.com/beego/beego": "Beego", "github.com/go-chi/chi": "Chi",
            "github.com/valyala/fasthttp": "FastHTTP", "github.com/kataras/iris": "Iris", "github.com/go-martini/martini": "Martini",
            "github.com/revel/revel": "Revel", "github.com/grpc/grpc-go": "gRPC", "go.micro.dev/v4": "Go Micro",
            "github.com/go-kit/kit": "Go Kit", "github.com/99designs/gqlgen": "gqlgen", "github.com/graphql-go/graphql": "GraphQL Go",
            "github.com/spf13/cobra": "Cobra", "github.com/urfave/cli": "CLI",
        },
        "library": {
            "gorm.io/gorm": "GORM", "github.com/jmoiron/sqlx": "SQLx", "go.mongodb.org/mongo-driver": "MongoDB Driver",
            "github.com/go-redis/redis": "Redis Client", "github.com/go-sql-driver/mysql": "MySQL Driver", "github.com/lib/pq": "PostgreSQL Driver",
            "github.com/mattn/go-sqlite3": "SQLite Driver", "google.golang.org/protobuf": "Protocol Buffers", "gopkg.in/yaml.v3": "YAML",
            "github.com/BurntSushi/toml": "TOML", "github.com/gorilla/websocket": "Gorilla WebSocket", "golang.org/x/net": "Go Net",
            "github.com/sirupsen/logrus": "Logrus", "go.uber.org/zap": "Zap", "github.com/rs/zerolog": "Zerolog", "github.com/spf13/viper": "Viper",
            "github.com/stretchr/testify": "Testify", "golang.org/x/crypto": "Go Crypto", "github.com/go-playground/validator": "Validator",
            "github.com/google/uuid": "UUID", "github.com/pkg/errors": "Errors",
        },
    },
    "java": {
        "framework": {
            "spring-boot": "Spring Boot", "spring-framework": "Spring Framework", "quarkus": "Quarkus", "micronaut": "Micronaut",
            "dropwizard": "Dropwizard", "ktor": "Ktor", "android": "Android",
        },
        "library": {"junit": "JUnit", "mockito": "Mockito", "jackson": "Jackson", "gson": "Gson", "hibernate": "Hibernate"},
    },
    "clojure": {"framework": {"ring": "Ring", "compojure": "Compojure", "luminus": "Luminus"}},
    "elixir": {
        "framework": {"phoenix": "Phoenix", "plug": "Plug", "absinthe": "Absinthe"},
        "library": {"ecto": "Ecto", "genserver": "GenServer", "httpoison": "HTTPoison"},
    },
    "deno": {"framework": {"oak": "Oak", "fresh": "Fresh"}},
}

# First fragment found in a container image names the tool.
BASE_IMAGES = [
    ("node", "Node.js"), ("python", "Python"), ("nginx", "Nginx"), ("apache", "Apache"), ("postgres", "PostgreSQL"), ("mysql", "MySQL"),
    ("redis", "Redis"), ("mongo", "MongoDB"), ("golang", "Go"), ("rust", "Rust"), ("openjdk", "Java"), ("java", "Java"),
    ("alpine", "Alpine Linux"), ("ubuntu", "Ubuntu"),
]
SERVICE_IMAGES = [
    ("postgres", "PostgreSQL"), ("mysql", "MySQL"), ("redis", "Redis"), ("mongo", "MongoDB"), ("nginx", "Nginx"), ("apache", "Apache"),
    ("elasticsearch", "Elasticsearch"), ("rabbitmq", "RabbitMQ"), ("kafka", "Apache Kafka"),
]
DOCKERFILES = ["dockerfile", "dockerfile.dev", "dockerfile.prod", "dockerfile.test"]
COMPOSE_FILES = ["docker-compose.yml", "docker-compose.yaml", "docker-compose.dev.yml", "docker-compose.prod.yml"]

# First word found in an npm script names the build tool.
SCRIPT_TOOLS = [
    ("webpack", "Webpack"), ("vite", "Vite"), ("rollup", "Rollup"), ("parcel", "Parcel"), ("next", "Next.js"), ("nuxt", "Nuxt.js"), ("gatsby", "Gatsby"),
]

# Kinds of technology folded to the four basic sets; others go by their name.
BASIC_SET = {
    "framework": "frameworks", "frameworks": "frameworks", "frontend_frameworks": "frameworks", "backend_frameworks": "frameworks",
    "library": "libraries", "libraries": "libraries", "language": "languages", "languages": "languages", "tool": "tools", "tools": "tools",
    "build_tools": "tools", "testing_frameworks": "tools", "development_tools": "tools",
}
LIBRARY_WORDS = ["library", "lib", "util"]


def exact_rows() -> list[tuple[str, str, str, str]]:
    return [(eco, package, tech, kind) for eco, kinds in EXACT.items() for kind, table in kinds.items() for package, tech in table.items()]


def part_rows() -> list[tuple[str, str, str, str]]:
    return [(eco, part, tech, kind) for eco, kinds in PARTS.items() for kind, table in kinds.items() for part, tech in table.items()]
