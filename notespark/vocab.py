"""Fixed values.

Everything in this module is data, not logic: word lists, lookup tables, patterns,
thresholds and text formats that results depend on.  They are stated plainly so that a
result can be checked against them.  Regular expressions are in Java syntax, as Spark
evaluates them; ``(?U)`` makes ``\\w``/``\\b``/``\\s`` Unicode-aware.
"""

# --------------------------------------------------------------------------- parsing
# Patterns of the note markup.
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
WIKILINK_WITH_ALIAS = r"\[\[[^\]|]+\|([^\]]+)\]\]"
WIKILINK_PLAIN = r"\[\[([^\]|]+)\]\]"
EMBED = r"!\[\[([^\]]+)\]\]"
INLINE_TAG = r"(?m)#(?:(?<=^#)|(?<=\s#))([a-zA-Z0-9_-]+)"
TOKEN = r"[a-zA-Zа-яА-ЯёЁ0-9_\-\.]+"
URL = r"https?://[^\s<>\"']+"

# Defaults of a note's fields and directories left out of a scan.
DEFAULT_TYPE = "note"
DEFAULT_PRIORITY = "medium"
TEMPLATE_DIR = "_templates"
GENERATED_FILES = ["index.md", "log.md"]

# Order of note types in the catalog and in a project's context.
CATALOG_TYPE_RANK = {
    "prd": 0, "architecture": 1, "guidelines": 2, "api": 3, "decision": 4,
    "concept": 5, "comparison": 6, "synthesis": 7, "research": 8, "note": 9,
}
CONTEXT_TYPE_RANK = {
    "prd": 0, "architecture": 1, "guidelines": 2, "api": 3, "decision": 4,
    "concept": 5, "comparison": 6, "synthesis": 7, "research": 8,
}
OTHER_TYPE_RANK = 99
NO_SUMMARY = "(no summary)"

# --------------------------------------------------------------------------- search
# Defaults of the search pipeline.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RRF_K = 60
RETRIEVAL_MULTIPLIER = 3
DEDUP_THRESHOLD = 0.85
MMR_LAMBDA = 0.7
DECAY_LAMBDA = 0.005

# --------------------------------------------------------------------------- lint
# Lint settings.
STALE_DAYS = 90
TODO_MARKER = r"(?iU)(?:TODO|FIXME|HACK|XXX|WIP)\b"
CONCEPT_MENTION = (
    r"(?iU)\b(Supabase|ChromaDB|Flutter|Next\.js|Firebase|Vercel|Docker|Redis|PostgreSQL"
    r"|OpenAI|Claude|Stripe|Telegram|FastAPI|SQLite|Prisma|Turso|LibSQL"
    r"|BM25|RRF|MMR|RAG|MCP|GraphQL|REST API|WebSocket|OAuth|JWT"
    r"|React|TypeScript|Python|Dart|SwiftUI)\b"
)
CONCEPT_TOP = 20
CONCEPT_MIN_MENTIONS = 3
ORPHAN_SKIP_STEMS = ["index", "log", "wiki-schema"]
GLOBAL_PREFIX = "_global"
REQUIRED_FIELDS = ["project", "type"]
RECOMMENDED_FIELDS = ["created", "tags", "updated"]
SEVERITY_RANK = {"critical": 0, "warning": 1, "info": 2}

# --------------------------------------------------------------------------- facts
# Predicates whose contradiction is a warning, and the confidence from
# which two contradicting facts are critical.
STACK_PREDICATES = ["uses", "uses_auth", "uses_db", "uses_framework", "deploys_to"]
CRITICAL_CONFIDENCE = 0.9

# Technology names by the predicate they specialise "uses" to.
TECH_BY_PREDICATE = {
    "uses_framework": [
        "flutter", "react", "next.js", "nextjs", "vue", "svelte", "django", "flask",
        "fastapi", "express", "nestjs", "spring", "nuxt", "remix", "astro", "vite",
    ],
    "uses_state": [
        "riverpod", "bloc", "provider", "getx", "redux", "zustand", "jotai", "recoil", "mobx",
    ],
    "uses_language": [
        "python", "typescript", "javascript", "dart", "rust", "go", "kotlin", "swift",
        "ruby", "java", "elixir",
    ],
    "uses_db": [
        "postgresql", "postgres", "mysql", "sqlite", "mongodb", "redis", "supabase",
        "firebase", "turso", "planetscale", "neon", "drizzle", "prisma",
    ],
    "uses_auth": [
        "clerk", "auth0", "firebase auth", "supabase auth", "nextauth", "lucia",
        "keycloak", "cognito",
    ],
    "deploys_to": [
        "vercel", "aws", "gcp", "docker", "kubernetes", "fly.io", "railway", "render",
        "heroku", "netlify", "cloudflare", "digitalocean", "testflight", "app store",
        "google play",
    ],
    "uses_ai": [
        "openai", "gpt", "claude", "gemini", "whisper", "langchain", "chromadb",
        "pinecone", "weaviate", "qdrant", "ollama", "llama",
    ],
    "uses_tool": [
        "obsidian", "telegram", "notion", "github", "vscode", "cursor", "sentry",
        "posthog", "mixpanel", "stripe", "lemon squeezy",
    ],
    "uses_testing": ["jest", "vitest", "pytest", "playwright", "cypress"],
    "uses_css": ["tailwind", "tailwindcss", "styled-components", "emotion"],
}

# The sentence patterns facts are read from, in order.  Each entry is
# (predicate, pattern, number of captured names).
_NAME = r"[`\"']?([\w][\w\.\-]*(?:\s[\w\.\-]+)?)[`\"']?"
FACT_PATTERNS = [
    ("uses",
     r"(?iU)(?:использ(?:ует|уем|ую)|переш(?:ли|ёл|ел)\s+на|"
     r"use[sd]?|using|adopt(?:ed|ing)?|implement(?:ed|ing)?|integrat(?:ed|ing)?|"
     r"выбрали|chose|picked|selected)\s+(?:the\s+)?(?:new\s+)?" + _NAME, 1),
    ("migration",
     r"(?iU)(?:switch(?:ed)?\s+from|migrat(?:ed|ing)\s+from|"
     r"replaced?|заменили|мигрировали\s+с|перешли\s+с)\s+" + _NAME +
     r"\s+(?:to|with|на|→)\s+" + _NAME, 2),
    ("deploys_to",
     r"(?iU)(?:deploy(?:ed|ing)?\s+(?:to|on)|host(?:ed|ing)?\s+on|"
     r"деплой\s+на|деплоим\s+на|running\s+on)\s+" + _NAME, 1),
    ("uses_auth",
     r"(?iU)(?:auth(?:entication|orization)?\s+(?:via|with|through|using)|"
     r"авториз(?:ация|ацию)\s+через|аутентификац(?:ия|ию)\s+через)\s+" + _NAME, 1),
    ("uses_db",
     r"(?iU)(?:database|db|storage|хранилище|база\s+данных)\s*(?::|—|–|-|is|=)\s*" + _NAME, 1),
    ("uses_framework",
     r"(?iU)(?:written\s+in|built\s+with|powered\s+by|stack\s*(?::|—|–|-|is)|"
     r"написан\s+на|сделан\s+на)\s+" + _NAME, 1),
    ("replaced",
     r"(?iU)(?:вместо|instead\s+of|rather\s+than|not\s+using)\s+" + _NAME, 1),
]
# Letters that match a plain one where case is ignored, though their lower case is another.
FOLDED_LETTERS = "\u017f\u0131\u0130\u212a\u1c80\u1c81\u1c82\u1c83\u1c84\u1c85"
PLAIN_LETTERS = "siikвдостт"
# Of each pattern: parts of words of which a match has one.
FACT_STEMS = [
    ["использ", "переш", "us", "adopt", "mplement", "ntegrat", "выбрали", "chose", "cked", "selected"],
    ["tch", "grat", "replace", "заменили", "мигрировали", "перешли"],
    ["deploy", "host", "депло", "runn"],
    ["auth", "авториз", "аутентификац"],
    ["database", "db", "storage", "хранилище", "база"],
    ["wr", "bu", "powered", "stack", "написан", "сделан"],
    ["вместо", "nstead", "rather", "not"],
]
FACT_STOP_WORDS = [
    "and", "or", "for", "with", "to", "in", "on", "at", "by", "as",
    "the", "a", "an", "is", "are", "was", "were", "from",
    "для", "и", "на", "с", "в", "из", "от", "до", "по", "к",
    "вместо", "через", "при", "без",
]
FACT_NOTE_TYPES = ["decision", "architecture", "note", "research"]
MIN_SENTENCE = 10

# --------------------------------------------------------------------------- sessions
# How failures are recognised in session notes.
FAILURE_HEADER = r"(?i)###?\s*(?:What Failed|Issues?|What Failed / Issues?|Problems?|Errors?|Blockers?)\b"
WORKAROUND = (
    r"(?i)(?:workaround|fix(?:ed)?|solution|resolved|switched to|replaced with|instead of)"
    r"\s*[:—–-]?\s*(.+)"
)
ISSUE_CATEGORIES = [
    ("crash", ["crash", "panic", "fatal", "segfault"]),
    ("config", ["config", "env", ".env", "environment", "settings"]),
    ("api", ["api", "endpoint", "request", "response", "cors"]),
    ("build", ["build", "compile", "webpack", "vite", "flutter build"]),
    ("tool", ["browser", "tool", "cursor", "terminal", "command"]),
    ("performance", ["timeout", "slow", "hang", "stuck", "freeze"]),
    ("database", ["firebase", "supabase", "database", "prisma", "migration"]),
    ("auth", ["auth", "login", "token", "permission"]),
]
OTHER_CATEGORY = "other"
MIN_ISSUE = 10
ISSUE_KEY_LENGTH = 80
SESSION_TAGS = ["session", "log"]

# Decision outcomes.
OUTCOME = r"(?is)##\s*Outcome.*?\n(.*?)(?=\n##\s|\z)"
OUTCOME_STATUS = r"(?i)\*?\*?Status\*?\*?\s*[:：]\s*(success|partial|failed|unknown)"
OUTCOME_LESSONS = r"(?is)\*?\*?Lessons?\s*learned?\*?\*?\s*[:：]\s*(.*?)(?=\n|\z)"

# Wake-up summary.
STACK_LINE_MARKERS = ["tech stack", "stack:", "framework:"]
RECENT_DAYS = 14
EMPTY_BLOCKERS = ["None", "—", "-", "N/A", ""]
KEEP_SNAPSHOTS = 50

# --------------------------------------------------------------------------- routing
# Inbox routing.
MIN_BODY = 15
MIN_PROJECT_NAME = 4
GENERIC_BUCKETS = [
    "inbox", "research", "general", "global", "global-config", "misc",
    "claude-config",
]
SPEC_HEADERS = [
    r"(?iU)ТЗ\s*[:\-–—]\s*([A-Za-z][\w\- ]{1,40})",
    r"(?iU)проект\s+называется\s+[«\"']?([A-Za-z][\w\-]{1,40})",
    r"(?iU)\bProject\s*[:=]\s*([A-Za-z][\w\-]{1,40})",
]
PROJECT_PREFIX = r"(?U)^@(\w[\w-]*)\s+"
# What ingest writes into related notes and concept stubs.
RELATED_BLOCK = "\n\n---\n### 🔗 Related (auto-linked {today})\n- [[{title}]] — see `{path}`\n"
STUB_NOTE = (
    '---\nproject: _global\ntype: concept\ntags:\n  - "concept"\n  - "auto-generated"\npriority: low\ncreated: {today}\n'
    "updated: {today}\n---\n\n# {entity}\n\n(Auto-generated concept stub — enrich during next session)\n\n## References\n"
    "- First mentioned in: `{project}/{title}`\n"
)
RELATED_QUERY_CHARS, RELATED_HITS = 200, 10
RELATED_MIN_SCORE = 0.3
RELATED_TOP = 5

# --------------------------------------------------------------------------- feeds
# Keywords that make a found tool relevant.
TOOL_KEYWORDS = {
    "high": [
        "mcp", "model context protocol", "obsidian", "knowledge base",
        "second brain", "flutter", "dart", "fastapi", "python",
        "next.js", "nextjs", "react", "typescript", "vercel",
        "prisma", "turso", "sqlite", "chromadb",
        "ai agent", "coding assistant", "llm",
    ],
    "medium": [
        "tailwind", "css", "firebase", "supabase",
        "telegram bot", "discord bot", "web scraping",
        "ci/cd", "github actions", "docker",
        "vector database", "embeddings", "rag",
    ],
}

# Keywords by topic for scoring code repositories.
REPO_TOPICS = {
    "ai": [
        "artificial-intelligence", "machine-learning", "llm", "gpt", "openai", "langchain",
        "rag", "embeddings", "vector-database", "ai-agent", "autonomous", "deep-learning",
        "transformer",
    ],
    "mcp": [
        "model-context-protocol", "mcp", "mcp-server", "mcp-client", "claude", "anthropic",
    ],
    "devtools": [
        "developer-tools", "cli", "devtools", "linter", "formatter", "code-generation",
        "ide", "vscode", "neovim", "automation", "ci-cd", "github-actions",
    ],
    "mobile": [
        "flutter", "dart", "ios", "android", "react-native", "mobile", "swift", "kotlin",
    ],
    "web": [
        "nextjs", "react", "typescript", "tailwindcss", "vercel", "prisma", "supabase",
        "firebase",
    ],
}
REPO_LANGUAGES = ["python", "typescript", "javascript", "dart"]
REPO_MCP_MARKS = ["mcp", "model-context-protocol"]
REPO_POINTS = {"keyword": 0.2, "keyword_cap": 3, "language": 0.15, "mcp": 0.3, "max": 1.0}
REPO_BANDS = [("high", 0.6), ("medium", 0.3)]
DIGEST_MIN_SCORE = 0.5
DIGEST_TOP = 5

# Keywords by the kind of project a found repository may help.  The labels are
# neutral; a user passes a table with the names of their own projects.
APPLICABLE_PROJECTS = [
    ("knowledge-base", ["vault", "obsidian", "knowledge", "mcp", "ai-agent"]),
    ("portfolio-site", ["portfolio", "nextjs", "prisma", "admin", "dashboard"]),
    ("video-summaries", ["youtube", "video", "summary", "ai", "flutter"]),
    ("landing-pages", ["landing", "saas", "template", "website"]),
    ("chat-bots", ["telegram", "bot", "chatbot", "messaging"]),
]

# --------------------------------------------------------------------------- source code
# Architectural layers by path keyword, in order.
LAYERS = [
    ("api", ["route", "router", "endpoint", "controller", "handler", "api", "view", "views",
             "pages", "app"]),
    ("service", ["service", "usecase", "use_case", "logic", "manager", "provider",
                 "interactor", "command", "query"]),
    ("model", ["model", "schema", "entity", "domain", "dto", "type", "types", "interface",
               "interfaces"]),
    ("data", ["repository", "repo", "dao", "database", "db", "migration", "seed", "fixture",
              "prisma", "drizzle", "storage", "cache"]),
    ("config", ["config", "setting", "env", "constant"]),
    ("util", ["util", "utils", "helper", "helpers", "lib", "common", "shared", "core"]),
    ("test", ["test", "spec", "fixture", "__test__", "__tests__"]),
    ("ui", ["component", "widget", "screen", "page", "layout", "template", "ui"]),
]
OTHER_LAYER = "other"

# Files scanned for the code map.
CODE_LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript",
    ".jsx": "javascript", ".dart": "dart",
}
CODE_SKIP_DIRS = [
    "node_modules", ".git", "__pycache__", ".dart_tool", "build",
    ".next", ".nuxt", "dist", "coverage", ".venv", "venv",
    ".eggs", "*.egg-info", ".mypy_cache", ".ruff_cache",
    ".pytest_cache", ".gradle", "ios", "android", "macos", "linux", "windows",
    "web", ".idea", ".vscode",
]
TS_IMPORT = (
    r"(?:import\s+.*?from\s+['\"]([^'\"]+)['\"]|"
    r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\))"
)
DART_IMPORT = r"import\s+['\"]([^'\"]+)['\"]"

# Files left out of a context pack, and file priorities.
PACK_SKIP_DIRS = [
    "node_modules", ".git", "__pycache__", ".venv", "venv", ".env",
    ".next", ".nuxt", "build", "dist", ".dart_tool", ".flutter-plugins",
    ".idea", ".vscode", ".gradle", "Pods", "ios/Pods",
    "coverage", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    "egg-info", ".egg-info", ".tox", "htmlcov",
]
PACK_SKIP_FILES = [
    ".DS_Store", "Thumbs.db", ".gitignore", ".gitattributes",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "poetry.lock", "Pipfile.lock", "Cargo.lock",
    "pubspec.lock", "Podfile.lock",
]
PACK_SKIP_EXTS = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".bmp",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".webm",
    ".zip", ".tar", ".gz", ".rar", ".7z",
    ".woff", ".woff2", ".ttf", ".eot",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".pyc", ".pyo", ".class", ".o", ".so", ".dylib",
    ".db", ".sqlite", ".sqlite3", ".map",
]
PACK_SKIP_SUFFIXES = [".min.js", ".min.css"]
PACK_HIGH = [
    "package.json", "tsconfig.json", "pyproject.toml", "pubspec.yaml",
    "prisma/schema.prisma", ".env.example", "docker-compose.yml",
    "Dockerfile", "Makefile", "README.md", "ARCHITECTURE.md",
    "main.py", "app.py", "run.py", "index.ts", "index.js",
    "main.dart", "lib/main.dart",
]
PACK_LOW = ["test", "spec", "mock", "fixture", "migration", "style", "css", "theme", "asset"]
PACK_RANK = {"high": 0, "medium": 1, "low": 2}
PACK_BUDGET = {"full": 200_000, "compact": 50_000, "minimal": 10_000}
# lines kept per priority; None keeps the whole file, 0 leaves it out
PACK_LINES = {
    "full": {"high": None, "medium": None, "low": None},
    "compact": {"high": None, "medium": 100, "low": 30},
    "minimal": {"high": 50, "medium": 20, "low": 0},
}
TREE_CHILDREN = 5
SCHEMA_CHARS = 3000

# Stacks by marker file and by package.
STACK_FILES = [
    ("package.json", "Node.js"), ("tsconfig.json", "TypeScript"), ("pyproject.toml", "Python"),
    ("requirements.txt", "Python"), ("pubspec.yaml", "Flutter/Dart"), ("Cargo.toml", "Rust"),
    ("go.mod", "Go"), ("Gemfile", "Ruby"), ("pom.xml", "Java/Maven"),
    ("build.gradle", "Java/Gradle"),
]
STACK_PACKAGES = [
    ("next", "Next.js"), ("react", "React"), ("@prisma/client", "Prisma"), ("prisma", "Prisma"),
    ("tailwindcss", "TailwindCSS"),
]

# Outside services by source pattern.
SERVICE_PATTERNS = [
    ("Telegram Bot", [r"telegram", r"sendMessage", r"TELEGRAM_BOT_TOKEN"]),
    ("OpenAI", [r"openai", r"chat\.completions", r"OPENAI_API_KEY"]),
    ("Stripe", [r"stripe", r"STRIPE_SECRET"]),
    ("Twilio", [r"twilio"]),
    ("SendGrid", [r"sendgrid", r"SENDGRID_API_KEY"]),
    ("Firebase", [r"firebase", r"firestore"]),
    ("Supabase", [r"supabase", r"SUPABASE_URL"]),
    ("Redis", [r"redis", r"REDIS_URL"]),
    ("S3 / AWS", [r"aws-sdk", r"boto3", r"S3_BUCKET"]),
    ("Google Maps", [r"maps\.googleapis", r"GOOGLE_MAPS"]),
    ("RSS Parser", [r"rss-parser", r"feedparser"]),
    ("Vercel", [r"vercel"]),
    ("Notion API", [r"notion\.com/v1", r"NOTION_API_KEY"]),
]
SCHEMA_PROVIDERS = {
    "sqlite": "SQLite", "postgresql": "PostgreSQL", "mysql": "MySQL", "libsql": "Turso (LibSQL)",
}
PY_ROUTE = r"@\w+\.(route|get|post|put|delete)\([\"']([^\"']+)"
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH"]

# --------------------------------------------------------------------------- pages
# Main text of an HTML page.
PAGE_TITLE = r"(?i)<title[^>]*>([^<]+)</title>"
PAGE_CONTAINERS = ["article", "main", "body"]
PAGE_NOISE = [
    "script", "style", "nav", "header", "footer", "aside", "noscript", "iframe", "svg", "form",
]
PAGE_ENTITIES = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&nbsp;", " "),
]
PAGE_CHARS = 3000
PAGE_CUT_MARK = "\n\n...(truncated)"

# --------------------------------------------------------------------------- dashboard
# Order of project states on the dashboard.
STATUS_RANK = {"active": 0, "mvp": 1, "paused": 2, "idea": 3, "done": 4, "unknown": 5}

# --------------------------------------------------------------------------- streaming
# The watcher's quiet time in seconds.
DEBOUNCE_SECONDS = 2.0

# The sentences of the session report's advice, and the share that calls for one.
ADVICE_SHARE = 30
ADVICE_REPEATING = (
    "Create a guidelines note for '{pattern}' — this issue appeared {count} times across {projects}"
)
ADVICE_AREA = (
    "Category '{category}' accounts for {pct}% of all issues — consider "
    "investing in better tooling or templates for this area"
)
ADVICE_WORKAROUNDS = "Document {count} proven workarounds as project guidelines to prevent repeated debugging"
ADVICE_NONE = (
    "No issues found — either sessions are going smoothly or issues aren't being "
    "documented in 'What Failed' sections"
)
