"""Fixed values that results depend on, kept as plain data."""

# Directory names that a corpus scan never descends into (fixed values).
IGNORED_DIRECTORIES = [
    "node_modules", ".git", ".godot", ".import", "dist", "build", "vendor",
    "three", ".next", ".cache", "coverage", ".vscode", ".idea",
]

# Base-name suffixes of vendored bundles (fixed values).
VENDOR_SUFFIX = r"(\.min\.js|\.min\.mjs|\.bundle\.js|-lock\.js|-lock\.json|\.umd\.js)$"

# Module sources, in no particular order (fixed values).
MODULE_EXTENSIONS = [".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx"]

# Extensions probed, in this order, for a specifier without one (fixed values).
PROBED_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json"]

# A JavaScript extension may stand for one of these (fixed values).
TYPED_TWINS = [".ts", ".tsx", ".mts", ".cts"]

# Files that count as assets (fixed values).
ASSET_EXTENSIONS = [
    ".glb", ".gltf", ".obj", ".fbx", ".png", ".jpg", ".jpeg", ".svg", ".webp",
    ".ktx", ".hdr", ".wav", ".ogg", ".mp3", ".tres", ".res",
]

# Extensions that make a string literal an asset reference (fixed values).
ASSET_LITERAL_EXTENSIONS = [
    ".glb", ".gltf", ".obj", ".fbx", ".png", ".jpg", ".jpeg", ".svg", ".webp",
    ".wav", ".ogg", ".mp3", ".ktx", ".hdr",
]

# Extensions a log or request can name as a source file (fixed values).
SOURCE_EXTENSIONS = [
    "gd", "js", "ts", "tsx", "jsx", "mjs", "html", "tscn", "json", "tres",
]

# Extensions a content search reads (fixed values).
SEARCH_EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json", ".gd", ".tscn",
    ".tres", ".godot", ".md", ".txt", ".html", ".css", ".yml", ".yaml", ".toml",
]

# Words that are no evidence in an issue text (fixed values).
STOP_WORDS = [
    "the", "and", "for", "with", "this", "that", "from", "have", "when", "what",
    "not", "but", "you", "are", "was", "were", "has", "had", "its", "his", "her",
    "they", "them", "then", "than", "there", "here", "will", "would", "could",
    "should", "about", "into", "over", "after", "before", "while", "because",
    "error", "errors", "issue", "problem", "bug",
]

# Names that look like calls but name no function (fixed values).
IGNORED_SYMBOLS = [
    "undefined", "null", "nan", "true", "false", "if", "for", "while", "switch",
    "catch", "return", "throw", "new", "typeof", "void", "delete", "await",
    "yield", "import", "export", "function", "func", "class", "super", "this",
    "constructor", "let", "const", "var", "async", "try", "finally", "do",
    "else", "case", "default", "break", "continue", "in", "of", "instanceof",
    "assert", "match", "pass", "signal", "extends", "self",
]

NODE_TYPES = ["scene", "script", "module", "asset"]
ENGINES = ["godot", "js"]
EDGE_KINDS = ["import", "asset_ref", "ext_resource", "requires", "signal_connection"]

# Globals a pure module must not touch (fixed values).
DOM_GLOBALS = ["window", "document", "navigator", "localStorage", "HTMLElement"]

# Import policy (fixed values; the first list is a parameter of the check).
FORBIDDEN_SUBSTRINGS = ["/app/", "svelte", "electron", "three"]

# Budgets and caps (fixed values).
AUTO_ATTACH = 6
DEFAULT_BUDGET_CHARS = 12_000
SLICE_CONTEXT_LINES = 5
DIFF_CONTEXT_LINES = 2
RECENT_LIMIT = 5
SEARCH_LINES_PER_FILE = 50
SEARCH_TOTAL_LINES = 500
SEARCH_TOTAL_NAMES = 200
DEBOUNCE_MS = 150

# Words that introduce a binding, and words that announce a function (fixed values).
INTRODUCING_WORDS = ["function", "class", "const", "let", "var"]
FUNCTION_WORDS = ["function", "method", "func"]
