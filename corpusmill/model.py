"""The data model: column schemas, severities, languages, tiers."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
SEVERITIES = ("error", "warning", "info", "suggestion")
SEVERITY_WEIGHT = {"error": 10.0, "warning": 1.0, "info": 0.0, "suggestion": 0.0}
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust",
    "rb": "ruby", "java": "java", "php": "php", "cs": "csharp", "swift": "swift", "html": "html", "css": "css", "json": "json",
    "yaml": "yaml", "yml": "yaml", "md": "markdown",
}
#: tier: (weight multiplier, rows of a rule that count)
TIERS = {"strict": (1.0, 40), "standard": (1.0, 30), "maintainability": (0.75, 24), "mechanical": (0.5, 16), "style": (0.5, 8), "advisory": (0.25, 8)}
DEFAULT_TIER = "mechanical"

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("ext", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("content", T.StringType())])
DIAGNOSTIC = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("message", T.StringType()),
    ]
)
EDGES = "src string, dst string"
EOF_LINE = 999_999
