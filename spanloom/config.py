"""Tunable parameters and the fixed vocabularies they default to."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

# --------------------------------------------------------------------------
# Fixed values. These vocabularies and weights define which results are right.
# --------------------------------------------------------------------------
_CASE_ROLES = ("simulation_case", "simulation_example")
_CODE_ROLES = ("core_library", "simulator_library", "binding")
_CONFIG_ROLES = ("config_or_schema",)

ROLE_HINTS: Mapping[str, tuple[str, ...]] = {
    "simulation": _CASE_ROLES,
    "case": _CASE_ROLES,
    "example": _CASE_ROLES,
    "dambreak": _CASE_ROLES,
    "heat": _CASE_ROLES,
    "transfer": _CASE_ROLES,
    "class": _CODE_ROLES,
    "function": _CODE_ROLES,
    "method": _CODE_ROLES,
    "api": _CODE_ROLES,
    "source": _CODE_ROLES,
    "code": _CODE_ROLES,
    "builder": ("simulator_library", "binding"),
    "config": _CONFIG_ROLES,
    "configuration": _CONFIG_ROLES,
    "configured": _CONFIG_ROLES,
    "schema": _CONFIG_ROLES,
    "json": _CONFIG_ROLES,
    "test": ("unit_test", "test"),
}
GENERIC_SYMBOL_TERMS = (
    "what", "when", "where", "which", "who", "with", "from", "this", "that",
)
# The names of the indexed repositories are generic too; `for_repositories` adds them.
GENERIC_PATH_TERMS = (
    "simulation", "example", "case", "source", "code", "function", "method",
    "config", "configuration", "configured", "schema", "test", "field", "fields",
    "dynamic", "dynamics", "what", "when", "where", "which", "who", "how",
    "does", "used", "use", "defined", "define", "information",
)
SCHEMA_INTENT_TERMS = ("config", "configuration", "configured", "schema", "json")

FEEDBACK_CATEGORIES = (
    "incorrect", "unsupported_claim", "incomplete", "irrelevant",
    "wrong_source", "unclear", "formatting", "other",
)
# Report order of the categories with their headings.
CATEGORY_LABELS: Mapping[str, str] = {
    "unsupported_claim": "Unsupported Claim",
    "incomplete": "Incomplete",
    "irrelevant": "Irrelevant",
    "incorrect": "Incorrect",
    "wrong_source": "Wrong Source",
    "unclear": "Unclear",
    "formatting": "Formatting",
    "other": "Other",
    "__uncategorized__": "Uncategorized",
}
RATINGS = ("helpful", "needs_review")
SECRET_KEYS = (
    "api_key", "llm_api_key", "authorization", "authorization_header",
    "access_token", "refresh_token", "token", "secret", "password",
)
SENSITIVE_KEY_FRAGMENTS = (
    "authorization", "api_key", "apikey", "token", "secret", "password",
)
CORPUS_REQUIRED_FIELDS = (
    "chunk_id", "repository", "source_role", "source_path", "content",
)
REVIEW_REQUIRED_FIELDS = (
    "interaction_id", "tester_id", "query", "raw_answer", "review_status",
)
SESSION_REQUIRED_FIELDS = (
    "interaction_id", "session_id", "tester_id", "timestamp",
    "query", "raw_answer", "status", "review_status",
)
PRIMARY_NODE_TYPES = ("function_definition", "method_declaration")
PYTHON_PRIMARY_NODE_TYPES = ("function_definition", "class_definition")
CONTEXT_NODE_TYPES = ("class_specifier", "struct_specifier", "template_declaration")
RETAINED_NODE_TYPES = CONTEXT_NODE_TYPES + PRIMARY_NODE_TYPES
# Order in which example relations are picked, by child type.
EXAMPLE_CHILD_TYPES = (
    "function_definition", "method_declaration", "template_declaration",
    "field_declaration", "class_specifier", "struct_specifier",
)
CPP_EXTENSIONS = (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx")
PREAMBLE_TITLE = "Function preamble (before first semantic section)"
TRUNCATION_MARKER = "\n[Evidence truncated to fit the Prototype V1 budget.]"
DEFAULT_TESTER = "local_tester"
DEFAULT_ENDPOINT_LABEL = "OpenAI SDK default"
PROMPT_VERSION = "grounded_answer_v1"
REVIEW_DIRECTORY = "review_batches"
EXPORT_DIRECTORY = "markdown_exports"


@dataclass(frozen=True)
class RankingConfig:
    """Weights and vocabularies of the lexical ranker."""

    k1: float = 1.5
    b: float = 0.75
    role_hints: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(ROLE_HINTS))
    repository_hints: Mapping[str, str] = field(default_factory=dict)
    generic_symbol_terms: tuple[str, ...] = GENERIC_SYMBOL_TERMS
    generic_path_terms: tuple[str, ...] = GENERIC_PATH_TERMS
    schema_intent_terms: tuple[str, ...] = SCHEMA_INTENT_TERMS
    schema_role: str = "config_or_schema"
    demoted_role: str = "test"
    explicit_symbol_boost: float = 24.0
    symbol_boost: float = 12.0
    symbol_words_boost: float = 10.0
    path_term_boost: float = 2.75
    path_term_cap: float = 8.25
    path_identifier_boost: float = 6.0
    path_identifier_cap: float = 6.0
    schema_role_boost: float = 14.0
    demoted_role_boost: float = -1.0
    hinted_role_boost: float = 2.5
    repository_boost: float = 1.5
    # A null symbol is indexed as the word "none".
    index_null_symbol: bool = True

    def for_repositories(self, names: Iterable[str]) -> RankingConfig:
        """Hint each repository by its own lower-cased name, as a generic path term."""
        hints = {name.lower(): name for name in names}
        generic = self.generic_path_terms + tuple(t for t in hints if t not in self.generic_path_terms)
        return replace(self, repository_hints=hints, generic_path_terms=generic)


@dataclass(frozen=True)
class PackingConfig:
    """Character budget of the evidence shown for one query."""

    total_chars: int = 18_000
    block_chars: int = 4_000


@dataclass(frozen=True)
class ChunkConfig:
    """Size limits of the chunking policies."""

    oversized_bytes: int = 5_000
    window_lines: int = 50
