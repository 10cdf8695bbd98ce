"""Path parts, role rules and URL checks as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Ordered (prefix, role) rules; `{package}` is the package folder.
# --------------------------------------------------------------------------
LIBRARY_ROLE_RULES = (
    ("src/", "core_library"),
    ("tests/unit_tests_src/", "unit_test"),
    ("tests/2d_examples/", "simulation_case"),
    ("tests/3d_examples/", "simulation_case"),
    ("tests/optimization/", "optimization_case"),
    ("tests/tests_sycl/", "sycl_case"),
    ("tests/extra_source_and_tests/", "extra_source_or_test"),
)
LIBRARY_DEFAULT_ROLE = "simulation_case"
PACKAGE_ROLE_RULES = (
    ("{package}/bindings/", "binding"),
    ("{package}/config/", "config_or_schema"),
    ("{package}/llm/", "llm_support"),
    ("{package}/sph_simulation/", "simulator_library"),
    ("{package}/visualization/", "visualization"),
    ("examples/", "simulation_example"),
)
PACKAGE_DEFAULT_ROLE = "test"
INVENTORY_ROLE_RULES = (
    ("{package}/bindings", "simulator_library"),
    ("{package}/config", "config/schema"),
    ("{package}/llm", "llm_support"),
    ("{package}/sph_simulation", "simulator_library"),
    ("{package}/visualization", "visualization"),
    ("examples", "simulation_example"),
    ("tests", "test"),
)
LANGUAGES = {
    ".py": "python", ".c": "cpp", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp",
    ".h": "cpp", ".hh": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".json": "json",
}


def for_package(rules: Sequence[tuple[str, str]], package: str) -> list[tuple[str, str]]:
    return [(prefix.format(package=package), role) for prefix, role in rules]


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(.+)\.[^.]+$", 1), F.lit("")), name)


def role_by_prefix(path: Column, rules: Sequence[tuple[str, str]], default: str | None) -> Column:
    """First matching prefix rule decides."""
    result = None
    for prefix, role in rules:
        hit = path.startswith(prefix)
        result = F.when(hit, role) if result is None else result.when(hit, role)
    return result.otherwise(F.lit(default))


def library_role(path: Column) -> Column:
    return role_by_prefix(path, LIBRARY_ROLE_RULES, LIBRARY_DEFAULT_ROLE)


def package_role(path: Column, package: str) -> Column:
    """JSON files are configuration wherever they lie; other files go by folder."""
    by_folder = role_by_prefix(path, for_package(PACKAGE_ROLE_RULES, package), PACKAGE_DEFAULT_ROLE)
    return F.when(extension(path) == ".json", "config_or_schema").otherwise(by_folder)


def inventory_root(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The scope root a path lies in, or null outside the scope."""
    return F.coalesce(
        *[F.when((path == root) | path.startswith(root + "/"), root) for root, _ in rules]
    )


def inventory_role(path: Column, rules: Sequence[tuple[str, str]], strict: bool = True) -> Column:
    """Role of the scope root; a path outside every root is an error."""
    result = None
    for root, role in rules:
        hit = (path == root) | path.startswith(root + "/")
        result = F.when(hit, role) if result is None else result.when(hit, role)
    if not strict:
        return result
    return result.otherwise(F.raise_error(F.concat(F.lit("path outside the scope: "), path)))


def language(path: Column) -> Column:
    ext = extension(path)
    return F.coalesce(*[F.when(ext == e, name) for e, name in LANGUAGES.items()])


def is_http_url(url: Column) -> Column:
    """Scheme http or https, and a host."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return scheme.isin("http", "https") & (host != "")
