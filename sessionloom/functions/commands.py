"""What a shell command or a path is."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, base_name, trim_space

# Fixed values.
VERIFICATION = ("test", "make build", "make demo", "make verify", "make lint", "make vet", "go vet", "go build", "golangci-lint")
DESTRUCTIVE = ("rm -rf", "rm -fr", "rm -r -f", "rm -f -r", "git reset --hard", "chmod -r", "chmod -rf", "chown -r", "chown -rf", "sudo rm")
NETWORK_HEADS = ("curl", "wget")
INSTALLERS = {
    "npm": ("install", "i", "add"),
    "pnpm": ("install", "i", "add"),
    "yarn": ("install", "i", "add"),
    "pip": ("install",),
    "pip3": ("install",),
    "brew": ("install",),
    "apt": ("install",),
    "apt-get": ("install",),
    "go": ("install", "get"),
    "cargo": ("install",),
}
MANIFESTS = (
    "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "go.mod", "go.sum", "requirements.txt", "pyproject.toml", "poetry.lock",
    "pipfile", "pipfile.lock", "cargo.toml", "cargo.lock", "gemfile", "gemfile.lock", "composer.json", "composer.lock",
)
NOT_SOURCE = (".md", ".txt", ".rst", ".adoc", ".yaml", ".yml", ".json", ".toml", ".ini", ".lock", ".env", ".gitignore", ".gitattributes")
SOURCE = (
    ".go", ".py", ".rb", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".java", ".kt", ".scala", ".rs", ".c", ".cc", ".cpp", ".h", ".hpp",
    ".cs", ".php", ".sh", ".bash", ".zsh", ".swift", ".m", ".mm", ".html", ".css", ".scss", ".sass", ".vue", ".svelte",
)
REDACTED_PATH = "[REDACTED_PATH_"


def _holds(words: tuple[str, ...]) -> str:
    """A pattern for any of the words; they don't begin or end with white space, so texts need not be trimmed."""
    return "|".join(map(re.escape, words))


def is_test(command: Column) -> Column:
    return F.lower(command).contains("test")


def is_verification(command: Column) -> Column:
    return F.lower(command).rlike(_holds(VERIFICATION))


def is_destructive(command: Column) -> Column:
    return F.lower(command).rlike(_holds(DESTRUCTIVE))


_INSTALL = "|".join(f"{k}{SPACE}+(?:{'|'.join(v)})" for k, v in INSTALLERS.items())
_NETWORK = f"^{SPACE}*(?:sudo{SPACE}+)?(?:{'|'.join(NETWORK_HEADS)}|{_INSTALL})(?:{SPACE}|$)"


def is_network(command: Column) -> Column:
    """The first word, or the one after ``sudo``, downloads or installs."""
    return F.lower(command).rlike(_NETWORK)


def is_manifest(path: Column) -> Column:
    return F.lower(base_name(path)).isin(*MANIFESTS)


def is_redacted_path(path: Column) -> Column:
    return trim_space(path).startswith(REDACTED_PATH)


_TEST_NAME = r"(?:^|/)(?:[^/]*_test\.go|[^/]*_test\.py|test_[^/]*\.(?:py|rb)|[^/]*\.(?:test|spec)\.[^/]*)/*$"
_TEST_DIR = r"(?:^|[/\\])(?:tests|test|__tests__|spec)[/\\]"


def _suffix(names: tuple[str, ...]) -> str:
    return f"(?:{'|'.join(n.replace('.', chr(92) + '.') for n in names)})/*$"


def is_test_file(path: Column) -> Column:
    """By the name's form, or a folder of tests on the way."""
    low = F.lower(path)
    return (path != "") & ~is_redacted_path(path) & (low.rlike(_TEST_NAME) | low.rlike(_TEST_DIR))


def is_source_file(path: Column) -> Column:
    low = F.lower(path)
    return (path != "") & ~is_redacted_path(path) & ~is_test_file(path) & ~low.rlike(_suffix(NOT_SOURCE)) & low.rlike(_suffix(SOURCE))


def is_safe_id(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9_.-]+$") & ~c.isin(".", "..")


def is_hex_digest(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")

