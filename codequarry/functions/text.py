"""Text functions as columns: identifiers, terms, tokens, hashes, redaction, paths. Python only where no builtin will do."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
TERM = r"[\p{L}\p{N}_]+"
SECRET = (
    r"(?i)\b(?:api[_-]?key|secret|token|password|passwd|private[_-]?key|authorization)\b\s*(?:=|:|=>)\s*(?:[\"'][^\"']{4,}[\"']|[^\s\"']{4,})"
)
PRIVATE_KEY = r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----"
REDACTED = "[REDACTED: potential secret]"
INJECTION = (
    r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions|disregard\s+(?:all\s+)?(?:previous|prior|above)"
    r"|you\s+are\s+now|new\s+system\s+prompt|<\s*/?\s*system\s*>|BEGIN\s+SYSTEM\s+PROMPT"
)
STOP_WORDS = (
    "a an the of to in on at by for from with into onto than then and or but as is are was were be been being it its that this these those which who whom whose when while so such also any each"
    " per via up out off over their there they them we our you your can could should would will may might must do does did has have had"
).split()


def split_identifier(name: Column) -> Column:
    """Parts of camel, Pascal, acronym, digit and snake case, lower case and distinct, then the whole word; none of a blank name."""
    bare = F.regexp_replace(name, r"^\s+|\s+$", "")
    spaced = F.regexp_replace(F.regexp_replace(bare, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2"), r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2")
    parts = F.concat(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), F.array(F.lower(bare)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, in order."""
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def estimate_tokens(text: Column) -> Column:
    """One for each four bytes begun; none for an empty text."""
    return F.when(F.octet_length(text) == 0, 0).otherwise(F.ceil(F.octet_length(text) / 4)).cast("long")


def compact_ref(symbol_id: Column) -> Column:
    return F.substring(F.sha2(symbol_id.cast("string"), 256), 1, 8)


def compact_declaration(kind: Column, name: Column) -> Column:
    letter = F.when(kind == "class", "c").when(kind == "function", "f").when(kind == "method", "m").otherwise("s")
    return F.concat(letter, F.lit(" "), name)


def role_marker(roles: Column) -> Column:
    """The marker of the first role in a fixed order."""
    out = F.lit(None).cast("string")
    for role, marker in reversed((("entry_point", "E"), ("registry_wiring", "W"), ("declared_entry_point", "D"), ("protocol_implementation", "I"), ("module_entry", "M"))):
        out = F.when(F.array_contains(roles, role), marker).otherwise(out)
    return out


def secret(line: Column) -> Column:
    return line.rlike(SECRET) | line.rlike(PRIVATE_KEY)


def redact(text: Column) -> Column:
    """Lines that hold a secret are replaced whole."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(secret(x), REDACTED).otherwise(x)), "\n")


def redactions(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), secret)).cast("long")


def injection_lines(text: Column) -> Column:
    """Numbers, from 1, of the lines that try to give instructions."""
    hits = F.transform(F.split(text, "\n"), lambda x, k: F.when(x.rlike(INJECTION), k + 1))
    return F.filter(hits, lambda x: x.isNotNull())


def path_tokens(path: Column) -> Column:
    """Folders but a leading src, and the file's name without its ending, each whole and then in its parts, lower case and distinct."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    parts = F.when(F.get(parts, F.lit(0)) == "src", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    named = F.transform(parts, lambda x, k: F.when(k == F.size(parts) - 1, F.regexp_replace(x, r"^(.+)\.[^.]+$", "$1")).otherwise(x))
    tokens = F.flatten(F.transform(named, lambda x: F.concat(F.array(F.lower(F.trim(x))), split_identifier(x))))
    return F.array_distinct(F.filter(tokens, lambda x: x != ""))


def module_candidates(path: Column) -> Column:
    """Dotted names by which a file may be imported."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), r"/__init__$", "")
    full = F.replace(bare, F.lit("/"), F.lit("."))
    return F.array_distinct(F.array(full, F.regexp_replace(full, r"^src\.", "")))


def namespace_ancestors(ns: Column) -> Column:
    parts = F.split(ns, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def version_tuple(version: Column) -> Column:
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^(\d+)", 1).try_cast("int"), F.lit(0)))


def byte_slice(source: Column, start: Column, end: Column) -> Column:
    """Bytes start to end of the text, line ends made plain."""
    part = F.decode(F.substring(F.encode(source, "UTF-8"), start + 1, end - start), "UTF-8")
    return F.replace(part, F.lit("\r\n"), F.lit("\n"))


def snippet(source: Column, line: Column, most: int = 1200) -> Column:
    return F.substring(F.try_element_at(F.split(source, "\n"), line.cast("int")), 1, most)


def import_lines(source: Column) -> Column:
    numbered = F.transform(F.split(source, "\n"), lambda x, k: F.struct((k + 1).alias("line"), x.alias("text")))
    return F.filter(numbered, lambda s: s["text"].rlike(r"^\s*(import|from)\s"))


def search_text(source: Column) -> Column:
    """The source and a copy with identifiers taken apart."""
    return F.concat(source, F.lit("\n"), F.regexp_replace(source, r"([a-z0-9])([A-Z])", "$1 $2"))


def term_pattern(term: str) -> str:
    """A term at the borders of identifiers, whatever its case (Java syntax)."""
    return rf"(?i)(?<![\p{{L}}\p{{N}}_]){re.escape(term)}(?![\p{{L}}\p{{N}}_])"


# Four notions of a test path, each with its own users; they differ on purpose.
def test_path_graph(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"(^|/)tests?/") | low.endswith("_test.py") | low.endswith("test.py")


def test_path_expansion(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"^evals/|(^|/)tests?/") | low.rlike(r"(^|/)test_[^/]*$") | low.endswith("_test.py")


def test_path_search(path: Column) -> Column:
    return path.startswith("tests/") | path.startswith("evals/") | path.contains("/tests/")


def test_path_packet(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"(^|/)(tests?|evals|__tests__)/") | low.rlike(r"(^|/)test_[^/]*$") | low.rlike(r"(_test|\.test|\.spec)\.[^/]+$")


def vendored_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(vendor|third_party|node_modules)/|\.min\.")


#: What is never indexed: names of parts of a path, of files, and endings.
DENIED_PARTS = (
    ".git .hg .svn .ssh .aws .gnupg __pycache__ .venv venv env .env node_modules .pytest_cache .mypy_cache .ruff_cache site-packages .tox".split()
)
DENIED_NAMES = "id_rsa id_dsa credentials credentials.json .npmrc".split()
DENIED_ENDINGS = ".pem .key .p12 .pfx .kdbx".split()
VENV = r"^\.?venv(?:[._-].+|\d+)?$"
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java",
    ".cs": "c_sharp", ".csx": "c_sharp", ".html": "html", ".htm": "html", ".css": "css", ".go": "go",
}


def hard_denied(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    return F.exists(parts, lambda p: p.isin(*DENIED_PARTS) | p.rlike(VENV)) | name.isin(*DENIED_NAMES) | name.startswith(".env") | F.regexp_extract(name, r".(\.[^.]+)$", 1).isin(*DENIED_ENDINGS)


def language(path: Column) -> Column:
    """By the ending; null where there is no parser."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1))


def probably_binary(content: Column) -> Column:
    """A zero byte among the first 8192."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, 8192)) > 0


def wildcard(pattern: str) -> tuple[str, bool]:
    """A LIKE pattern and whether it is anchored: * and ? are wildcards, without which the pattern may stand anywhere."""
    escaped = re.sub(r"([\\%_])", r"\\\1", pattern)
    anchored = "*" in pattern or "?" in pattern
    like = escaped.replace("*", "%").replace("?", "_")
    return (like if anchored else f"%{like}%"), anchored


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case of the 26 letters alone."""
    return F.translate(c, _UPPER, _LOWER)


def ascii_like(c: Column, pattern: str) -> Column:
    return ascii_lower(c).like(pattern.translate(str.maketrans(_UPPER, _LOWER)))
