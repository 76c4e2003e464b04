"""Extractors: source files to symbols, calls, imports and class hierarchies, one Arrow batch at a time.

Python is parsed by its own grammar; other languages by patterns for declarations, imports and calls, as their grammars are
not part of the installation. A file that can't be parsed gives one row with its error."""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DECLARED = {
    "java": r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)(?:[^{]*?\b(?:extends|implements)\s+(?P<bases>[\w.,<>\s]+))?",
    "c_sharp": r"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(?P<kind>class|interface|enum|record|struct)\s+(?P<name>\w+)(?:\s*:\s*(?P<bases>[\w.,<>\s]+))?",
    "javascript": r"^\s*(?:export\s+(?:default\s+)?)?(?:(?P<kind>class)\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w.]+))?|(?:async\s+)?(?P<fkind>function)\s*\*?\s*(?P<fname>\w+)\s*\()",
    "go": r"^(?:type\s+(?P<name>\w+)\s+(?P<kind>struct|interface)|(?P<fkind>func)\s+(?:\(\s*\w+\s+\*?(?P<recv>\w+)\s*\)\s*)?(?P<fname>\w+)\s*\()",
}
_DECLARED["typescript"] = _DECLARED["tsx"] = _DECLARED["javascript"]
_IMPORTED = {
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "c_sharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",
    "javascript": r"(?:\bfrom\s+|\brequire\(\s*|^\s*import\s+)['\"]([^'\"]+)['\"]", "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$",
}
_IMPORTED["typescript"] = _IMPORTED["tsx"] = _IMPORTED["javascript"]
_METHOD = re.compile(r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|synchronized)\s+)*[\w<>\[\],.?]+\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?:throws\s+[\w.,\s]+)?[{]")
_CALL = re.compile(r"(?:(?P<receiver>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\.)?(?P<name>[A-Za-z_$][\w$]*)\s*\(")
_KEYWORDS = frozenset("if for while switch return catch function new def class with elif except assert sizeof using lock foreach func".split())


def symbol_id(language: str, path: str, qualified: str, salt: str) -> str:
    return f"{language}:{path}:{qualified}:{hashlib.sha256(salt.encode()).hexdigest()[:16]}"


def _named(node: ast.AST | None) -> str | None:
    """The last part of a type written as a name, a dotted name or a string of one."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        m = re.fullmatch(r"\s*(?:\w+\.)*([A-Za-z_]\w*)\s*", node.value)
        return m[1] if m else None
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


class Types(dict):
    """Name to type, of names that are always bound to one type; null for those that aren't."""

    def note(self, name: str, kind: str | None) -> None:
        self[name] = kind if self.get(name, kind) == kind else None


def _made(value: ast.AST | None, returns: dict[str, str]) -> str | None:
    """The type that an expression makes: a call of a class (by its capital), or of a function whose return type is declared."""
    if not isinstance(value, ast.Call) or not (name := _named(value.func)):
        return None
    return name if name[0].isupper() else returns.get(name)


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """The nodes below, without those of functions and classes in it."""
    for child in ast.iter_child_nodes(node):
        yield child
        if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            yield from _own(child)


def _parameters(fn: ast.FunctionDef | ast.AsyncFunctionDef) -> Types:
    a = fn.args
    return Types({x.arg: _named(x.annotation) for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]})


def scope_types(fn: ast.FunctionDef | ast.AsyncFunctionDef, returns: dict[str, str]) -> Types:
    """Types of a function's parameters and local names."""
    types = _parameters(fn)
    for node in _own(fn):
        if isinstance(node, ast.Assign):
            for target in node.targets:
                if isinstance(target, ast.Name):
                    types.note(target.id, _made(node.value, returns))
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            types.note(node.target.id, _named(node.annotation))
        elif isinstance(node, ast.withitem) and isinstance(node.optional_vars, ast.Name):
            types.note(node.optional_vars.id, _made(node.context_expr, returns))
    bound = {n.id for n in _own(fn) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    known = {t.id for n in _own(fn) for t in ([x for x in n.targets] if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else [n.optional_vars] if isinstance(n, ast.withitem) else []) if isinstance(t, ast.Name)}
    for name in bound - known:  # loops, unpacking and the like
        types[name] = None
    return types


def attribute_types(cls: ast.ClassDef, returns: dict[str, str]) -> Types:
    """Types of a class's attributes: declared in its body, or bound to self in its methods."""
    types = Types()
    for node in cls.body:
        if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            types.note(node.target.id, _named(node.annotation))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            of = _parameters(node)
            for x in _own(node):
                targets = x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, (ast.AnnAssign, ast.AugAssign)) else []
                for t in targets:
                    if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                        declared = _named(x.annotation) if isinstance(x, ast.AnnAssign) else None
                        value = getattr(x, "value", None)
                        types.note(t.attr, declared or _made(value, returns) or (of.get(value.id) if isinstance(value, ast.Name) else None))
    return types


def narrowed(test: ast.AST) -> dict[str, str]:
    """Types that a condition settles for its branch: isinstance of a name and one class, alone or joined by `and`."""
    if isinstance(test, ast.BoolOp) and isinstance(test.op, ast.And):
        return {k: v for t in test.values for k, v in narrowed(t).items()}
    if isinstance(test, ast.Call) and _named(test.func) == "isinstance" and len(test.args) == 2 and isinstance(test.args[0], ast.Name) and (kind := _named(test.args[1])):
        return {test.args[0].id: kind}
    return {}


def _py(path: str, source: str) -> dict:
    parsed = ast.parse(source)
    offsets = [0]
    for line in source.split("\n"):
        offsets.append(offsets[-1] + len(line.encode()) + 1)
    symbols, calls, imports, bases = [], [], [], []
    returns = {n.name: t for n in ast.walk(parsed) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and (t := _named(n.returns)) and t[0].isupper() and t not in ("None", "Any")}

    def byte(line, col):
        return offsets[line - 1] + col

    def walk(node, owners, in_class, local, attributes):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                is_class = isinstance(child, ast.ClassDef)
                qualified = ".".join([*owners, child.name])
                n_params = None
                if not is_class:
                    a = child.args
                    n_params = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) - int(in_class and not any(getattr(x, "id", "") == "staticmethod" for x in child.decorator_list))
                header = source.split("\n")[child.lineno - 1].strip()[:500]
                symbols.append({"symbol_id": symbol_id("python", path, qualified, f"{child.lineno}:{header}"), "name": child.name, "qualified_name": qualified, "kind": "class" if is_class else "method" if in_class else "function", "signature": header, "start_line": child.lineno, "end_line": child.end_lineno, "start_byte": byte(child.lineno, child.col_offset), "end_byte": byte(child.end_lineno, child.end_col_offset), "body_start": byte(child.body[0].lineno, child.body[0].col_offset), "body_end": byte(child.end_lineno, child.end_col_offset), "is_private": child.name.startswith("_") and not child.name.startswith("__"), "n_params": n_params})
                if is_class:
                    bases.extend({"class_name": qualified, "parent_name": ast.unparse(b)} for b in child.bases)
                walk(child, [*owners, child.name], is_class, {} if is_class else {**local, **scope_types(child, returns)}, attribute_types(child, returns) if is_class else attributes)
                continue
            if isinstance(child, ast.Call):
                fn = child.func
                name = fn.attr if isinstance(fn, ast.Attribute) else fn.id if isinstance(fn, ast.Name) else None
                if name:
                    on = fn.value if isinstance(fn, ast.Attribute) else None
                    kind = local.get(on.id) if isinstance(on, ast.Name) else attributes.get(on.attr) if isinstance(on, ast.Attribute) and isinstance(on.value, ast.Name) and on.value.id == "self" else _made(on, returns)
                    calls.append({"name": name, "receiver": ast.unparse(on) if on is not None else None, "receiver_type": kind, "line": child.lineno, "start_byte": byte(child.lineno, child.col_offset), "arg_count": len(child.args) + len(child.keywords)})
            elif isinstance(child, ast.Import):
                imports.extend(a.name for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                head = "." * child.level + (child.module or "")
                imports.extend([head, *(f"{head}.{a.name}" for a in child.names if head.strip("."))])
            if isinstance(child, ast.If) and (settled := narrowed(child.test)):
                walk(ast.Expression(child.test), owners, in_class, local, attributes)
                walk(ast.Module(child.body, []), owners, in_class, {**local, **settled}, attributes)
                walk(ast.Module(child.orelse, []), owners, in_class, local, attributes)
            else:
                walk(child, owners, in_class, local, attributes)

    walk(parsed, [], False, {}, {})
    return {"symbols": symbols, "calls": calls, "imports": sorted({i for i in imports if i}), "bases": bases, "namespaces": [], "bindings": []}


def _block_end(lines: list[str], start: int) -> int:
    """The line on which the braces opened from `start` on are closed."""
    depth, opened = 0, False
    for k in range(start, len(lines)):
        depth += lines[k].count("{") - lines[k].count("}")
        opened |= "{" in lines[k]
        if opened and depth <= 0:
            return k
    return len(lines) - 1


_NAMESPACE = {"java": re.compile(r"^\s*package\s+([\w.]+)\s*;", re.M), "c_sharp": re.compile(r"^\s*namespace\s+([\w.]+)", re.M)}
_BOUND = re.compile(r"\b(?:const|let|var)\s+(?:(?P<name>\w+)|\{(?P<names>[^}]*)\})\s*=\s*require\(\s*['\"](?P<module>[^'\"]+)['\"]|\bimport\s+(?P<clause>[\w*{}\s,$]+?)\s+from\s+['\"](?P<source>[^'\"]+)['\"]")


def module_bindings(source: str) -> list[dict]:
    """Names that a script binds to modules or to what they export, by require or import."""
    out = []
    for m in _BOUND.finditer(source):
        clause, module = (m["clause"], m["source"]) if m["clause"] else (m["name"] or "{" + m["names"] + "}", m["module"])
        for part in re.split(r"[{},]", clause):
            words = re.split(r"\s+as\s+|\s*:\s*", part.strip())
            if words[-1] and words[-1] != "*":
                out.append({"name": words[-1], "module": module})
    return out


def _other(path: str, source: str, language: str) -> dict:
    lines = source.split("\n")
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line.encode()) + 1)
    spaces = list(dict.fromkeys(_NAMESPACE[language].findall(source))) if language in _NAMESPACE else []
    bindings = module_bindings(source) if language in ("javascript", "typescript", "tsx") else []
    return _scan(path, lines, offsets, language, []) | {"namespaces": spaces, "bindings": bindings}


def _scan(path: str, lines: list[str], offsets: list[int], language: str, owners: list[tuple[str, int]]) -> dict:
    symbols, calls, imports, bases = [], [], [], []
    declared = re.compile(_DECLARED.get(language, r"(?!)"))
    imported = re.compile(_IMPORTED.get(language, r"(?!)"))

    def add(name, kind, k, n_params=None, owner=None):
        qualified = ".".join([*(o for o, _ in owners), *([owner] if owner else []), name])
        end = _block_end(lines, k)
        header = lines[k].strip()[:500]
        symbols.append({"symbol_id": symbol_id(language, path, qualified, f"{k + 1}:{header}"), "name": name, "qualified_name": qualified, "kind": kind, "signature": header, "start_line": k + 1, "end_line": end + 1, "start_byte": offsets[k], "end_byte": offsets[end + 1] - 1, "body_start": None, "body_end": None, "is_private": name.startswith("_") or "private" in header.split(name)[0], "n_params": n_params})
        return qualified, end

    for k, line in enumerate(lines):
        while owners and k > owners[-1][1]:
            owners.pop()
        imports += imported.findall(line)
        name_here = None
        if m := declared.match(line):
            d = m.groupdict()
            if d.get("name"):
                name_here = d["name"]
                qualified, end = add(d["name"], "interface" if d["kind"] == "interface" else "class", k)
                bases += [{"class_name": qualified, "parent_name": b.strip()} for b in re.split(r",|\bimplements\b", re.sub(r"<[^<>]*>", "", d.get("bases") or "")) if b.strip()]
                owners.append((d["name"], end))
            else:
                name_here = d["fname"]
                add(d["fname"], "method" if d.get("recv") else "function", k, owner=d.get("recv"))
        elif language in ("java", "c_sharp") and (m := _METHOD.match(line)) and m["name"] not in _KEYWORDS:
            name_here = m["name"]
            add(m["name"], "method", k, len([p for p in m["params"].split(",") if p.strip()]))
        for c in _CALL.finditer(line):
            if c["name"] not in _KEYWORDS and c["name"] != name_here:
                inner = line[c.end() :].split(")")[0]
                calls.append({"name": c["name"], "receiver": c["receiver"], "receiver_type": None, "line": k + 1, "start_byte": offsets[k] + len(line[: c.start()].encode()), "arg_count": len([a for a in inner.split(",") if a.strip()])})
    return {"symbols": symbols, "calls": calls, "imports": sorted(set(imports)), "bases": bases}


def parse(path: str, source: str, language: str | None) -> dict:
    """symbols, calls, imports, bases, status and error of one file."""
    empty: dict = {"symbols": [], "calls": [], "imports": [], "bases": [], "namespaces": [], "bindings": []}
    if language is None:
        return empty | {"status": "unsupported", "error": None}
    try:
        return (_py(path, source) if language == "python" else _other(path, source, language)) | {"status": "parsed", "error": None}
    except (SyntaxError, ValueError, RecursionError) as e:
        return empty | {"status": "parse_error", "error": f"{type(e).__name__}: {e}"}


_SYMBOL = "symbol_id: string, name: string, qualified_name: string, kind: string, signature: string, start_line: int, end_line: int, start_byte: bigint, end_byte: bigint, body_start: bigint, body_end: bigint, is_private: boolean, n_params: int"
_FACTS = "path string, status string, error string, facts string"
_SHAPE = f"struct<symbols: array<struct<{_SYMBOL}>>, calls: array<struct<name: string, receiver: string, receiver_type: string, line: int, start_byte: bigint, arg_count: int>>, imports: array<string>, bases: array<struct<class_name: string, parent_name: string>>, namespaces: array<string>, bindings: array<struct<name: string, module: string>>>"


def facts(found: DataFrame) -> DataFrame:
    """path, status, error and `f` (symbols, calls, imports, bases) of each file of a scan: one narrow stage, no shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, language, content in pdf[["path", "language", "content"]].itertuples(index=False, name=None):
                p = parse(path, (bytes(content) if content is not None else b"").decode("utf-8", "replace").replace("\r\n", "\n"), language if isinstance(language, str) else None)
                rows.append((path, p.pop("status"), p.pop("error"), json.dumps(p)))
            yield pd.DataFrame(rows, columns=["path", "status", "error", "facts"])

    raw = found.select("path", "language", "content").mapInPandas(run, _FACTS)
    return raw.select("path", "status", "error", F.from_json("facts", _SHAPE).alias("f"))


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """symbols, calls, imports, class_hierarchy, namespaces and module bindings of parsed files."""
    one = lambda c: parsed.select("path", F.explode(f"f.{c}").alias("x"))
    return {
        "symbols": one("symbols").select("path", "x.*"),
        "calls": one("calls").select("path", "x.*"),
        "imports": one("imports").select("path", F.col("x").alias("module")),
        "class_hierarchy": one("bases").select("path", "x.*"),
        "namespaces": one("namespaces").select("path", F.col("x").alias("namespace")),
        "bindings": one("bindings").select("path", "x.*"),
    }


def skeleton(source: str, symbols: list[dict], include_private: bool = True) -> str:
    """Imports and headers of a file, with bodies left out."""
    lines = source.split("\n")
    out = [x for x in lines if re.match(r"\s*(import|from|using|package)\s", x)]
    for s in sorted(symbols, key=lambda s: s["start_line"]):
        if include_private or not s["is_private"]:
            head = lines[s["start_line"] - 1]
            out.append(head if s["kind"] == "class" else f"{head} ...")
    return "\n".join(out)


def compress(text: str, intent: str, most_chars: int = 3000) -> str:
    """A text whose long bodies that don't concern the intent are left out, if it is over the limit."""
    if len(text) <= most_chars:
        return text
    wanted = set(re.findall(r"\w+", intent.lower()))
    try:
        symbols = _py("x", text)["symbols"]
    except (SyntaxError, ValueError):
        return text[:most_chars]
    lines, gone = text.split("\n"), set()
    for s in symbols:
        words = set(re.findall(r"[a-z]+|\d+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", s["name"]).lower().replace("_", " ")))
        if s["kind"] != "class" and not words & wanted and s["end_line"] - s["start_line"] > 2:
            gone |= set(range(s["start_line"] + 1, s["end_line"] + 1))
    out = []
    for k, line in enumerate(lines, 1):
        if k not in gone:
            out.append(line)
        elif k - 1 not in gone:
            out.append(" " * (len(line) - len(line.lstrip())) + "...")
    return "\n".join(out)
