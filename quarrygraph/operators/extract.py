"""Extraction: a source file in, nodes and raw edges out.

Python is read with its own parser; other languages by line patterns of their declarations, which gives names and spans
but no receiver types. There are no grammar packages here, so the depth of a real grammar is not claimed for them.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions import text as T
from quarrygraph.plans.shared import cut

NODE = "id string, name string, kind string, path string, owner string, language string, span_start int, span_end int, signature string, exported boolean, body_hash string, arity int, variadic boolean"
RAW = "source string, relation string, file string, language string, target_id string, specifier string, name string, via_member boolean, recv_type string, arg_count int"
_FIELDS = [f.split()[0] for f in NODE.split(", ")]
_RAW = [f.split()[0] for f in RAW.split(", ")]

#: Patterns of declarations by language: kind and a pattern whose group is the name.
DECLARATIONS = {
    "typescript": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"), ("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"), ("type", r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*[=<]"), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)")],
    "go": [("function", r"^func\s+([A-Za-z_]\w*)\s*[(\[]"), ("method", r"^func\s+\([^)]*\)\s*([A-Za-z_]\w*)"), ("struct", r"^type\s+([A-Za-z_]\w*)\s+struct\b"), ("interface", r"^type\s+([A-Za-z_]\w*)\s+interface\b")],
    "java": [("class", r"^\s*(?:[\w@]+\s+)*class\s+([A-Za-z_]\w*)"), ("interface", r"^\s*(?:[\w@]+\s+)*interface\s+([A-Za-z_]\w*)"), ("method", r"^\s+(?:public|private|protected|static|final|\s)+[\w<>\[\], ]+\s+([a-z]\w*)\s*\([^;]*\)\s*(?:throws [\w, ]+)?\{")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([a-z_]\w*)"), ("struct", r"^\s*(?:pub\s+)?struct\s+([A-Z]\w*)"), ("trait", r"^\s*(?:pub\s+)?trait\s+([A-Z]\w*)"), ("enum", r"^\s*(?:pub\s+)?enum\s+([A-Z]\w*)")],
    "ruby": [("class", r"^\s*class\s+([A-Z]\w*)"), ("module", r"^\s*module\s+([A-Z]\w*)"), ("method", r"^\s*def\s+(?:self\.)?([a-z_]\w*[?!]?)")],
    "php": [("class", r"^\s*(?:abstract\s+|final\s+)?class\s+([A-Za-z_]\w*)"), ("function", r"^\s*(?:(?:public|private|protected|static|abstract)\s+)*function\s+&?([A-Za-z_]\w*)")],
    "c": [("function", r"^[A-Za-z_][\w\s\*]*?\b([A-Za-z_]\w*)\s*\([^;]*\)\s*\{?\s*$"), ("struct", r"^\s*(?:typedef\s+)?struct\s+([A-Za-z_]\w*)\s*\{")],
    "kotlin": [("class", r"^\s*(?:[\w]+\s+)*class\s+([A-Za-z_]\w*)"), ("function", r"^\s*(?:[\w]+\s+)*fun\s+(?:<[^>]*>\s*)?([A-Za-z_]\w*)")],
    "swift": [("class", r"^\s*(?:[\w]+\s+)*class\s+([A-Za-z_]\w*)"), ("struct", r"^\s*(?:[\w]+\s+)*struct\s+([A-Za-z_]\w*)"), ("function", r"^\s*(?:[\w]+\s+)*func\s+([A-Za-z_]\w*)")],
}
DECLARATIONS["javascript"], DECLARATIONS["cpp"] = DECLARATIONS["typescript"], DECLARATIONS["c"]
IMPORTS = {
    "typescript": r"""^\s*(?:import|export)\b[^'"]*['"]([^'"]+)['"]""", "javascript": r"""^\s*(?:import|export)\b[^'"]*['"]([^'"]+)['"]""",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;", "kotlin": r"^\s*import\s+([\w.]+)", "c": r'^\s*#\s*include\s*"([^"]+)"', "cpp": r'^\s*#\s*include\s*"([^"]+)"',
    "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$', "php": r"^\s*use\s+([\w\\]+)", "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "ruby": r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""",
}


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


class _Ids:
    """Ids in document order; a taken one gets the next free ordinal."""

    def __init__(self) -> None:
        self.taken: set[str] = set()

    def mint(self, base: str) -> str:
        out, k = base, 2
        while out in self.taken:
            out, k = f"{base}~{k}", k + 1
        self.taken.add(out)
        return out


def _children(node: ast.AST) -> list[ast.AST]:
    """A node's children in document order, without the marks of loads, stores and operators."""
    out: list[ast.AST] = []
    for field in node._fields:
        value = getattr(node, field, None)
        if isinstance(value, list):
            out.extend(v for v in value if isinstance(v, ast.AST))
        elif isinstance(value, ast.AST) and value._fields:
            out.append(value)
    return out


def _statements(node: ast.AST) -> list[ast.AST]:
    """The children that are statements or may hold some, as no expression does."""
    return [n for n in _children(node) if not isinstance(n, ast.expr | ast.arguments)]


def _python(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    tree = ast.parse(text)
    lines, ids = text.split("\n"), _Ids()
    nodes: list[tuple] = [(path, path, "file", path, None, "python", 1, len(lines), None, True, _digest(text), None, None)]
    raw: list[tuple] = []

    def callee(f: ast.expr) -> tuple[str | None, bool, str | None]:
        if isinstance(f, ast.Name):
            return f.id, False, None
        if isinstance(f, ast.Attribute):
            return f.attr, True, f.value.id if isinstance(f.value, ast.Name) else None
        return None, False, None

    def types_in(body: ast.AST) -> dict[str, str]:
        """Variables bound once to a call of a capitalised name."""
        found: dict[str, set[str]] = {}
        rest = [body]
        while rest:
            n = rest.pop()
            rest.extend(_statements(n))
            if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Name) and n.value.func.id[:1].isupper():
                found.setdefault(n.targets[0].id, set()).add(n.value.func.id)
        return {k: next(iter(v)) for k, v in found.items() if len(v) == 1}

    def own_calls(body: ast.AST) -> list[ast.Call]:
        """Calls in document order, but for those of definitions inside."""
        found, rest = [], _children(body)[::-1]
        while rest:
            n = rest.pop()
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                continue
            if isinstance(n, ast.Call):
                found.append(n)
            rest.extend(_children(n)[::-1])
        return found

    def charge(body: ast.AST, source: str, owner: str | None) -> None:
        calls = own_calls(body)
        bound = types_in(body) if calls else {}
        for n in calls:
            name, member, base = callee(n.func)
            if name:
                raw.append((source, "calls", path, "python", None, None, name, member, owner if base == "self" else bound.get(base or ""), len(n.args)))

    def visit(node: ast.AST, outer: list[str], parent: str, owner: str | None) -> None:
        for child in _statements(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                cls = isinstance(child, ast.ClassDef)
                kind = "class" if cls else "method" if owner else "function"
                me = ids.mint(f"{path}#{'.'.join([*outer, child.name])}")
                arity = variadic = None
                if not cls:
                    a = child.args
                    arity = len(a.posonlyargs) + len(a.args) - (1 if owner else 0)
                    variadic = bool(a.vararg or a.defaults)
                start, end = min([child.lineno, *(d.lineno for d in child.decorator_list)]), child.end_lineno or child.lineno
                body = "\n".join(lines[start - 1 : end])
                nodes.append((me, child.name, kind, path, owner if not cls else None, "python", start, end, lines[child.lineno - 1].strip(), not child.name.startswith("_"), _digest(body), arity, variadic))
                raw.append((parent, "contains", path, "python", me, None, None, None, None, None))
                if cls:
                    for base in child.bases:
                        name, _, _ = callee(base)
                        if name:
                            raw.append((me, "extends", path, "python", None, None, name, False, None, None))
                visit(child, [*outer, child.name], me, child.name if cls else None)
                charge(child, me, None if cls else owner)
            elif isinstance(child, ast.Import):
                raw.extend((path, "imports", path, "python", None, a.name, None, False, None, None) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                raw.append((path, "imports", path, "python", None, ("./" + "../" * (child.level - 1) if child.level else "") + (child.module or "").replace(".", "/" if child.level else "."), None, False, None, None))
            else:
                visit(child, outer, parent, owner)

    visit(tree, [], path, None)
    charge(tree, path, None)
    return nodes, raw


def _by_lines(path: str, text: str, language: str) -> tuple[list[tuple], list[tuple]]:
    lines, ids = text.split("\n"), _Ids()
    nodes: list[tuple] = [(path, path, "file", path, None, language, 1, len(lines), None, True, _digest(text), None, None)]
    raw: list[tuple] = []
    found = []
    for k, line in enumerate(lines, 1):
        for kind, pattern in DECLARATIONS.get(language, ()):
            if m := re.match(pattern, line):
                found.append((k, kind, m[1], line))
                break
        if (pattern := IMPORTS.get(language)) and (m := re.match(pattern, line)):
            raw.append((path, "imports", path, language, None, m[1], None, False, None, None))
    for k, (start, kind, name, line) in enumerate(found):
        following = found[k + 1][0] if k + 1 < len(found) else len(lines) + 1
        end = max(start, following - 1)
        me = ids.mint(f"{path}#{name}")
        body = lines[start - 1 : end]
        nodes.append((me, name, kind, path, None, language, start, end, line.strip(), True, _digest("\n".join(body)), None, None))
        raw.append((path, "contains", path, language, me, None, None, None, None, None))
        if kind in ("function", "method"):
            for called in dict.fromkeys(re.findall(r"(?<![\w.])([A-Za-z_]\w*)\s*\(", "\n".join(body[1:]))):
                raw.append((me, "calls", path, language, None, None, called, False, None, None))
    return nodes, raw


def _vue(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """The script blocks of a component file, at their places in it."""
    kept = [""] * (text.count("\n") + 1)
    for m in re.finditer(r"(?s)<script\b[^>]*>\n?(.*?)</script>", text):
        first = text.count("\n", 0, m.start(1))
        for k, line in enumerate(m[1].split("\n")):
            kept[first + k] = line
    nodes, raw = _by_lines(path, "\n".join(kept), "typescript")
    return [(*n[:5], "vue", *n[6:]) for n in nodes], raw


def extract_file(path: str, text: str, language: str | None) -> tuple[list[tuple], list[tuple]]:
    """Nodes and raw edges of a file; one that its parser refuses is read by lines."""
    if language == "python":
        try:
            return _python(path, text)
        except (SyntaxError, ValueError, RecursionError):
            pass
    if language == "vue":
        return _vue(path, text)
    return _by_lines(path, text, language or "text")


def _spread(files: DataFrame) -> DataFrame:
    """Files dealt by path over all cores: a table of small texts is few bytes, and so few tasks, but long to parse."""
    spark = files.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return files.select("path", "text", "language").repartition(parts, "path")


def _run(columns: list[str], pick: Callable[[tuple[list[tuple], list[tuple]]], list[tuple]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [r for path, text, language in zip(pdf["path"], pdf["text"], pdf["language"], strict=True) for r in pick(extract_file(path, text or "", language))]
            out = pd.DataFrame(rows, columns=columns)
            for c in ("span_start", "span_end", "arity", "arg_count"):
                if c in out:
                    out[c] = out[c].astype("Int32")
            yield out

    return run


def _checked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("exported", (F.col("kind") == "file") | T.exported(F.col("language"), F.col("name"), F.col("signature")))


def extract_nodes(files: DataFrame) -> DataFrame:
    """Nodes of ``files(path, text, language)``."""
    return _checked(_spread(files).mapInPandas(_run(_FIELDS, lambda found: found[0]), NODE))


def extract_raw_edges(files: DataFrame) -> DataFrame:
    return _spread(files).mapInPandas(_run(_RAW, lambda found: found[1]), RAW)


def extract_both(files: DataFrame, name: str = "extracted") -> tuple[DataFrame, DataFrame]:
    """Nodes and raw edges, numbered by ``edge``, of one parse of each file: both are written as one table, so the
    numbers stay."""
    shared = [c for c in _RAW if c in _FIELDS]
    more = [c for c in _RAW if c not in shared]
    nothing, no_node = (None,) * len(more), dict.fromkeys(_FIELDS)

    def pick(found: tuple[list[tuple], list[tuple]]) -> list[tuple]:
        rows = [(*n, *nothing) for n in found[0]]
        for r in found[1]:
            own = dict(zip(_RAW, r, strict=True))
            rows.append((*(no_node | {c: own[c] for c in shared}).values(), *(own[c] for c in more)))
        return rows

    types = {f.split()[0]: f for f in (NODE + ", " + RAW).split(", ")}
    rows = _spread(files).mapInPandas(_run([*_FIELDS, *more], pick), ", ".join(types[c] for c in [*_FIELDS, *more]))
    both = cut(rows.withColumn("edge", F.monotonically_increasing_id()), name)
    return _checked(both.where("kind is not null").select(*_FIELDS)), both.where("relation is not null").select(*_RAW, "edge")


def incremental(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(fresh files, reusable nodes)``: only files whose hash isn't the cached one's are extracted again.
    ``files(path, hash, ...)``, ``cached(path, hash, ...)``."""
    same = files.select("path", "hash").join(cached.select("path", "hash").distinct(), ["path", "hash"], "left_semi")
    return files.join(same.select("path"), "path", "left_anti"), cached.join(same, ["path", "hash"], "left_semi")
