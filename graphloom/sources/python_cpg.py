"""Python source files to graph tables.

The one place where rows are taken apart in Python: a file at a time, out of ``binaryFile`` rows, in Arrow batches. A file
is parsed with the standard library's ``ast``; its columns are UTF-8 byte offsets, so node ids carry start bytes without
bookkeeping. Imports of one file resolve to exports of another, by joins; a file of whose imports some do is parsed again, with
what they name. A file that does not parse gives a row of ``errors`` and the graph of those top-level blocks that do.

Files of many checkouts go through together if each row says by ``graph_id`` which one it is of: imports resolve within a
checkout only, and node ids begin with it, so equal paths stay apart in every later join.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import model
from graphloom.functions import text
from graphloom.staging import materialize, spread

FUNCTION, CLASS, BLOCK, VARIABLE, CALL = "FunctionNode", "ClassNode", "CodeBlockNode", "VariableNode", "CallNode"
_PREFIX = {FUNCTION: "function", CLASS: "class", BLOCK: "code_block", VARIABLE: "variable", CALL: "call"}
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def scan(spark: SparkSession, root: str, recursive: bool = True, only: str | None = None) -> DataFrame:
    """``file_path, content`` of the Python files below ``root``, without excluded directories; or of the ``only`` file in it."""
    files = spark.read.format("binaryFile")
    if only is not None:
        files = files.load(f"{root.rstrip('/')}/{only}")
    else:
        files = files.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.py").load(root)
    path = text.relative_path(F.col("path"), re.sub("^file:/*", "/", root))
    return files.select(path.alias("file_path"), "content").filter(~excluded(path))


def excluded(path: Column) -> Column:
    """Whether a file lies in a directory that is never scanned."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*map(F.lit, model.EXCLUDED_DIRS)))


def decode(content: bytes) -> str:
    """UTF-8 with one ``?`` for each byte that is not, so that offsets stay."""
    return re.sub("[\udc80-\udcff]", "?", content.decode("utf-8", "surrogateescape"))


def compact(name: str) -> str:
    name = re.sub(r"\s+", " ", name.strip())
    return name if len(name) <= 256 else f"{name[:246]}-{hashlib.sha1(name.encode()).hexdigest()[:8]}"


@dataclass
class _File:
    path: str
    source: str
    imported: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.data = self.source.encode()
        self.lines = self.data.split(b"\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.nodes: dict[str, dict] = {}
        self.edges: list[tuple[str, str, str, str | None]] = []
        self.scopes: list[dict[str, str]] = [dict(self.imported)]
        self.callers: list[str] = []
        self.functions: dict[str, str] = {}  # first function of each name
        self.used: set[tuple[str, str]] = set()

    # -- places and names
    def byte(self, n: ast.AST) -> int:
        return self.starts[n.lineno - 1] + n.col_offset

    def snippet(self, n: ast.AST) -> str:
        end = self.starts[n.end_lineno - 1] + n.end_col_offset
        return self.data[self.byte(n) : end].decode()

    def node_id(self, kind: str, name: str, start: int) -> str:
        return f"{_PREFIX[kind]}:{compact(name)}@{self.path}:{start}"

    def add(self, kind: str, name: str | None, start: int, first: int, last: int, shown: str | None = None, **more) -> str:
        i = self.node_id(kind, name or "", start)
        self.nodes.setdefault(i, {"identifier": i, "kind": kind, "name": shown, "file_path": self.path, "line_start": first, "line_end": last, **more})
        return i

    def link(self, src: str, dst: str, kind: str, operation: str | None = None) -> None:
        self.edges.append((src, dst, kind, operation))

    # -- scopes
    def bind(self, name: str, to: str) -> None:
        self.scopes[-1][name] = to

    def resolve(self, name: str) -> tuple[str | None, int]:
        for depth in range(len(self.scopes) - 1, -1, -1):
            if name in self.scopes[depth]:
                return self.scopes[depth][name], depth
        return None, -1

    def note_use(self, found: str, depth: int) -> None:
        if self.callers and depth < len(self.scopes) - 1 and found.startswith("variable:") and (found, self.callers[-1]) not in self.used:
            self.used.add((found, self.callers[-1]))
            self.link(found, self.callers[-1], "USED_BY")

    # -- what values are made of
    def atoms(self, n: ast.AST) -> Iterator[tuple[str, ast.AST]]:
        """Names, whole dotted attributes, and calls followed by what their arguments are made of, in source order."""
        if isinstance(n, ast.Name):
            yield n.id, n
        elif isinstance(n, ast.Attribute):
            yield re.sub(r"\s+", " ", self.snippet(n).strip()), n
        elif isinstance(n, ast.Call):
            yield "", n
            yield from self.argument_atoms(n)
        else:
            for child in ast.iter_child_nodes(n):
                yield from self.atoms(child)

    def argument_atoms(self, call: ast.Call) -> Iterator[tuple[str, ast.AST]]:
        for a in sorted([*call.args, *[k.value for k in call.keywords]], key=lambda x: (x.lineno, x.col_offset)):
            yield from self.atoms(a)

    def target(self, call: ast.Call) -> str | None:
        """The function or class that is called, if it is known: by name, or by the method's name alone."""
        f = call.func
        if isinstance(f, ast.Name):
            found = self.resolve(f.id)[0]
        elif isinstance(f, ast.Attribute):
            found = self.resolve(f.attr)[0]
            if not (found or "").startswith(("function:", "class:")):
                found = self.functions.get(f.attr)
        else:
            return None
        return found if found and found.startswith(("function:", "class:")) else None

    def call_id(self, call: ast.Call) -> str:
        name = f"{call.func.attr}()" if isinstance(call.func, ast.Attribute) else self.snippet(call)
        return self.node_id(CALL, name, self.byte(call))

    def add_call(self, call: ast.Call, callee: str) -> str:
        name = f"{call.func.attr}()" if isinstance(call.func, ast.Attribute) else self.snippet(call)
        caller = self.callers[-1]
        i = self.add(CALL, name, self.byte(call), call.lineno, call.end_lineno, caller_id=caller, callee_id=callee)
        self.link(caller, i, "CALLS")
        self.link(i, callee, "CALLED_BY")
        seen = set()
        for name, atom in self.argument_atoms(call):
            if isinstance(atom, ast.Call):
                source = self.call_id(atom) if self.target(atom) else None
            else:
                source, depth = self.resolve(name)
                if source:
                    self.note_use(source, depth)
            if source and source not in seen:
                seen.add(source)
                self.link(source, i, "FLOWS_TO")
        return i

    # -- statements
    def targets(self, n: ast.AST) -> Iterator[tuple[str, ast.AST]]:
        if isinstance(n, ast.Name):
            yield n.id, n
        elif isinstance(n, (ast.Attribute, ast.Subscript)):
            yield re.sub(r"\s+", " ", self.snippet(n).strip()), n
        elif isinstance(n, (ast.Tuple, ast.List)):
            for e in n.elts:
                yield from self.targets(e)
        elif isinstance(n, ast.Starred):
            yield from self.targets(n.value)

    def variable(self, name: str, n: ast.AST, hint: str = "") -> str:
        i = self.add(VARIABLE, name, self.byte(n), n.lineno, n.end_lineno, shown=name, type_hint=hint)
        self.bind(name, i)
        return i

    def defined(self, name: str, n: ast.AST, hint: str) -> str:
        """The variable of a name in this scope, made at its first definition there."""
        now = self.scopes[-1].get(name)
        return now if now and now.startswith("variable:") else self.variable(name, n, hint)

    def assign(self, n: ast.Assign | ast.AnnAssign | ast.AugAssign) -> None:
        if n.value is None:
            return
        left = n.targets if isinstance(n, ast.Assign) else [n.target]
        hint = re.sub(r"\s+", " ", self.snippet(n.annotation)) if isinstance(n, ast.AnnAssign) else ""
        names = [t for x in left for t in self.targets(x)]
        sources: dict[str, None] = {}
        for name, atom in self.atoms(n.value):
            if isinstance(atom, ast.Call):
                if self.callers and (callee := self.target(atom)):
                    sources[self.add_call(atom, callee)] = None
                continue
            found, depth = self.resolve(name)
            if found and found not in sources:
                sources[found] = None
                self.note_use(found, depth)
        if isinstance(n, ast.AugAssign):
            sources |= {p: None for name, _ in names if (p := self.resolve(name)[0])}
        for name, at in names:
            to = self.defined(name, at, hint)
            for s in sources:
                self.link(s, to, "DEFINED_BY", "assignment")

    def function(self, n: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        i = self.add(FUNCTION, n.name, self.byte(n), n.lineno, n.end_lineno, shown=n.name)
        self.bind(n.name, i)
        self.scopes.append({})
        self.callers.append(i)
        a = n.args
        for arg, default in self.parameters(a):
            hint = re.sub(r"\s+", " ", self.snippet(arg.annotation)) if arg.annotation else ""
            self.link(i, self.variable(arg.arg, arg, hint), "DEFINED_BY", "parameter")
            for part in (arg.annotation, default):
                for name in sorted((x for x in ast.walk(part) if isinstance(x, ast.Name)), key=self.byte) if part else ():
                    self.link(i, self.variable(name.id, name), "DEFINED_BY", "parameter")
        for s in n.body:
            self.process(s)
        self.callers.pop()
        self.scopes.pop()

    @staticmethod
    def parameters(a: ast.arguments) -> list[tuple[ast.arg, ast.AST | None]]:
        plain = [*a.posonlyargs, *a.args]
        pairs = list(zip(plain, [None] * (len(plain) - len(a.defaults)) + a.defaults, strict=True))
        pairs += [(a.vararg, None)] if a.vararg else []
        pairs += list(zip(a.kwonlyargs, a.kw_defaults, strict=True))
        return pairs + ([(a.kwarg, None)] if a.kwarg else [])

    def class_(self, n: ast.ClassDef) -> None:
        last = max([n.lineno, *[x.end_lineno for x in [*n.bases, *[k.value for k in n.keywords]]]])
        if n.bases or n.keywords:  # the closing bracket may stand below the last base
            depth = 0
            for t in _tokens("\n".join(x.decode() for x in self.lines[n.lineno - 1 : n.body[0].lineno])):
                depth += (t.string in "([{") - (t.string in ")]}") if t.type == tokenize.OP else 0
                if t.string == ")" and depth == 0:
                    last = n.lineno + t.end[0] - 1
                    break
        i = self.add(CLASS, n.name, self.byte(n), n.lineno, last, shown=n.name)
        self.bind(n.name, i)
        before = set(self.nodes)
        for s in n.body:
            self.process(s)
        for inner in [x for x in self.nodes if x not in before]:
            self.link(i, inner, "DEFINED_BY", "assignment")

    def process(self, n: ast.AST) -> None:
        if isinstance(n, _DEFS):
            self.function(n)
        elif isinstance(n, ast.ClassDef):
            self.class_(n)
        elif isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            self.assign(n)
        elif isinstance(n, ast.Call):
            if not self.callers:
                return
            for name, atom in self.argument_atoms(n):
                if not isinstance(atom, ast.Call):
                    found, depth = self.resolve(name)
                    if found:
                        self.note_use(found, depth)
            if callee := self.target(n):
                self.add_call(n, callee)
                for child in ast.iter_child_nodes(n):
                    self.process(child)
        else:
            for child in ast.iter_child_nodes(n):
                self.process(child)

    # -- the module
    def module(self) -> None:
        tree = self.tree = ast.parse(self.source)
        for n in tree.body:  # names that may be used before they are defined
            if isinstance(n, ast.ClassDef):
                self.bind(n.name, self.node_id(CLASS, n.name, self.byte(n)))
                for m in n.body:
                    if isinstance(m, _DEFS) and not m.decorator_list:
                        self.bind(m.name, self.node_id(FUNCTION, m.name, self.byte(m)))
        for n in tree.body:
            if isinstance(n, _DEFS) and not n.decorator_list:
                self.bind(n.name, self.node_id(FUNCTION, n.name, self.byte(n)))
        for n in sorted((x for x in ast.walk(tree) if isinstance(x, _DEFS)), key=self.byte):
            self.functions.setdefault(n.name, self.node_id(FUNCTION, n.name, self.byte(n)))
        for n in tree.body:
            if isinstance(n, (ast.Assign, ast.AnnAssign)):
                for x in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    for name, at in self.targets(x):
                        if not (self.scopes[0].get(name) or "").startswith("variable:"):
                            self.variable(name, at, self.snippet(n.annotation) if isinstance(n, ast.AnnAssign) else "")
        for n in tree.body:
            if isinstance(n, (*_DEFS, ast.ClassDef)):
                self.process(n)
        for run in self.runs(tree):
            first, last = run[0], run[-1]
            line = self.lines[first[0] - 1].decode().strip()
            i = self.add(BLOCK, line, self.starts[first[0] - 1] + first[1], first[0], last[2])
            self.callers.append(i)
            for *_, n in run:
                if n is not None:
                    self.process(n)
            self.callers.pop()

    def runs(self, tree: ast.Module) -> list[list[tuple]]:
        """Contiguous top-level statements and comments that are neither definitions nor imports."""
        items = []
        for n in tree.body:
            breaks = isinstance(n, (*_DEFS, ast.ClassDef, ast.Import)) or isinstance(n, ast.ImportFrom) and n.module != "__future__"
            start = min([n.lineno, *[d.lineno for d in getattr(n, "decorator_list", [])]])
            items.append((start, n.col_offset, n.end_lineno, None if breaks else n, breaks))
        spans = [(a, c) for a, _, c, _, _ in items]
        for t in _tokens(self.source) if "#" in self.source else ():
            if t.type == tokenize.COMMENT and t.start[1] == 0 and not any(a <= t.start[0] <= c for a, c in spans):
                items.append((t.start[0], 0, t.start[0], None, False))
        out, run = [], []
        for a, b, c, n, breaks in sorted(items, key=lambda x: x[:3]):
            if breaks:
                out += [run] if run else []
                run = []
            else:
                run.append((a, b, c, n))
        return out + ([run] if run else [])

    def exports(self) -> list[tuple[str, str, str]]:
        """Name, kind and node of the module's functions, classes and variables: a later kind overwrites an earlier."""
        found: dict[str, tuple[str, str]] = {}
        tree = self.tree
        for kind, want in ((FUNCTION, _DEFS), (CLASS, ast.ClassDef)):
            for n in tree.body:
                if isinstance(n, want):
                    found[n.name] = (kind, self.node_id(kind, n.name, self.byte(n)))
        for n in tree.body:
            for x in n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []:
                if isinstance(x, ast.Name):
                    i = self.scopes[0].get(x.id)
                    if i and i.startswith("variable:"):
                        found[x.id] = (VARIABLE, i)
        return [(name, kind, i) for name, (kind, i) in found.items()]

    def imports(self) -> list[tuple[str, int, str, str]]:
        """Module text, level, imported name and local name of top-level ``from`` imports."""
        return [(n.module or "", n.level, a.name, a.asname or a.name) for n in self.tree.body if isinstance(n, ast.ImportFrom) for a in n.names if a.name != "*"]


def _tokens(source: str) -> Iterator[tokenize.TokenInfo]:
    try:
        yield from tokenize.generate_tokens(io.StringIO(source).readline)
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return


def salvage(source: str) -> str:
    """A source with a syntax error without those top-level blocks that do not parse; all else keeps its place in bytes."""
    lines = source.splitlines(keepends=True)
    starts = [i for i, x in enumerate(lines) if x[:1].strip() and x[0] not in "#)]}" and not re.match(r"(else|elif|except|finally)\b", x)]
    starts = [i for k, i in enumerate(starts) if not k or not lines[starts[k - 1]].startswith("@")]  # decorators stay with theirs
    out = lines[: starts[0]] if starts else []
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        block = "".join(lines[a:b])
        try:
            ast.parse(block)
        except (SyntaxError, ValueError, RecursionError):
            block = "".join(c if c in "\r\n" else " " * len(c.encode("utf-8", "surrogatepass")) for c in block)
        out.append(block)
    return "".join(out)


def parse(path: str, content: bytes, imported: dict[str, str] | None = None) -> dict[str, list]:
    """``nodes, edges, exports, imports, errors`` of one file, in source order.

    Of a file with a syntax error, what parses is kept beside the error.
    """
    errors: list[str] = []
    source = decode(content)
    for again in (True, False):
        f = _File(path, source, dict(imported or {}))
        try:
            f.module()
            return {"nodes": list(f.nodes.values()), "edges": f.edges, "exports": f.exports(), "imports": f.imports(), "errors": errors}
        except (SyntaxError, ValueError, RecursionError) as e:
            errors.append(f"{type(e).__name__}: {e}")
            if again:
                source = salvage(source)
    return {"nodes": [], "edges": [], "exports": [], "imports": [], "errors": errors[:1]}


ROWS = "what string, ord bigint, a string, b string, c string, d string, file_path string, line_start int, line_end int, name string, kind string, graph_id string"


def _flat(path: str, got: dict[str, list]) -> Iterator[tuple]:
    for k, n in enumerate(got["nodes"]):
        yield "node", k, n["identifier"], n.get("type_hint"), n.get("caller_id"), n.get("callee_id"), path, n["line_start"], n["line_end"], n["name"], n["kind"]
    for k, (src, dst, kind, op) in enumerate(got["edges"]):
        yield "edge", k, src, dst, kind, op, path, None, None, None, None
    for k, (name, kind, i) in enumerate(got["exports"]):
        yield "export", k, i, None, None, None, path, None, None, name, kind
    for k, (module, level, name, local) in enumerate(got["imports"]):
        yield "import", k, module, str(level), local, None, path, None, None, name, None
    for k, e in enumerate(got["errors"]):
        yield "error", k, e, None, None, None, path, None, None, None, None


def _pass(files: DataFrame) -> DataFrame:
    """One parse of every file of each ``graph_id``; an optional column ``imported`` maps local names to the nodes they import.

    Files are dealt to all tasks first: small ones are many to a stored block, and parsing costs time, not bytes. The hash keeps a
    join by file before it from standing for that exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
        schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in ROWS.split(", ")])
        for batch in batches:
            own = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            imported = own.get("imported", [None] * batch.num_rows)
            rows = []
            for graph_id, path, content, names in zip(own["graph_id"], own["file_path"], own["content"], imported, strict=True):
                rows += [(*x, graph_id) for x in _flat(path, parse(path, content, dict(names or ())))]
            columns = zip(*rows, strict=True) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return spread(files, F.xxhash64("graph_id", "file_path")).mapInArrow(run, ROWS)


def scoped(graph_id: Column, identifier: Column) -> Column:
    """An id that no other checkout has; the plain one where there is one checkout only."""
    return F.when(graph_id == "", identifier).otherwise(F.concat(graph_id, F.lit("|"), identifier))


def build(files: DataFrame) -> dict[str, DataFrame]:
    """``nodes``, ``edges`` and ``errors`` of all files, imports linked to what they name.

    With ``graph_id`` in ``files``, of every checkout, and each row says of which; a null one is a checkout as well.
    """
    many = "graph_id" in files.columns
    rows = files.select(F.coalesce("graph_id", F.lit("null")).alias("graph_id") if many else F.lit("").alias("graph_id"), "file_path", "content")
    first = materialize(_pass(rows), "symbols")
    module = text.module_name(F.col("file_path"))
    exports = first.filter("what = 'export'").select("graph_id", module.alias("module"), "name", F.col("a").alias("node"), "ord", "file_path")
    w = Window.partitionBy("graph_id", "module", "name").orderBy("file_path", F.desc("ord"))
    exports = exports.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("graph_id", "module", "name", "node")
    imports = first.filter("what = 'import'").withColumn("here", module)
    package = F.when(F.endswith("file_path", F.lit("__init__.py")), F.col("here")).otherwise(F.regexp_replace("here", r"\.?[^.]+$", ""))
    parts = F.filter(F.split(package, r"\."), lambda x: x != "")
    level = F.col("b").cast("int")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level + 1, F.lit(0))), ".")
    full = F.when(level == 0, F.col("a")).otherwise(F.array_join(F.filter(F.array(base, F.col("a")), lambda x: x != ""), "."))
    file = ["graph_id", "file_path"]
    linked = imports.withColumn("module", full).join(exports, ["graph_id", "module", "name"]).groupBy(*file, "c").agg(F.max_by("node", "ord").alias("node"))
    linked = materialize(linked.groupBy(*file).agg(F.map_from_entries(F.collect_list(F.struct("c", "node"))).alias("imported")), "imported")
    # Other files would give the same rows again.
    rows = materialize(_pass(rows.join(linked, file)), "parsed").union(first.join(linked.select(*file), file, "left_anti").select(*first.columns))
    of = [F.col("graph_id")] if many else []
    own = lambda c: scoped(F.col("graph_id"), F.col(c))
    nodes = rows.filter("what = 'node'").select(
        *of, own("a").alias("identifier"), "kind", "name", "file_path", "line_start", "line_end", F.lit(0).alias("token_count"), F.col("b").alias("type_hint"), own("c").alias("caller_id"), own("d").alias("callee_id"),
        F.lit(0.0).alias("finding_evidence_score"), F.lit(0.0).alias("security_path_score"), "ord",
    )
    edges = rows.filter("what = 'edge'").select(*of, own("a").alias("src"), own("b").alias("dst"), F.col("c").alias("type"), F.col("d").alias("operation"), "ord")
    errors = rows.filter("what = 'error'").select(*of, "file_path", F.col("a").alias("error"))
    return {"nodes": nodes, "edges": edges, "errors": errors}
