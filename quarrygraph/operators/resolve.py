"""Resolution of raw edges to nodes: relational joins on names, owners, paths and suffixes.

``nodes(id, name, kind, path, owner, language, arity, variadic)``; ``raw(edge, source, relation, file, language, name,
via_member, recv_type, specifier, arg_count)`` where ``edge`` numbers the raw edges. A rule that finds more than one
node finds none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed table of languages that can call each other.
FAMILIES = {"typescript": "js", "javascript": "js", "vue": "js", "java": "jvm", "kotlin": "jvm", "scala": "jvm", "c": "c", "cpp": "c", "python": "python", "go": "go", "php": "php", "swift": "swift", "r": "r", "ruby": "ruby", "rust": "rust", "perl": "perl"}
#: Fixed order of what a relative import may leave out.
PROBES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")
MAX_ANCESTORS = 3
#: Copies of a key's row over which the rows that share the key are dealt.
COPIES = 16


def family(language: Column) -> Column:
    """A language that the table doesn't name is a family of its own; only no language is an unknown one."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair]), language), language)


def reachable(a: Column, b: Column) -> Column:
    """Unknown families never rule a target out."""
    return family(a).isNull() | family(b).isNull() | (family(a) == family(b))


def _one(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias("target")).where("n = 1").drop("n")


def _spread(many: DataFrame, few: DataFrame, on: list[str], by: str) -> DataFrame:
    """Inner join of ``many``, of which very many rows may share a key, with copies of the rows of ``few``. It is a merge
    of sorted parts, since Spark takes rows that are made or exploded for smaller than they are and would build a hash
    table on them."""
    dealt = many.withColumn("copy", F.pmod(F.xxhash64(by), F.lit(COPIES)).cast("int"))
    each = few.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return dealt.join(each.hint("merge"), [*on, "copy"]).drop("copy")


def _fits(argc: Column, arity: Column, variadic: Column) -> Column:
    return argc.isNull() | arity.isNull() | F.when(F.coalesce(variadic, F.lit(False)), argc >= arity - 1).otherwise(argc == arity)


def bare_names(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(edge, target, confidence)``: a name that is unique in its file (extracted), else unique among the reachable
    nodes of other files (inferred). Where some candidates take the number of arguments, only those count.

    A call whose file has no candidate sees all others alike, so its answer hangs on name, family and number of
    arguments only: symbols are counted by class first, and a common name never meets its calls one by one."""
    calls = raw.where("name is not null and not coalesce(via_member, false) and specifier is null").select("edge", "file", family(F.col("language")).alias("family"), "name", "arg_count")
    symbols = nodes.where("kind <> 'file'").select("id", "name", F.col("path").alias("file"), family(F.col("language")).alias("spoken"), "arity", "variadic")
    meets = F.col("family").isNull() | F.col("spoken").isNull() | (F.col("family") == F.col("spoken"))
    fits = _fits(F.col("arg_count"), F.col("arity"), F.col("variadic"))

    def only(rows: DataFrame, *keys: str) -> DataFrame:
        counted = rows.withColumn("fits", fits).groupBy(*keys).agg(
            F.sum(F.when(F.col("fits"), F.col("n"))).alias("fit"), F.sum("n").alias("any"), F.min(F.when(F.col("fits"), F.col("id"))).alias("id_fit"), F.min("id").alias("id_any")
        )
        return counted.select(*keys, F.coalesce("fit", "any").alias("n"), F.coalesce("id_fit", "id_any").alias("target"))

    own = only(calls.join(symbols.withColumn("n", F.lit(1)), ["name", "file"]).where(meets), "edge")
    rest = calls.join(own, "edge", "left_anti")
    classes = symbols.groupBy("name", "spoken", "arity", "variadic").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    asked = rest.select("name", "family", "arg_count").distinct()
    known = only(asked.join(classes, "name").where(meets), "name", "family", "arg_count").where("n = 1").alias("k")
    r = rest.alias("r")
    other = r.join(known, (F.col("r.name") == F.col("k.name")) & F.col("r.family").eqNullSafe(F.col("k.family")) & F.col("r.arg_count").eqNullSafe(F.col("k.arg_count"))).select("edge", "target")
    return own.where("n = 1").select("edge", "target", F.lit("extracted").alias("confidence")).unionByName(other.withColumn("confidence", F.lit("inferred")))


def _ancestors(owners: DataFrame, parents: DataFrame) -> DataFrame:
    """``(owner, type, depth)``: the ancestors of each owner up to three levels, at their least depth. Types with a common
    ancestor are dealt over copies of that ancestor's own parents."""
    above = parents.join(parents.select(F.col("parent").alias("owner")).distinct().hint("merge"), "owner", "left_semi").select(F.col("owner").alias("type"), "parent")
    rows = owners.join(parents.hint("merge"), "owner").select("owner", F.col("parent").alias("type"))
    levels = [rows]
    for _ in range(1, MAX_ANCESTORS):
        rows = _spread(rows, above, ["type"], "owner").select("owner", F.col("parent").alias("type"))
        levels.append(rows)
    numbered = [r.select("owner", "type", F.lit(d).alias("depth")) for d, r in enumerate(levels, 1)]
    return reduce(DataFrame.unionByName, numbered).where("owner <> type").groupBy("owner", "type").agg(F.min("depth").alias("depth"))


def typed_members(raw: DataFrame, nodes: DataFrame, parents: DataFrame, traits: DataFrame | None = None) -> DataFrame:
    """``(edge, target, confidence)``: a member of the receiver's type, of a trait that it uses, or of its ancestors up
    to three levels. The first level with candidates decides: one candidate, or of several the call's own file's
    (not in Swift, where they are overloads), else none. ``parents(owner, parent)``, ``traits(owner, trait)``.

    Ancestors are found for types, not for calls. Members of the receiver's type itself are joined at once; those of
    ancestors and traits, which very many calls may share, are copied, and the calls are dealt over the copies."""
    calls = raw.where("via_member and recv_type is not null and name is not null").select("edge", "name", F.col("recv_type").alias("owner"), "file", "language", "arg_count")
    members = nodes.where("owner is not null").select("id", "name", F.col("owner").alias("type"), F.col("path").alias("at"), F.col("language").alias("spoken"), "arity", "variadic")
    parents = parents.where("owner is not null and parent is not null").distinct()
    inherited = parents.select(F.col("parent").alias("type")).distinct()
    ancestors = _ancestors(calls.select("owner").distinct(), parents)
    # of the ancestors those that have members; of their traits those that an ancestor uses
    having = inherited.join(members.select("type").distinct().hint("merge"), "type", "left_semi")
    types = _spread(ancestors, having, ["type"], "owner").select("owner", "type", (2 * F.col("depth")).alias("level"))
    lending = inherited
    if traits is not None:
        traits = traits.where("owner is not null and trait is not null").distinct()
        own = traits.select("owner", F.col("trait").alias("type"), F.lit(1).alias("level"))
        used = traits.select(F.col("owner").alias("type"), "trait").join(inherited.hint("merge"), "type", "left_semi")
        lent = _spread(ancestors, used, ["type"], "owner").select("owner", F.col("trait").alias("type"), (2 * F.col("depth") + 1).alias("level"))
        types = types.unionByName(own.unionByName(lent).groupBy("owner", "type").agg(F.min("level").alias("level")))
        lending = inherited.unionByName(traits.select(F.col("trait").alias("type"))).distinct()
    lenders = members.join(lending.hint("merge"), "type", "left_semi")
    near = calls.withColumn("type", F.col("owner")).withColumn("level", F.lit(0)).join(members.hint("merge"), ["type", "name"])
    far = _spread(calls.join(types.hint("merge"), "owner"), lenders, ["type", "name"], "edge")
    found = near.unionByName(far).where(reachable(F.col("language"), F.col("spoken")))
    # of a level's candidates (of a trait's alone) those that take the number of arguments, if any do; the nearest first
    fits, trait = _fits(F.col("arg_count"), F.col("arity"), F.col("variadic")), F.when(F.col("level") % 2 == 1, F.col("type"))
    best = lambda c: F.min(F.when(c, F.struct((F.col("at") != F.col("file")).alias("far"), F.col("id"))))
    per = found.groupBy("edge", "level", trait.alias("trait")).agg(F.count_if(fits).alias("fit"), F.count("*").alias("any"), best(fits).alias("b"), best(F.lit(True)).alias("a"), F.max(F.coalesce(F.col("language") == "swift", F.lit(False))).alias("swift"))
    level = per.groupBy("edge", "level").agg(F.sum(F.when(F.col("fit") > 0, F.col("fit")).otherwise(F.col("any"))).alias("n"), F.min(F.coalesce("b", "a")).alias("best"), F.max("swift").alias("swift"))
    first = level.groupBy("edge").agg(F.min_by(F.struct("level", "n", "best", "swift"), "level").alias("f")).select("edge", "f.*")
    sure = first.where("n = 1 or (level % 2 = 0 and not best.far and not swift)")
    return sure.select("edge", F.col("best.id").alias("target"), F.when(F.col("best.far"), "inferred").otherwise("extracted").alias("confidence"))


def _normal(path: Column) -> Column:
    """A path with its ``.`` and ``..`` parts worked out."""

    def step(state: Column, part: Column) -> Column:
        up = F.slice(state, F.lit(1), F.greatest(F.size(state) - 1, F.lit(0)))
        return F.when((part == "") | (part == "."), state).when(part == "..", up).otherwise(F.concat(state, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step), "/")


def relative_imports(raw: DataFrame, files: DataFrame) -> DataFrame:
    """``(edge, target)``: the first of the import's possible spellings that is a file. ``files(path)``."""
    some = raw.where(F.col("specifier").startswith(".")).select("edge", F.concat_ws("/", F.regexp_replace("file", "[^/]+$", "."), "specifier").alias("joined"))
    tries = some.select("edge", F.posexplode(F.transform(F.array(*map(F.lit, PROBES)), lambda p: F.concat(_normal(F.col("joined")), p))).alias("place", "path"))
    return tries.join(files.select("path").distinct(), "path").groupBy("edge").agg(F.min_by("path", "place").alias("target"))


def suffix_index(files: DataFrame) -> DataFrame:
    """``(suffix, path)``: every tail of whole path parts."""
    plain = files.select("path").distinct()
    parts = F.split("path", "/")
    return plain.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("suffix"))


def unique_suffixes(raw: DataFrame, files: DataFrame, wanted: Column) -> DataFrame:
    """``(edge, target)``: the only file whose path ends in the wanted tail; ``wanted`` is an expression over ``raw``."""
    keyed = raw.select("edge", wanted.alias("suffix")).where("suffix is not null")
    return keyed.join(_one(suffix_index(files), "suffix", "path"), "suffix").select("edge", "target")


def java_imports(raw: DataFrame, files: DataFrame) -> DataFrame:
    """A qualified name's file, else its enclosing type's."""
    tail = lambda e: F.concat(F.replace(e, F.lit("."), F.lit("/")), F.lit(".java"))
    some = raw.where("language = 'java' and specifier is not null")
    direct = unique_suffixes(some, files, tail(F.col("specifier")))
    outer = unique_suffixes(some.join(direct, "edge", "left_anti"), files, tail(F.regexp_replace("specifier", r"\.[^.]*$", "")))
    return direct.unionByName(outer)


def c_includes(raw: DataFrame, files: DataFrame) -> DataFrame:
    """A file relative to the including one, else the only file of that tail."""
    some = raw.where("language in ('c', 'cpp') and specifier is not null")
    near = some.select("edge", _normal(F.concat_ws("/", F.regexp_replace("file", "[^/]+$", "."), "specifier")).alias("path")).join(files.select("path").distinct(), "path").select("edge", F.col("path").alias("target"))
    return near.unionByName(unique_suffixes(some.join(near, "edge", "left_anti"), files, F.col("specifier")))


def namespace_imports(raw: DataFrame, files: DataFrame, separator: str, extension: str) -> DataFrame:
    """The longest tail of a namespaced name that ends any file's path decides; if it ends several, there is none."""
    parts = F.filter(F.split("specifier", separator), lambda x: x != "")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct((F.size(parts) - k).alias("size"), F.concat(F.array_join(F.slice(parts, k, F.size(parts)), "/"), F.lit(extension)).alias("suffix")))
    ends = suffix_index(files).groupBy("suffix").agg(F.count("*").alias("n"), F.min("path").alias("target"))
    keyed = raw.where("specifier is not null").select("edge", F.explode(tails).alias("t")).select("edge", "t.size", "t.suffix").join(ends, "suffix")
    best = keyed.groupBy("edge").agg(F.max_by(F.struct("n", "target"), "size").alias("b"))
    return best.where("b.n = 1").select("edge", "b.target")


def go_modules(texts: DataFrame) -> DataFrame:
    """``(module, dir)`` of the module files among ``texts(path, text)``."""
    rows = texts.where(F.substring_index("path", "/", -1) == "go.mod")
    found = rows.select(F.regexp_extract("text", r"(?m)^\s*module\s+(\S+)", 1).alias("module"), F.regexp_replace("path", r"/?go\.mod$", "").alias("at"))
    return found.where("module <> ''").select("module", F.when(F.col("at") == "", ".").otherwise(F.col("at")).alias("dir"))


def rust_uses(raw: DataFrame, files: DataFrame) -> DataFrame:
    """``(edge, target)`` of uses below ``crate``: the file's crate is its longest root (a directory with ``lib.rs`` or
    ``main.rs``); in it the longest head of the name that is a module's file decides, and none if two are. A use of at
    most one part may mean the root's only file itself."""
    paths = files.select("path").distinct()
    roots = paths.where(F.substring_index("path", "/", -1).isin("lib.rs", "main.rs")).select(F.regexp_replace("path", "/?[^/]+$", "").alias("root"))
    dirs = F.slice(F.split("file", "/"), F.lit(1), F.size(F.split("file", "/")) - 1)
    heads = F.transform(F.sequence(F.lit(0), F.size(dirs)), lambda k: F.array_join(F.slice(dirs, F.lit(1), k), "/"))
    some = raw.where("language = 'rust' and specifier rlike '^crate\\\\b'").select("edge", "file", F.filter(F.split(F.regexp_replace("specifier", "^crate", ""), "::"), lambda x: x != "").alias("parts"))
    owned = some.select("edge", "parts", F.explode(heads).alias("root")).join(roots.distinct(), "root").groupBy("edge").agg(F.max_by(F.struct("root", "parts"), F.length("root")).alias("o")).select("edge", "o.*")
    below = lambda tail: F.when(F.col("root") == "", tail).otherwise(F.concat("root", F.lit("/"), tail))
    name = lambda k: F.array_join(F.slice("parts", F.lit(1), k), "/")
    modules = F.flatten(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array(*[F.struct(k.alias("size"), below(F.concat(name(k), F.lit(end))).alias("path")) for end in (".rs", "/mod.rs")])))
    own = F.array(*[F.struct(F.lit(0).alias("size"), below(F.lit(f)).alias("path")) for f in ("lib.rs", "main.rs")])
    tries = F.concat(F.when(F.size("parts") > 0, modules).otherwise(F.slice(own, 1, 0)), F.when(F.size("parts") <= 1, own).otherwise(F.slice(own, 1, 0)))
    hits = owned.select("edge", F.explode(tries).alias("t")).select("edge", "t.size", "t.path").join(paths, "path")
    sized = hits.groupBy("edge", "size").agg(F.count("*").alias("n"), F.min("path").alias("target"))
    # two files of one module end the search among modules; the root's file may still stand for a single part
    top = sized.groupBy("edge").agg(F.max_by(F.struct("n", "target"), "size").alias("m"), F.max(F.when(F.col("size") == 0, F.struct("n", "target"))).alias("own"))
    return top.select("edge", F.when(F.col("m.n") == 1, F.col("m.target")).when(F.col("own.n") == 1, F.col("own.target")).alias("target")).where("target is not null")


def go_imports(raw: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """The first file of the imported package's directory, below the longest module name. ``modules(module, dir)``."""
    some = raw.where("language = 'go' and specifier is not null").select("edge", "specifier")
    parts = F.split("specifier", "/")
    heads = some.select("edge", "specifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("module"))
    hit = _spread(heads, modules, ["module"], "edge").groupBy("edge", "specifier").agg(F.max_by(F.struct("module", "dir"), F.length("module")).alias("m"))
    rest = F.expr("substr(specifier, length(m.module) + 2)")
    wanted = hit.select("edge", _normal(F.concat_ws("/", "m.dir", rest)).alias("dir"))
    per_dir = files.where(F.col("path").endswith(".go")).groupBy(F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).agg(F.min("path").alias("target"))
    return wanted.join(per_dir.hint("merge"), "dir").select("edge", "target")


def _by_rule(*rules: DataFrame) -> DataFrame:
    """``(edge, target)`` of the first rule that finds one."""
    numbered = [r.select("edge", "target", F.lit(k).alias("rule")) for k, r in enumerate(rules)]
    return reduce(DataFrame.unionByName, numbered).groupBy("edge").agg(F.min_by("target", "rule").alias("target"))


def resolve(raw: DataFrame, nodes: DataFrame, parents: DataFrame, modules: DataFrame | None = None, traits: DataFrame | None = None) -> DataFrame:
    """``(source, target, relation, confidence)``: distinct edges of all rules; imports and heritage that find no node
    keep their name as an external target, calls and references that find none are dropped. ``modules(module, dir)``
    are the modules that Go imports may name, ``traits(owner, trait)`` the traits that classes use."""
    files = nodes.where("kind = 'file'").select("path")
    rules = [relative_imports(raw, files), java_imports(raw, files), c_includes(raw, files), rust_uses(raw, files), namespace_imports(raw.where("language = 'php'"), files, r"\\", ".php")]
    paths = _by_rule(*rules, *([go_imports(raw, files, modules)] if modules is not None else []))
    direct = raw.where("target_id is not null").select("edge", F.col("target_id").alias("target"), F.lit("extracted").alias("confidence"))
    found = direct.unionByName(bare_names(raw, nodes)).unionByName(typed_members(raw, nodes, parents, traits)).unionByName(paths.withColumn("confidence", F.lit("extracted")))
    found = found.groupBy("edge").agg(F.min_by("target", "confidence").alias("target"), F.min("confidence").alias("confidence"))
    joined = raw.join(found, "edge", "left")
    outside = F.when(F.col("relation").isin("imports", "extends", "implements"), F.coalesce("specifier", "name"))
    rows = joined.select("source", F.coalesce("target", outside).alias("target"), "relation", F.coalesce("confidence", F.lit("extracted")).alias("confidence")).where("target is not null")
    return rows.groupBy("source", "target", "relation").agg(F.min("confidence").alias("confidence"))
