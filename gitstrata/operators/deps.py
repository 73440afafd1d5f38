"""Dependency inventory: manifests to (ecosystem, package, version, scope) rows.

One projection reads every kind of manifest: the file name picks the expression,
whose list of entries is exploded. There is no shuffle before the roll-ups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.common import contains_any, non_empty
from gitstrata.functions.paths import file_name, with_language
from gitstrata.rules import catalog as rules

NPM = "dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>, engines map<string,string>"
COMPOSER = "require map<string,string>, `require-dev` map<string,string>"
DENO = "imports map<string,string>"
ENTRY = "array<struct<package:string,version:string,scope:string>>"


def _entry(package: Column, version: Column | None, scope: str | Column) -> Column:
    version = F.lit(None).cast("string") if version is None else non_empty(version)
    return F.struct(
        package.alias("package"), version.alias("version"), (F.lit(scope) if isinstance(scope, str) else scope).alias("scope")
    )


def _map_entries(table: Column, scope: str) -> Column:
    pairs = F.coalesce(F.map_entries(table), F.array().cast("array<struct<key:string,value:string>>"))
    return F.transform(pairs, lambda e: _entry(e["key"], e["value"], scope))


def _overlay(base: Column, over: Column) -> Column:
    """Entries of both maps; the second one wins where both name a package."""
    names = F.coalesce(F.map_keys(over), F.array().cast("array<string>"))
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(names, k))
    return F.concat(_map_entries(kept, "runtime"), _map_entries(over, "dev"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _section(content: Column, header: str) -> Column:
    """Lines of one bracketed section."""
    return _lines(F.regexp_extract(content, r"(?ms)^\[" + header + r"\][ \t]*\n(.*?)(?=^\[|\z)", 1))


def _indented(content: Column, header: str) -> Column:
    """Lines indented below a top-level key."""
    return _lines(F.regexp_extract(content, r"(?m)^" + header + r":[ \t]*\n((?:[ \t]+.*(?:\n|\z)|[ \t]*\n)*)", 1))


def _pick(lines: Column, keep: str, package: str, version: str, scope: str) -> Column:
    chosen = F.filter(lines, lambda line: line.rlike(keep))
    return F.transform(chosen, lambda line: _entry(F.regexp_extract(line, package, 1), F.regexp_extract(line, version, 1), scope))


def _requirements(content: Column) -> Column:
    lines = F.filter(F.transform(_lines(content), lambda line: F.trim(line)), lambda line: (line != "") & ~line.startswith("#"))
    name = r"^(.*?)\s*(?:==|>=|~=|$)"
    return F.transform(
        lines,
        lambda line: _entry(F.lower(F.regexp_extract(line, name, 1)), F.regexp_extract(line, r"(?:==|>=|~=)\s*([^,;\s]+)", 1), "runtime"),
    )


def _go_mod(content: Column) -> Column:
    lines = F.transform(_lines(content), lambda line: F.trim(F.regexp_replace(line, r"//.*$", "")))
    return _pick(lines, r"^(?!require|module)\S*[./]\S*\s+v\S+", r"^(\S+)", r"\s(v\S+)", "runtime")


def _gemfile(content: Column) -> Column:
    lines = F.transform(_lines(content), lambda line: F.trim(line))
    return _second_group(lines, r"""^gem[^'"]*['"]([^'"]+)['"](?:\s*,\s*['"]([^'"]+)['"])?""", "runtime")


def _second_group(lines: Column, keep: str, scope: str) -> Column:
    chosen = F.filter(lines, lambda line: line.rlike(keep))
    return F.transform(chosen, lambda line: _entry(F.regexp_extract(line, keep, 1), F.regexp_extract(line, keep, 2), scope))


def _gradle(content: Column) -> Column:
    dependency = r"""^\s*(?:implementation|api|compile|compileOnly|runtimeOnly|annotationProcessor|testImplementation|testCompile)\s*\(?\s*['"]([^:'"]+:[^:'"]+):?([^'"]*)['"]"""
    plugin = r"""^\s*id\s*\(?['"]([^'"]+)['"]\)?\s*version\s*['"]([^'"]+)['"]"""
    return F.concat(_second_group(_lines(content), dependency, "runtime"), _second_group(_lines(content), plugin, "plugin"))


def _all_pairs(content: Column, regex: str, scope: str) -> Column:
    names, versions = F.regexp_extract_all(content, F.lit(regex), F.lit(1)), F.regexp_extract_all(content, F.lit(regex), F.lit(2))
    return F.zip_with(names, versions, lambda n, v: _entry(n, v, scope))


_TOML = r"""^\s*([A-Za-z0-9_.-]+)\s*=\s*(?:"([^"]*)"|\{.*?version\s*=\s*"([^"]*)".*\}|.*)\s*$"""


def _toml(lines: Column, scope: str) -> Column:
    chosen = F.filter(lines, lambda line: line.rlike(r"^\s*[A-Za-z0-9_.-]+\s*=") & ~line.startswith("#"))
    return F.transform(
        chosen,
        lambda line: _entry(
            F.regexp_extract(line, _TOML, 1), F.concat(F.regexp_extract(line, _TOML, 2), F.regexp_extract(line, _TOML, 3)), scope
        ),
    )


def _pyproject(content: Column) -> Column:
    backend = F.regexp_extract(content, r"""(?m)^\s*build-backend\s*=\s*["']([^"']*)["']""", 1)
    tool = F.lit(None).cast("string")
    for name in reversed(list(rules.EXACT["python-build"]["tool"])):
        tool = F.when(backend.contains(name), name).otherwise(tool)
    build = F.when(tool.isNotNull(), F.array(_entry(tool, None, "build"))).otherwise(F.array().cast(ENTRY))
    return F.concat(_toml(_section(content, r"tool\.poetry\.dependencies"), "runtime"), build)


def _yaml(lines: Column, scope: str) -> Column:
    return _second_group(lines, r"^  ([A-Za-z0-9_-]+):\s*(\S*)\s*$", scope)


def _pom(content: Column) -> Column:
    blocks = F.regexp_extract_all(content, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))

    def tag(block: Column, name: str) -> Column:
        return F.trim(F.regexp_extract(block, f"(?s)<{name}>(.*?)</{name}>", 1))

    return F.transform(
        blocks,
        lambda b: _entry(
            F.concat(tag(b, "groupId"), F.lit(":"), tag(b, "artifactId")), tag(b, "version"), F.coalesce(non_empty(tag(b, "scope")), F.lit("runtime"))
        ),
    )


def all_dependencies(files: DataFrame) -> DataFrame:
    """Every dependency that any manifest of the tree declares."""
    text, name = F.col("content"), F.lower(file_name("path"))
    npm, composer, deno = F.from_json(text, NPM), F.from_json(text, COMPOSER), F.from_json(text, DENO)
    node = npm["engines"]["node"]
    runtime = F.when(node.isNotNull(), F.array(_entry(F.lit("node"), node, "engine"))).otherwise(F.array().cast(ENTRY))
    kinds = [
        ("package.json", "javascript", F.concat(_overlay(npm["dependencies"], npm["devDependencies"]), runtime)),
        ("requirements.txt", "python", _requirements(text)),
        ("go.mod", "go", _go_mod(text)),
        ("gemfile", "ruby", _gemfile(text)),
        ("build.gradle", "java", _gradle(text)),
        ("build.gradle.kts", "java", _gradle(text)),
        ("project.clj", "clojure", _all_pairs(text, r"""\[([A-Za-z0-9./_-]+)\s+"([^"]+)"\]""", "runtime")),
        ("mix.exs", "elixir", _all_pairs(text, r"""\{:(\w+),\s*"([^"]*)\"""", "runtime")),
        ("cargo.toml", "rust", _toml(_section(text, "dependencies"), "runtime")),
        ("pyproject.toml", "python", _pyproject(text)),
        ("pubspec.yaml", "dart", F.concat(_yaml(_indented(text, "dependencies"), "runtime"), _yaml(_indented(text, "dev_dependencies"), "dev"))),
        ("composer.json", "php", _overlay(composer["require"], composer["require-dev"])),
        ("pom.xml", "java", _pom(text)),
        ("deno.json", "deno", _map_entries(deno["imports"], "runtime")),
    ]
    entries, ecosystem = None, None
    for file, eco, expression in kinds:
        test, typed = name == file, expression.cast(ENTRY)
        entries = F.when(test, typed) if entries is None else entries.when(test, typed)
        ecosystem = F.when(test, eco) if ecosystem is None else ecosystem.when(test, eco)
    manifests = files.filter(name.isin([file for file, _, _ in kinds]))
    rows = manifests.select("repository_id", "path", ecosystem.alias("ecosystem"), F.explode(entries).alias("d"))
    eco = F.when(F.col("d.scope") == "build", "python-build").otherwise(F.col("ecosystem"))
    return rows.select("repository_id", "path", eco.alias("ecosystem"), "d.package", "d.version", "d.scope").filter(F.col("package") != "")


def identify(deps: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Technology and kind of each dependency; unknown packages are dropped.

    The built-in names are a fixed table under 200 rows and are broadcast; a
    catalog of one's own (``ecosystem, package, technology, kind``) is joined on
    equality, with Spark choosing how.
    """
    spark = deps.sparkSession
    named = spark.createDataFrame(rules.exact_rows(), "ecosystem string, package string, _technology string, _kind string")

    def hit(technology: Column, kind: Column) -> Column:
        return F.struct(technology.alias("technology"), kind.alias("kind"))

    hits = [F.when(F.col("_technology").isNotNull(), hit(F.col("_technology"), F.col("_kind")))]
    # a package that its own name identifies is not matched by prefix as well
    hits += [
        F.when((F.col("ecosystem") == eco) & F.col("package").startswith(start) & F.col("_technology").isNull(), hit(F.lit(tech), F.lit(kind)))
        for eco, kind, start, tech in rules.PREFIXES
    ]
    for eco in rules.PARTS:
        # the parts of one ecosystem are looked for only in its own packages
        parts = [F.when(F.col("package").contains(part), hit(F.lit(tech), F.lit(kind))) for e, part, tech, kind in rules.part_rows() if e == eco]
        hits.append(F.when(F.col("ecosystem") == eco, F.array_compact(F.array(*parts))))
    single, several = hits[: 1 + len(rules.PREFIXES)], hits[1 + len(rules.PREFIXES) :]
    own_parts = F.coalesce(*several, F.array().cast("array<struct<technology:string,kind:string>>"))
    every = F.array_distinct(F.concat(F.array_compact(F.array(*single)), own_parts))
    if catalog is not None:
        own = catalog.select("ecosystem", "package", F.struct("technology", "kind").alias("_own"))
        listed = own.groupBy("ecosystem", "package").agg(F.collect_set("_own").alias("_own"))
        deps_listed = deps.join(listed, ["ecosystem", "package"], "left")
        every = F.array_distinct(F.concat(every, F.coalesce("_own", F.array().cast("array<struct<technology:string,kind:string>>"))))
    else:
        deps_listed = deps
    marked = deps_listed.join(F.broadcast(named), ["ecosystem", "package"], "left").withColumn("_hit", F.explode(every))
    return marked.select(*deps.columns, "_hit.technology", "_hit.kind")


def _first_tool(text: Column, table: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for fragment, tool in reversed(table):
        out = F.when(text.contains(fragment), tool).otherwise(out)
    return out


def image_tools(files: DataFrame) -> DataFrame:
    """Tools behind container files: base images, service images, their environment."""
    text, name = F.col("content"), F.lower(file_name("path"))
    dockerfile, compose = name.isin(rules.DOCKERFILES), name.isin(rules.COMPOSE_FILES)
    bases = F.regexp_extract_all(text, F.lit(r"(?im)^[ \t]*FROM ([^:\s]*)"), F.lit(1))
    services = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*image:[ \t]*[\"']?([^\s\"']+)"), F.lit(1))
    lower = F.lower(text)
    environment = F.array(
        F.when(lower.contains("database_url") | lower.contains("db_"), "Database"), F.when(lower.contains("redis_url"), "Redis")
    )
    tools = F.when(
        dockerfile, F.concat(F.array(F.lit("Docker")), F.transform(bases, lambda i: _first_tool(F.lower(i), rules.BASE_IMAGES)))
    ).when(
        compose,
        F.concat(F.array(F.lit("Docker Compose")), F.transform(services, lambda i: _first_tool(F.lower(i), rules.SERVICE_IMAGES)), environment),
    ).when(name == ".dockerignore", F.array(F.lit("Docker")))
    return (
        files.filter(dockerfile | compose | (name == ".dockerignore"))
        .select("repository_id", "path", F.explode(F.array_distinct(F.array_compact(tools))).alias("tool"))
    )


def script_tools(files: DataFrame) -> DataFrame:
    """Build tool named by each npm script, if any."""
    scripts = F.from_json("content", NPM)["scripts"]
    rows = files.filter(F.lower(file_name("path")) == "package.json").select("repository_id", "path", F.explode(scripts).alias("script", "command"))
    tool = _first_tool(F.lower("command"), rules.SCRIPT_TOOLS)
    return rows.select("repository_id", "path", "script", tool.alias("tool")).filter(F.col("tool").isNotNull())


def language_histogram(files: DataFrame) -> DataFrame:
    """Files per repository and language; unlisted suffixes are left out."""
    named = with_language(files.select("repository_id", "path"), "commit", "path")
    return named.filter(F.col("language") != "Other").groupBy("repository_id", "language").agg(F.count("*").alias("files"))


def basic_set(kind: Column, technology: Column) -> Column:
    """languages, frameworks, libraries or tools; an unlisted kind goes by the name."""
    out = F.when(contains_any(F.lower(technology), rules.LIBRARY_WORDS), "libraries").otherwise("tools")
    for name, basic in rules.BASIC_SET.items():
        out = F.when(F.lower(kind) == name, basic).otherwise(out)
    return out


def tech_sets(found: DataFrame) -> DataFrame:
    """Distinct technologies per repository and basic set, one row each, with their use."""
    return (
        found.withColumn("basic", basic_set(F.col("kind"), F.col("technology")))
        .groupBy("repository_id", "basic", "technology")
        .agg(F.count("*").alias("uses"))
    )
