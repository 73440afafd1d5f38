"""Dependency inventory queries. The SQL side knows what each made manifest declares."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitstrata.functions.common import joined
from gitstrata.operators import deps as ops
from gitstrata.plans.registry import query
from gitstrata.rules import catalog as rules

# What the fifteen manifest templates declare: kind, ecosystem, package, version, scope (s = size, w = name)
DECLARED = [
    (0, "javascript", "'react'", "'^' || s || '.1.0'", "dev"), (0, "javascript", "'express'", "'4.' || s || '.1'", "runtime"),
    (0, "javascript", "'lodash'", "'4.17.' || s", "runtime"), (0, "javascript", "w", "'1.0.' || s", "runtime"),
    (0, "javascript", "'jest'", "'2' || s || '.0.0'", "dev"), (0, "javascript", "'@angular/core'", "'1' || s || '.0.0'", "dev"),
    (0, "javascript", "'node'", "'>=' || s", "engine"),
    (1, "python", "'django'", "'3.' || s", "runtime"), (1, "python", "'requests'", "'2.' || s || '.0'", "runtime"), (1, "python", "'pillow'", "'8.' || s", "runtime"),
    (1, "python", "'numpy'", "NULL", "runtime"), (1, "python", "w", "'1.' || s", "runtime"), (1, "python", "'pytest'", "NULL", "runtime"),
    (2, "go", "'github.com/gin-gonic/gin'", "'v1.' || s || '.0'", "runtime"), (2, "go", "'gorm.io/gorm'", "'v1.2' || s || '.1'", "runtime"),
    (2, "go", "'github.com/' || w || '/' || w", "'v0.' || s || '.0'", "runtime"),
    (3, "ruby", "'rails'", "'~> 7.' || s", "runtime"), (3, "ruby", "'sidekiq'", "NULL", "runtime"), (3, "ruby", "w", "NULL", "runtime"),
    (4, "java", "'org.springframework.boot'", "'3.' || s || '.0'", "plugin"), (4, "java", "'org.springframework.boot:spring-boot-starter-web'", "'3.' || s || '.0'", "runtime"),
    (4, "java", "'io.ktor:ktor-server'", "'2.' || s || '.0'", "runtime"), (4, "java", "w || ':' || w", "'1.' || s", "runtime"),
    (5, "clojure", "'ring/ring-core'", "'1.' || s || '.0'", "runtime"), (5, "clojure", "'compojure'", "'1.6.' || s", "runtime"), (5, "clojure", "w || '/' || w", "'1.' || s", "runtime"),
    (6, "elixir", "'phoenix'", "'~> 1.' || s", "runtime"), (6, "elixir", "'ecto'", "'~> 3.' || s", "runtime"),
    (7, "rust", "'serde'", "'1.' || s", "runtime"), (7, "rust", "'tokio'", "'1.' || s", "runtime"), (7, "rust", "w", "'0.' || s", "runtime"),
    (8, "python", "'python'", "'^3.' || s", "runtime"), (8, "python", "'django'", "'^4.' || s", "runtime"), (8, "python", "w", "'1.' || s", "runtime"), (8, "python-build", "'poetry'", "NULL", "build"),
    (9, "dart", "'flutter'", "NULL", "runtime"), (9, "dart", "'http'", "'^1.' || s || '.0'", "runtime"), (9, "dart", "w", "'^0.' || s || '.0'", "runtime"), (9, "dart", "'bloc'", "'^8.' || s || '.0'", "dev"),
    (10, "php", "'laravel/framework'", "'^1' || s || '.0'", "runtime"), (10, "php", "'monolog/monolog'", "'3.' || s", "runtime"), (10, "php", "w || '/' || w", "'1.' || s", "runtime"), (10, "php", "'phpunit/phpunit'", "'^1' || s || '.0'", "dev"),
    (11, "java", "'org.springframework.boot:spring-boot-starter'", "'3.' || s || '.0'", "runtime"), (11, "java", "w || ':gson'", "'2.' || s", "runtime"),
    (12, "deno", "'oak'", "'https://deno.land/x/oak@v1' || s || '.0'", "runtime"), (12, "deno", "w", "'npm:' || w || '@1.' || s", "runtime"),
]
DEPS = """
WITH p AS (SELECT p_partkey, p_partkey % 15 AS k, CAST(p_size AS VARCHAR) AS s, replace(p_name, ' ', '-') AS w FROM part),
 d AS (""" + "\n UNION ALL ".join(f"SELECT p_partkey, s AS repository_id, '{e}' AS ecosystem, {p} AS package, {v} AS version, '{sc}' AS scope FROM p WHERE k = {k}" for k, e, p, v, sc in DECLARED) + ")\n"


@query("all_dependencies", DEPS + "SELECT repository_id, p_partkey, ecosystem, package, version, scope FROM d")
def _(t):
    out = ops.all_dependencies(t.f_manifests)
    return out.withColumn("p_partkey", F.regexp_extract("path", r"^m(\d+)/", 1).cast("long")).drop("path")


EXACT = ", ".join("('" + "', '".join(row) + "')" for row in rules.exact_rows())
PARTS = ", ".join("('" + "', '".join(row) + "')" for row in rules.part_rows())
IDENTIFIED = DEPS + f""", x(ecosystem, package, technology, kind) AS (VALUES {EXACT}), y(ecosystem, part, technology, kind) AS (VALUES {PARTS}),
 i AS (SELECT d.*, technology, kind FROM d JOIN x USING (ecosystem, package) UNION ALL SELECT DISTINCT d.*, technology, kind FROM d JOIN y ON d.ecosystem = y.ecosystem AND contains(d.package, part)
  UNION ALL SELECT d.*, 'Angular', 'frontend_frameworks' FROM d WHERE ecosystem = 'javascript' AND starts_with(package, '@angular/'))
"""


@query("identify_dependencies", IDENTIFIED + "SELECT repository_id, p_partkey, package, technology, kind FROM i")
def _(t):
    out = ops.identify(ops.all_dependencies(t.f_manifests))
    return out.select("repository_id", F.regexp_extract("path", r"^m(\d+)/", 1).cast("long").alias("p_partkey"), "package", "technology", "kind")


@query("tech_sets", IDENTIFIED + """
SELECT repository_id, CASE WHEN kind IN ('framework', 'frontend_frameworks', 'backend_frameworks') THEN 'frameworks' WHEN kind = 'library' THEN 'libraries' WHEN kind IN ('tool', 'build_tools', 'testing_frameworks', 'development_tools') THEN 'tools'
 WHEN contains(lower(technology), 'lib') OR contains(lower(technology), 'util') THEN 'libraries' ELSE 'tools' END AS basic, technology, count(*) AS uses FROM i GROUP BY 1, 2, 3""")
def _(t):
    return ops.tech_sets(ops.identify(ops.all_dependencies(t.f_manifests)))


@query("tech_set_texts", IDENTIFIED + """
SELECT repository_id, string_agg(DISTINCT technology, '|' ORDER BY technology) AS frameworks FROM i WHERE kind IN ('framework', 'frontend_frameworks', 'backend_frameworks') GROUP BY 1""")
def _(t):
    sets = ops.tech_sets(ops.identify(ops.all_dependencies(t.f_manifests))).filter("basic = 'frameworks'")
    return sets.groupBy("repository_id").agg(joined(F.collect_set("technology")).alias("frameworks"))


@query("identify_own_catalog", """
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, replace(p_name, ' ', '-') AS package, p_name AS technology FROM part WHERE p_partkey % 15 = 0""")
def _(t):
    own = t.part.select(F.lit("javascript").alias("ecosystem"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("package"), F.col("p_name").alias("technology"), F.lit("library").alias("kind")).distinct()
    out = ops.identify(ops.all_dependencies(t.f_manifests), own).filter((F.col("ecosystem") == "javascript") & (F.col("kind") == "library"))
    return out.select(F.regexp_extract("path", r"^m(\d+)/", 1).cast("long").alias("p_partkey"), "package", "technology")


@query("image_tools", """
SELECT CAST(p_size AS VARCHAR) AS repository_id, p_partkey, unnest(CASE p_partkey % 15 WHEN 13 THEN ['Docker', 'Python', 'Nginx'] ELSE ['Docker Compose', 'PostgreSQL', 'Redis', 'Database'] END) AS tool FROM part WHERE p_partkey % 15 IN (13, 14)""")
def _(t):
    return ops.image_tools(t.f_manifests).withColumn("p_partkey", F.regexp_extract("path", r"^m(\d+)/", 1).cast("long")).drop("path")


@query("script_tools", """
WITH p AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS repository_id, replace(p_name, ' ', '-') AS w FROM part WHERE p_partkey % 15 = 0)
SELECT p_partkey, repository_id, 'build' AS script, 'Vite' AS tool FROM p UNION ALL SELECT p_partkey, repository_id, 'dev', 'Next.js' FROM p UNION ALL SELECT p_partkey, repository_id, w, 'Webpack' FROM p""")
def _(t):
    return ops.script_tools(t.f_manifests).withColumn("p_partkey", F.regexp_extract("path", r"^m(\d+)/", 1).cast("long")).drop("path")


@query("language_histogram", """
SELECT repository_id, CASE ext WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'ts' THEN 'TypeScript' WHEN 'tsx' THEN 'React' WHEN 'java' THEN 'Java' WHEN 'rs' THEN 'Rust' WHEN 'go' THEN 'Go' WHEN 'sql' THEN 'SQL'
 WHEN 'md' THEN 'Markdown' WHEN 'yml' THEN 'YAML' END AS language, count(*) AS files FROM (SELECT repository_id, regexp_extract(path, '[.]([a-z]+)$', 1) AS ext FROM f_code) GROUP BY 1, 2""", "f_code")
def _(t):
    return ops.language_histogram(t.f_code)
