"""Views that give the driver's tables the shapes the operators read.

Each body is one SQL text that Spark and DuckDB both run, so a query and its
oracle start from the same rows. Names in braces are tables or other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gitstrata.sources.files import spread

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Tables of long texts and the key that spreads them when they have few splits.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}

# Source snippets appended to document texts, so that code rules meet code. A
# pilcrow stands for a line break; doc_id picks one.
_SNIPPETS = [
    ("src/controllers", "user_controller", "py", "python",
     "import os¶from . import models¶def create_user(request):¶    query = \"SELECT * FROM users WHERE id=\" + request.id + \"\"¶    cursor.execute(query)¶    password = \"hunter2-secret\"¶    if request.user and request.ok:¶        for item in items:¶            total.append(item)¶    return total¶"),
    ("web/views", "profile", "js", "javascript",
     "import React from \"react\"¶import {{ api }} from \"./api\"¶const [user, setUser] = useState(null)¶async function load() {{¶  try {{¶    const res = await fetch(url)¶    node.innerHTML = \"<b>\" + res.name¶  }} catch (e) {{ console.log(e) }}¶}}¶for (let i = 0; i < rows.length; i++) {{¶  document.write(\"x\" + rows[i])¶}}¶"),
    ("src/models", "account", "java", "java",
     "package src.models;¶import src.models.Base;¶public class AccountFactory {{¶  private static AccountFactory instance;¶  public static AccountFactory getInstance() {{¶    if (instance == null) {{ instance = new AccountFactory(); }}¶    return instance;¶  }}¶  @Autowired¶  void update() {{ MessageDigest.getInstance(\"MD5\"); }}¶}}¶"),
    ("services/api", "worker_service", "ts", "typescript",
     "import express from \"express\"¶import {{ Injectable }} from \"@angular/core\"¶export class WorkerObserver {{¶  constructor(svc: Service) {{ }}¶  notify() {{ list.map(x => x).filter(y => y) }}¶}}¶// eval( input + 1 )¶app.get(\"/x\", handler)¶"),
    ("lib/util", "engine", "rs", "rust",
     "use std::io;¶struct Engine {{ parts: Vec<u8> }}¶impl Engine {{¶    pub fn start(&mut self) -> Result<(), Error> {{¶        let v = vec![1, 2];¶        v.iter().map(|x| x + 1);¶        match self.run()? {{ _ => Ok(()) }}¶    }}¶}}¶"),
    ("pkg/core", "server", "go", "go",
     "package core¶func (s *Server) Handle(w Writer, r *Request) error {{¶    if err := s.check(r); err != nil {{¶        return err¶    }}¶    switch r.Kind {{¶    case 1:¶        return nil¶    }}¶    return nil¶}}¶"),
    ("app/domain", "repository", "py", "python",
     "class UserRepository:¶    def __init__(self, store: Store):¶        self.store = store¶    def find_by_name(self, name):¶        with self.store.open() as s:¶            return [r for r in s if r.name == name]¶    def save(self, row):¶        try:¶            yield self.store.put(row)¶        except Exception:¶            pass¶@app.route(\"/x\", methods=[\"POST\"])¶def delete_user(request):¶    return yaml.load(request.body)¶"),
    ("tests/unit", "login.test", "js", "javascript",
     "describe(\"login\", () => {{¶  it(\"works\", () => {{ expect(true).toBe(true) }})¶}})¶var token = \"abcdefghijklmnopqrstuvwx\"¶eval(\"a\" + token)¶setInterval(tick, 100)¶"),
    ("db/migration", "schema", "sql", "sql",
     "CREATE TABLE users (id INT);¶CREATE INDEX idx ON users (id);¶SELECT * FROM users WHERE name = 'x' + 'y';¶"),
    ("docs", "guide", "md", "markdown", "# Guide¶TODO: write more about the singleton and the factory¶while (true) wait¶"),
    ("deploy/k8s", "docker-compose", "yml", "yaml", "services:¶  db:¶    image: postgres:16¶  cache:¶    image: redis:7¶"),
    ("src/ui/components", "button", "tsx", "typescript",
     "import {{ memo }} from './memo'¶export const createButton = (props: Props) => {{¶  const cb = useCallback(() => props.go(), [])¶  if (props.kind == 1) {{ return null }}¶  return React.memo(cb)¶}}¶"),
]


def _case(column: str, values: list[str]) -> str:
    quoted = ["'" + v.replace("'", "''") + "'" for v in values]
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted[:-1]))
    return f"CASE {column} % {len(values)} {arms} ELSE {quoted[-1]} END"


_KIND = len(_SNIPPETS)

_MANIFESTS = [
    ("package.json", "{{\"dependencies\": {{\"react\": \"^ZZ.0.0\", \"express\": \"4.ZZ.1\", \"lodash\": \"4.17.ZZ\", \"YY\": \"1.0.ZZ\"}}, \"devDependencies\": {{\"react\": \"^ZZ.1.0\", \"jest\": \"2ZZ.0.0\", \"@angular/core\": \"1ZZ.0.0\"}}, \"scripts\": {{\"build\": \"vite build\", \"dev\": \"next dev\", \"YY\": \"webpack --mode YY\"}}, \"engines\": {{\"node\": \">=ZZ\"}}}}"),
    ("requirements.txt", "# YY deps¶django==3.ZZ¶Requests>=2.ZZ.0¶pillow~=8.ZZ¶numpy¶¶YY==1.ZZ¶pytest¶"),
    ("go.mod", "module example.com/YY¶¶require (¶    github.com/gin-gonic/gin v1.ZZ.0 // indirect¶    gorm.io/gorm v1.2ZZ.1¶    github.com/YY/YY v0.ZZ.0¶)¶"),
    ("Gemfile", "source 'https://rubygems.org'¶gem 'rails', '~> 7.ZZ'¶gem \"sidekiq\"¶gem 'YY'¶"),
    ("build.gradle", "plugins {{¶  id 'org.springframework.boot' version '3.ZZ.0'¶}}¶dependencies {{¶  implementation 'org.springframework.boot:spring-boot-starter-web:3.ZZ.0'¶  implementation \"io.ktor:ktor-server:2.ZZ.0\"¶  testImplementation 'YY:YY:1.ZZ'¶}}¶"),
    ("project.clj", "(defproject YY \"0.ZZ.0\"¶  :dependencies [[ring/ring-core \"1.ZZ.0\"]¶                 [compojure \"1.6.ZZ\"]¶                 [YY/YY \"1.ZZ\"]])¶"),
    ("mix.exs", "defp deps do¶  [¶    {{:phoenix, \"~> 1.ZZ\"}},¶    {{:ecto, \"~> 3.ZZ\"}},¶    {{:YY, \"~> 1.ZZ\"}}¶  ]¶end¶"),
    ("Cargo.toml", "[package]¶name = \"YY\"¶¶[dependencies]¶serde = \"1.ZZ\"¶tokio = {{ version = \"1.ZZ\", features = [\"full\"] }}¶YY = \"0.ZZ\"¶¶[dev-dependencies]¶proptest = \"1.0\"¶"),
    ("pyproject.toml", "[build-system]¶requires = [\"poetry-core\"]¶build-backend = \"poetry.core.masonry.api\"¶¶[tool.poetry.dependencies]¶python = \"^3.ZZ\"¶django = \"^4.ZZ\"¶YY = \"1.ZZ\"¶"),
    ("pubspec.yaml", "name: YY¶dependencies:¶  flutter:¶    sdk: flutter¶  http: ^1.ZZ.0¶  YY: ^0.ZZ.0¶dev_dependencies:¶  bloc: ^8.ZZ.0¶"),
    ("composer.json", "{{\"require\": {{\"laravel/framework\": \"^1ZZ.0\", \"monolog/monolog\": \"3.ZZ\", \"YY/YY\": \"1.ZZ\"}}, \"require-dev\": {{\"phpunit/phpunit\": \"^1ZZ.0\"}}}}"),
    ("pom.xml", "<project><dependencies><dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter</artifactId><version>3.ZZ.0</version></dependency><dependency><groupId>YY</groupId><artifactId>gson</artifactId><version>2.ZZ</version></dependency></dependencies></project>"),
    ("deno.json", "{{\"imports\": {{\"oak\": \"https://deno.land/x/oak@v1ZZ.0\", \"YY\": \"npm:YY@1.ZZ\"}}}}"),
    ("Dockerfile", "FROM python:3.ZZ-slim AS build¶RUN pip install YY¶FROM nginx:1.ZZ¶"),
    ("docker-compose.yml", "services:¶  db:¶    image: postgres:1ZZ¶  cache:¶    image: redis:ZZ¶  app:¶    image: YY:latest¶    environment:¶      - DATABASE_URL=x¶"),
]

VIEWS: dict[str, str] = {
    "f_patterns": """
SELECT * FROM (VALUES ('click','click','interaction','simple',false), ('view','view','interaction','simple',false),
  ('purchase','purchase','commerce','advanced',false), ('signup','signup','commerce','intermediate',false),
  ('error','error','fault','intermediate',true), ('never_seen','never_seen','fault','advanced',true))
  AS t(pattern_id, name, category, complexity_level, is_antipattern)""",
    "f_occurrences": """
SELECT event_id AS occurrence_id, CAST(user_id % 20 AS VARCHAR(20)) AS repository_id, event_type AS pattern_id,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'src/f' || CAST(event_id % 97 AS VARCHAR(20)) || '.py' END AS file_path,
  least(value / 100, 1.0) AS confidence_score, ts AS detected_at,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'model' || CAST(event_id % 3 AS VARCHAR(20)) END AS ai_model_used,
  CAST(event_id % 500 AS BIGINT) AS processing_time_ms
FROM {events}""",
    # A wide pattern vocabulary: every part name is a pattern, every order line an occurrence.
    "f_name_patterns": """
SELECT DISTINCT p_name AS pattern_id,
  CASE WHEN p_name LIKE 's%' THEN 'auth_' || p_name WHEN p_name LIKE '%ring%' THEN 'cache_' || p_name
       WHEN p_name LIKE '%bolt%' THEN 'strategy_' || p_name WHEN p_name LIKE 'large%' THEN 'react_async_' || p_name
       WHEN p_name LIKE '%nut%' THEN 'hardcoded_' || p_name ELSE p_name END AS name,
  CASE WHEN p_name LIKE '%a%' THEN 'structure' ELSE 'behaviour' END AS category,
  CASE WHEN p_name LIKE 's%' THEN 'simple' WHEN p_name LIKE 'l%' THEN 'advanced' ELSE NULL END AS complexity_level,
  p_name LIKE '%gear%' AS is_antipattern
FROM {part}""",
    "f_name_occurrences": """
SELECT CAST(l_suppkey % 40 AS VARCHAR(20)) AS repository_id, p_name AS pattern_id,
  'src/f' || CAST(l_partkey % 211 AS VARCHAR(20)) || '.ts' AS file_path,
  1 - l_discount AS confidence_score, l_shipdate AS detected_at
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "f_repositories": """
SELECT CAST(c_custkey % 50 AS VARCHAR(20)) AS repository_id, 'https://github.com/org/repo' || CAST(c_custkey % 50 AS VARCHAR(20)) || '.git' AS url,
  'repo' || CAST(c_custkey % 50 AS VARCHAR(20)) AS name,
  CASE WHEN c_custkey % 50 < 30 THEN 'completed' WHEN c_custkey % 50 < 40 THEN 'pending' ELSE 'failed' END AS status,
  CASE c_custkey % 5 WHEN 0 THEN 'Python' WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'Java' WHEN 3 THEN 'Go' ELSE NULL END AS primary_language,
  CASE WHEN c_custkey % 50 % 3 = 0 THEN NULL WHEN c_custkey % 50 % 7 = 0 THEN false ELSE true END AS is_public,
  max(CASE WHEN c_custkey % 50 % 11 = 0 THEN NULL ELSE CAST(c_custkey AS BIGINT) END) AS analysis_count,
  count(DISTINCT c_nationkey) AS unique_users, count(*) AS stars
FROM {customer} GROUP BY c_custkey % 50, c_custkey % 5""",
    "f_repo_tags": """
SELECT DISTINCT CAST(c_custkey % 50 AS VARCHAR(20)) AS repository_id, lower(c_mktsegment) AS tag FROM {customer} WHERE c_nationkey % 4 = 0""",
    "f_user_repos": """
SELECT CAST(c_nationkey AS VARCHAR(20)) AS user_id, CAST(c_custkey % 50 AS VARCHAR(20)) AS repository_id,
  min(CASE WHEN c_acctbal < 0 THEN 'viewer' ELSE 'analyst' END) AS access_type, max(CAST(c_custkey AS BIGINT)) AS last_seq
FROM {customer} WHERE c_custkey % 3 = 0 GROUP BY c_nationkey, c_custkey % 50""",
    "f_commits": """
SELECT CAST(o_custkey % 50 AS VARCHAR(20)) AS repository_id, CAST(o_orderkey AS VARCHAR(20)) AS hash,
  c_name AS author_name, lower(c_name) || CASE WHEN c_nationkey % 3 = 0 THEN '@gmail.com' WHEN c_nationkey % 3 = 1 THEN '@corp.com' ELSE '@dev.io' END AS author_email,
  o_orderdate AS committed_date,
  CASE o_orderstatus WHEN 'F' THEN 'fix: ' WHEN 'O' THEN 'feat: ' ELSE 'Clean ' END || o_orderpriority AS message
FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey""",
    "f_file_changes": """
SELECT CAST(l_orderkey AS VARCHAR(20)) AS hash,
  CASE WHEN l_suppkey % 9 = 0 THEN 'api/' ELSE 'src/' END || CAST(l_suppkey AS VARCHAR(20)) || '/f' || CAST(l_partkey AS VARCHAR(20)) ||
    CASE l_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.java' ELSE '.txt' END AS file_path,
  CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'deleted' ELSE 'modified' END AS change_type,
  CAST(l_quantity AS BIGINT) AS additions, CAST(round(l_tax * 1000) AS BIGINT) AS deletions
FROM {lineitem}""",
    "f_files": """
SELECT source AS repository_id, 'd' || CAST(doc_id % 6 AS VARCHAR(20)) || '/doc' || CAST(doc_id AS VARCHAR(20)) || '.' || lang AS path, text AS content, lang AS language
FROM {documents}""",
    "f_code": f"""
SELECT source AS repository_id,
  {_case('doc_id', [s[0] for s in _SNIPPETS])} || '/' || {_case('doc_id', [s[1] for s in _SNIPPETS])} || CAST(doc_id AS VARCHAR(20)) || '.' || {_case('doc_id', [s[2] for s in _SNIPPETS])} AS path,
  text || chr(10) || replace({_case('doc_id', [s[4] for s in _SNIPPETS])}, '¶', chr(10)) AS content,
  {_case('doc_id', [s[3] for s in _SNIPPETS])} AS language
FROM {{documents}}""",
    "f_manifests": f"""
SELECT CAST(p_size AS VARCHAR(20)) AS repository_id, 'm' || CAST(p_partkey AS VARCHAR(20)) || '/' || {_case('p_partkey', [m[0] for m in _MANIFESTS])} AS path,
  replace(replace(replace({_case('p_partkey', [m[1] for m in _MANIFESTS])}, '¶', chr(10)), 'ZZ', CAST(p_size AS VARCHAR(20))), 'YY', replace(p_name, ' ', '-')) AS content
FROM {{part}}""",
    "f_technologies": """
SELECT CAST(p_size AS VARCHAR(20)) AS repository_id, p_name AS name,
  CASE p_type WHEN 'ECONOMY' THEN 'languages' WHEN 'STANDARD' THEN 'frameworks' WHEN 'PROMO' THEN 'libraries' WHEN 'SMALL' THEN 'tools' ELSE lower(p_type) END AS category,
  p_brand AS version, CAST(p_partkey % 9 AS BIGINT) AS usage_count
FROM {part}""",
    "f_results": """
SELECT CAST(l_orderkey % 100 AS VARCHAR(20)) AS session_id, 'model' || CAST(l_suppkey % 5 AS VARCHAR(20)) AS model_name, p_name AS detected_patterns_text,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 5 END AS complexity_score, 1 - l_discount AS confidence_score,
  l_quantity AS processing_time, CAST(l_partkey AS BIGINT) AS total_tokens, l_tax AS cost_estimate, l_shipdate AS created_at,
  CASE WHEN l_returnflag = 'R' THEN 'failed' END AS error_message
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "f_models": """
SELECT DISTINCT 'model' || CAST(s_suppkey % 6 AS VARCHAR(20)) AS model_name, s_suppkey % 6 % 2 = 0 AS is_available FROM {supplier} WHERE s_suppkey % 6 <> 4""",
    "f_request_log": """
SELECT event_id AS request_id, CAST(user_id AS VARCHAR(20)) AS user_id, '/' || event_type AS endpoint, ts, value AS duration_ms,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code
FROM {events}""",
    "f_health_metrics": """
SELECT event_id, event_type AS name, value, ts, CAST(75 AS DOUBLE) AS threshold_warning, CAST(90 AS DOUBLE) AS threshold_critical FROM {events}""",
    "f_snapshot_prev": """
SELECT repository_id, path, md5(content) AS content_hash FROM {f_files} WHERE path NOT LIKE '%7.%'""",
    "f_snapshot_cur": """
SELECT repository_id, path, md5(CASE WHEN path LIKE '%3.%' THEN content || '#' ELSE content END) AS content_hash FROM {f_files} WHERE path NOT LIKE '%1.%'""",
    "f_sessions": """
SELECT CAST(conv_id AS VARCHAR(20)) AS session_id, turn, CASE role WHEN 'user' THEN 'running' WHEN 'assistant' THEN 'completed' ELSE 'created' END AS status FROM {conversations}""",
    "f_analysis_sessions": """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS session_id, CAST(o_custkey % 50 AS VARCHAR(20)) AS repository_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS started_at,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL '90' MINUTE END AS completed_at
FROM {orders}""",
    "f_model_results": """
SELECT CAST(l_orderkey AS BIGINT) AS task_id, 'model' || CAST(l_suppkey % 5 AS VARCHAR(20)) AS model_id, 1 - l_discount AS confidence, l_quantity AS num_value, l_returnflag AS str_value
FROM {lineitem}""",
    # Stored analyses of five types, one per order.
    "f_analyses": """
SELECT CAST(o_orderkey AS BIGINT) AS analysis_id, CAST(o_custkey % 50 AS VARCHAR(20)) AS repository_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'performance' WHEN 2 THEN 'architectural' WHEN 3 THEN 'pattern' ELSE 'quality' END AS analysis_type,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'model' || CAST(o_custkey % 4 AS VARCHAR(20)) END AS model_used,
  o_totalprice / 5000 AS score, o_orderdate AS created_at
FROM {orders}""",
}

_REF = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def references(view: str) -> list[str]:
    """Tables and views that the body of ``view`` reads, in order of mention."""
    return list(dict.fromkeys(_REF.findall(VIEWS[view])))


def with_views(sql: str, views: list[str]) -> str:
    """Put the definitions of ``views`` (and what they read) in front of ``sql``."""
    ordered: list[str] = []

    def visit(view: str) -> None:
        for ref in references(view):
            if ref in VIEWS:
                visit(ref)
        if view not in ordered:
            ordered.append(view)

    for view in views:
        visit(view)
    if not ordered:
        return sql
    ctes = []
    for view in ordered:
        names = {ref: ref for ref in references(view)}
        ctes.append(f"{view} AS ({VIEWS[view].format(**names)})")
    body = sql.strip()
    head = "WITH " + ",\n".join(ctes)
    if body[:5].upper() == "WITH ":
        return head + ",\n" + body[5:]
    return head + "\n" + body


class Tables:
    """Lazy access to the base tables and bound views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._frames:
            if name in BASE:
                frame = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                if name in TEXT_KEYS:
                    frame = spread(frame, TEXT_KEYS[name])
            else:
                args = {ref: getattr(self, ref) for ref in references(name)}
                frame = self.spark.sql(VIEWS[name], **args) if args else self.spark.sql(VIEWS[name])
            self._frames[name] = frame
        return self._frames[name]

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"
